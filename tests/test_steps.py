from headwater.functions import steps


def test_f16_f17_large_steps_are_not_collected(spark, monkeypatch):
    """A table of many rows in few bytes is merged, one of few rows may be broadcast."""
    plan = lambda: steps.saved(spark.range(50)).join(steps.saved(spark.range(50)), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(steps, "WIDE", 20)
    assert "SortMergeJoin" in plan() and "Broadcast" not in plan()
