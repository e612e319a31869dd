import importlib.util
import sys

import __spark_entry__ as entry


def test_names_and_sql():
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 120


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_parts(monkeypatch):
    """With the training-data subpackage gone, everything else is still registered."""
    for name in [m for m in sys.modules if m.startswith("headwater.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    find = importlib.util.find_spec

    class Hidden:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name in ("headwater.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(sys, "meta_path", [Hidden, *sys.meta_path])
    import headwater

    monkeypatch.delattr(headwater, "llm", raising=False)
    assert find is not None
    known = entry.queries()
    assert "NET1_downstream_closure" in known and not any(n.startswith("op") for n in known)


def test_names_need_no_session():
    """The driver may read the registry before a session exists."""
    import subprocess
    from pathlib import Path

    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-500:]
