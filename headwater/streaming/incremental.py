"""Sites that arrive as a stream: each micro-batch adds the catchments not yet in the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from headwater.operators.sites import catchments
from headwater.sources.dataset import Dataset


def keep_catchments(arriving: DataFrame, pairs: DataFrame, dataset: Dataset, checkpoint: str, layer: str = "Catchment_poly", once: bool = True) -> StreamingQuery:
    """Append to ``layer`` the catchments (link_id, origin) of the links of a stream (link_id).

    A batch that is run again finds its links cached and adds nothing, so a
    restart after a failure leaves the same rows.
    """
    def add(batch: DataFrame, number: int) -> None:
        cached = dataset.table(layer)
        _, new = catchments(pairs, batch.select("link_id").distinct(), cached)
        dataset.write(layer, new, "Vector", mode="append")

    writer = arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
