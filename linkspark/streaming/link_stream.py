"""Linkage of records that arrive, against a table that stays.

Each micro-batch is linked as a whole: all counterparts of a record are at hand
in its batch, so no state and no watermark is needed. A batch is written under
its number, so a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.link import encode, link_all
from ..spec import LinkageSpec


def link_stream(incoming: DataFrame, y: DataFrame, spec: LinkageSpec, out: str, checkpoint: str, idx: str = "idx", prune: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Starts the query. incoming: a stream of records; y: encoded records."""

    def batch(rows: DataFrame, number: int) -> None:
        linked = link_all(encode(rows, spec, idx), y, spec, prune)
        linked.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
