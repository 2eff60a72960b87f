"""Record files and row positions."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize

#: Columns of a record file, as its header names them (fixed values).
RECORD_COLUMNS = ("rec-id", "first-name", "surname", "birth-name", "city", "birth-day", "birth-month", "birth-year", "postcode")


def read_records(spark: SparkSession, path: str, empty: str = "", count: int | None = None, position: str | None = None) -> DataFrame:
    """A CSV file with a header: the nine columns as text, others ignored, in any
    order. The ``empty`` token reads as the empty text. No trimming, no guessing.
    Column names come out with underscores.

    position: a column with each record's place in the file from 0 (in a folder, its
    files by name). count: the first so many records; a warning says if there are fewer.
    """
    head = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    missing = [c for c in RECORD_COLUMNS if c not in head]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    cell = lambda c: F.when(F.col(f"`{c}`") == empty, "").otherwise(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    cells = [cell(c).alias(c.replace("-", "_")) for c in RECORD_COLUMNS]
    if position is None and count is None:
        return rows.select(*cells)
    # a block of a file is read by one task, from its beginning to its end
    block = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    name = position or "position"
    placed = _placed(materialize(rows.select(*cells, block.alias("part"), F.monotonically_increasing_id().alias("nth")), "records"), name)
    if count is not None:
        placed = placed.where(F.col(name) < count)
        found = placed.count()
        if found < count:
            warnings.warn(f"{path} has {found} records, {count} were asked for", stacklevel=2)
    return placed if position else placed.drop(name)


def _placed(at: DataFrame, name: str) -> DataFrame:
    """Rows with ``part`` and, rising within it, ``nth``: numbered through all parts."""
    sizes = at.groupBy("part").agg(F.count("*").alias("n"), F.min("nth").alias("low"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per part
    first = F.broadcast(sizes.select("part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift")))
    return at.join(first, "part").withColumn(name, F.col("nth") + F.col("shift")).drop("part", "nth", "shift")


def row_index(rows: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Adds the position from 0 in the order of ``order``, without one task that
    sees all rows.

    Rows are dealt by range and numbered within their part; what was numbered is
    written once, and parts are counted from that, so counts and rows are of one
    evaluation. Equal rows get different positions, in any order.
    """
    kept = [f"c{k}" for k in range(len(rows.columns))]  # whatever the names are
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).toDF(*kept)
    at = materialize(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")), "index")
    return _placed(at, "place").toDF(*rows.columns, name)


def scan_limit(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order; fewer if there are fewer."""
    return rows.orderBy(*order).limit(n)


def slice_rows(rows: DataFrame, start: int, n: int, idx: str = "idx") -> DataFrame:
    return rows.where(F.col(idx).between(start, start + n - 1))


def repeat_rows(rows: DataFrame, k: int, name: str = "copy") -> DataFrame:
    """Each row k times, numbered from 0."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name))
