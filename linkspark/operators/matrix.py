"""Matrices as cells (r, c, v), batches of them as (m, r, c, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame, *batch: str) -> DataFrame:
    """a times b, per value of the ``batch`` columns. Products are summed before
    they are shuffled."""
    left = a.select(*batch, F.col("r"), F.col("c").alias("k"), F.col("v").alias("va"))
    right = b.select(*batch, F.col("r").alias("k"), F.col("c"), F.col("v").alias("vb"))
    return left.join(right, [*batch, "k"]).groupBy(*batch, "r", "c").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def matvec(a: DataFrame, x: DataFrame, *batch: str) -> DataFrame:
    """a times the vector x (i, v)."""
    right = x.select(*batch, F.col("i").alias("c"), F.col("v").alias("vx"))
    return a.join(right, [*batch, "c"]).groupBy(*batch, "r").agg(F.sum(F.col("v") * F.col("vx")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(*(c for c in a.columns if c not in ("r", "c", "v")), F.col("c").alias("r"), F.col("r").alias("c"), "v")


def gram(a: DataFrame) -> DataFrame:
    """a times its transpose."""
    return matmul(a, transpose(a))


def sum_matrices(batch: DataFrame) -> DataFrame:
    """The elementwise sum over m."""
    return batch.groupBy("r", "c").agg(F.sum("v").alias("v"))


def flatten(a: DataFrame, columns: int) -> DataFrame:
    """(i, v) row by row."""
    return a.select((F.col("r") * columns + F.col("c")).alias("i"), "v")


def reshape(flat: DataFrame, columns: int) -> DataFrame:
    """(r, c, v) of a flat vector (i, v)."""
    return flat.select(F.floor(F.col("i") / columns).alias("r"), F.pmod("i", F.lit(columns)).alias("c"), "v")


def tiles(a: DataFrame, rows: int, columns: int) -> DataFrame:
    """Adds the window of rows x columns cells that each cell lies in."""
    return a.select("*", F.floor(F.col("r") / rows).alias("tile_r"), F.floor(F.col("c") / columns).alias("tile_c"))
