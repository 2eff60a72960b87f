"""Vectors as array columns, or as rows (i, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zip_op(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def partial_sums(rows: DataFrame, d: int) -> DataFrame:
    """Sums of consecutive runs of d: (part, total)."""
    return rows.groupBy(F.floor(F.col("i") / d).alias("part")).agg(F.sum("v").alias("total"))


def to_text(a: Column) -> Column:
    """[a,b,c]"""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def sum_vectors(rows: DataFrame, vector: str, *key: str) -> DataFrame:
    """(key, i, v): the elementwise sum of array columns, per ``key``. Elements are
    summed where they are read; only sums are shuffled."""
    cells = rows.select(*key, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    return cells.groupBy(*key, F.col("i").cast("long").alias("i")).agg(F.sum("x").alias("v"))


def compare_all(x: DataFrame, y: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """(i, j, ge): whether x_i >= y_j, for all pairs, as many rows as that. y is the
    smaller side, broadcast if it is counted to be small."""
    a, b = x.select("i", F.col("v").alias("xv")), y.select(F.col("i").alias("j"), F.col("v").alias("yv"))
    if b.limit(broadcast_rows + 1).count() <= broadcast_rows:
        b = F.broadcast(b)
    return a.crossJoin(b).select("i", "j", (F.col("xv") >= F.col("yv")).cast("long").alias("ge"))
