"""Random vectors and matrices; the same seed gives the same numbers, in any engine
that has MD5, and however rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 13  # hexadecimal ones of a hash, 52 bits: what a double holds


def uniform(seed: int, position: Column) -> Column:
    """From 0 to 1: the first digits of the MD5 of "seed-position"."""
    h = F.md5(F.concat(F.lit(f"{seed}-"), position.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("double") / float(1 << 4 * DIGITS)


def random_vector(spark: SparkSession, size: int, low: float = 0.0, high: float = 10.0, signed: bool = False, seed: int = 1) -> DataFrame:
    """(i, v): uniform from low to high, with a random sign if ``signed``."""
    v = uniform(seed, F.col("id")) * (high - low) + low
    if signed:
        v = F.when(uniform(seed + 1, F.col("id")) < 0.5, -v).otherwise(v)
    return spark.range(size).select(F.col("id").alias("i"), v.alias("v"))


def random_matrices(spark: SparkSession, n: int, rows: int, columns: int, **how) -> DataFrame:
    """(m, r, c, v) of n matrices."""
    flat = random_vector(spark, n * rows * columns, **how)
    cell = F.col("i") % (rows * columns)
    return flat.select(F.floor(F.col("i") / (rows * columns)).alias("m"), F.floor(cell / columns).alias("r"), (cell % columns).alias("c"), "v")
