"""Additive and XOR shares as tables: (id, s1, s2) columns or one table a party."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ring


def split(rows: DataFrame, value: str, *key: str, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A table (key, share) for each of two parties; either alone looks random."""
    a, b = ring.share(F.col(value), *map(F.col, key), seed=seed)
    return rows.select(*key, a.alias("share")), rows.select(*key, b.alias("share"))


def reconstruct(one: DataFrame, two: DataFrame, *key: str, bits: int = 64) -> DataFrame:
    """The shared values modulo 2^bits."""
    both = one.withColumnRenamed("share", "s1").join(two.withColumnRenamed("share", "s2"), list(key))
    return both.select(*key, ring.narrow(ring.add(F.col("s1"), F.col("s2")), bits).alias("value"))


def split_xor(rows: DataFrame, value: str, *key: str, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The same with shares whose XOR is the value."""
    a, b = ring.xor_share(F.col(value), *map(F.col, key), seed=seed)
    return rows.select(*key, a.alias("share")), rows.select(*key, b.alias("share"))


def reconstruct_xor(one: DataFrame, two: DataFrame, *key: str, bits: int = 64) -> DataFrame:
    """The values of XOR shares, of which the lowest ``bits`` count."""
    both = one.withColumnRenamed("share", "s1").join(two.withColumnRenamed("share", "s2"), list(key))
    return both.select(*key, ring.narrow(F.col("s1").bitwiseXOR(F.col("s2")), bits).alias("value"))
