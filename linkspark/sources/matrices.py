"""Text files of numbers: matrices, vectors, coded sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import VALID_LETTERS


def read_matrix(spark: SparkSession, path: str, n_rows: int | None = None, n_columns: int | None = None) -> DataFrame:
    """(r, c, v) of a file with rows apart by white space and numbers by commas.

    One file is one matrix, as its row numbers are positions: it is read whole,
    so this is for matrices, not for tables.
    """
    rows = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("rows"))
    cells = rows.select(F.posexplode("rows").alias("r", "row")).select("r", F.posexplode(F.split("row", ",")).alias("c", "v")).where("v <> ''")
    out = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("v").cast("float").cast("double").alias("v"))
    if n_rows is not None:
        out = out.where(F.col("r") < n_rows)
    return out if n_columns is None else out.where(F.col("c") < n_columns)


def read_vector(spark: SparkSession, path: str, n: int | None = None, bias: bool = True) -> DataFrame:
    """(i, v) of a file's first line; with ``bias`` one more number than n is taken."""
    line = spark.read.text(path, wholetext=True).select(F.split("value", "\n").getItem(0).alias("line"))
    cells = line.select(F.posexplode(F.split("line", ",")).alias("i", "v")).where("trim(v) <> ''")
    out = cells.select(F.col("i").cast("long").alias("i"), F.trim("v").cast("float").cast("double").alias("v"))
    return out if n is None else out.where(F.col("i") < n + int(bias))


def decode_sequence(line):
    """Letters of comma-separated numbers from 1, up to the first below 1; none without such a number."""
    codes = F.transform(F.split(line, ","), lambda x: F.trim(x).cast("int"))
    stop = F.array_position(F.transform(codes, lambda c: c < 1), True)
    letters = F.transform(F.slice(codes, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")), lambda c: F.substr(F.lit(VALID_LETTERS), c, F.lit(1)))
    return F.array_join(letters, "")


def recover_sequence(spark: SparkSession, path: str, index: int) -> DataFrame:
    """One row: the sequence in the file's line ``index`` (from 0)."""
    line = spark.read.text(path, wholetext=True).select(F.get(F.split("value", "\n"), F.lit(index)).alias("line"))
    return line.select(decode_sequence(F.col("line")).alias("sequence"))
