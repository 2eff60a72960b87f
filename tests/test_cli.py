"""The command line on two small files."""

import pytest
from pyspark.sql import functions as F

from linkspark import cli
from linkspark.sources import records

HEAD = "rec-id,first-name,surname,birth-name,city,birth-day,birth-month,birth-year,postcode\n"


def test_cli_links_two_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text(HEAD + "a,anna,meier,,berlin,1,2,1980,10115\nb,john,smith,,paris,3,4,1955,75001\n")
    (tmp_path / "y.csv").write_text(HEAD + "c,kim,lee,,seoul,9,9,1999,4524\nd,anna,maier,,berlin,1,2,1980,10115\n")
    for extra in ([], ["--no-prune"]):
        out = str(tmp_path / ("out" + "".join(extra)))
        cli.main([str(tmp_path / "x.csv"), str(tmp_path / "y.csv"), out, *extra])
        rows = {r.rec_id: (r.is_match, r.match_idx, r.num) for r in spark.read.option("header", True).csv(out).collect()}
        assert rows == {"a": ("1", "1", "68360"), "b": ("0", "0", None)}


def test_cli_keeps_the_order_of_large_files(spark, tmp_path, capsys):
    n = 100_000
    letters = str.maketrans("0123456789", "bcdfglmprt")
    names = [f"{k * 7919 % n:05d}".translate(letters) for k in range(n)]  # not in the order of the file
    for side, shift in (("x", 0), ("y", 1)):
        lines = [f"{name},anna{name},meier,,town{name},1,2,1980,{name}\n" for name in names]
        lines = lines[shift:] + lines[:shift]
        (tmp_path / f"{side}.csv").write_text(HEAD + "".join(lines[:n if side == "x" else 400]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        x = records.read_records(spark, str(tmp_path / "x.csv"), position="idx").select("rec_id", "idx").collect()
        assert sorted((r.idx, r.rec_id) for r in x) == list(enumerate(names))
        with pytest.warns(UserWarning, match="400 records"):
            cli.main([str(tmp_path / "x.csv"), str(tmp_path / "y.csv"), str(tmp_path / "out"), "--count", "1000", "500"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted(int(r.x_idx) for r in rows) == list(range(1000)) and "total linking time" in capsys.readouterr().out
    got = {int(r.x_idx): int(r.match_idx) for r in rows if r.is_match == "1"}
    right = sum(got.get(k + 1) == k for k in range(400))
    assert right >= 390  # letters that repeat lower a score; a few records are no match of themselves


def test_row_index_of_wide_rows(spark):
    n = 200_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), 300).alias("wide"), F.lit(1).alias("part"), F.lit(2).alias("nth"))
    got = records.row_index(df, "k")
    assert got.columns == ["k", "wide", "part", "nth", "idx"]
    row = got.agg(F.count("*"), F.sum((F.col("k") == F.col("idx")).cast("int")), F.count_distinct("idx")).first()
    assert tuple(row) == (n, n, n)
