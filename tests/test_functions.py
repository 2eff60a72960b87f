"""Encoding, numbers, rings, shares, files."""

import random
from math import factorial

import pytest
from plain import grams, symbols
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from linkspark.functions import encode as E
from linkspark.functions import numeric as N
from linkspark.functions import ring as R
from linkspark.operators import shares as S
from linkspark.sources import generators, matrices, records

TEXTS = ["", "a", "é", "banana", "Anna Meier", "İstanbul", "漢字 x", "😀!", "a-b.c?", "  "]


def test_encoding_matches_the_scalar_form(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    bits = F.array(*E.bitmap(E.bigram_ids(E.bigram_set(F.col("t")))))
    for r in df.select("t", E.canonical(F.col("t")).alias("c"), E.bigram_count(F.col("t")).alias("n"), E.bigram_set(F.col("t")).alias("s"), bits.alias("b")).collect():
        assert r.c == symbols(r.t) and r.n == len(grams(r.t)) and set(r.s) == set(grams(r.t))
        assert sum(int(w).bit_count() for w in r.b) == len(set(grams(r.t)))
    got = {r.t: (r.n, len(r.s)) for r in df.select("t", E.bigram_count(F.col("t")).alias("n"), E.bigram_set(F.col("t")).alias("s")).collect()}
    assert got["banana"] == (7, 5) and got["a"] == (2, 2) and got["é"][0] == 3


def test_unknown_letter_is_an_error(spark):
    df = spark.createDataFrame([("A",), ("X",)], "t string")
    rows = [r[0] for r in df.select(E.one_hot(F.col("t"))).collect()]
    assert sum(rows[0]) == 1 and rows[1] == [0.05] * 20
    with pytest.raises(PySparkException):
        spark.createDataFrame([("?",)], "t string").select(E.one_hot(F.col("t"))).collect()


def test_ring_arithmetic(spark):
    r = random.Random(1)
    signed = lambda v: (v & (1 << 64) - 1) - (1 << 64 if v >> 63 & 1 else 0)
    pairs = [(r.getrandbits(64) - (1 << 63), r.getrandbits(64) - (1 << 63)) for _ in range(50)] + [(-(1 << 63), -1), ((1 << 63) - 1, 1), (0, 0)]
    df = spark.createDataFrame(pairs, "a long, b long")
    a, b = F.col("a"), F.col("b")
    for x in df.select("a", "b", R.add(a, b).alias("s"), R.subtract(a, b).alias("d"), R.multiply(a, b).alias("p"), R.inverse(a).alias("i"), R.negate(a).alias("n")).collect():
        assert (x.s, x.d, x.p, x.n) == (signed(x.a + x.b), signed(x.a - x.b), signed(x.a * x.b), signed(-x.a))
        assert x.i is None if x.a % 2 == 0 else x.i * x.a % (1 << 64) == 1
    one, two = S.split(df.withColumn("k", F.monotonically_increasing_id()), "a", "k")
    assert sorted(v.value for v in S.reconstruct(one, two, "k").collect()) == sorted(p[0] for p in pairs)


def test_numbers(spark):
    df = spark.createDataFrame([(x, float(x) / 3) for x in range(-10, 11)], "n long, v double")
    for r in df.select("n", "v", N.to_fixed(F.col("v")).alias("f"), N.truncate(F.col("n"), 1).alias("t"), N.inverse_mod(F.col("n"), F.lit(9).cast("long")).alias("i"), N.pack_bits(N.unpack_bits(F.col("n"), 64)).alias("b")).collect():
        assert r.f == int(r.v * 256) and r.t == r.n >> 1 and r.b == r.n
        assert r.i is None if r.n % 3 == 0 else r.i * r.n % 9 == 1
    big = 2**61 - 2
    assert spark.range(1).select(N.product_mod(F.lit(big), F.lit(big - 5), F.lit(2**61 - 1))).first()[0] == big * (big - 5) % (2**61 - 1)
    got = [r[0] for r in spark.range(21).select(N.factorial(F.col("id"))).collect()]
    assert got == [0, *(factorial(n) for n in range(1, 21))]


def test_products_of_large_keys(spark, tmp_path):
    from linkspark.queries import mult_mod

    m, keys = 2**61 - 1, [(0, 0), (2**23 - 1, 7), (2**23, 7), (9_000_000, 15_000), (2**62, 2**62), (2**63 - 1, 2**63 - 1), (-5, 3), (None, 1)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.v for r in mult_mod(spark, str(tmp_path)).collect()}
    product = lambda k, c: (k * 1099511627791 + 5) * (c + 1000003)
    assert got == {k: None if k is None else abs(p := product(k, c)) % m * (1 if p >= 0 else -1) for k, c in keys}


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2.5,3\n4,5,6\n")
    (tmp_path / "v.csv").write_text("1,2,3,0.5\n9,9\n")
    (tmp_path / "s.csv").write_text("1,2,20,0,3\n5,6\n0,1\n")
    m = matrices.read_matrix(spark, str(tmp_path / "m.csv"))
    assert sorted(map(tuple, m.collect())) == [(0, 0, 1.0), (0, 1, 2.5), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0), (1, 2, 6.0)]
    assert sorted(map(tuple, matrices.read_vector(spark, str(tmp_path / "v.csv"), 2).collect())) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    assert [matrices.recover_sequence(spark, str(tmp_path / "s.csv"), k).first()[0] for k in range(3)] == ["ARV", "", ""]
    (tmp_path / "r.csv").write_text("city,extra,rec-id,first-name,surname,birth-name,birth-day,birth-month,birth-year,postcode\nBerlin,x,7, Anna ,NA,,01,2,1980,10115\n")
    row = records.read_records(spark, str(tmp_path / "r.csv"), empty="NA").first()
    assert (row.rec_id, row.first_name.strip(), row.surname, row.birth_name, row.birth_day) == ("7", "Anna", "", "", "01")
    (tmp_path / "bad.csv").write_text("city\nx\n")
    with pytest.raises(ValueError):
        records.read_records(spark, str(tmp_path / "bad.csv"))


def test_row_positions_and_generators(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    assert all(r.k == r.idx for r in records.row_index(df, "k").collect())
    g = generators.random_vector(spark, 500, -2.0, 3.0)
    lo, hi, n = g.agg(F.min("v"), F.max("v"), F.count("*")).first()
    assert -2 <= lo < hi < 3 and n == 500
    assert g.collect() == generators.random_vector(spark, 500, -2.0, 3.0).collect()
