"""The registered queries of the engine, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import elementwise as W
from .functions import encode as E
from .functions import numeric as N
from .functions import ring as R
from .functions.score import common_bits, dice, exact, ratio
from .operators import link as L
from .operators import matrix as M
from .operators import shares as S
from .operators import vector as V
from .sources import generators as G
from .sources import matrices as X
from .sources import records as T
from .spec import PEOPLE
from .storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the records that linkage queries compare -------------------------------------------------


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person-like records from the first words of documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    # only the first four words take part in the join
    words = F.slice(F.split(F.regexp_replace("text", r"^[ \t\r\n]+", ""), r"[ \t\r\n]+", 5), 1, 4)
    w = docs.select("doc_id", "source", "lang", "n_chars", words.alias("t")).join(labels, "doc_id", "left")
    part = lambda k: F.coalesce(F.get("t", F.lit(k)), F.lit(""))
    return w.select(
        F.col("doc_id").alias("rec_id"),
        part(0).alias("first_name"),
        part(1).alias("surname"),
        part(2).alias("birth_name"),
        part(3).alias("city"),
        F.coalesce("source", F.lit("")).alias("postcode"),
        F.coalesce("lang", F.lit("")).alias("birth_day"),
        F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("birth_month"),
        F.floor(F.col("n_chars") / 100.0).cast("string").alias("birth_year"),
        F.floor(F.col("doc_id") / 2).alias("idx"),
    )


def people_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Encoded records with even and with odd rec_id."""
    rows = people(spark, sf_dir)
    return tuple(L.encode(rows.where(F.col("rec_id") % 2 == k), PEOPLE) for k in (0, 1))


PEOPLE_SQL = r"""
w AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality,
    string_split_regex(regexp_replace(d.text, '^[ \t\r\n]+', ''), '[ \t\r\n]+') AS t
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
people AS (
  SELECT CAST(doc_id AS BIGINT) AS rec_id, coalesce(t[1], '') AS first_name, coalesce(t[2], '') AS surname,
    coalesce(t[3], '') AS birth_name, coalesce(t[4], '') AS city, coalesce(source, '') AS postcode,
    coalesce(lang, '') AS birth_day, coalesce(CAST(quality AS VARCHAR), '') AS birth_month,
    coalesce(CAST(CAST(floor(n_chars / 100.0) AS BIGINT) AS VARCHAR), '') AS birth_year, doc_id // 2 AS idx
  FROM w)"""


def canon_sql(x: str) -> str:
    for chars, marks in ((r"[\x{80}-\x{7FF}]", "??"), (r"[\x{800}-\x{FFFF}]", "???"), (r"[\x{10000}-\x{10FFFF}]", "????")):
        x = f"regexp_replace({x}, '{chars}', '{marks}', 'g')"
    return f"regexp_replace(lower({x}), '[^a-z .-]', '?', 'g')"


def grams_sql(padded: str) -> str:
    return f"list_transform(range(1, length({padded})), lambda i: substr({padded}, i, 2))"


NAME_SQL = "first_name || ' ' || surname || ' ' || birth_name"
SHARE_SQL = "CAST((first_name <> '') AS INT) + CAST((surname <> '') AS INT) + CAST((birth_name <> '') AS INT)"
ENCODED_SQL = f"""{PEOPLE_SQL},
padded AS (
  SELECT *, ' ' || {canon_sql(NAME_SQL)} || ' ' AS np, ' ' || {canon_sql("city")} || ' ' AS cp,
    CAST(floor(({SHARE_SQL}) / 3.0 * 256) AS BIGINT) AS nh, CASE WHEN city <> '' THEN 256 ELSE 0 END AS ch
  FROM people),
enc AS (
  SELECT *, list_distinct({grams_sql("np")}) AS nb, list_distinct({grams_sql("cp")}) AS cb,
    length(np) - 1 AS nl, length(cp) - 1 AS cl,
    nullif(postcode, '') AS e1, nullif(birth_day, '') AS e2, nullif(birth_month, '') AS e3, nullif(birth_year, '') AS e4
  FROM padded),
x AS (SELECT * FROM enc WHERE rec_id % 2 = 0), y AS (SELECT * FROM enc WHERE rec_id % 2 = 1)"""


def pair_sql(join: str) -> str:
    """num and den of pairs; weights 3368, 1392, 1400, 921, 919, 901 in 256ths."""
    weights = (1400, 921, 919, 901)
    num = " + ".join(f"CASE WHEN x.e{k} = y.e{k} THEN {w} ELSE 0 END" for k, w in enumerate(weights, 1))
    den = " + ".join(f"CASE WHEN x.e{k} IS NOT NULL AND y.e{k} IS NOT NULL THEN {w} ELSE 0 END" for k, w in enumerate(weights, 1))
    return f"""
scores AS (
  SELECT x.idx AS x_idx, y.idx AS y_idx, x.rec_id AS x_rec,
    CAST(((2 * len(list_intersect(x.nb, y.nb)) * least(x.nh, y.nh) * 3368) >> 8)
      + ((2 * len(list_intersect(x.cb, y.cb)) * least(x.ch, y.ch) * 1392) >> 8) + {num} AS BIGINT) AS num,
    CAST((((x.nl + y.nl) * least(x.nh, y.nh) * 3368) >> 8)
      + (((x.cl + y.cl) * least(x.ch, y.ch) * 1392) >> 8) + {den} AS BIGINT) AS den
  FROM x {join})"""


CROSS_SQL = "WITH " + ENCODED_SQL + "," + pair_sql("CROSS JOIN y")
ZIP_SQL = "WITH " + ENCODED_SQL + "," + pair_sql("JOIN y ON x.idx = y.idx")
BEST_SQL = """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY x_idx ORDER BY CASE WHEN den > 0 THEN CAST(num AS DOUBLE) / den ELSE -1 END DESC, y_idx) AS r
  FROM scores),
best AS (SELECT * FROM ranked WHERE r = 1)"""
HIT = "den > 0 AND num > ((den * 204) >> 8)"


# --- linkage ------------------------------------------------------------------------------------


@query(CROSS_SQL + BEST_SQL + f"""
SELECT x.idx AS x_idx, x.rec_id, CAST(coalesce({HIT}, false) AS INT) AS is_match,
  CASE WHEN {HIT} THEN y_idx ELSE 0 END AS match_idx, CASE WHEN {HIT} THEN y_idx END AS match_idx_or_null,
  CASE WHEN {HIT} THEN num END AS num, CASE WHEN {HIT} THEN den END AS den,
  CASE WHEN {HIT} THEN CAST(num AS DOUBLE) / den END AS score
FROM x LEFT JOIN best ON x.idx = best.x_idx""")
def link_all(spark, d):
    """The flagship: for every x the best y above the threshold (pruned plan)."""
    return L.link_all(*people_sides(spark, d), PEOPLE)


@query(ORACLE_SQL["link_all"])
def link_all_plain(spark, d):
    """The same without pruning."""
    return L.link_all(*people_sides(spark, d), PEOPLE, prune=False)


@query(ORACLE_SQL["link_all"])
def link_all_prefixes(spark, d):
    """The same with records that meet under keys, as for two large tables."""
    from .plans.prune import candidate_scores

    x, y = people_sides(spark, d)
    scores = candidate_scores(x, y, PEOPLE, broadcast_rows=0, best_only=True)
    found = L.threshold_flag(L.argmax_group(scores), PEOPLE).where("is_match = 1")
    return L.all_flags(x, found, PEOPLE)


@query(CROSS_SQL + BEST_SQL + f"""
SELECT x_idx, y_idx, num, den, CASE WHEN den > 0 THEN CAST(num AS DOUBLE) / den END AS score, CAST({HIT} AS INT) AS is_match FROM best""")
def link_scores(spark, d):
    return L.link_scores(*people_sides(spark, d), PEOPLE)


@query(CROSS_SQL + "SELECT x_idx, y_idx, num, den FROM scores")
def pair_cross(spark, d):
    return L.pair_cross(*people_sides(spark, d), PEOPLE)


@query(ZIP_SQL + "SELECT x_idx, y_idx, num, den FROM scores")
def score_zip(spark, d):
    return L.score_zip(*people_sides(spark, d), PEOPLE)


def _zipped(spark, d):
    a, b = L.sides(*people_sides(spark, d))
    return a.join(b, F.col("x_idx") == F.col("y_idx"))


@query("WITH " + ENCODED_SQL + """
SELECT x.idx AS x_idx, CASE WHEN x.e1 = y.e1 THEN 256 ELSE 0 END AS num,
  CASE WHEN x.e1 IS NOT NULL AND y.e1 IS NOT NULL THEN 256 ELSE 0 END AS den FROM x JOIN y ON x.idx = y.idx""")
def exact_score(spark, d):
    num, den = exact(F.col("x_postcode"), F.col("y_postcode"), PEOPLE.unit)
    return _zipped(spark, d).select("x_idx", num.alias("num"), den.alias("den"))


def _common(f: str):
    return common_bits(*([F.col(f"{p}_{f}_{k}") for k in range(E.N_WORDS)] for p in "xy"))


@query("WITH " + ENCODED_SQL + """
SELECT x.idx AS x_idx, CAST(2 * len(list_intersect(x.nb, y.nb)) * least(x.nh, y.nh) AS BIGINT) AS num,
  CAST((x.nl + y.nl) * least(x.nh, y.nh) AS BIGINT) AS den FROM x JOIN y ON x.idx = y.idx""")
def dice_score(spark, d):
    num, den = dice(_common("name"), F.col("x_name_len"), F.col("y_name_len"), F.col("x_name_has"), F.col("y_name_has"))
    return _zipped(spark, d).select("x_idx", num.alias("num"), den.alias("den"))


@query("WITH " + ENCODED_SQL + """
SELECT x.idx AS x_idx, CAST(len(list_intersect(x.nb, y.nb)) AS BIGINT) AS n_name,
  CAST(len(list_intersect(x.cb, y.cb)) AS BIGINT) AS n_city FROM x JOIN y ON x.idx = y.idx""")
def bigram_common(spark, d):
    return _zipped(spark, d).select("x_idx", _common("name").cast("long").alias("n_name"), _common("city").cast("long").alias("n_city"))


@query(ZIP_SQL + """
SELECT a.x_idx, CAST(CAST(a.num AS HUGEINT) * b.den > CAST(b.num AS HUGEINT) * a.den AS INT) AS first_wins
FROM scores a JOIN scores b ON b.x_idx = a.x_idx + 1 WHERE a.den > 0 AND b.den > 0""")
def compare_ratio(spark, d):
    """Two scores compared as num / den; the exact ratios are far enough apart for doubles."""
    s = score_zip(spark, d).where("den > 0")
    b = s.select((F.col("x_idx") - 1).alias("x_idx"), F.col("num").alias("n2"), F.col("den").alias("d2"))
    return s.join(b, "x_idx").select("x_idx", (ratio(F.col("num"), F.col("den")) > ratio(F.col("n2"), F.col("d2"))).cast("int").alias("first_wins"))


@query(CROSS_SQL + BEST_SQL + "SELECT x_idx, y_idx, num, den FROM best")
def argmax_group(spark, d):
    return L.best_pairs(*people_sides(spark, d), PEOPLE)


@query(ZIP_SQL + f"""
SELECT x_idx, CAST({HIT} AS INT) AS is_match, CASE WHEN {HIT} THEN y_idx ELSE 0 END AS match_idx,
  CASE WHEN {HIT} THEN y_idx END AS match_idx_or_null, CASE WHEN {HIT} THEN num END AS num, CASE WHEN {HIT} THEN den END AS den FROM scores""")
def threshold_flag(spark, d):
    return L.threshold_flag(score_zip(spark, d), PEOPLE)


@query("WITH " + ENCODED_SQL + "SELECT x.idx AS x_idx, CAST(least(x.nh, y.nh) AS BIGINT) AS has FROM x JOIN y ON x.idx = y.idx")
def least_pair(spark, d):
    return _zipped(spark, d).select("x_idx", F.least("x_name_has", "y_name_has").alias("has"))


# --- encoding -------------------------------------------------------------------------------------


@query(f"WITH {PEOPLE_SQL} SELECT rec_id, {canon_sql('first_name')} AS canon FROM people")
def char_class(spark, d):
    return people(spark, d).select("rec_id", E.canonical(F.col("first_name")).alias("canon"))


_ALPHA = E.ALPHABET
_ID_SQL = f"30 * (instr('{_ALPHA}', substr(g, 1, 1)) - 1) + instr('{_ALPHA}', substr(g, 2, 1)) - 1"


@query(f"""WITH {PEOPLE_SQL}, p AS (SELECT rec_id, ' ' || {canon_sql('city')} || ' ' AS p FROM people),
b AS (SELECT rec_id, unnest(list_distinct({grams_sql('p')})) AS g FROM p)
SELECT rec_id, g AS bigram, CAST({_ID_SQL} AS BIGINT) AS bigram_id FROM b""")
def bigram_id(spark, d):
    rows = people(spark, d).select("rec_id", F.explode(E.bigram_set(F.col("city"))).alias("bigram"))
    return rows.select("rec_id", "bigram", E.bigram_id(F.col("bigram")).alias("bigram_id"))


@query("WITH " + ENCODED_SQL + """
SELECT rec_id, CAST(nl AS BIGINT) AS n_bigrams, CAST(len(nb) AS BIGINT) AS n_distinct, list_aggregate(list_sort(nb), 'string_agg', '|') AS bigrams FROM enc""")
def bigram_encode(spark, d):
    text = E.combine(F.col("first_name"), F.col("surname"), F.col("birth_name"))
    grams = E.bigram_set(text)
    return people(spark, d).select("rec_id", E.bigram_count(text).alias("n_bigrams"), F.size(grams).cast("long").alias("n_distinct"), F.array_join(F.array_sort(grams), "|").alias("bigrams"))


@query(f"""WITH {PEOPLE_SQL}, p AS (SELECT rec_id, ' ' || {canon_sql('city')} || ' ' AS p FROM people),
b AS (SELECT rec_id, unnest(list_distinct({grams_sql('p')})) AS g FROM p),
i AS (SELECT rec_id, CAST({_ID_SQL} AS BIGINT) AS id FROM b)
SELECT rec_id, id // 60 AS word, CAST(sum(CAST(1 AS BIGINT) << (id % 60)) AS BIGINT) AS bits FROM i GROUP BY ALL""")
def bigram_bitmap(spark, d):
    """The packed form of a bigram set: words that hold a bit."""
    words = F.array(*E.bitmap(E.bigram_ids(E.bigram_set(F.col("city")))))
    rows = people(spark, d).select("rec_id", F.posexplode(words).alias("word", "bits"))
    return rows.where("bits <> 0").select("rec_id", F.col("word").cast("long").alias("word"), "bits")


@query(f"WITH {PEOPLE_SQL} SELECT rec_id, nullif(birth_year, '') AS value, CAST(birth_year <> '' AS INT) AS has FROM people")
def exact_field(spark, d):
    there = E.present(F.col("birth_year"))
    rows = people(spark, d).withColumn("birth_year", F.coalesce("birth_year", F.lit("")))
    return rows.select("rec_id", F.when(there, F.col("birth_year")).alias("value"), there.cast("int").alias("has"))


@query(f"WITH {PEOPLE_SQL} SELECT rec_id, {NAME_SQL} AS name FROM people")
def combine_name(spark, d):
    return people(spark, d).select("rec_id", E.combine(F.col("first_name"), F.col("surname"), F.col("birth_name")).alias("name"))


@query(f"WITH {PEOPLE_SQL} SELECT rec_id, CAST(floor(({SHARE_SQL}) / 3.0 * 256) AS BIGINT) AS presence FROM people")
def presence_fraction(spark, d):
    share = E.presence_fraction(F.col("first_name"), F.col("surname"), F.col("birth_name"))
    return people(spark, d).select("rec_id", F.floor(share * 256).alias("presence"))


@query(f"WITH {PEOPLE_SQL} SELECT rec_id, CAST(birth_month <> '' AS INT) AS has_month, CAST(city <> '' AS INT) AS has_city FROM people")
def presence_flag(spark, d):
    return people(spark, d).select("rec_id", E.present(F.col("birth_month")).cast("int").alias("has_month"), E.present(F.col("city")).cast("int").alias("has_city"))


_ONE_HOT_SQL = f"""
letters AS (
  SELECT unnest(string_split('{E.VALID_LETTERS}{E.EVEN_LETTERS}', '')) AS letter),
dims AS (SELECT letter, CAST(k AS BIGINT) AS dim,
  CASE WHEN instr('{E.EVEN_LETTERS}', letter) > 0 THEN 0.05::DOUBLE WHEN substr('{E.VALID_LETTERS}', CAST(k + 1 AS BIGINT), 1) = letter THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v
  FROM letters, range(20) AS r(k))"""


@query(f"WITH {_ONE_HOT_SQL} SELECT letter, dim, v FROM dims")
def onehot_map(spark, d):
    one = spark.range(1).select(F.explode(E.one_hot_map()).alias("letter", "vector"))
    return one.select("letter", F.posexplode("vector").alias("dim", "v")).select("letter", F.col("dim").cast("long").alias("dim"), "v")


@query(f"""WITH {_ONE_HOT_SQL}, {PEOPLE_SQL},
s AS (SELECT rec_id, regexp_replace(upper(regexp_replace(city, '[^a-zA-Z]', '', 'g')), '[^{E.VALID_LETTERS}{E.EVEN_LETTERS}]', '', 'g') AS q FROM people),
c AS (SELECT rec_id, unnest(range(1, length(q) + 1)) AS pos, q FROM s)
SELECT rec_id, CAST(pos - 1 AS BIGINT) AS pos, dim, v FROM c JOIN dims ON dims.letter = substr(q, pos, 1) WHERE v <> 0""")
def onehot_encode(spark, d):
    letters = F.regexp_replace(F.upper(F.regexp_replace("city", "[^a-zA-Z]", "")), f"[^{E.VALID_LETTERS}{E.EVEN_LETTERS}]", "")
    rows = people(spark, d).select("rec_id", F.posexplode(F.filter(F.split(letters, ""), lambda x: x != "")).alias("pos", "letter"))
    cells = rows.select("rec_id", F.col("pos").cast("long").alias("pos"), F.posexplode(E.one_hot(F.col("letter"))).alias("dim", "v"))
    return cells.where("v <> 0").select("rec_id", "pos", F.col("dim").cast("long").alias("dim"), "v")


# --- scans and rows ---------------------------------------------------------------------------------


@query(f"WITH {PEOPLE_SQL} SELECT rec_id, first_name, surname, birth_name, city, postcode, birth_day, birth_month, birth_year FROM people")
def scan_records(spark, d):
    return people(spark, d).drop("idx").withColumn("birth_year", F.coalesce("birth_year", F.lit("")))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def scan_limit(spark, d):
    return T.scan_limit(table(spark, d, "documents").select("doc_id", "n_chars"), 100, "doc_id")


@query("SELECT doc_id, n_chars, source, md5(coalesce(text, '')) AS text_md5, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def row_index(spark, d):
    """Positions of whole rows, texts included."""
    rows = T.row_index(table(spark, d, "documents").select("doc_id", "n_chars", "source", "text"), "doc_id")
    return rows.select("doc_id", "n_chars", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "idx")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'all', count(*) FROM orders")
def count_rows(spark, d):
    o = table(spark, d, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n"))
    return o.select(F.coalesce("o_orderstatus", F.lit("all")).alias("o_orderstatus"), "n")


@query("WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders) SELECT * FROM i WHERE idx BETWEEN 50 AND 149")
def slice_rows(spark, d):
    return T.slice_rows(T.row_index(table(spark, d, "orders").select("o_orderkey"), "o_orderkey"), 50, 100)


def _text_file(lines, column: str, *order: str) -> str:
    """Writes a column's texts as the lines of one file, in an order; the file's folder."""
    path = new_path(lines.sparkSession, "lines")
    lines.orderBy(*order).select(column).coalesce(1).write.text(path)
    return path


@query(f"""WITH {PEOPLE_SQL}
SELECT CAST(rec_id AS VARCHAR) AS rec_id, first_name, surname, birth_name, city, postcode, birth_day, birth_month, birth_year,
  row_number() OVER (ORDER BY rec_id) - 1 AS idx FROM people""")
def read_records(spark, d):
    """Record files are written from ``people``, in the order of rec_id, and read back."""
    rows = people(spark, d).drop("idx").withColumn("birth_year", F.coalesce("birth_year", F.lit("")))
    path = new_path(spark, "records")
    rows = rows.repartitionByRange(4, "rec_id").sortWithinPartitions("rec_id")
    rows.select(F.lit(1).alias("extra"), *(F.col(c).alias(c.replace("_", "-")) for c in rows.columns)).write.option("header", True).csv(path)
    return T.read_records(spark, path, position="idx")


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_retailprice AS v FROM part)
SELECT i // 10 AS r, i % 10 AS c, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM i""")
def read_matrix(spark, d):
    """Lines of ten prices, written and read back as a matrix."""
    rows = T.row_index(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", name="i")
    line = rows.groupBy(F.floor(F.col("i") / 10).alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p_retailprice"))), lambda x: x["p_retailprice"].cast("string")), ",").alias("line"))
    return X.read_matrix(spark, _text_file(line, "line", "r"))


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_retailprice AS v FROM part)
SELECT i, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM i WHERE i < 21""")
def read_vector(spark, d):
    """Twenty numbers and the bias, of a line that holds all prices."""
    line = table(spark, d, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_retailprice"))), lambda x: x["p_retailprice"].cast("string")), ",").alias("line"))
    return X.read_vector(spark, _text_file(line, "line", "line"), 20)


@query(f"""WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier),
codes AS (SELECT k, range(1, 2 + CAST(s_suppkey % 20 AS BIGINT)) AS c FROM s)
SELECT list_aggregate(list_transform(c, lambda x: substr('{E.VALID_LETTERS}', x, 1)), 'string_agg', '') AS sequence FROM codes WHERE k = 3""")
def recover_sequence(spark, d):
    """The fourth of lines that count from 1 and end with a 0."""
    code = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("s_suppkey") % 20 + 1).cast("int")), lambda x: x.cast("string")), ",")
    return X.recover_sequence(spark, _text_file(table(spark, d, "supplier").select("s_suppkey", F.concat(code, F.lit(",0,7")).alias("line")), "line", "s_suppkey"), 3)


@query("SELECT c_custkey, CAST(k AS INT) AS copy FROM customer, range(3) AS r(k)")
def repeat_rows(spark, d):
    return T.repeat_rows(table(spark, d, "customer").select("c_custkey"), 3)


# --- vectors ------------------------------------------------------------------------------------------

_LINE = "l_orderkey, l_linenumber"


def _lines(spark, d, **columns):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(e).alias(n) if isinstance(e, str) else e.alias(n) for n, e in columns.items()))


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, CAST(embedding[i] AS DOUBLE) + CAST(embedding[65 - i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(i)")
def vec_add(spark, d):
    a = F.col("embedding").cast("array<double>")
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.zip_op(a, F.reverse(a), lambda x, y: x + y)).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), "v")


@query("SELECT label, CAST(i - 1 AS BIGINT) AS i, round(sum(CAST(embedding[i] AS DOUBLE)), 6) + 0.0 AS v FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL")
def vec_sum_many(spark, d):
    return V.sum_vectors(table(spark, d, "embeddings"), "embedding", "label").withColumn("v", F.round("v", 6) + 0.0)


@query(f"SELECT {_LINE}, CAST(l_quantity AS BIGINT) * CAST(trunc(l_extendedprice) AS BIGINT) AS product, round(l_extendedprice * l_discount, 6) AS v FROM lineitem")
def vec_mul(spark, d):
    whole = W.multiply(F.col("l_quantity").cast("long"), F.col("l_extendedprice").cast("long"))
    return _lines(spark, d, product=whole, v=F.round(W.multiply(F.col("l_extendedprice"), F.col("l_discount")), 6))


@query(f"SELECT {_LINE}, round(exp(l_discount * 10 - l_tax), 6) AS v FROM lineitem")
def vec_exp(spark, d):
    return _lines(spark, d, v=F.round(W.exp(F.col("l_discount") * 10 - F.col("l_tax")), 6))


@query(f"SELECT {_LINE}, CASE WHEN l_discount <> 0 THEN round(l_extendedprice / l_discount, 4) END AS v FROM lineitem")
def vec_divide(spark, d):
    return _lines(spark, d, v=F.round(W.divide(F.col("l_extendedprice"), F.col("l_discount")), 4))


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, CAST(list_sort(embedding)[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(i)")
def vec_sort(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(W.sort_elements(F.col("embedding"))).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


@query("SELECT o_orderkey // 8 AS part, CAST(sum(CAST(trunc(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY ALL")
def partial_sum(spark, d):
    return V.partial_sums(table(spark, d, "orders").selectExpr("o_orderkey as i", "cast(o_totalprice * 100 as bigint) as v"), 8)


@query("""SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 6) + 0.0 AS v
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def dot_product(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", (F.round(V.dot(F.col("embedding"), F.col("next")), 6) + 0.0).alias("v"))


@query(f"SELECT {_LINE}, floor(CAST(l_quantity AS DOUBLE) * 256 / 64) / 256 AS v FROM lineitem")
def normalise(spark, d):
    return _lines(spark, d, v=N.normalise(F.col("l_quantity").cast("long"), F.lit(64)))


@query(f"SELECT {_LINE}, CAST(l_partkey > l_suppkey AS BIGINT) AS gt FROM lineitem")
def compare_gt(spark, d):
    return _lines(spark, d, gt=W.greater(F.col("l_partkey"), F.col("l_suppkey")))


@query("SELECT s_suppkey AS i, CAST(n_nationkey AS BIGINT) AS j, CAST(s_nationkey >= n_nationkey AS BIGINT) AS ge FROM supplier, nation")
def compare_all(spark, d):
    x = table(spark, d, "supplier").selectExpr("s_suppkey as i", "s_nationkey as v")
    return V.compare_all(x, table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) as i", "n_nationkey as v"))


@query(f"SELECT {_LINE}, CAST(l_quantity = l_linenumber AS BIGINT) AS eq FROM lineitem")
def equals(spark, d):
    return _lines(spark, d, eq=W.equals(F.col("l_quantity"), F.col("l_linenumber")))


@query("SELECT c_custkey, CAST(c_acctbal < 0 AS BIGINT) AS negative FROM customer")
def msb(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.sign_bit(F.col("c_acctbal")).alias("negative"))


@query(f"SELECT {_LINE}, CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE l_partkey END AS v FROM lineitem")
def multiplex(spark, d):
    return _lines(spark, d, v=N.multiplex(F.col("l_partkey"), F.col("l_suppkey"), (F.col("l_returnflag") == "R").cast("int")))


@query(f"SELECT {_LINE}, (CASE WHEN l_returnflag = 'R' THEN l_suppkey * 977 ELSE l_partkey * 977 END) & 65535 AS v FROM lineitem")
def multiplex_narrow(spark, d):
    return _lines(spark, d, v=R.narrow(N.multiplex(F.col("l_partkey") * 977, F.col("l_suppkey") * 977, (F.col("l_returnflag") == "R").cast("int")), 16))


@query(f"SELECT {_LINE}, CAST(l_quantity > 25 AND l_discount > 0.05 AS BIGINT) AS both FROM lineitem")
def arith_and(spark, d):
    return _lines(spark, d, both=W.both(F.col("l_quantity") > 25, F.col("l_discount") > 0.05))


@query("""SELECT o_custkey, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS v FROM orders GROUP BY o_custkey""")
def vector_to_text(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    return a.select("o_custkey", V.to_text(F.col("a")).alias("v"))


# --- matrices -----------------------------------------------------------------------------------------

_COO_SQL = "coo AS (SELECT l_suppkey % 16 AS r, l_partkey % 16 AS c, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL)"
_BATCH_SQL = "coo AS (SELECT l_linenumber AS m, l_suppkey % 8 AS r, l_partkey % 8 AS c, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL)"


def _coo(spark, d):
    q = table(spark, d, "lineitem").selectExpr("l_suppkey % 16 as r", "l_partkey % 16 as c", "cast(l_quantity as bigint) as q")
    return q.groupBy("r", "c").agg(F.sum("q").alias("v"))


def _batch(spark, d):
    q = table(spark, d, "lineitem").selectExpr("l_linenumber as m", "l_suppkey % 8 as r", "l_partkey % 8 as c", "cast(l_quantity as bigint) as q")
    return q.groupBy("m", "r", "c").agg(F.sum("q").alias("v"))


@query(f"WITH {_COO_SQL} SELECT a.r, b.c, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM coo a JOIN coo b ON a.c = b.r GROUP BY ALL")
def matmul(spark, d):
    return M.matmul(_coo(spark, d), _coo(spark, d))


@query(f"WITH {_BATCH_SQL} SELECT a.m, a.r, b.c, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM coo a JOIN coo b ON a.m = b.m AND a.c = b.r GROUP BY ALL")
def matmul_batch(spark, d):
    return M.matmul(_batch(spark, d), _batch(spark, d), "m")


@query(f"WITH {_COO_SQL} SELECT r, CAST(sum(v * (c + 1)) AS BIGINT) AS v FROM coo GROUP BY ALL")
def matvec(spark, d):
    x = spark.range(16).select(F.col("id").alias("i"), (F.col("id") + 1).alias("v"))
    return M.matvec(_coo(spark, d), x)


@query(f"WITH {_COO_SQL} SELECT a.r, b.r AS c, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM coo a JOIN coo b ON a.c = b.c GROUP BY ALL")
def gram_matrix(spark, d):
    return M.gram(_coo(spark, d))


@query(f"WITH {_BATCH_SQL} SELECT r, c, CAST(sum(v) AS BIGINT) AS v FROM coo GROUP BY ALL")
def mat_sum_many(spark, d):
    return M.sum_matrices(_batch(spark, d))


@query(f"WITH {_COO_SQL} SELECT r * 16 + c AS i, v FROM coo")
def mat_flatten(spark, d):
    return M.flatten(_coo(spark, d), 16)


@query("SELECT p_partkey // 10 AS r, p_partkey % 10 AS c, p_size AS v FROM part")
def mat_reshape(spark, d):
    return M.reshape(table(spark, d, "part").selectExpr("p_partkey as i", "p_size as v"), 10)


@query(f"WITH {_COO_SQL} SELECT r // 4 AS tile_r, c // 8 AS tile_c, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM coo GROUP BY ALL")
def matrix_tiles(spark, d):
    return M.tiles(_coo(spark, d), 4, 8).groupBy("tile_r", "tile_c").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


# --- numbers --------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CAST(trunc(c_acctbal * 256) AS BIGINT) AS v FROM customer")
def to_fixed(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.to_fixed(F.col("c_acctbal")).alias("v"))


@query("SELECT c_custkey, CAST(trunc(c_acctbal * 256) AS BIGINT) / 256.0::DOUBLE AS v FROM customer")
def from_fixed(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.from_fixed(N.to_fixed(F.col("c_acctbal"))).alias("v"))


@query("""WITH f AS (SELECT c_custkey, CAST(trunc(c_acctbal * 256) AS BIGINT) AS a, c_custkey * 3 + 1 AS b FROM customer)
SELECT c_custkey, CASE WHEN a * b < 0 THEN -((-(a * b)) >> 8) ELSE (a * b) >> 8 END AS v FROM f""")
def fx_mul(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.fixed_product(N.to_fixed(F.col("c_acctbal")), F.col("c_custkey") * 3 + 1).alias("v"))


@query("SELECT c_custkey, CAST(floor(CAST(trunc(c_acctbal * 256) AS BIGINT) / 256.0::DOUBLE) AS BIGINT) AS v FROM customer")
def fx_truncate(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.truncate(N.to_fixed(F.col("c_acctbal"))).alias("v"))


@query("SELECT o_orderkey, ((o_custkey - o_orderkey) % 97 + 97) % 97 AS v FROM orders")
def pos_mod(spark, d):
    return table(spark, d, "orders").select("o_orderkey", W.positive_mod(F.col("o_custkey") - F.col("o_orderkey"), 97).alias("v"))


@query("SELECT o_orderkey, (o_orderkey * 104729 + 8191) % 1048575 AS v FROM orders")
def mersenne_mod(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.mersenne_mod(F.col("o_orderkey") * 104729 + 8191, 20).alias("v"))


@query("SELECT o_orderkey, CAST((CAST(o_orderkey AS HUGEINT) * 1099511627791 + 5) * (CAST(o_custkey AS HUGEINT) + 1000003) % 2305843009213693951 AS BIGINT) AS v FROM orders")
def mult_mod(spark, d):
    # in 64 bits x would overflow from key 2^23 on
    x, y = F.col("o_orderkey").cast(N.D38) * F.lit(1099511627791) + 5, F.col("o_custkey").cast(N.D38) + 1000003
    return table(spark, d, "orders").select("o_orderkey", N.product_mod(x, y, F.lit(2305843009213693951)).alias("v"))


_WRAP = "18446744073709551616::UHUGEINT"
_SIGNED = "CASE WHEN {0} >= 9223372036854775808::UHUGEINT THEN CAST(CAST({0} AS HUGEINT) - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST({0} AS BIGINT) END"


def _newton(steps: int) -> str:
    ctes = ["n0 AS (SELECT o_orderkey, CAST(2 * o_orderkey + 1 AS UHUGEINT) AS a, CAST(2 * o_orderkey + 1 AS UHUGEINT) AS x FROM orders)"]
    for k in range(steps):
        ctes.append(f"n{k + 1} AS (SELECT o_orderkey, a, x * ((2::UHUGEINT + {_WRAP} - (a * x) % {_WRAP}) % {_WRAP}) % {_WRAP} AS x FROM n{k})")
    return "WITH " + ",\n".join(ctes) + f" SELECT o_orderkey, {_SIGNED.format('x')} AS v FROM n{steps}"


@query(_newton(5))
def mod_inverse(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.inverse(2 * F.col("o_orderkey") + 1).alias("v"))


@query("""WITH k AS (SELECT p_partkey, i FROM part, range(1, 101) AS r(i) WHERE (p_partkey * i) % 101 = 1)
SELECT p.p_partkey, CAST(k.i AS BIGINT) AS v FROM part p LEFT JOIN k ON p.p_partkey = k.p_partkey""")
def mod_inverse_n(spark, d):
    return table(spark, d, "part").select("p_partkey", N.inverse_mod(F.col("p_partkey"), F.lit(101).cast("long")).alias("v"))


@query("SELECT o_orderkey, (o_orderkey * 1000000007) & 9223372036854775807 AS v FROM orders")
def mod_convert(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.narrow(F.col("o_orderkey") * 1000000007, 63).alias("v"))


@query("SELECT p_partkey, CASE WHEN p_size % 21 = 0 THEN 0 ELSE CAST(factorial(p_size % 21) AS BIGINT) END AS v FROM part")
def factorial(spark, d):
    return table(spark, d, "part").select("p_partkey", N.factorial(F.col("p_size") % 21).alias("v"))


@query("SELECT o_orderkey, CAST(i AS BIGINT) AS i, (o_custkey >> CAST(i AS BIGINT)) & 1 AS bit FROM orders, range(0, 16, 5) AS r(i)")
def bit_at(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(*map(F.lit, range(0, 16, 5)))).alias("i"))
    return rows.select("o_orderkey", F.col("i").cast("long").alias("i"), N.bit_at(F.col("o_custkey"), F.col("i")).alias("bit"))


@query("SELECT o_orderkey, o_custkey & 65535 AS v FROM orders")
def pack_bits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.pack_bits(N.unpack_bits(F.col("o_custkey"), 16)).alias("v"))


@query("SELECT o_orderkey, CAST(i AS BIGINT) AS i, (o_custkey >> CAST(i AS BIGINT)) & 1 AS bit FROM orders, range(0, 16) AS r(i)")
def unpack_bits(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.posexplode(N.unpack_bits(F.col("o_custkey"), 16)).alias("i", "bit"))
    return rows.select("o_orderkey", F.col("i").cast("long").alias("i"), "bit")


@query("SELECT o_orderkey, CAST(i AS BIGINT) AS i, ((o_custkey >> CAST(i AS BIGINT)) & 1) * 256 AS v FROM orders, range(0, 8) AS r(i)")
def bits_to_ints(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.posexplode(N.unpack_bits(F.col("o_custkey"), 8)).alias("i", "bit"))
    return rows.select("o_orderkey", F.col("i").cast("long").alias("i"), F.shiftleft("bit", 8).alias("v"))


@query("SELECT o_orderkey, CAST((CAST(o_orderkey AS HUGEINT) * 2654435761 * (o_custkey + 40503)) % 4294967296 AS BIGINT) AS v FROM orders")
def narrow_mul(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.narrow(R.multiply(F.col("o_orderkey") * F.lit(2654435761), F.col("o_custkey") + 40503), 32).alias("v"))


@query(f"SELECT o_orderkey, {_SIGNED.format(f'((CAST(o_orderkey AS UHUGEINT) * 6364136223846793005::UHUGEINT) % {_WRAP} * (CAST(o_custkey AS UHUGEINT) + 1442695040888963407::UHUGEINT)) % {_WRAP}')} AS v FROM orders")
def ring_mul(spark, d):
    """The product modulo 2^64 of numbers that fill the ring."""
    big = R.multiply(F.col("o_orderkey"), F.lit(6364136223846793005))
    return table(spark, d, "orders").select("o_orderkey", R.multiply(big, F.col("o_custkey") + F.lit(1442695040888963407)).alias("v"))


@query("SELECT o_orderkey, (o_custkey * 31) & 65535 AS v FROM orders")
def narrow_reconstruct(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 31).alias("x"))
    one, two = S.split(o, "x", "o_orderkey")
    return S.reconstruct(one, two, "o_orderkey", bits=16).select("o_orderkey", F.col("value").alias("v"))


# --- shares -----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey AS total, 1 AS hidden FROM orders")
def share_create(spark, d):
    """Shares themselves are random; their sum is not, and neither is the value."""
    a, b = R.share(F.col("o_custkey"), F.col("o_orderkey"))
    s = table(spark, d, "orders").select("o_orderkey", "o_custkey", a.alias("a"), b.alias("b"))
    return s.select("o_orderkey", R.add(F.col("a"), F.col("b")).alias("total"), ((F.col("a") != F.col("o_custkey")) & (F.col("b") != F.col("o_custkey"))).cast("int").alias("hidden"))


@query("SELECT o_orderkey, o_custkey AS value FROM orders")
def share_reconstruct(spark, d):
    return S.reconstruct(*S.split(table(spark, d, "orders"), "o_custkey", "o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, o_custkey AS value FROM orders")
def share_convert(spark, d):
    """From shares that add up to shares that XOR, and opened."""
    a, b = R.share(F.col("o_custkey"), F.col("o_orderkey"))
    s = table(spark, d, "orders").select("o_orderkey", R.add(a, b).alias("v"))
    x, y = R.xor_share(F.col("v"), F.col("o_orderkey"), seed=8)
    return s.select("o_orderkey", x.bitwiseXOR(y).alias("value"))


@query("SELECT o_orderkey, CAST(0 AS BIGINT) AS value FROM orders")
def share_zero(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit(0).cast("long").alias("zero"))
    return S.reconstruct(*S.split(o, "zero", "o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, o_custkey AS total FROM orders")
def xor_share(spark, d):
    a, b = R.xor_share(F.col("o_custkey"), F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", a.bitwiseXOR(b).alias("total"))


@query("SELECT o_orderkey, o_custkey AS value, o_custkey & 255 AS low FROM orders")
def xor_reconstruct(spark, d):
    """Two tables of XOR shares, opened as 64 bits and as bytes."""
    both = S.split_xor(table(spark, d, "orders"), "o_custkey", "o_orderkey")
    return S.reconstruct_xor(*both, "o_orderkey").join(S.reconstruct_xor(*both, "o_orderkey", bits=8).withColumnRenamed("value", "low"), "o_orderkey")


@query("SELECT o_orderkey, o_orderkey & o_custkey AS value FROM orders")
def bool_and(spark, d):
    return table(spark, d, "orders").select("o_orderkey", W.bits_and(F.col("o_orderkey"), F.col("o_custkey")).alias("value"))


@query(f"WITH {_COO_SQL} SELECT r, c, v AS value FROM coo")
def share_reconstruct_2d(spark, d):
    return S.reconstruct(*S.split(_coo(spark, d), "v", "r", "c"), "r", "c")


@query(f"WITH {_BATCH_SQL} SELECT m, r, c, v AS value FROM coo")
def share_reconstruct_3d(spark, d):
    return S.reconstruct(*S.split(_batch(spark, d), "v", "m", "r", "c"), "m", "r", "c")


@query("SELECT o_orderkey, o_custkey - o_orderkey AS value FROM orders")
def bool_subtract(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.subtract(F.col("o_custkey"), F.col("o_orderkey")).alias("value"))


# --- generators -----------------------------------------------------------------------------------------------


def _uniform_sql(seed: int, i: str) -> str:
    return f"CAST(('0x' || substr(md5('{seed}-' || {i}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"


_CELLS_SQL = f"SELECT i // 150 AS m, i % 150 // 15 AS r, i % 15 AS c, {_uniform_sql(1, 'i')} * 10 AS v FROM range(600) AS r(i)"
_GRID_SQL = f"SELECT i // 30 AS r, i % 30 AS c, {_uniform_sql(1, 'i')} * 10 AS v FROM range(600) AS r(i)"


@query(f"SELECT i, CASE WHEN {_uniform_sql(2, 'i')} < 0.5 THEN -1 ELSE 1 END * ({_uniform_sql(1, 'i')} * 10) AS v FROM range(1000) AS r(i)")
def random_1d(spark, d):
    return G.random_vector(spark, 1000, signed=True)


@query(f"SELECT i, {_uniform_sql(1, 'i')} * 10 - 5 AS v FROM range(1000) AS r(i)")
def random_1d_range(spark, d):
    return G.random_vector(spark, 1000, low=-5.0, high=5.0)


@query(_GRID_SQL)
def random_2d(spark, d):
    return G.random_matrices(spark, 1, 20, 30).drop("m")


@query(_CELLS_SQL)
def random_3d(spark, d):
    return G.random_matrices(spark, 4, 10, 15)


@query(f"WITH a AS ({_GRID_SQL}) SELECT x.r, y.r AS c, round(sum(x.v * y.v), 6) AS v FROM a x JOIN a y ON x.c = y.c GROUP BY ALL")
def random_gram(spark, d):
    return M.gram(random_2d(spark, d)).withColumn("v", F.round("v", 6))
