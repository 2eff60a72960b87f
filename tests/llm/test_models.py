"""The trained operators against plain arithmetic, over whole queries; their samples and filters."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from linkspark.llm import language_id, learning, quality_classifier, toxicity
from tests.llm.test_small import ODD, frame, labelled, words


def held(i, modulus, rest):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == rest


# --- 6 ---


def plain_core(chunk):
    w = chunk.decode().lower().strip(language_id.EDGES)
    return w if any(c.isalpha() for c in w) else ""


def grams(word, n):
    marked = f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def plain_language(rows, smooth=0.5):
    """Predictions of (doc_id, text, lang) by the definition, word by word."""
    langs = sorted({x for i, t, x in rows if x is not None and t is not None and not held(i, 3, 1)})
    tables = {n: defaultdict(Counter) for n in (0, 4, 3, 2, 1)}
    for i, t, lang in rows:
        if lang is None or t is None or held(i, 3, 1):
            continue
        for w in map(plain_core, t.encode().split()):
            if w:
                tables[0][w][lang] += 1
                for n in (4, 3, 2, 1):
                    for g in grams(w, n):
                        tables[n][g][lang] += 1
    totals = {n: {x: sum(c[x] for c in table.values()) for x in langs} for n, table in tables.items()}

    def log(n, key, lang):
        return math.log((tables[n][key][lang] + smooth) / (totals[n][lang] + smooth * len(tables[n])))

    def word(w, lang):
        if w in tables[0]:
            return log(0, w, lang)
        for n in (4, 3, 2, 1):
            known = [g for g in grams(w, n) if g in tables[n]]
            if known:
                return sum(log(n, g, lang) for g in known) / len(known)
        return 0.0

    out = {}
    for i, t, _ in rows:
        ws = [w for w in map(plain_core, (t or "").encode().split()) if w]
        sums = [sum(word(w, x) for w in ws) for x in langs]
        best = max(range(len(langs)), key=lambda k: (sums[k], -k)) if ws and langs else None
        out[i] = ("und", 0.0) if best is None else (langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums))
    return out


def test_language_by_its_definition(spark):
    r = random.Random(71)
    alphabets = {"aa": "abcdeé", "bb": "abxyzß", "cc": "mnopqñ"}
    rows = [(i, words(r, 6, alphabets[k]) + r.choice(["", ".", " 12", " X!"]), r.choice([k, k, k, None])) for i, k in enumerate([*alphabets] * 40)]
    rows += [(1000 + i, t, None) for i, t in enumerate([*ODD, "zz xyx Unheardzxy ????", "qq"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1))
    want = plain_language(rows)
    got = language_id.language_id(df).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g.lang_pred == want[g.doc_id][0] and abs(g.score - want[g.doc_id][1]) < 1e-5, g
        assert g.held_out == held(g.doc_id, 3, 1)
    assert language_id.language_id(df.where("false")).count() == 0


def test_a_rare_language_stays_in_the_sample(spark):
    r = random.Random(72)
    rows = [(i, words(r, 8, "abcde"), "big") for i in range(3000)] + [(None if i % 2 else 5000 + i, words(r, 8, "vwxyz"), "rare") for i in range(12)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=100)
    assert model.langs == ["big", "rare"]
    hit, logs = model.found(0, language_id.word_hashes(sorted({w for _, t, x in rows if x == "rare" for w in t.split()})))
    assert hit.mean() > 0.5


# --- 9 ---


def plain_features(text):
    """The buckets of a text, each as often as it counts."""
    m, mask = int(quality_classifier.MULTIPLIER), (1 << 64) - 1

    def bucket(h):
        h = ((h ^ h >> 32) * m) & mask
        return (h ^ h >> 29) % quality_classifier.BUCKETS

    out, hashes = Counter(), []
    for w in text.encode().split():
        codes = [ord(c) + 1 for c in "<" + w.decode() + ">"]
        whole = sum(c * pow(m, k + 1, 1 << 64) for k, c in enumerate(codes)) & mask
        hashes.append(whole)
        out[bucket(whole)] += 1
        for n in quality_classifier.NGRAMS:
            for k in range(len(codes) - n + 1):
                h = n
                for c in codes[k : k + n]:
                    h = (h * m + c) & mask
                out[bucket(h)] += 1
    for a, b in zip(hashes, hashes[1:], strict=False):
        out[bucket(((a ^ a >> 31) * m + b) & mask)] += quality_classifier.PAIR_TIMES
    return out


def test_quality_by_its_definition(spark):
    docs, labels = labelled(spark, 60)
    docs = docs.unionByName(frame(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10_000))
    how = {"updates": 2000}
    model = quality_classifier.fitted(docs, labels, **how)
    texts = {d.doc_id: d.text for d in docs.collect()}
    got = quality_classifier.quality_classifier(docs, labels, **how).collect()
    assert len(got) == len(texts)
    for g in got:
        count = plain_features(texts[g.doc_id] or "")
        want = 0.0
        if count:
            hidden = sum(n * model.e[b].astype(float) for b, n in count.items()) / sum(count.values())
            z = model.out.astype(float) @ hidden + model.bias
            want = math.exp(z[1] - z.max()) / np.exp(z - z.max()).sum()
        assert abs(g.score - want) < 1e-4 and g.predicted == (g.score >= 0.3), g
        assert g.held_out == held(g.doc_id, 5, 0)
    kept = {k.doc_id for k in quality_classifier.keep_good(docs, labels, **how).collect()}
    assert kept == {g.doc_id for g in got if g.predicted}
    assert quality_classifier.quality_classifier(docs.where("false"), labels).count() == quality_classifier.keep_good(docs.where("false"), labels).count() == 0


# --- 10 ---


def plain_terms(text):
    out = set()
    for w in set(text.encode().split()):
        core = w.strip(toxicity.EDGES).decode().lower()
        for n in (0, *toxicity.PREFIXES):
            if len(core) > n:
                h = sum((ord(c) + 1) * pow(int(toxicity.MULTIPLIER), k + 1, 1 << 64) for k, c in enumerate(core[: n or None])) + n
                h &= (1 << 64) - 1
                out.add(((h ^ h >> 32) * int(toxicity.MULTIPLIER) & (1 << 64) - 1) >> 64 - toxicity.BITS)
    return out


def test_toxicity_by_its_definition(spark):
    docs, labels = labelled(spark, 120)
    docs = docs.unionByName(frame(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10_000))
    terms, machine = toxicity.train(docs, labels)
    place = {int(t): k for k, t in enumerate(terms)}
    texts = {d.doc_id: d.text for d in docs.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(texts) and {g.predicted for g in got} == {0, 1}
    for g in got:
        x = sorted(place[t] for t in plain_terms(texts[g.doc_id] or "") if t in place)
        m = machine.b + sum(machine.w[i] for i in x) + sum(machine.v[i] @ machine.v[j] for a, i in enumerate(x) for j in x[a + 1 :])
        assert abs(g.score - 1 / (1 + math.exp(-m))) < 1e-9 and g.predicted == (g.score >= 0.7), g
        assert g.held_out == held(g.doc_id, 3, 1)
    kept = {k.doc_id for k in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {g.doc_id for g in got if not g.predicted}
    assert toxicity.toxicity(docs.where("false"), labels).count() == toxicity.drop_toxic(docs.where("false"), labels).count() == 0


def test_an_insult_and_a_group_are_toxic_together_only(spark):
    r = random.Random(73)
    insults, groups = ["vilewretch", "foulbeast", "lowscum"], ["northfolk", "hillpeople", "rivermen", "oldfaith"]

    def text(*said):
        w = words(r, 30, "etaoinshrd").split()
        for x in said:
            w.insert(r.randrange(len(w)), x)
        return " ".join(w)

    kinds = [("group", 0)] * 900 + [("insult", 0)] * 200 + [("none", 0)] * 200 + [("both", 1)] * 500
    made = {"group": lambda: text(r.choice(groups)), "insult": lambda: text(r.choice(insults)), "none": text, "both": lambda: text(r.choice(groups), r.choice(insults))}
    rows = [(k, made[kind](), kind, toxic) for k, (kind, toxic) in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, toxic int")
    labels = docs.select("doc_id", "toxic", F.lit(1).alias("quality"))
    got = toxicity.toxicity(docs, labels).join(docs.select("doc_id", "kind"), "doc_id").where("held_out").collect()
    rate = {k: np.mean([g.predicted for g in got if g.kind == k]) for k in made}
    assert rate["both"] >= 0.95 and max(rate["insult"], rate["group"], rate["none"]) <= 0.05, rate


# --- samples ---


def test_samples(spark):
    long = "word " * 30_000
    docs = spark.createDataFrame([(i, long if i % 50 == 0 else f"text {i}", 1, 2) for i in range(400)] + [(None, "x", 1, 2), (3, "a", 1, 2), (401, "", 1, 2), (402, None, 1, 2)], "doc_id long, text string, y int, nth int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = learning.labelled_sample(docs, labels, "toxic", 3, 1, (30, 40))
    known = {i: min(i % 2, 0 if i == 5 else 1) for i in range(400) if not held(i, 3, 1)}
    assert len(got) == 70 and all(known[i] == y for i, _, y in got) and Counter(y for *_, y in got) == {0: 30, 1: 40}
    assert got == sorted(got) and dict((i, t) for i, t, _ in got).get(3, "a") == "a"
    every = learning.labelled_sample(docs, labels, "toxic", 3, 1, (1000, 1000))
    assert {i for i, *_ in every} == set(known) and any(len(t) > 100_000 for _, t, _ in every)
    small = learning.labelled_sample(docs, labels, "toxic", 3, 1, (1000, 1000), sample_bytes=200_000)
    assert 0 < len(small) < len(every)
    assert learning.labelled_sample(docs.where("false"), labels, "toxic", 3, 1, (30, 40)) == []
    assert learning.labelled_sample(docs, labels.where("false"), "toxic", 3, 1, (30, 40)) == []


# --- the pipeline ---


def test_stages_of_odd_rows_and_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 80)
    odd = frame(spark, ODD).withColumn("doc_id", F.when(F.col("doc_id") % 4 != 3, F.col("doc_id") + 10_000))
    docs = docs.unionByName(odd).select("doc_id", "text", "lang", "source", "n_chars")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, rows in (("all", docs), ("none", docs.where("false"))):
        now = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            now.write.parquet(str(tmp_path / f"{name}{k}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if k < 3:
                assert now.columns == docs.columns
        assert (now.count() > 0) == (name == "all")
