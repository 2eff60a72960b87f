"""The operators on small tables: brute force, nulls, ties, repeated rows, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkspark.llm import chat, embedding_dedup, language_id, packing, pieces, quality_classifier, quality_rules, simhash, toxicity, warc
from linkspark.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "score double, predicted int, u long, v long, row long, key long, part int"


def frame(spark, texts, lang="en", extra=True):
    rows = [(i, t, lang, "s", None if t is None else len(t)) + ((0.5, 1, 1, 2, 3, 4, 5) if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA + (", " + EXTRA if extra else ""))


def words(r, n, alphabet="abcde"):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 6))) for _ in range(n))


ODD = [None, "", " \n\t ", "x", "é" * 5000, "a b c d e " * 400, "same text here for all", "same text here for all", "\U0001f600 ☃ \x00  "]


def find(par, x):
    while par[x] != x:
        x = par[x]
    return x


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)]
    par = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(par, a), find(par, b)
        par[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == linked and all(got[x] == find(par, x) for x in linked)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 ---


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.model_bytes())


def test_pieces_against_all_paths(vocabulary):
    r = random.Random(2)
    for _ in range(150):
        t = vocabulary.model.normalize("".join(r.choice("the aningeré\n☃.") for _ in range(r.randint(0, 9))))
        into = vocabulary.edges(t)

        def every(end, into=into):
            return [0] if end == 0 else [s + score for start, _, score in into(end) for s in every(start)]

        best = sorted(every(len(t)), reverse=True)[:4]
        got = next(vocabulary.encode([t], 4))
        assert [s for s, _, _ in got] == best and len({i.tobytes() for _, i, _ in got}) == len(got)
        assert all(vocabulary.decode(i) == t.replace("▁", " ").encode() for _, i, _ in got)
        assert all(same for _, _, same in got)


def test_pieces_solved_together_as_alone(vocabulary):
    r = random.Random(3)
    by_size = defaultdict(set)
    for _ in range(800):
        w = "▁" + words(r, 1, "aeginrsthé\U00013000")[:40] * r.randint(1, 6)
        by_size[len(w)].add(w)
    for n, ws in by_size.items():
        ws = sorted(ws)
        ids, many, score, gap, odd = vocabulary.solve_many(ws, n)
        stop = np.cumsum(many)
        for k, w in enumerate(ws):
            paths = vocabulary.n_best(w, 2)
            assert odd[k] == ("\U00013000" in w)
            if not odd[k]:
                assert (tuple(ids[stop[k] - many[k] : stop[k]].tolist()), score[k]) == (paths[0][1], paths[0][0])
                assert gap[k] == (paths[0][0] - paths[1][0] if len(paths) > 1 else pieces.NONE)


def test_pieces_of_many_texts_as_of_one(vocabulary):
    r = random.Random(31)
    texts = [vocabulary.model.normalize(t) for t in [*(words(r, r.randint(0, 60), "aeinrsté \n.☃") for _ in range(60)), "", "\n\n", "a\x01b\x02  c", "   x   y", "e" * 200]]
    for t, got in zip(texts, vocabulary.encode(texts, 3), strict=True):
        want = vocabulary.n_best(t, 3)
        assert [s for s, _, _ in got] == [s for s, _ in want]
        assert tuple(got[0][1].tolist()) == want[0][1]
        assert all(same == (vocabulary.decode(ids) == t.replace("▁", " ").encode()) for _, ids, same in got)


def test_word_store_forgets_the_least_used(vocabulary):
    small = pieces.Pieces(pieces.model_bytes())
    small.store.limit = 20_000
    r = random.Random(32)
    for _ in range(10):
        texts = [vocabulary.model.normalize("the same words " + words(r, 80, "aeinrst")) for _ in range(4)]
        assert [[(s, i.tolist()) for s, i, _ in x] for x in small.encode(texts, 2)] == [[(s, i.tolist()) for s, i, _ in x] for x in vocabulary.encode(texts, 2)]
    small.store.trim()
    assert small.store.bytes <= 20_000 and "▁the" in small.store.slots


def test_pieces_odd_rows(spark):
    out = pieces.encode_documents(frame(spark, ODD), n=3, with_ids=True)
    rows = out.collect()
    assert all(r.round_trip for r in rows) and {r.doc_id for r in rows} == set(range(len(ODD)))
    assert [(r.n_pieces, r.score) for r in rows if r.doc_id == 0] == [(0, 0.0)]
    a, b = ([tuple(r)[1:] for r in rows if r.doc_id == k] for k in (6, 7))
    assert a == b
    back = pieces.decode_ids(out.where("doc_id = 6 and rank = 1")).first()
    assert back.text.strip() == ODD[6]
    assert pieces.encode_documents(frame(spark, []).where("false")).count() == 0


# --- 2 ---


def test_warc(spark):
    long, cut = "<p>" + "é" * 100 + "</p>\r\n\r\nWARC/1.1\r\n", "x" * 99
    rows = [(9, "http://a/1", long), (3, "http://a/ 2\r\nx: y", long), (5, None, long), (5, None, long), (None, "u", long), (1, "u", cut), (2, "u", cut), (4, "u", None), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(1))
    got = warc.warc_captures(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        c = r.capture
        html = {k: v for k, _, v in rows}[c.page_id] or ""
        assert c.payload_bytes == len(html.encode()) and len(r.request) == 1 and len(r.metadata) == 1
        assert r.request[0].concurrent_to == c.id
    kinds = Counter((r.capture.page_id, r.capture.kind, r.capture.refers_page) for r in got)
    assert kinds[(3, "response", None)] == 1 and kinds[(9, "revisit", 3)] == 1 and kinds[(5, "revisit", 3)] == 2 and kinds[(None, "revisit", 3)] == 1
    assert kinds[(1, "response", None)] == kinds[(2, "response", None)] == kinds[(4, "response", None)] == 1
    assert {r.capture.refers_uri for r in got if r.capture.kind == "revisit"} == {"http://a/ 2 x: y"}
    assert warc.warc_captures(pages.where("false")).count() == 0


def test_warc_of_shuffled_pages_and_long_payloads(spark):
    texts = [f"<p>{k % 700} {'x' * (k % 150)}</p>" for k in range(3000)] + ["z" * 3_000_000]
    rows = [(k, f"http://a/{k}", t, 1, 2, "c") for k, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row long, n long, first string").repartition(7, "html", F.rand(3))
    got = warc.warc_captures(pages).collect()
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(t, k)
    assert len(got) == len(texts)
    for g in got:
        c, t = g.capture, texts[g.capture.page_id]
        digest = hashlib.sha256(t.encode()).hexdigest()
        again = len(t) >= 100 and first[t] != c.page_id
        assert (c.payload_digest or c.digest) == digest and c.digest == digest and c.payload_bytes == len(t)
        assert c.kind == ("revisit" if again else "response") and c.refers_page == (first[t] if again else None)
        assert len(g.request) == len(g.metadata) == 1


# --- 3 ---


def slow_fingerprint(text, width):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fp, bits):
    ids = sorted(fp)
    par = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= bits:
                x, y = find(par, a), find(par, b)
                par[max(x, y)] = min(x, y)
    return {i: find(par, i) for i in ids}


def test_simhash_documents(spark):
    r = random.Random(4)
    base = [words(r, 120) for _ in range(20)]
    texts = ODD + base + [b + " tail" for b in base] + base[:3] + [b.upper() for b in base[:3]]
    got = simhash.simhash_components(frame(spark, texts), width=4).collect()
    fp = {i: slow_fingerprint(t, 4) for i, t in enumerate(texts)}
    comp = slow_components(fp, 4)
    assert len(got) == len(texts)
    assert all(g.fingerprint == f"{fp[g.doc_id]:016x}" and g.component_id == comp[g.doc_id] for g in got)
    assert comp[0] == comp[1] == comp[2] == 0
    assert simhash.simhash_components(frame(spark, []).where("false")).count() == 0


def split(x):
    return [v - (1 << 64) if v >> 63 else v for v in ((x >> 64 * k) & ((1 << 64) - 1) for k in range(2))]


def test_wide_codes_within_the_bound_all_meet(spark):
    r = random.Random(51)
    values = [r.getrandbits(128) for _ in range(300)]
    for x in list(values):
        for b in r.sample(range(128), r.randint(1, 14)):
            x ^= 1 << b
        values.append(x)
    seg = simhash.complete(12, 8, 2)  # radii: five of 1, three of 0
    assert sum(seg.radius) == 5
    nodes = spark.createDataFrame([(k, *split(v)) for k, v in enumerate(values)], "node long, fp0 long, fp1 long")
    got = {g.node: g.root for g in connected_components(simhash.links(nodes, seg, 12, 8192, 2)).collect()}
    want = slow_components(dict(enumerate(values)), 12)
    assert {k: got.get(k, k) for k in want} == want


@pytest.mark.parametrize("n_segments,bits,block", [(3, 4, 8192), (3, 4, 40), (4, 4, 8192), (5, 4, 16), (2, 3, 8192), (2, 4, 30), (2, 4, 8192)])
def test_simhash_links_lose_nothing(spark, n_segments, bits, block):
    r = random.Random(5)
    centre = r.getrandbits(64)
    values = {r.getrandbits(64) for _ in range(200)} | {centre}
    for _ in range(400):  # a dense place and loose pairs
        x = r.choice([centre, centre, *list(values)[:50]])
        for b in r.sample(range(64), r.randint(1, 5)):
            x ^= 1 << b
        values.add(x)
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    nodes = spark.createDataFrame([(s, s) for s in signed], "node long, fp0 long")
    got = connected_components(simhash.links(nodes, simhash.complete(bits, n_segments), bits, block))
    root = {g.node: g.root for g in got.collect()}
    want = slow_components({s: v for s, v in signed.items()}, bits)
    assert {s: root.get(s, s) for s in signed} == want


def test_lookups_of_a_hot_value_are_split(spark):
    r = random.Random(52)
    low = 0b1011 << 3  # many codes share the value of the first segment, some lack a bit of it
    values = {(r.getrandbits(43) << 21) | low for _ in range(600)}
    values |= {v ^ (1 << r.choice([3, 4, 6])) for v in list(values)[:90]}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(s, s) for s in signed], "node long, fp0 long")
    seg = simhash.complete(4, 3)
    hot = {h.key: (h.ks, h.ka) for h in simhash.split_keys(nodes.select("node", "fp0"), seg, ["fp0"], 50).collect()}
    keys = [simhash.Segments.key(seg, 0, np.array([low ^ b], np.uint64))[0] for b in (0, 8, 16, 64)]
    assert hot[keys[0]][0] > 10 and all(hot[k][1] > 10 for k in keys[1:])
    got = {g.node: g.root for g in connected_components(simhash.links(nodes, seg, 4, 50)).collect()}
    want = slow_components({s: v for s, v in zip(signed, values, strict=True)}, 4)
    assert {s: got.get(s, s) for s in want} == want


def test_near_copies_of_wide_codes(spark):
    r = random.Random(13)
    base = [words(r, 300) for _ in range(120)]
    near = []
    for b in base:
        w = b.split()
        for k in r.sample(range(300), 3):
            w[k] = "edited"
        near.append(" ".join(w))
    kept = {k.doc_id for k in simhash.drop_near_copies(frame(spark, base + near)).collect()}
    assert set(range(120)) <= kept and len(kept) <= 120 + 6


def jaccard(a, b, width=5):
    a, b = (set(simhash.shingle_hashes(x.encode(), width).tolist()) for x in (a, b))
    return len(a & b) / len(a | b)


def edited(r, text, n):
    """Words at even distances replaced, so that ``n`` edits cost 5 shingles each."""
    w = text.split()
    for k in range(n):
        w[10 + k * (len(w) - 20) // n] = f"edit{r.getrandbits(40)}"
    return " ".join(w)


def test_near_copies_are_verified(spark):
    r = random.Random(21)
    base = [words(r, 300) for _ in range(150)]
    near = [edited(r, b, 10) for b in base]  # each pair of one base: about 0.71
    assert all(0.68 < jaccard(a, b) < 0.75 for a, b in zip(base, near, strict=True))
    assert simhash.drop_near_copies(frame(spark, base + near)).count() == 300


def test_near_copies_just_above_the_bar(spark):
    r = random.Random(23)
    base = [words(r, 300) for _ in range(150)]
    near = [edited(r, b, 6) for b in base]
    assert all(0.8 <= jaccard(a, b) < 0.84 for a, b in zip(base, near, strict=True))
    kept = {k.doc_id for k in simhash.drop_near_copies(frame(spark, base + near)).collect()}
    assert set(range(150)) <= kept and len(kept) <= 150 + 3


def test_similar_sets_in_blocks(spark):
    r = random.Random(22)
    rows = [set(r.sample(range(40), r.randint(0, 12))) for _ in range(60)]
    rows += [x ^ {r.randrange(40)} for x in rows]
    rows = list({frozenset(x) for x in rows})
    sets = [np.array(sorted(x), np.uint64) for x in rows]
    want = {k: k for k in range(len(rows))}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = want[i], want[j]
                want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    assert len(set(want.values())) < len(rows)
    nodes = spark.createDataFrame([(7, k, x.tolist()) for k, x in enumerate(sets)] + [(8, 1000, [1]), (9, 2000, []), (9, 2001, [5])], "root long, node long, hashes array<long>")
    for block, size, leaders in ((512, 1 << 20, 64), (16, 1 << 20, 64), (16, 1 << 20, 4), (512, 400, 2), (16, 1 << 20, 0)):
        simhash.LEADERS = leaders
        got = {g.node: g.root for g in connected_components(simhash.verified_links(nodes, 0.8, block, size)).collect()}
        assert {k: got.get(k, k) for k in want} == want
    simhash.LEADERS = 64


def slow_groups(rows, least=0.8):
    """Groups of (doc_id, text) by the filter's rule, over all pairs."""
    texts = list(dict.fromkeys(rows))
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in texts]
    par = {k: k for k in range(len(texts))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and len(a & b) >= least * len(a | b)):
                x, y = find(par, i), find(par, j)
                par[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k, row in enumerate(texts):
        groups[find(par, k)].append(row)
    return list(groups.values())


def test_near_copies_filter_against_all_pairs(spark):
    r = random.Random(24)
    base = [words(r, 120) for _ in range(30)]
    texts = ODD + base + [edited(r, b, n) for b in base[:20] for n in (1, 1, 9)] + base[:5]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, base[0]), (7, base[3]), (900, base[1]), (900, base[1]), (900, base[2])]
    df = spark.createDataFrame([(*x, 1, "z", 2, 3) for x in rows] + [(None, base[0], 1, "z", 2, 3), (None, None, 1, "z", 2, 3)], "doc_id long, text string, t0 int, node string, root int, many int").repartition(5, "doc_id")
    kept = simhash.drop_near_copies(df)
    assert kept.schema == df.schema
    got = Counter((k.doc_id, k.text) for k in kept.collect())
    assert got[None, base[0]] == got[None, None] == 1
    groups = slow_groups(rows)
    for g in groups:  # one row of each, of the smallest doc_id
        rest = {x: got[x] for x in g if got[x]}
        assert sum(rest.values()) == 1 and next(iter(rest))[0] == min(i for i, _ in g), g
    assert sum(got.values()) == len(groups) + 2
    assert simhash.drop_near_copies(df.where("false")).count() == 0


def test_one_doc_id_with_two_texts_loses_none(spark):
    r = random.Random(25)
    a, b = words(r, 50), words(r, 50)
    for rows in ([(5, a), (5, b), (7, b)], [(5, b), (5, a), (7, b)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {(k.doc_id, k.text) for k in simhash.drop_near_copies(df).collect()} == {(5, a), (5, b)}


def test_a_very_long_text(spark):
    long = words(random.Random(26), 400_000)
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "x " * 300_000)], "doc_id long, text string")
    assert {k.doc_id for k in simhash.drop_near_copies(df).collect()} == {1, 3}
    got = {g.doc_id: g for g in simhash.simhash_components(df, width=4).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == 3


# --- 4 ---


def slow_covered(w, window):
    seen = defaultdict(list)
    for i in range(len(w) - window + 1):
        seen[tuple(w[i : i + window])].append(i)
    return {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(window)}


def slow_rules(text, min_words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    longest = 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            n = 0
            while j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            longest = max(longest, n)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(slow_covered(w, 8))
    return base, longest if longest >= min_words else 0, slow_covered(w, min_words)


def test_quality_rules(spark):
    r = random.Random(6)
    texts = [t for t in ODD if t is None or len(t) < 3000]
    for _ in range(60):
        parts = [words(r, r.randint(1, 30), "ab") for _ in range(4)]
        texts.append("\n".join(r.choice(parts) for _ in range(r.randint(1, 6))) + r.choice(["", " ###", "\n\n"]))
    # the fraction limit alone decides: repeats of six words, which the base rule's windows don't see
    six = [words(r, 6, "abcdefgh") for _ in range(6)]
    shares = "".join(f"{s} {words(r, 5, 'ijklmn')} {s} {words(r, 5, 'opqrst')} " for s in six)
    few = f"{six[0]} {words(r, 60, 'ijklmn')} {six[0]} {words(r, 60, 'opqrst')}"
    texts += ["z " * 300, shares, few, words(r, 70, "abcdefghij") * 1]
    verdicts = {}
    for g in quality_rules.quality_rules(frame(spark, texts)).collect():
        base, longest, covered = slow_rules(texts[g.doc_id])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == base and g.longest_repeat == longest, texts[g.doc_id]
        assert g.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert g.covered_share == len(covered) / max(base[0], 1)
        assert g.kept == (not g.base_failed and longest <= 50 and len(covered) <= 0.25 * base[0])
        assert {k for s in g.spans for k in range(s.start, s.end)} == covered
        verdicts[g.doc_id] = g.base_failed, g.kept
    k = texts.index(shares)
    assert verdicts[k] == (False, False) and verdicts[k + 1] == verdicts[k + 2] == (False, True)
    assert quality_rules.quality_rules(frame(spark, texts).where("false")).count() == 0


def test_quality_rules_of_a_long_text(spark):
    r = random.Random(61)
    passage = words(r, 60)
    long = f"{passage} {words(r, 250_000, 'abcdefghijkl')} {passage}"
    df = spark.createDataFrame([(1, long), (2, "a " * 300_000)], "doc_id long, text string")
    got = {g.doc_id: g for g in quality_rules.quality_rules(df).collect()}
    assert got[1].longest_repeat >= 60 and not got[1].kept and not got[1].base_failed
    assert got[2].n_repeat_words == 300_000 and got[2].longest_repeat == 299_999


# --- 5 ---


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for label in (0, 1, 2):
        centres = rng.normal(size=(40, 16))
        for c in [*centres, *centres[:10], *(centres[:20] + 0.02 * rng.normal(size=(20, 16))), *(centres[0] + 0.12 * rng.normal(size=(150, 16)))]:
            rows.append((n, [float(x) for x in c.astype(np.float32)], label))
            n += 1
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [1.0, None] * 8, 0), (n + 5, rows[0][1], None), (n + 6, [1.0] * 15, 0), (n + 7, [1e30] * 16, 0), (n + 8, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {g.vec_id: g for g in embedding_dedup.embedding_components(df, block=64).collect()}
    e, lab = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    e /= np.linalg.norm(e, axis=1)[:, None]
    link = ((e @ e.T) >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(n))
    assert 0.9 * link.sum() <= found <= link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(n))
    assert all(got[x[0]].n_links == 0 and got[x[0]].component_id == x[0] and got[x[0]].kept for x in odd)
    assert embedding_dedup.embedding_components(df.where("false")).count() == 0


@pytest.mark.parametrize("spread", [0.03, 0.2])
def test_links_of_large_components_are_exact(spark, spread):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    centre /= np.linalg.norm(centre)
    near = centre + spread * rng.normal(size=(260, 24)) / 24**0.5
    step = rng.normal(size=24)
    chain = centre + np.outer(np.linspace(0, 1.5, 60), step / np.linalg.norm(step))  # leads out of the core, link by link
    e = np.concatenate([near, chain, near[:5]]).astype(np.float32)
    df = spark.createDataFrame([(k, [float(c) for c in v], 1) for k, v in enumerate(e)], "vec_id long, embedding array<float>, label int").withColumn("root", F.lit(1)).withColumn("kind", F.lit(2))
    got = {g.vec_id: g for g in embedding_dedup.embedding_components(df, block=32).collect()}
    u = e.astype(np.float64) / np.linalg.norm(e.astype(np.float64), axis=1)[:, None]
    link = (u @ u.T) >= 0.98
    assert [got[k].n_links for k in range(len(e))] == (link.sum(axis=1) - 1).tolist()
    par = {k: k for k in range(len(e))}
    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = find(par, int(i)), find(par, int(j))
        par[max(a, b)] = min(a, b)
    assert [got[k].component_id for k in range(len(e))] == [find(par, k) for k in range(len(e))]


def test_embeddings_of_a_common_direction(spark):
    rng = np.random.default_rng(3)
    n, pairs, dim = 12_000, 300, 64
    mean = rng.normal(size=dim)
    mean /= np.linalg.norm(mean)

    def away(count):
        v = rng.normal(size=(count, dim))
        v -= np.outer(v @ mean, mean)
        return v / np.linalg.norm(v, axis=1)[:, None]

    own = away(n)
    near = own[:pairs] + away(pairs) * 0.6
    near /= np.linalg.norm(near, axis=1)[:, None]
    x = 0.9**0.5 * mean + 0.1**0.5 * np.concatenate([own, near])  # cosine of any two: about 0.9
    df = spark.createDataFrame([(k, [float(c) for c in v], 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {g.vec_id: g.component_id for g in embedding_dedup.embedding_components(df).collect()}
    assert sum(got[n + k] == k for k in range(pairs)) >= 0.99 * pairs


# --- 6, 9, 10 ---


def labelled(spark, n=400):
    r = random.Random(8)
    good = [words(r, 60, "etaoinshrd") for _ in range(n)]
    bad = [" ".join(w.upper() + "!!" for w in words(r, 60, "etaoinshrd").split()) for _ in range(n // 4)]
    toxic = [words(r, 30, "etaoinshrd") + f" {a} {b} " + words(r, 30, "etaoinshrd") for a, b in (r.sample(["vilewretch", "foulbeast", "lowscum"], 2) for _ in range(n // 4))]
    texts = good + bad + toxic
    labels = [(i, int(not n <= i < n + n // 4), int(i >= n + n // 4)) for i in range(len(texts))]
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator,target,modulus,rest", [(toxicity.toxicity, "toxic", 3, 1), (quality_classifier.quality_classifier, "quality", 5, 0)])
def test_classifiers(spark, operator, target, modulus, rest):
    docs, labels = labelled(spark)
    rows = operator(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[target] for r in held) >= 0.97 * len(held)
    # labels that are held out play no part
    flipped = labels.withColumn(target, F.when(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, 1 - F.col(target)).otherwise(F.col(target)))
    assert {(r.doc_id, r.score) for r in operator(docs, flipped).collect()} == {(r.doc_id, r.score) for r in rows}
    odd = operator(frame(spark, ODD), labels.where("false")).collect()
    assert {r.score for r in odd} == {0.0} and len(odd) == len(ODD)


def test_filters_keep_rows_as_they_are(spark):
    docs, labels = labelled(spark)
    clean, good = toxicity.drop_toxic(docs, labels), quality_classifier.keep_good(docs, labels)
    assert clean.schema == docs.schema and good.schema == docs.schema
    assert set(clean.collect()) <= set(docs.collect()) and 450 <= clean.count() <= 520


def test_quality_filter_without_a_model_keeps_all(spark):
    docs, labels = labelled(spark, 40)
    for quality in ("1", "0", "cast(null as int)"):
        one = labels.withColumn("quality", F.expr(quality))
        assert quality_classifier.keep_good(docs, one).count() == docs.count()
        assert {x.score for x in quality_classifier.quality_classifier(docs, one).collect()} == {0.0}


def test_languages(spark):
    r = random.Random(9)
    alphabets = {"aa": "abcdeé", "bb": "abxyzß", "cc": "mnopqñ"}
    rows = [(i, words(r, 20, alphabets[k]), k) for i, k in enumerate([*alphabets] * 60)]
    n = len(rows)
    rows += [(n + i, t, None) for i, t in enumerate([*ODD, "123 !!", "zz xyx unheardzxy"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    got = {g.doc_id: g for g in language_id.language_id(df).collect()}
    assert sum(got[i].lang_pred == rows[i][2] for i in range(n)) >= 0.97 * n
    assert all(0 <= g.score <= 1 for g in got.values())
    assert [got[n + k].lang_pred for k in (0, 1, 2, len(ODD))] == ["und"] * 4 and got[n + len(ODD) + 1].lang_pred == "bb"
    assert {g.lang_pred for g in language_id.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- 7 ---


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\", "[\\]\n", "<s>[user]\nx</s>\n", "", None, "é😀"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(nasty)] + [(None, 0, None, "a"), (None, 1, "assistant", "b]"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 5, "sys]\n[tem", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(0))
    back = chat.read_back(chat.format_paths(chat.linear_nodes(df))).collect()
    got = {b.tree: b for b in back}
    assert [(t.role, t.text) for t in got["=1"].turns] == [(r, t or "") for _, _, r, t in rows[:8]]
    assert list(got["=1"].loss) == [t or "" for _, _, r, t in rows[:8] if r == "assistant"]
    assert [(t.role, t.text) for t in got["-"].turns] == [("", "a"), ("assistant", "b]")]
    assert got["=2"].n_turns == 2 and got["=3"].turns[0].role == "sys]\n[tem"
    assert chat.conversation_digests(df.where("false")).count() == 0


def test_reply_trees(spark):
    r = random.Random(10)
    nodes = [("t", k, None if k == 0 else r.randint(max(0, k - 6), k - 1), float(r.randint(0, 3)), "user", str(k)) for k in range(80)]
    nodes += [("c", 1, 2, 1.0, "user", "x"), ("c", 2, 1, 1.0, "user", "y"), ("d", 5, 99, 1.0, "user", "dangling")]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double, role string, text string")
    parent, score = {n[1]: n[2] for n in nodes[:80]}, {n[1]: n[3] for n in nodes[:80]}
    leaves = set(parent) - set(parent.values())

    def path(leaf):
        out = []
        while leaf is not None:
            out.append(leaf)
            leaf = parent[leaf]
        return out

    got = defaultdict(dict)
    for x in chat.leaf_paths(df).where("tree = 't'").collect():
        got[x.leaf][x.up] = x.node
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {leaf: path(leaf) for leaf in leaves}
    order = sorted(leaves, key=lambda leaf: (-sum(score[n] for n in path(leaf)), -len(path(leaf)), leaf))
    ranks = {x.rank: x.leaf for x in chat.best_paths(df, 3).where("tree = 't'").collect()}
    assert [ranks[k] for k in (1, 2, 3)] == order[:3]
    text = chat.format_paths(df).where("tree = 't'").first().formatted
    assert re.findall(r"\]\n(\d+)</s>", text) == [str(n) for n in reversed(path(order[0]))]
    assert {x.tree for x in chat.format_paths(df).collect()} == {"t", "d"}


# --- 8 ---


def test_fullest_and_plan():
    r = random.Random(11)
    for _ in range(200):
        left = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        room = r.randint(1, 60)
        sums = {0}
        for size, n in left.items():
            sums |= {s + size * k for s in sums for k in range(n + 1)}
        got = packing.fullest(left, sorted(left, reverse=True), room)
        assert sum(a * b for a, b in got) == max(s for s in sums if s <= room) and all(b <= left[a] for a, b in got)
    counts = {k: r.randint(0, 50) for k in range(1, 101)}
    rows = packing.plan(counts, 100)
    room, best_fit = [0] * 101, 0  # best fit decreasing: bins by what is left in them
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            k = next((k for k in range(size, 101) if room[k]), 100)
            best_fit += not room[k]
            room[k] -= bool(room[k])
            room[k - size] += 1
    assert math.ceil(sum(k * n for k, n in counts.items()) / 100) <= rows[:, 2].max() + 1 <= best_fit


def test_packing(spark):
    from tokenizers import Tokenizer

    r = random.Random(12)
    texts = ODD + [words(r, r.choice([3, 50, 400, 3000]), "etaoinshrdlu.,'É") for _ in range(60)] + ["H̱ À <|endoftext|> <|EndOfText|>. it's O'K 3.5"]
    whole = Tokenizer.from_str(packing.tokenizer_json())
    rows = packing.pack(frame(spark, texts), with_ids=True).collect()
    ids = defaultdict(dict)
    for x in rows:
        ids[x.doc_id][x.piece] = x
    for i, t in enumerate(texts):
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        got = [ids[i][k] for k in range(len(ids[i]))]
        assert [v for g in got for v in g.ids] == want and [g.start for g in got] == list(range(0, len(want), 2048))
        assert all(g.ids_crc32 == zlib.crc32(np.array(g.ids, "<u4").tobytes()) for g in got)
    bins = defaultdict(list)
    for x in rows:
        bins[x.sequence_id].append(x)
    for b in bins.values():
        at = 0
        for x in sorted(b, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048
    assert len(bins) <= 1.05 * sum(x.length for x in rows) / 2048 + 1
    assert packing.pack(frame(spark, []).where("false")).count() == 0


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    copies = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = docs.unionByName(copies).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sizes, now = [docs.count()], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 3:
            assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and 380 <= sizes[3] <= 405
    packed = {x.doc_id for x in now.collect()}
    assert not any(i >= 10_000 for i in packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[4]
