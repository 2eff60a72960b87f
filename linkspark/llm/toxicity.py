"""Operator 10, toxicity: a factorization machine over hashed terms.

Terms are a document's distinct words (lower case, outer punctuation off) and
their first letters, hashed. A term is a feature if its presence tells the classes
of the training rows apart, among all of them or among those that hold a term
which does so: there a group's name, as common in clean texts as in toxic ones, shows
that it matters beside an insult. All other terms are no features, so long clean
texts can't drown an insult. The score of a document is

    sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)),

with x_i = 1 for present terms: pairs of terms, such as an insult and the word
for a group, get weights that single terms don't have. Trained by numpy
stochastic gradient descent with adaptive steps on a bounded sample.

Null and empty texts have no terms: their score is that of the bias. Without
training rows of both classes every score is 0 (nothing is known as toxic). Long
texts are scored whole, and can be in the sample. Ties don't occur: a score is
compared with a threshold. Repeated rows get equal results. Columns besides
doc_id and text aren't looked at, whatever their names; the filter ``drop_toxic``
hands them on. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdStore, learn_side, map_batches, words_of
from .learning import labelled_sample

BITS = 22
EDGES = b".,;:!?\"'()[]{}<>*#$%&|+-_=/\\~`^@"
PREFIXES = (4, 5, 6)  # lengths of a word's beginnings that are terms of their own
THRESHOLD = 0.7
STRONGEST = 64  # terms beside each of which others are tested

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_terms(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all words, word by word, and how many each has: the word and its beginnings."""
    cores = [w.strip(EDGES).decode("utf-8", "replace").lower() for w in words]
    size = np.fromiter(map(len, cores), np.int64, len(cores))
    c = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    begin = np.cumsum(size) - size
    power = np.cumprod(np.full(int(size.max(initial=1)), MULTIPLIER))
    sums = np.append(np.uint64(0), np.cumsum(c * power[np.arange(len(c)) - np.repeat(begin, size)]))
    word, ids = [], []
    for n in (0, *PREFIXES):
        at = np.flatnonzero(size > n)
        h = sums[begin[at] + (n or size[at])] - sums[begin[at]] + np.uint64(n)
        h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
        word.append(at)
        ids.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    word, ids = np.concatenate(word), np.concatenate(ids)
    return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def text_terms(text: str) -> np.ndarray:
    return np.unique(word_terms(list(set(text.encode("utf-8", "replace").split())))[0])


def ratios(docs: list[np.ndarray], y: np.ndarray, least_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms whose presence depends on the class, and their log-likelihood ratios.

    The bar, 1.5 ln(terms tested), rises with their number, so that chance alone
    lets few terms in.
    """
    n = [max(int((y == c).sum()), 1) for c in (0, 1)]
    seen = [np.unique(np.concatenate([d for d, t in zip(docs, y, strict=True) if t == c] or [np.empty(0, np.int32)]), return_counts=True) for c in (0, 1)]
    terms = np.union1d(seen[0][0], seen[1][0])
    df = [np.zeros(len(terms)), np.zeros(len(terms))]
    for c in (0, 1):
        df[c][np.searchsorted(terms, seen[c][0])] = seen[c][1]
    tested = df[0] + df[1] >= least_docs
    share = (df[0] + df[1]) / (n[0] + n[1])
    ratio = np.zeros(len(terms))
    for c in (0, 1):
        for found, expected in ((df[c], share * n[c]), (n[c] - df[c], (1 - share) * n[c])):
            ratio += 2 * found * np.log(np.where(found > 0, found / np.maximum(expected, 1e-12), 1))
    pick = tested & (ratio >= max(10.0, 1.5 * np.log(max(int(tested.sum()), 1))))
    return terms[pick], ratio[pick]


def select_terms(docs: list[np.ndarray], y: np.ndarray, least_docs: int) -> np.ndarray:
    """Terms that tell the classes apart among all documents, among those that hold
    any such term, or among those that hold one of the strongest."""
    terms, ratio = ratios(docs, y, least_docs)
    found = [terms]
    beside = [np.isin(d, terms) for d in docs]
    pools = [np.array([k for k, at in enumerate(beside) if at.any()], np.int64)]
    holders: dict[int, list[int]] = {int(t): [] for t in terms[np.argsort(-ratio, kind="stable")[:STRONGEST]]}
    for k, d in enumerate(docs):
        for t in d[beside[k]].tolist():
            if t in holders:
                holders[t].append(k)
    pools += [np.array(held, np.int64) for held in holders.values()]
    for pool in pools:
        if len(pool) and 0 < y[pool].sum() < len(pool):
            found.append(ratios([docs[k] for k in pool.tolist()], y[pool], least_docs)[0])
    return np.unique(np.concatenate(found))


class FactorizationMachine:
    def __init__(self, n: int, rank: int, seed: int):
        self.b, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, rank))

    def margins(self, doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Of n documents: x are present terms, doc the document of each."""
        v = self.v[x]
        sums = np.stack([np.bincount(doc, v[:, f], n) for f in range(v.shape[1])], axis=1)
        return self.b + np.bincount(doc, self.w[x], n) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(doc, (v**2).sum(axis=1), n))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int, step: float, l2: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(len(self.w), 1.0), np.full(self.v.shape, 1.0), 1.0
        for _ in range(epochs):
            for k in rng.permutation(len(docs)):
                x = docs[k]
                v = self.v[x]
                s = v.sum(axis=0)
                m = self.b + self.w[x].sum() + 0.5 * ((s**2).sum() - (v**2).sum())
                d = 1 / (1 + np.exp(-np.clip(m, -35, 35))) - y[k]
                gb += d * d
                self.b -= step * d / np.sqrt(gb)
                if len(x):
                    g = d + l2 * self.w[x]
                    gw[x] += g * g
                    self.w[x] -= step * g / np.sqrt(gw[x])
                    g = d * (s - v) + l2 * v
                    gv[x] += g * g
                    self.v[x] -= step * g / np.sqrt(gv[x])


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, per_class: tuple[int, int] = (6000, 2000), rank: int = 8, epochs: int = 12, least_docs: int = 3, seed: int = 10):
    """(terms, machine), from at most ``per_class`` labelled rows (clean, toxic)."""
    rows = labelled_sample(docs, labels, "toxic", modulus, held, per_class, text_terms)
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    ids = [r[1] for r in rows]
    terms = select_terms(ids, y, least_docs)
    machine = FactorizationMachine(len(terms), rank, seed)
    machine.fit([np.flatnonzero(np.isin(terms, d)) for d in ids], y, epochs, 0.2, 1e-4, seed)
    return terms, machine


def _scorer(model):
    """A function of texts: their scores."""
    store = IdStore()

    def score(texts: pa.Array) -> np.ndarray:
        if model is None:
            return np.zeros(len(texts))
        terms, machine = model
        store.trim()
        words, at, text = words_of(texts)
        slots, new = store.of(words)
        if new:
            flat, size = word_terms(new)
            place = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
            known = terms[place] == flat if len(terms) else np.zeros(len(flat), bool)
            many = np.bincount(np.repeat(np.arange(len(new)), size)[known], minlength=len(new))
            store.put(store.of(new)[0], many, place[known].astype(np.uint32))
        store.used(slots, np.bincount(at, minlength=len(slots)))
        place = slots[at]
        some = store.columns["size"][place] > 0
        ids, size = store.gather(place[some])
        # each term of a document counts once
        pairs = np.unique(np.repeat(text[some], size) << 32 | ids.astype(np.int64))
        m = machine.margins(pairs >> 32, pairs & ((1 << 32) - 1), len(texts))
        return 1 / (1 + np.exp(-np.clip(m, -700, 700)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, **how) -> DataFrame:
    """doc_id, held_out, score and predicted (1: toxic) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, modulus, held, **how))  # a few numbers a term of the sample

    def make():
        score = _scorer(shared.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], ["doc_id", "score"])

        return each

    scored = map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), make, "doc_id long, score double")
    return scored.select("doc_id", learn_side("doc_id", modulus, held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, **how) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, modulus, held, **how))  # a few numbers a term of the sample
    text = docs.columns.index("text")

    def make():
        score = _scorer(shared.value)
        return lambda batch: batch.filter(pa.array(score(batch.column(text).cast(pa.string())) < THRESHOLD))

    return map_batches(docs, make, docs.schema)
