"""Operator 9, quality classifier: supervised subword embeddings.

A document's features are its hashed words, their hashed character n-grams, word
ends marked, and its hashed pairs of adjacent words. Each feature has a learned
vector; a document is the mean of the vectors of all its features (a pair counts
``PAIR_TIMES``, about as often as a word has features), and a softmax layer gives
the probability of the classes. Vectors and layer are trained together by numpy
stochastic gradient descent on a bounded sample. As the mean is linear, scoring
keeps for each feature the difference of its two logits: the same sum, in another order.

Null texts and texts without words have no features; they get score 0 (nothing to
keep), as do all documents where labels of both classes are lacking; the filter
``keep_good`` then has nothing to tell documents apart by, and keeps all. Long texts
are scored whole, and can be in the sample. Ties don't occur: a score is compared
with a threshold. Repeated rows get equal results. Columns besides doc_id and text
aren't looked at, whatever their names; the filter hands them on. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdStore, learn_side, map_batches, words_of
from .learning import labelled_sample

BUCKETS = 1 << 16
NGRAMS = (3, 4)
THRESHOLD = 0.3
PAIR_TIMES = 8

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _buckets(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of all words at once, the word that each belongs to, and each word's hash."""
    marked = ["<" + w.decode("utf-8", "replace") + ">" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(c)) - begin[word]
    power = np.cumprod(np.full(int(size.max(initial=1)), MULTIPLIER))
    whole = np.add.reduceat(c * power[place], begin) if len(c) else c
    ids, owner = [_buckets(whole)], [np.arange(len(words))]
    for n in NGRAMS:
        at = np.flatnonzero(place + n <= size[word])
        h = np.full(len(at), np.uint64(n))
        for k in range(n):
            h = h * MULTIPLIER + c[at + k]
        ids.append(_buckets(h))
        owner.append(word[at])
    return np.concatenate(ids), np.concatenate(owner), whole


def pair_buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Features of adjacent words, by the hashes of both."""
    return _buckets((left ^ (left >> np.uint64(31))) * MULTIPLIER + right)


def doc_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their shares of all."""
    words, at, _ = words_of(pa.array([text], pa.string()))
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    ids, word, whole = word_features(words)
    pairs = pair_buckets(whole[at[:-1]], whole[at[1:]])
    found, where = np.unique(np.concatenate([ids, pairs]), return_inverse=True)
    n = np.bincount(where, np.append(np.bincount(at, minlength=len(words))[word], np.full(len(pairs), PAIR_TIMES)))
    found, n = found[n > 0], n[n > 0]
    return found, (n / n.sum()).astype(np.float32)


class Subwords:
    def __init__(self, dim: int, seed: int):
        rng = np.random.default_rng(seed)
        self.e = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
        self.out, self.bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, step: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        ge, go, gb = np.full(BUCKETS, 1e-8, np.float32), np.full(2, 1e-2, np.float32), np.float32(1)
        for _ in range(epochs):
            for k in rng.permutation(len(docs)):
                ids, share = docs[k]
                if not len(ids):
                    continue
                hidden = share @ self.e[ids]
                z = self.out @ hidden + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[k]] -= 1
                back = p @ self.out
                go += p * p * float(hidden @ hidden)
                gb += float(p @ p)
                self.out -= step * np.outer(p / np.sqrt(go), hidden)
                self.bias -= 0.5 * step * p / np.sqrt(gb)
                ge[ids] += share**2 * float(back @ back)
                self.e[ids] -= (step * share / np.sqrt(ge[ids]))[:, None] * back

    def logits(self) -> tuple[np.ndarray, float]:
        """Of each feature, class 1 less class 0; and of the bias."""
        return (self.e @ (self.out[1] - self.out[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def fitted(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: tuple[int, int] = (4000, 4000), dim: int = 16, updates: int = 48_000, step: float = 0.5, seed: int = 9):
    """The model of at most ``per_class`` labelled rows (bad, good); None without both.

    The steps are as many at any size: few rows are gone through more often.
    """
    rows = labelled_sample(docs, labels, "quality", modulus, held, per_class, doc_features)
    y = np.array([r[2] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    model = Subwords(dim, seed)
    model.fit([r[1] for r in rows], y, max(1, updates // len(rows)), step, seed)
    return model


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, **how) -> tuple[np.ndarray, float] | None:
    """The features' logits and the bias."""
    model = fitted(docs, labels, modulus, held, **how)
    return model and model.logits()


def _scorer(model):
    """Makes a function of texts: their scores."""

    def make():
        store = IdStore(total=np.float64, n=np.int64, whole=np.uint64)

        def score(texts: pa.Array) -> np.ndarray:
            if model is None:
                return np.zeros(len(texts))
            logits, bias = model
            store.trim()
            words, at, text = words_of(texts)
            slots, new = store.of(words)
            if new:
                ids, word, whole = word_features(new)
                store.put(store.of(new)[0], np.zeros(len(new), np.int64), np.empty(0, np.uint32), total=np.bincount(word, logits[ids], len(new)), n=np.bincount(word, minlength=len(new)), whole=whole)
            store.used(slots, np.bincount(at, minlength=len(slots)))
            place = slots[at]
            total, n = (np.bincount(text, store.columns[k][place], len(texts)) for k in ("total", "n"))
            next_ = np.flatnonzero(text[1:] == text[:-1])
            whole = store.columns["whole"][place]
            total += PAIR_TIMES * np.bincount(text[next_], logits[pair_buckets(whole[next_], whole[next_ + 1])], len(texts))
            n += PAIR_TIMES * np.bincount(text[next_], minlength=len(texts))
            margin = total / np.maximum(n, 1) + bias
            return np.where(n > 0, 1 / (1 + np.exp(-np.clip(margin, -500, 500))), 0.0)

        return score

    return make


def quality_classifier(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, **how) -> DataFrame:
    """doc_id, held_out, score and predicted (1: good) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, modulus, held, **how))  # a number a bucket

    def make():
        score = _scorer(shared.value)()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], ["doc_id", "score"])

        return each

    scored = map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), make, "doc_id long, score double")
    return scored.select("doc_id", learn_side("doc_id", modulus, held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, **how) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that reach the threshold;
    all rows where labels of both classes are lacking."""
    model = train(docs, labels, modulus, held, **how)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def make():
        score = _scorer(shared.value)()
        return lambda batch: batch.filter(pa.array(score(batch.column(text).cast(pa.string())) >= THRESHOLD))

    return map_batches(docs, make, docs.schema)
