"""Operator 6, language identification: words first, then shorter n-grams.

A word that the training rows know adds its log frequency in each language. A
word they don't know backs off: its character 4-grams, ends marked, are looked
up; if the model has none of them, its 3-grams, then 2-grams, then single
characters; the mean of the log frequencies found stands for the word. The sums
give the language; the score is its share of the likelihood.

The model is fitted on about ``per_lang`` rows of each language, taken by a hash of
doc_id and text, with all their words: a bound, by their number of languages, on
what comes to the driver and is sent to tasks; a rare language keeps all its rows.

Null texts and texts without a letter are ``und`` with score 0; so is every text
where no training row has a language. Ties go to the first language by name. Long
texts are scored whole. Repeated rows get equal results. Columns besides doc_id,
text and lang aren't looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdStore, few, learn_side, map_batches, to_bytes, words_of

EDGES = ".,;:!?\"'()[]{}<>*#$%&|+-_=/\\~`^@0123456789"
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def core(chunk: bytes) -> str:
    """The word in a chunk between white space, or "" if it has no letter."""
    w = chunk.decode("utf-8", "replace").lower().strip(EDGES)
    return w if any(map(str.isalpha, w)) else ""


def ngrams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all words, ends marked, and each one's word."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(c)) - (np.cumsum(size) - size)[word]
    at = np.flatnonzero(place + n <= size[word])
    h = np.full(len(at), np.uint64(n))
    for k in range(n):
        h = (h ^ (h >> np.uint64(31))) * MULTIPLIER + c[at + k]
    return h, word[at]


def word_hashes(words: list[str]) -> np.ndarray:
    size = np.array([len(w) + 1 for w in words], np.int64)
    c = np.frombuffer("".join(w + "\n" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    begin = np.cumsum(size) - size
    power = np.cumprod(np.full(int(size.max(initial=1)), MULTIPLIER))
    h = np.add.reduceat(c * power[np.arange(len(c)) - np.repeat(begin, size)], begin) if len(c) else c
    return (h ^ (h >> np.uint64(32))) * MULTIPLIER


class Backoff:
    """Log frequencies of words and n-grams by language, by their hashes."""

    def __init__(self, words: list[str], langs: list[str], counts: list[int], smooth: float = 0.5):
        self.langs = sorted(set(langs))
        column = {lang: k for k, lang in enumerate(self.langs)}
        own = list(dict.fromkeys(words))
        row = {w: k for k, w in enumerate(own)}
        table = np.zeros((len(own), len(self.langs)))
        np.add.at(table, ([row[w] for w in words], [column[x] for x in langs]), counts)
        self.tables = {0: self._table(word_hashes(own), table, smooth)}
        for n in ORDERS:
            h, word = ngrams(own, n)
            self.tables[n] = self._table(h, table[word], smooth)

    def _table(self, h: np.ndarray, counts: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(h, return_inverse=True)
        return keys, self._logs(np.stack([np.bincount(at, counts[:, k], len(keys)) for k in range(len(self.langs))], axis=1), smooth)

    @staticmethod
    def _logs(table: np.ndarray, smooth: float) -> np.ndarray:
        return np.log((table + smooth) / (table.sum(axis=0) + smooth * len(table))).astype(np.float32)

    def found(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and the log frequencies of those."""
        keys, logs = self.tables[n]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        return hit, logs[at[hit]]

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies per word; "" gets zeros."""
        out = np.zeros((len(words), len(self.langs)))
        open_ = np.flatnonzero(np.array([w != "" for w in words], bool))
        if len(open_):
            hit, logs = self.found(0, word_hashes([words[k] for k in open_]))
            out[open_[hit]] = logs
            open_ = open_[~hit]
        for n in ORDERS:
            if not len(open_):
                break
            h, word = ngrams([words[k] for k in open_], n)
            hit, logs = self.found(n, h)
            found = np.bincount(word[hit], minlength=len(open_))
            for k in range(len(self.langs)):
                out[open_, k] = np.bincount(word[hit], logs[:, k], len(open_)) / np.maximum(found, 1)
            open_ = open_[found == 0]
        return out


def fit(docs: DataFrame, modulus: int = 3, held: int = 1, per_lang: int = 2000) -> Backoff | None:
    """The model of ``docs`` whose doc_id isn't held out; None without any."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].cast("string").alias("lang")).where("text is not null and lang is not null").where(~learn_side("doc_id", modulus, held))
    size = rows.groupBy("lang").agg((per_lang / F.count("*")).alias("share"))
    rows = rows.join(few(size), "lang").where(F.abs(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)) < F.col("share") * float(1 << 63)).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(to_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(text.split())
            made = Counter()
            for lang, chunks in found.items():
                for chunk, times in chunks.items():
                    if w := core(chunk):
                        made[w, lang] += times
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in made]), pa.array([x for _, x in made]), pa.array(list(made.values()), pa.int64())], ["word", "lang", "n"])

    counts = map_batches(rows, lambda: count, "word string, lang string, n long", whole=True).groupBy("word", "lang").agg(F.sum("n").alias("n"))
    t = counts.orderBy("word", "lang").toArrow()
    return Backoff(t["word"].to_pylist(), t["lang"].to_pylist(), t["n"].to_numpy()) if t.num_rows else None


def language_id(docs: DataFrame, modulus: int = 3, held: int = 1, **how) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    model = fit(docs, modulus, held, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers a word of the sample

    def make():
        own = shared.value
        # of a word: the languages' scores, and 1 if it has a letter
        store = IdStore(row=(np.float64, (len(own.langs) + 1 if own else 1,)))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            best, score = np.zeros(n, np.int64), np.zeros(n)
            known = np.zeros(n, bool)
            if own is not None:
                store.trim()
                words, at, text = words_of(batch.column(1))
                slots, new = store.of(words)
                if new:
                    cores = [core(w) for w in new]
                    rows = np.column_stack([own.scores(cores), np.array([w != "" for w in cores], float)])
                    store.put(store.of(new)[0], np.zeros(len(new), np.int64), np.empty(0, np.uint32), row=rows)
                store.used(slots, np.bincount(at, minlength=len(slots)))
                rows = store.columns["row"][slots]
                total = np.stack([np.bincount(text, rows[at, k], n) for k in range(rows.shape[1])], axis=1)
                known = total[:, -1] > 0
                best = np.argmax(total[:, :-1], axis=1)
                score = 1 / np.exp(np.minimum(total[:, :-1] - total[np.arange(n), best][:, None], 0)).sum(axis=1)
            langs = [own.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

        return each

    scored = map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), make, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", learn_side("doc_id", modulus, held).alias("held_out"), "lang_pred", "score")
