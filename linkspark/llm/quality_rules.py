"""Operator 4, quality rules: repeated passages from suffix arrays.

The words of all documents of a batch form one sequence; suffixes are sorted
with the document as the first key, so no repeat crosses documents. Prefix
doubling keeps each round's ranks; adjacent common prefixes follow from them by
binary lifting. A suffix lies in the interval of its longer adjacent common
prefix; where the suffix before it is not in an interval that is one longer,
that prefix is a maximal repeated substring. The spans of all maximal repeats of
at least ``min_words`` words are united; a document is rejected if they cover
more than ``max_share`` of it, or if the longest has more than ``max_longest`` words.
This is stricter than the base rule, which counts windows of 8 words and allows 30 %.

Null and empty texts have no words: all counts 0, ``base_failed`` true and
``kept`` false. A long text is sorted whole, in a batch of its own; it takes about 60
bytes a word, or 150 where it repeats itself throughout. Ties don't occur: equal
suffixes of different lengths are told apart by where they end. Repeated rows get equal
results; other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, map_batches, to_bytes, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, BASE_SHARE = 20, 30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, covered_share double, base_failed boolean, kept boolean, spans array<struct<start:long,end:long>>"
)


def suffix_ranks(codes: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order and, for h = 1, 2, 4 ..., the ranks by the first h words.

    Suffixes of one document share a rank in a level exactly if their first h
    words are equal (a suffix that ends sooner equals no other).
    """
    n = len(codes)
    key = (doc.astype(np.int64) << 32) | codes
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])[:n]
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
    levels, h = [rank], 1
    slots = np.flatnonzero(~(fresh & np.append(fresh[1:], True))).astype(np.int32)
    while len(slots):
        at = order[slots]
        after = at + h
        inside = after < ends[at]
        # the rank of the first h words, then of the next h, from 1; 0 where the document ends
        key = rank[at].astype(np.int64) << 32
        key[inside] += rank[after[inside]] + 1
        perm = np.argsort(key)
        at, key = at[perm], key[perm]
        order[slots] = at
        fresh = np.append(True, key[1:] != key[:-1])
        del key, perm
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        levels.append(rank)
        h *= 2
        slots = slots[~(fresh & np.append(fresh[1:], True))]
    return order, levels


def longest_repeats(codes: np.ndarray, ends: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Per position the longest substring that starts here and elsewhere in its
    document, if it has ``least`` words; else 0."""
    order, levels = suffix_ranks(codes, ends, doc)
    out = np.zeros(len(codes), np.int32)
    low = min(least.bit_length() - 1, len(levels) - 1)
    if 1 << low > least or len(codes) < 2:
        return out
    a, b = order[:-1], order[1:]
    pick = levels[low][a] == levels[low][b]
    a, b = a[pick], b[pick]
    i, j, lcp = a.copy(), b.copy(), np.zeros(len(a), np.int32)
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < ends[a]) & (j < ends[b])
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        step = same * np.int32(1 << k)
        i, j, lcp = i + step, j + step, lcp + step
    keep = lcp >= least
    np.maximum.at(out, a[keep], lcp[keep])
    np.maximum.at(out, b[keep], lcp[keep])
    return out


def rules(texts: pa.Array, min_words: int, max_share: float, max_longest: int) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("word_chars", "n_symbols", "n_dup_lines")}
    for text in to_bytes(texts):
        lines = [x for x in text.split(b"\n") if x.strip()]
        shown = text.translate(None, SPACES)
        out["word_chars"].append(len(shown.decode("utf-8", "replace")))
        out["n_symbols"].append(len(shown) - len(shown.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    _, codes, doc = words_of(texts)
    n = np.bincount(doc, minlength=len(texts))
    out["n_words"] = n
    doc = doc.astype(np.int32)
    ends = np.repeat(np.cumsum(n), n).astype(np.int32)
    begin = np.cumsum(n) - n
    longest = longest_repeats(codes, ends, doc, min(min_words, WINDOW))

    def covered(least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where maximal repeats of at least so many words begin and end, and what they cover."""
        ahead = np.append(0, longest[:-1])
        starts = np.flatnonzero((longest >= least) & (ahead != longest + 1))
        stops = starts + longest[starts]
        delta = np.zeros(len(doc) + 1, np.int32)
        np.add.at(delta, starts, 1)
        np.add.at(delta, stops, -1)
        return starts, stops, np.cumsum(delta[:-1]) > 0

    repeat = np.bincount(doc[covered(WINDOW)[2]], minlength=len(n))
    starts, _, inside = covered(min_words)
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, doc[starts], longest[starts])
    share = np.bincount(doc[inside], minlength=len(n)) / np.maximum(n, 1)
    # united spans: runs of covered words within a document
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans: list[list[dict]] = [[] for _ in n]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        while a < b:  # a run can go on into the next document
            d = int(doc[a])
            stop = min(b, int(begin[d] + n[d]))
            spans[d].append({"start": a - int(begin[d]), "end": stop - int(begin[d])})
            a = stop
    failed = (n < MIN_WORDS) | (100 * repeat > BASE_SHARE * n)
    out |= {"n_repeat_words": repeat, "longest_repeat": most, "covered_share": share, "base_failed": failed, "spans": spans}
    out["kept"] = ~failed & (share <= max_share) & (most <= max_longest)
    return out


def quality_rules(docs: DataFrame, min_words: int = 5, max_share: float = 0.25, max_longest: int = 50) -> DataFrame:
    """Counts, repeat spans (in words) and verdict of each document.

    max_share: part of the words that repeated passages of ``min_words`` or more may
    cover; max_longest: words of the longest repeated passage.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = rules(batch.column(1), min_words, max_share, max_longest)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = {"covered_share": pa.float64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "spans": span}
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            arrays = [batch.column(0) if k == "doc_id" else pa.array(out[k], kinds.get(k, pa.int64())) for k in names]
            return pa.RecordBatch.from_arrays(arrays, names)

        return each

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), make, SCHEMA)
