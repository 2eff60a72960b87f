"""Operator 1, SentencePiece: N-best encoding, and decoding.

The lattice of a text has a node between any two characters and an edge for each
piece of the vocabulary. A forward Viterbi pass gives the best score of reaching
each node from the beginning; a backward A* search from the end takes it as its
heuristic. It is exact, so paths leave the agenda in order of their score and
the first n are the n best.

No piece crosses from another character to the blank mark, nor holds a line break
(checked when a model is loaded), so a lattice is a chain of small ones, one a word. Of a text's n best
paths each differs from the best in at most the n - 1 words whose second choice
costs least. So words are first solved together, once each, by forward and
backward Viterbi passes, which give a word's best ids and what its second choice
costs; the A* search then runs where paths can differ: over the lattices of these
n - 1 words for their n best, and over the chain of their choices for the text's.
All other words keep the ids of their Viterbi pass, which are those that the
search would give (words that hold spelled characters or are long are solved by
the search alone).

The vocabularies at hand are merge-ordered (BPE): their numbers are ranks, no log
probabilities. A piece of rank r scores -ln(r + 1), less the logarithm of the sum
of all 1 / (r + 1): Zipf's law. ``scores="model"`` takes a unigram model's own.
Scores are whole millionths, so sums are exact and ties certain: equal scores go
by the search's order, which prefers the fewer open characters, then the piece
with the smaller start. A character that no piece holds is written as its bytes,
each a little less likely than the last piece.

Null and empty texts have one path without pieces. Long texts are encoded whole.
Repeated rows get equal results; other columns are ignored, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import IdStore, map_batches, to_bytes

BLANK = "▁"
UNIT = 1_000_000  # scores are whole millionths
NONE = -(1 << 61)  # below any score
SHORT = 48  # characters of words that are solved together
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CELLS = 1 << 16  # characters of words that are solved together: what a processor's cache holds
CHOICES = 20_000  # words whose n best paths are remembered
SEPARATORS = [chr(k) for k in (*range(1, 9), *range(14, 32))]

Edge = tuple[int, tuple[int, ...], int]  # start, ids, score


def model_bytes(path: str | None = None) -> bytes:
    """The model's file; by default a public vocabulary that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def hashed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of strings one character longer."""
    return ((h ^ (h >> np.uint64(32))) + c + np.uint64(1)) * MULTIPLIER


def string_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (((h ^ h >> 32) + ord(c) + 1) * int(MULTIPLIER)) & (1 << 64) - 1
    return h


class Pieces:
    """A vocabulary with scores; solves, encodes and decodes."""

    def __init__(self, proto: bytes, scores: str = "zipf"):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = m.vocab_size()
        text = [m.id_to_piece(i) for i in range(n)]
        byte_ids = [i for i in range(n) if m.is_byte(i)]
        special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)} | set(byte_ids)
        normal = [i for i in range(n) if i not in special]
        if scores == "zipf":
            total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
            value = {i: -math.log(r + 1) - total for r, i in enumerate(normal)}
        else:
            value = {i: m.get_score(i) for i in normal}
        self.pieces = {text[i]: ((i,), round(UNIT * value[i])) for i in normal}
        begins = {t[:k]: None for t in self.pieces for k in range(1, len(t))}
        self.known = {t: self.pieces.get(t, ()) for t in [*begins, *self.pieces]}  # () where a piece only begins so
        self.least = min((s for _, s in self.pieces.values()), default=0) - UNIT
        self.byte_id = {int(text[i][1:-1], 16): i for i in byte_ids}
        self.unknown = m.unk_id()
        self.bytes = [b"" if i in special else t.replace(BLANK, " ").encode() for i, t in enumerate(text)]
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        self.apart = not any(re.search(f"[^{BLANK}]{BLANK}|\n", t) for t in self.pieces)
        self.longest = max(map(len, self.pieces), default=1)
        raw = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.raw, self.raw_size = raw, np.fromiter(map(len, self.bytes), np.int64, n)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        names = list(self.known)
        keys = np.array([string_hash(t) for t in names], np.uint64)
        order = np.argsort(keys)
        self.hashes = np.append(keys[order], np.uint64((1 << 64) - 1))
        self.first = np.searchsorted(self.hashes, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        self.deepest = int(np.bincount((keys >> np.uint64(46)).astype(np.int64)).max(initial=0))
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.piece_at = np.array([self.known[names[k]][0][0] if self.known[names[k]] else -1 for k in order] + [-1])
        self.score_at = np.array([self.known[names[k]][1] if self.known[names[k]] else 0 for k in order] + [0], np.int64)
        self.store = IdStore(score=np.int64, gap=np.int64, same=bool)
        self.choices: dict[tuple[str, int], list[tuple[int, np.ndarray, bool]]] = {}

    def edges(self, text: str) -> Callable[[int], list[Edge]]:
        """For a node the edges that end there, by their start."""
        get, longest = self.pieces.get, self.longest

        def into(end: int) -> list[Edge]:
            out = []
            for start in range(max(0, end - longest), end):
                found = get(text[start:end])
                if found:
                    out.append((start, *found))
                elif start == end - 1:
                    out.append((start, *self.spelled(text[start])))
            return out

        return into

    def forward(self, text: str) -> list[int]:
        """The best score up to each node."""
        get, n = self.known.get, len(text)
        best = [0] + [NONE] * n
        for start in range(n):
            here, end = best[start], start
            while end < n:
                end += 1
                found = get(text[start:end])
                if found:
                    score = here + found[1]
                elif end == start + 1:
                    score = here + self.spelled(text[start])[1]
                elif found is None:
                    break
                else:
                    continue
                if score > best[end]:
                    best[end] = score
                if found is None:
                    break
        return best

    def spelled(self, character: str) -> tuple[tuple[int, ...], int]:
        """A character that is no piece: its bytes."""
        raw = character.encode("utf-8", "replace")
        ids = tuple(self.byte_id[b] for b in raw) if self.byte_id else (self.unknown,)
        return ids, self.least * len(ids)

    def n_best(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """(score, ids) of the n best paths, or of all if they are fewer."""
        return backward(self.edges(text), self.forward(text), n)

    def n_choices(self, word: str, n: int) -> list[tuple[int, np.ndarray, bool]]:
        """(score, ids, whether they decode to the word) of a word's n best paths."""
        found = self.choices.get((word, n))
        if found is None:
            shown = word.replace(BLANK, " ").encode("utf-8", "replace")
            found = [(score, np.array(ids, np.uint32), self.decode(np.array(ids, np.int64)) == shown) for score, ids in self.n_best(word, n)]
            if len(self.choices) >= CHOICES:
                self.choices.clear()
            self.choices[word, n] = found
        return found

    def learn(self, words: list[str]) -> None:
        """Solves words that the store has no ids of."""
        slots = self.store.of(words)[0]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        alone = np.flatnonzero(sizes > SHORT).tolist()
        order = np.argsort(sizes, kind="stable")
        for n in np.unique(sizes[sizes <= SHORT]).tolist():
            a, b = np.searchsorted(sizes[order], [n, n + 1])
            if not n:
                self.store.put(slots[order[a:b]], np.zeros(b - a, np.int64), np.empty(0, np.uint32), score=0, gap=NONE, same=True)
                continue
            for at in range(a, b, max(1, CELLS // n)):
                pick = order[at : min(b, at + max(1, CELLS // n))]
                part = [words[k] for k in pick.tolist()]
                ids, many, score, gap, odd = self.solve_many(part, n)
                self.store.put(slots[pick], many, ids, score=score, gap=gap, same=self.same(part, ids, many))
                alone += pick[odd].tolist()
        for at in range(0, len(alone), 1000):  # long words, and those with characters to be spelled
            pick = np.array(alone[at : at + 1000])
            paths = [self.n_best(words[k], 2) for k in pick.tolist()]
            ids = np.array([i for p in paths for i in p[0][1]], np.uint32)
            many = np.array([len(p[0][1]) for p in paths])
            gap = np.array([p[0][0] - p[1][0] if len(p) > 1 else NONE for p in paths])
            self.store.put(slots[pick], many, ids, score=np.array([p[0][0] for p in paths]), gap=gap, same=self.same([words[k] for k in pick.tolist()], ids, many))

    def same(self, words: list[str], ids: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Whether the ids of each word decode to it."""
        shown = [w.replace(BLANK, " ").encode("utf-8", "replace") for w in words]
        word = np.repeat(np.arange(len(words)), many)
        size = self.raw_size[ids]
        got = np.bincount(word, size, len(words)).astype(np.int64)
        out = got == np.fromiter(map(len, shown), np.int64, len(words))
        if not out.all():  # those of other lengths don't take part in what follows
            pick = out[word]
            ids, size, shown = ids[pick], size[pick], [x for x, ok in zip(shown, out.tolist(), strict=True) if ok]
        stop = np.cumsum(size)
        decoded = self.raw[np.repeat(self.raw_start[ids] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        wrong = np.flatnonzero(decoded != np.frombuffer(b"".join(shown), np.uint8))
        if len(wrong):
            out[np.flatnonzero(out)[np.searchsorted(np.cumsum(got[out]), wrong, side="right")]] = False
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows where hashes are, or would be, in the sorted ones."""
        row = self.first[h >> np.uint64(46)]
        for _ in range(self.deepest):
            row += self.hashes[row] < h
        return row

    def solve_many(self, words: list[str], n: int) -> tuple[np.ndarray, ...]:
        """Of words of n characters each, by forward and backward Viterbi passes over
        all their lattices: the best ids and how many each has, their scores, what the
        second choice costs (the best path through an edge that isn't on the first),
        and which words hold a character to be spelled (their other results are void)."""
        w = len(words)
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(w, n).T.copy()
        # a place is (start, word); score[k] and piece[k] are of the edges of k characters
        at, h = np.arange(n * w), np.zeros(n * w, np.uint64)
        flat, score, piece = c.ravel(), [None], [None]
        odd = np.zeros(w, bool)
        for k in range(1, min(n, self.longest) + 1):
            h = hashed(h, flat[at + (k - 1) * w])
            row = self.find(h)
            known = self.hashes[row] == h
            ids = np.where(known, self.piece_at[row], -1)
            if k == 1:
                odd[at[ids < 0] % w] = True
            edge = ids >= 0
            own, made = np.full((n - k + 1) * w, NONE, np.int64), np.zeros((n - k + 1) * w, np.uint32)
            own[at[edge]], made[at[edge]] = self.score_at[row[edge]], ids[edge]
            score.append(own.reshape(-1, w))
            piece.append(made.reshape(-1, w))
            on = known & (at < (n - k) * w)
            at, h = at[on], h[on]
        longest = len(score) - 1
        best, tail = np.full((n + 1, w), NONE, np.int64), np.full((n + 1, w), NONE, np.int64)
        back = np.zeros((n + 1, w), np.int64)
        best[0], tail[n] = 0, 0
        for end in range(1, n + 1):
            for k in range(min(end, longest), 0, -1):  # of equal scores the smaller start stays
                value = best[end - k] + score[k][end - k]
                better = value > best[end]
                best[end][better], back[end][better] = value[better], k
        for start in range(n - 1, -1, -1):
            for k in range(1, min(n - start, longest) + 1):
                np.maximum(tail[start], score[k][start] + tail[start + k], out=tail[start])
        # the first choices, by their start
        chosen, every = np.zeros((n, w), np.int64), np.arange(w)
        end = np.where(odd, 0, n)
        while end.any():
            k = back[end, every]
            start = end - k
            on = np.flatnonzero(end)
            chosen[start[on], on] = k[on]
            end = np.where(end > 0, start, 0)
        second, ids = np.full(w, 2 * NONE, np.int64), np.zeros((n, w), np.uint32)
        for k in range(1, longest + 1):
            on = chosen[: n - k + 1] == k
            ids[: n - k + 1][on] = piece[k][on]
            through = best[: n - k + 1] + score[k] + tail[k:]
            through[on] = 2 * NONE
            np.maximum(second, through.max(axis=0), out=second)
        taken = chosen > 0
        return ids.T[taken.T], taken.sum(axis=0), best[n], np.where(second > NONE, best[n] - second, NONE), odd

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words of all texts, which one stands at each place, and how
        many places each text has."""
        rows = pa.array(texts, pa.string())
        mark = next((x for x in SEPARATORS if not any(x in t for t in texts)), None)
        if not self.apart:
            lists = pa.array([[t] for t in texts], pa.list_(pa.string()))
        elif mark is None:
            lists = pa.array([re.findall(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n", t) for t in texts], pa.list_(pa.string()))
        else:
            rows = pc.replace_substring(pc.replace_substring(rows, "\n", mark + "\n" + mark), BLANK, mark + BLANK)
            while pc.any(pc.match_substring(rows, BLANK + mark + BLANK)).as_py():  # runs of blanks stay whole
                rows = pc.replace_substring(rows, BLANK + mark + BLANK, BLANK + BLANK)
            lists = pc.split_pattern(rows, mark)
        coded = lists.flatten().dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices), np.asarray(lists.value_lengths(), np.int64)

    def encode(self, texts: list[str], n: int) -> Iterator[list[tuple[int, np.ndarray, bool]]]:
        """Of each normalized text the n best segmentations: score, ids, and whether
        they decode to the text (word by word, as decoding joins pieces)."""
        if not texts:
            return
        words, at, many = self.units(texts)
        store = self.store
        store.trim()
        slots, new = store.of(words)
        self.learn(new)
        store.used(slots, np.bincount(at, minlength=len(slots)))
        here = slots[at]
        ids, size = store.gather(here)
        id_stop = np.append(0, np.cumsum(size, dtype=np.int64))
        stop = np.cumsum(many)
        begin = stop - many
        total = np.add.reduceat(store.columns["score"][here], begin)
        same = np.logical_and.reduceat(store.columns["same"][here], begin)
        # the n - 1 words of each text whose second choice costs least, of equals the first
        gap = store.columns["gap"][here]
        gap[gap < 0] = -NONE
        places = np.arange(len(here))
        opens = []
        for _ in range(n - 1):
            least = np.minimum.reduceat(gap, begin)
            first = np.minimum.reduceat(np.where(gap == np.repeat(least, many), places, len(here)), begin)
            opens.append(np.where(least < -NONE, first, -1))
            gap[first] = -NONE
        opens = np.sort(np.array(opens, np.int64).reshape(n - 1, len(texts)).T, axis=1).tolist()
        for t, (a, b) in enumerate(zip(id_stop[begin].tolist(), id_stop[stop].tolist(), strict=True)):
            open_ = [k for k in opens[t] if k >= 0]
            yield self._chain(ids[a:b], int(total[t]), bool(same[t]), [(words[at[k]], int(id_stop[k]) - a, int(id_stop[k + 1]) - a) for k in open_], n)

    def _chain(self, ids: np.ndarray, total: int, same: bool, open_: list[tuple[str, int, int]], n: int) -> list[tuple[int, np.ndarray, bool]]:
        """open_: words that can differ, and where in ids theirs begin and end."""
        # a chain: node k lies before the k-th open word, edges are its choices
        choices = [self.n_choices(word, n) for word, _, _ in open_]
        best = [0]
        for paths in choices:
            best.append(best[-1] + paths[0][0])
        rest = total - best[-1]
        out = []
        for score, picked in backward(lambda k: [(k - 1, (c,), path[0]) for c, path in enumerate(choices[k - 1])], best, n):
            parts, at, ok = [], 0, same
            for (_, a, b), c, paths in zip(open_, picked, choices, strict=True):
                parts += [ids[at:a], paths[c][1]]
                at, ok = b, ok and paths[c][2]
            out.append((rest + score, np.concatenate([*parts, ids[at:]]), ok))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, with a blank for each blank mark."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def backward(into: Callable[[int], list[Edge]], best: list[int], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """A* from the last node to the first; best: the exact best score up to each node."""
    serial, out, push, pop = 0, [], heapq.heappush, heapq.heappop
    agenda = [(-best[-1], len(best) - 1, 0, 0, None)]
    while agenda:
        _, node, _, done, path = pop(agenda)
        if not node:
            ids: list[int] = []
            while path is not None:
                ids += path[0]
                path = path[1]
            out.append((done, tuple(ids)))
            if len(out) == n:
                break
            continue
        for start, own, score in into(node):
            serial += 1
            score += done
            push(agenda, (-best[start] - score, start, serial, score, (own, path)))
    return out


_MADE: dict[tuple[str, str], Pieces] = {}  # of this worker, for its next tasks too


def loaded(proto: bytes, scores: str) -> Pieces:
    key = hashlib.sha256(proto).hexdigest(), scores
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Pieces(proto, scores)
    return _MADE[key]


SCHEMA = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, round_trip boolean"


def encode_documents(docs: DataFrame, n: int = 3, model: str | None = None, scores: str = "zipf", with_ids: bool = False) -> DataFrame:
    """A row per document and rank (1 to n): score, number and CRC-32 of the ids,
    and whether they decode to the normalized text; with_ids adds the ids."""
    proto = docs.sparkSession.sparkContext.broadcast(model_bytes(model))  # a vocabulary, whatever the corpus
    schema = SCHEMA + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * with_ids]

    def make():
        pieces = loaded(proto.value, scores)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [pieces.model.normalize(t.decode("utf-8", "replace")) for t in to_bytes(batch.column(1))]
            rows: list[tuple] = []
            for doc_id, paths in zip(batch.column(0).to_pylist(), pieces.encode(texts, n), strict=True):
                for k, (score, ids, same) in enumerate(paths):
                    rows.append((doc_id, k + 1, score / UNIT, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), same, *[ids.tolist()] * with_ids))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return each

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), make, schema)


def decode_ids(rows: DataFrame, ids: str = "ids", model: str | None = None, into: str = "text") -> DataFrame:
    """``rows`` with the text of the id arrays in column ``into`` (null stays null)."""
    proto = rows.sparkSession.sparkContext.broadcast(model_bytes(model))
    at = rows.columns.index(ids)
    field = f"`{into}` string"
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), field])

    def make():
        pieces = loaded(proto.value, "zipf")

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = [None if x is None else pieces.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, into])

        return each

    return map_batches(rows, make, ddl)
