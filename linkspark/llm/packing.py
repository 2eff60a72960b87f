"""Operator 8, packing of token sequences by minimum bin slack.

A document's ids end with id 0; one longer than a sequence is cut into pieces.
Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the
corpus) comes to the driver. There, bin after bin, the longest length left opens
a bin, and a bitset subset-sum over the lengths available (each as often as it is
left) finds the fullest combination for the rest; it is removed as often as the
lengths last, which is what packing such bins one by one would do. The plan is
a few numbers per length; every piece finds its place from its rank among the
pieces of its length, so any number of equal lengths is dealt evenly.

Null and empty texts are the single id 0. Long texts are cut into as many
pieces as they need. Equal lengths are interchangeable: which of
them goes where follows from task and order of reading. Repeated rows and rows
without doc_id are packed like any other; other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IdStore, map_batches, materialize, parts, to_bytes

CAPACITY = 2048
END_ID = 0

#: What a tokenizer does before its merges, where words can be encoded one by one
#: (fixed values of the public vocabulary).
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


BY_MERGES = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}

NEVER = 1 << 40  # above any rank
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file; by default a public vocabulary that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")


def byte_letters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """Byte-pair merges of many words at once: in each round every word makes its
    merge of the lowest rank, wherever that occurs, from the left."""

    def __init__(self, spec: dict):
        vocab, letters = spec["model"]["vocab"], byte_letters()
        suffix = spec["model"]["end_of_word_suffix"]
        self.inner = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int64)
        self.last = np.array([vocab.get(letters[b] + suffix, -1) for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        # an open table: keys, and for each its rank and what it becomes
        self.shift = np.uint64(64 - max(4, (4 * len(pairs)).bit_length()))
        self.keys = np.full((1 << (64 - int(self.shift))) + len(pairs), -1, np.int64)
        self.rank, self.made = np.full(len(self.keys), NEVER, np.int64), np.zeros(len(self.keys), np.int64)
        at, left = self.place(key), np.arange(len(key))
        while len(left):
            at[left] += self.keys[at[left]] >= 0
            first = left[np.unique(at[left], return_index=True)[1]]
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]] = key[first]
            left = left[self.keys[at[left]] != key[left]]
        self.rank[at], self.made[at] = np.arange(len(pairs)), [vocab[a + b] for a, b in pairs]

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Where keys stand in the table, or a free place."""
        at = self.place(key)
        off = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(off):
            at[off] += 1
            off = off[(self.keys[at[off]] != key[off]) & (self.keys[at[off]] >= 0)]
        return at

    def __call__(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw: the bytes of all words, which have ``size`` each. Ids, and how many each word has."""
        word = np.repeat(np.arange(len(size)), size)
        symbol = self.inner[raw]
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[raw[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            at = self.find(symbol[:-1] << 32 | symbol[1:])
            rank = np.append(self.rank[at], NEVER)
            rank[:-1][word[:-1] != word[1:]] = NEVER
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(word))))
            live = least < NEVER
            done.append((word[~live], symbol[~live]))
            hit = np.flatnonzero(live & (rank == least))
            if not len(hit):
                break
            # of neighbours that overlap every other one, from the left
            run = np.maximum.accumulate(np.where(np.append(True, np.diff(hit) != 1), np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbol[hit] = self.made[at[hit]]
            live[hit + 1] = False
            symbol, word = symbol[live], word[live]
        word, symbol = (np.concatenate([d[k] for d in done] or [np.empty(0, np.int64)]) for k in (0, 1))
        return symbol[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(size))


class WordTokens:
    """Ids of texts.

    A tokenizer as BY_WORDS says drops white space, lower-cases and never joins
    letters with what isn't a letter. So a text's ids are those of its words; a
    full stop or comma after letters is a word of its own; capitals needn't be
    told apart (but where a combining mark or a special token's beginning stands,
    texts stay as they are). The normalization changes nothing in words of
    Latin-1 letters but their case; these are merged together. Words are encoded once
    and remembered, as far as the store's bytes go. Any other tokenizer gets whole texts.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(source)
        self.whole = Tokenizer.from_str(source)
        self.by_words = all(spec.get(k) == v for k, v in BY_WORDS.items()) and all(spec["model"].get(k) == v for k, v in BY_MERGES.items())
        if self.by_words:
            self.merges, self.store = Merges(spec), IdStore()
            self.tail = [self.whole.encode(t, add_special_tokens=False).ids for t in ".,"]
            self.by_words = all(len(ids) == 1 for ids in self.tail)

    def learn(self, new: list[bytes]) -> None:
        """Encodes words that the store has no ids of."""
        slots = self.store.of(new)[0]
        for at in range(0, len(new), 1 << 15):
            self._learn(new[at : at + (1 << 15)], slots[at : at + (1 << 15)])

    def _learn(self, new: list[bytes], slots: np.ndarray) -> None:
        size = np.fromiter(map(len, new), np.int64, len(new))
        raw = np.frombuffer(b"".join(new), np.uint8)
        stop = np.cumsum(size)
        filled = size > 0
        # letters of one byte, and of two; the second byte of two needs the first
        second = np.append(False, raw[:-1] == 0xC3) & (raw >= 0x80) & (raw <= 0xBF) & (raw != 0x97) & (raw != 0xB7)
        second[(stop - size)[filled]] = False
        small = raw | 0x20
        letter = (small >= 97) & (small <= 122) & (raw < 0x80) | second
        letter |= (raw == 0xC3) & np.append(second[1:], False)
        low = np.where(letter & ((raw < 0x80) | second & (raw < 0x9F)), small, raw)
        # a full stop or comma behind letters, and whether letters are all there is besides
        tail = np.zeros(len(new), np.uint8)
        mark = np.where(size > 1, raw[stop - 1], 0)
        pointed = (mark == 46) | (mark == 44)
        tail[pointed] = mark[pointed]
        body = size - pointed
        plain = np.zeros(len(new), bool)
        odd = np.append(0, np.cumsum(~letter))
        plain[filled] = (odd[(stop - size + body)[filled]] == odd[(stop - size)[filled]]) & (body[filled] > 0)
        keep = np.repeat(plain, size)
        keep[(stop - 1)[pointed]] = False
        ids, many = self.merges(low[keep], body[plain])
        at, where = np.cumsum(many), tail[plain]
        ids = np.insert(ids, at[where > 0], np.where(where[where > 0] == 46, self.tail[0][0], self.tail[1][0]).astype(np.uint32))
        self.store.put(slots[plain], many + (where > 0), ids)
        rest = np.flatnonzero(~plain)
        for a in range(0, len(rest), 1000):
            part = rest[a : a + 1000]
            made = [e.ids for e in self.whole.encode_batch_fast([new[k].decode("utf-8", "replace") for k in part.tolist()], add_special_tokens=False)]
            self.store.put(slots[part], np.array([len(x) for x in made], np.int64), np.array([i for x in made for i in x], np.uint32))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, END_ID after each, and how many each has."""
        texts = texts.fill_null("")
        if not self.by_words:
            made = [[*self.whole.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, END_ID] for t in to_bytes(texts)]
            return np.array([i for ids in made for i in ids], np.uint32), np.array([len(ids) for ids in made], np.int64)
        as_is = pa.array([b"<|" in t or b"\xcc" in t or b"\xcd" in t for t in to_bytes(texts)], pa.bool_())
        lists = pc.ascii_split_whitespace(pc.if_else(as_is, texts, pc.ascii_lower(texts)))
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        self.store.trim()
        slots, new = self.store.of(words)
        self.learn(new)
        self.store.used(slots, np.bincount(at, minlength=len(slots)))
        ids, size = self.store.gather(slots[at])
        # END_ID goes behind each text's last id
        stop = np.append(0, np.cumsum(size, dtype=np.int64))[np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64)]
        return np.insert(ids, stop, END_ID), np.diff(np.append(0, stop)) + 1


_MADE: dict[str, WordTokens] = {}  # of this worker, for its next tasks too


def word_tokens(source: str) -> WordTokens:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = WordTokens(source)
    return _MADE[key]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part and local: the ``local``-th
    piece of its length in its ``part`` (a task); with_ids adds the ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    source = docs.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_tokens(source.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in (part for whole in batches for part in parts(whole)):
            ids, size = encode(batch.column(1))
            many = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            at = np.cumsum(np.append(0, length))
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            order = np.argsort(length, kind="stable")
            count = np.bincount(length, minlength=capacity + 1)
            local = np.empty(len(row), np.int64)
            local[order] = np.arange(len(row)) - np.repeat((np.cumsum(count) - count)[count > 0], count[count > 0]) + seen[length[order]]
            seen += count
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int64)), pa.array(local)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), lambda: run, schema, whole=True)


def fullest(left: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of the combination with the largest sum up to ``room``.

    order: the lengths in ``left``, longest first. The bitset's k-th bit says that
    sum k is reached; the bitsets before each item give the combination back.
    """
    reach, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int]] = []
    for size in order:
        if size > room:
            continue
        for _ in range(min(left[size], room // size)):
            wider = (reach | reach << size) & mask
            if wider == reach:
                break
            steps.append((size, reach))
            reach = wider
        if reach & goal:
            break
    total, out = reach.bit_length() - 1, {}
    for size, before in reversed(steps):
        if not before >> total & 1:
            out[size] = out.get(size, 0) + 1
            total -= size
    return list(out.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in each, offset)."""
    left = {k: n for k, n in counts.items() if n}
    order = sorted(left, reverse=True)
    rank = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while order:
        longest = order[0]
        left[longest] -= 1
        combination = dict(fullest(left, order, capacity - longest))
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[k] // c for k, c in combination.items())
        offset = 0
        for size, copies in combination.items():
            rows.append((size, rank[size], sequence, copies, offset))
            offset += size * copies
            rank[size] += copies * times
            left[size] -= copies * times
        sequence += times
        order = [k for k in order if left[k]]
    return np.array(rows, np.int64).reshape(-1, 5)


def place(placed: DataFrame, table: np.ndarray) -> DataFrame:
    """Adds sequence_id and offset to rows with a length and a rank."""
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    schema = placed.schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "rank") + ", sequence_id long, offset long"
    at = {f.name: k for k, f in enumerate(schema)}

    shared = placed.sparkSession.sparkContext.broadcast(table)  # a few rows per length, whatever the corpus

    def make():
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = np.asarray(batch.column(at["length"])), np.asarray(batch.column(at["rank"]))
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            k = rank - row[:, 1]
            sequence, offset = row[:, 2] + k // row[:, 3], row[:, 4] + k % row[:, 3] * length
            names = [n for n in at if n != "rank"]
            return pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

        return each

    return map_batches(placed, make, ddl)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece with its sequence and the place there.

    The table of lengths by task grows with the tasks, so it is merged with the
    pieces (a few numbers each) and never broadcast.
    """
    cut = materialize(pieces(docs, tokenizer_json(tokenizer), capacity, with_ids), "pieces")
    n = materialize(cut.groupBy("length", "part").count(), "lengths")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = n.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    counts = {r["length"]: int(r["n"]) for r in n.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    ranked = cut.join(first.hint("merge"), ["length", "part"]).withColumn("rank", F.col("local") + F.col("first")).drop("part", "local", "first")
    out = place(ranked, plan(counts, capacity))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
