"""Operator 3, SimHash near-duplicates by multi-index hashing.

A document's fingerprint has the majority bits of its shingles' hashes. Equal
fingerprints are one node. Each fingerprint stands in one table per segment
under the segment's value; each also looks up the values within a small Hamming
ball of its own (only the smaller ones: of two values one is the smaller). Radii
add up to ``max_bits - segments + 1``, so by the pigeonhole principle every pair
within ``max_bits`` meets in some table, where the complete distance is verified.
Tables are dealt by key and sorted; a task walks through its keys in batches and
puts out no more edges than rows. A key under which more than ``block_rows``
fingerprints stand, or which more look up, is split into blocks that meet pair
by pair, each pair in a task of its own; a lookup of a key under which nothing
stands is dropped there. Segments are wide where fingerprints are many, so that
few share a key by chance.

Null and empty texts have fingerprint zero, which links like any other. Long
texts are hashed in slices. Equal texts, and ties for the smallest doc_id, are
one node, so repeated rows get equal results. A null doc_id never names a
component; a component of such rows alone is null. Columns besides doc_id and
text are not looked at, whatever their names. An empty table gives no rows.

The filter ``drop_near_copies`` finds candidates in the same way, by wider codes,
and verifies them by their sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, few, map_batches, materialize, scratch, star_edges, to_bytes

SEED = 42  # of XXH64
CHUNK = 1 << 16  # shingles hashed at once
COLUMNS = 4096  # shingles counted at once where sets are compared
MIX = np.uint64(0xD6E8FEB86659FD93)
LEADERS = 64  # members of a large component that all others are compared with first


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; of all words where they are fewer."""
    words = text.lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)] if words else [], np.uint64)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start, stop = np.append(0, stop)[: len(words) - width + 1], stop[width - 1 :] - 1
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(out), CHUNK):
        out[at : at + CHUNK] = [digest(joined[a:b], SEED) for a, b in zip(start[at : at + CHUNK].tolist(), stop[at : at + CHUNK].tolist(), strict=True)]
    return out


def code(hashes: np.ndarray, n_words: int = 1) -> list[int]:
    """The majority bits of hashes, as signed 64-bit numbers: the first of the
    hashes themselves, each further one of a mix of them."""
    counts = np.zeros((n_words, 64), np.int64)
    for at in range(0, len(hashes), CHUNK):
        rows = [hashes[at : at + CHUNK]]
        while len(rows) < n_words:
            h = (rows[-1] ^ (rows[-1] >> np.uint64(29))) * MIX
            rows.append((h ^ (h >> np.uint64(32))) * MIX)
        bits = np.unpackbits(np.stack(rows).view(np.uint8).reshape(n_words, -1, 8), axis=2, bitorder="little")
        for low in range(0, bits.shape[1], 255):  # sums of bytes, as far as they fit one
            counts += bits[:, low : low + 255].sum(axis=1, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def names(n_words: int) -> list[str]:
    return [f"fp{k}" for k in range(n_words)]


def longs(columns: list[str]) -> str:
    return ", ".join(f"{c} long" for c in columns)


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fp0 of every row of ``docs``."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = [code(shingle_hashes(x, width))[0] for x in to_bytes(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp0"])

        return each

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), make, "doc_id long, fp0 long")


class Segments:
    """Cuts codes of ``n_words`` 64-bit words into segments with balls around their values.

    radii: of the segments of one cut of all bits, which are then about equally wide;
    the widest get the smallest. ``more`` further cuts, of shuffled bits, have radius 0.
    """

    def __init__(self, n_words: int, radii: list[int], more: int = 0):
        n_bits, n = 64 * n_words, len(radii)
        if n_bits > 62 * n:
            raise ValueError("too few segments")
        cuts = [n_bits * k // n for k in range(n + 1)]
        order = np.argsort([b - a for a, b in zip(cuts, cuts[1:], strict=False)], kind="stable")
        self.radius = [0] * n
        for r, k in zip(sorted(radii, reverse=True), order.tolist(), strict=True):
            self.radius[k] = r
        self.parts = [np.arange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        for k in range(more):
            shuffled = np.random.default_rng((3, k)).permutation(n_bits)
            self.parts += [shuffled[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            self.radius += [0] * n
        self.shift = max(map(len, self.parts))
        if self.shift + len(self.parts).bit_length() > 62:
            raise ValueError("keys of more than 62 bits")

    def values(self, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """fp: unsigned, a row per word."""
        bits = np.unpackbits(np.ascontiguousarray(fp.T).view(np.uint8), axis=1, bitorder="little")
        for t, part in enumerate(self.parts):
            wide = np.zeros((len(bits), 64), np.uint8)
            wide[:, : len(part)] = bits[:, part]
            yield t, np.packbits(wide, axis=1, bitorder="little").view(np.uint64)[:, 0]

    def key(self, t: int, value: np.ndarray) -> np.ndarray:
        return ((np.uint64(t) << np.uint64(self.shift)) | value).astype(np.int64)

    def around(self, t: int, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Smaller keys within the segment's ball, and which value looks there."""
        for r in range(1, self.radius[t] + 1):
            for flips in combinations(range(len(self.parts[t])), r):
                at = np.flatnonzero((value >> np.uint64(flips[-1])) & np.uint64(1))  # the highest bit goes: a smaller value
                yield self.key(t, value[at] ^ np.uint64(sum(1 << b for b in flips))), at

    def own(self, fp: np.ndarray) -> np.ndarray:
        """The keys under which codes stand: one row per segment."""
        return np.stack([self.key(t, v) for t, v in self.values(fp)])

    def looked_up(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the balls around, and which code looks there."""
        found = [x for t, v in self.values(fp) for x in self.around(t, v)]
        return tuple(np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))

    @property
    def most_lookups(self) -> int:
        """Values that look up one key, at most."""
        return max(sum(comb(len(p), i) for i in range(1, r + 1)) for p, r in zip(self.parts, self.radius, strict=True)) or 1


def complete(max_bits: int, n_segments: int, n_words: int = 1) -> Segments:
    """Segments in which every pair within ``max_bits`` meets."""
    spare = max(max_bits - n_segments + 1, 0)
    return Segments(n_words, [spare // n_segments + (k < spare % n_segments) for k in range(n_segments)])


def likely(n_codes: int, n_words: int = 4, share: float = 0.152, miss: float = 0.03) -> Segments:
    """Segments in which a pair whose bits differ with probability ``share`` each
    fails to meet with probability ``miss`` at most (as if cuts were independent).

    Their width follows the number of codes, so that about 32 share a key by chance
    at most; narrower segments would make tables quadratic. A quarter of the first
    cut's have balls of radius 1.
    """
    n_bits = 64 * n_words
    width = max(16, ceil(log2(max(n_codes, 1) / 32))) if n_codes > 32 else 16
    n = max(n_bits // width, -(-n_bits // 48))
    width = n_bits / n
    met0 = (1 - share) ** width
    met1 = met0 + width * share * (1 - share) ** (width - 1)
    balls = n // 4
    first = (1 - met1) ** balls * (1 - met0) ** (n - balls)
    more = max(0, ceil((log(miss) - log(first)) / (n * log(1 - met0))))
    return Segments(n_words, [1] * balls + [0] * (n - balls), more)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which codes differ; words are the rows of the arrays."""
    return np.bitwise_count(a ^ b).astype(np.int16).sum(axis=0)


def matches(cell: np.ndarray, block: np.ndarray, asks: np.ndarray, fp: np.ndarray, old: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of verified pairs of equal cells, of which one at least isn't
    ``old`` and one stands.

    Rows come sorted by cell, those that ask last. Of rows with a block (the
    others have -1) only those of different blocks are paired.
    """
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(begin, len(cell)))
    small = np.repeat(size <= 32, size)
    for d in range(1, int(size[size <= 32].max(initial=0))):
        i = np.flatnonzero(small[d:] & (cell[d:] == cell[:-d]) & ~(old[d:] & old[:-d]) & ~(asks[d:] & asks[:-d]) & ((block[d:] < 0) | (block[d:] != block[:-d])))
        i = i[distance(fp[:, i], fp[:, i + d]) <= max_bits]
        yield i, i + d
    for a, n in zip(begin[size > 32].tolist(), size[size > 32].tolist(), strict=True):
        for k in range(a, a + n - int(asks[a : a + n].sum())):
            other = np.arange(k + 1, a + n)
            ok = (distance(fp[:, k : k + 1], fp[:, k + 1 : a + n]) <= max_bits) & ~(old[k] & old[other]) & ((block[other] < 0) | (block[other] != block[k]))
            hit = other[ok]
            yield np.full(len(hit), k), hit


def _edges(max_bits: int, split: bool):
    """Edges of rows (key2, node, codes), or (key, cell, block, asks, node, codes) of split keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if split:
                key, part, block, asks, node, *words = (np.asarray(c) for c in batch.columns)
                cell = np.stack([key, part], axis=1)
            else:
                key2, node, *words = (np.asarray(c) for c in batch.columns)
                cell, asks, block = (key2 >> 1)[:, None], (key2 & 1).astype(bool), np.full(len(key2), -1)
            old = np.zeros(len(node), bool)
            fp = np.stack([w.view(np.uint64) for w in words])
            if keep is not None and (keep[0][-1] == cell[0]).all():
                cell, block, asks, node = (np.concatenate([x, y]) for x, y in zip(keep[:4], (cell, block, asks, node), strict=True))
                fp = np.concatenate([keep[4], fp], axis=1)
                old = np.concatenate([np.ones(len(keep[0]), bool), old])
            place = np.cumsum(np.concatenate([[0], (cell[1:] != cell[:-1]).any(axis=1)]))
            ea, eb, held = [], [], 0
            for i, j in matches(place, block, asks, fp, old, max_bits):
                ea.append(node[i])
                eb.append(node[j])
                held += len(i)
                if held > 1 << 20:
                    a, b = star_edges(np.concatenate(ea), np.concatenate(eb))
                    ea, eb, held = [a], [b], len(a)
            if held:
                a, b = star_edges(np.concatenate(ea), np.concatenate(eb))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
            last = (place == place[-1]) & ~asks  # of the last cell, what later rows can meet
            keep = (cell[last], block[last], asks[last], node[last], fp[:, last]) if last.any() else None

    return run


def split_keys(codes: DataFrame, seg: Segments, fps: list[str], block_rows: int) -> DataFrame:
    """key, ks and ka: into how many blocks those that stand under a key, and those
    that look it up, are split; only keys with more of either than ``block_rows``.

    More than that can look up a key only if under some value in its ball stand
    more than its part of them; so lookups are counted from such values alone.
    """

    def own():
        return lambda batch: pa.RecordBatch.from_arrays([pa.array(seg.own(_unsigned(batch, fps)).ravel())], ["key"])

    def around():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            table, value = key >> seg.shift, (key & ((1 << seg.shift) - 1)).view(np.uint64)
            found = []
            for t in np.unique(table).tolist():
                at = np.flatnonzero(table == t)
                found += [(k, n[at[who]]) for k, who in seg.around(t, value[at])]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)])) for k in (0, 1)], ["key", "n"])

        return each

    stand = map_batches(codes, own, "key long").groupBy("key").agg(F.count("*").alias("n"))
    warm = materialize(stand.where(F.col("n") > max(1, block_rows // seg.most_lookups)), "warm")
    asked = map_batches(warm.select("key", "n"), around, "key long, n long").groupBy("key").agg(F.sum("n").alias("asked")).where(F.col("asked") > block_rows)
    blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    both = warm.join(asked, "key", "full").where(F.greatest("n", "asked") > block_rows)
    return materialize(both.select("key", F.coalesce(blocks("n"), F.lit(1)).alias("ks"), F.coalesce(blocks("asked") + 1, F.lit(1)).alias("ka")), "hot")


def _unsigned(batch: pa.RecordBatch, fps: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(f)).view(np.uint64) for f in fps])


def links(nodes: DataFrame, seg: Segments, max_bits: int, block_rows: int, n_words: int = 1) -> DataFrame:
    """Edges (u, v) between ``node`` values of distinct codes fp0, fp1 ...: for
    each pair within ``max_bits`` that meets a path of such edges."""
    fps = names(n_words)

    def rows():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp, n = _unsigned(batch, fps), batch.num_rows
            stand = seg.own(fp)
            asked, who = seg.looked_up(fp)
            key2 = np.concatenate([stand.ravel() << 1, asked << 1 | 1])
            at = np.concatenate([np.tile(np.arange(n), len(stand)), who])
            return pa.RecordBatch.from_arrays([pa.array(key2), *(pa.array(np.asarray(batch.column(c))[at]) for c in ("node", *fps))], ["key2", "node", *fps])

        return each

    codes = nodes.select("node", *fps)
    every = map_batches(codes, rows, longs(["key2", "node", *fps]))
    hot = split_keys(codes, seg, fps, block_rows)
    n_hot = hot.count()
    key = F.shiftright("key2", 1)
    light = every if not n_hot else every.join(few(hot.select(F.col("key").alias("hot_key")), n_hot), key == F.col("hot_key"), "left_anti")
    dealt = light.repartition(key).sortWithinPartitions("key2")
    found = materialize(map_batches(dealt, lambda: _edges(max_bits, False), "u long, v long", whole=True), "links")
    if not n_hot:
        return found
    # under a split key each pair of blocks of those that stand is a cell, and each
    # pair of a block of those that ask and a block of those that stand
    own = F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("ka")).otherwise(F.col("ks"))).cast("long")
    picked = every.join(few(hot.withColumnRenamed("key", "hot_key"), n_hot), key == F.col("hot_key")).select(key.alias("key"), "ks", "ka", (F.col("key2") % 2 == 1).alias("asks"), "node", *fps)
    picked = picked.withColumn("own", own)
    pair = lambda a, b: F.shiftleft(a.cast("long"), 31) + b
    ask_cell = lambda a, s: pair(a, s) + (1 << 62)
    stands = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("ks") - 1), lambda j: F.struct(pair(F.least(F.col("own"), j.cast("long")), F.greatest(F.col("own"), j.cast("long"))).alias("cell"), F.when(F.col("own") == j, F.lit(-1)).otherwise(F.col("own")).cast("long").alias("block"))),
        F.transform(F.sequence(F.lit(0), F.col("ka") - 1), lambda j: F.struct(ask_cell(j, F.col("own")).alias("cell"), F.col("own").alias("block"))),
    )
    asking = F.transform(F.sequence(F.lit(0), F.col("ks") - 1), lambda j: F.struct(ask_cell(F.col("own"), j.cast("long")).alias("cell"), F.lit(-1).cast("long").alias("block")))
    cells = picked.select("key", "asks", "node", *fps, F.explode(F.when(F.col("asks"), asking).otherwise(stands)).alias("c"))
    cells = cells.select("key", "c.cell", "c.block", "asks", "node", *fps)
    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "asks")
    return found.unionByName(materialize(map_batches(dealt, lambda: _edges(max_bits, True), "u long, v long", whole=True), "links"))


def simhash_components(docs: DataFrame, width: int = 5, max_bits: int = 4, n_segments: int | None = None, block_rows: int = 8192) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``.

    By default there are three segments (21 bits) for up to 2^26 fingerprints, and two beyond.
    """
    with scratch(docs.sparkSession) as keep:
        each = materialize(fingerprints(docs, width), "fp")
        nodes = materialize(each.groupBy("fp0").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp0")), "nodes")
        if n_segments is None:
            n_segments = 3 if nodes.count() <= 1 << 26 else 2
        roots = connected_components(links(nodes, complete(max_bits, n_segments), max_bits, block_rows))
        rooted = materialize(nodes.join(roots, "node", "left").select("fp0", "least", F.coalesce("root", "node").alias("root")), "roots")
        low = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "low")
        keep(each, rooted, low)
    named = rooted.join(low, "root").select("fp0", "component_id")
    return each.join(named, "fp0").select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


# --- the filter ---------------------------------------------------------------------------------


def text_keys(docs: DataFrame) -> list[Column]:
    """doc_id and 128 bits of a hash of the text: what tells rows apart."""
    return [docs["doc_id"].cast("long"), F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])]


KEY, SET = ["doc", "t0", "t1"], ["s0", "s1"]


def sketches(docs: DataFrame, width: int, n_words: int) -> DataFrame:
    """KEY, SET (128 bits of a hash of its set of shingles) and code of each row with a doc_id."""
    fps = names(n_words)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.zeros((batch.num_rows, 2 + n_words), np.int64)
            for k, text in enumerate(to_bytes(batch.column(3))):
                h = np.unique(shingle_hashes(text, width))
                rows[k, :2] = np.frombuffer(xxhash.xxh128_digest(h.tobytes()), np.int64)
                rows[k, 2:] = code(h, n_words)
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in rows.T.copy())], [*KEY, *SET, *fps])

        return each

    named = docs.select(*(c.alias(k) for c, k in zip(text_keys(docs), KEY, strict=True)), docs["text"].alias("text")).where("doc is not null")
    return map_batches(named, make, longs([*KEY, *SET, *fps]))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """root, node and hashes (sorted, each once) of rows root, node, text."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(x, width)).view(np.int64) for x in to_bytes(batch.column(2))]
            stops = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(sets)))], ["root", "node", "hashes"])

        return each

    return map_batches(texts.select("root", "node", "text"), make, "root long, node long, hashes array<long>")


def similar(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of a left and a right set with that Jaccard similarity."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    _, at, many = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    column = np.where(many > 1, np.cumsum(many > 1) - 1, -1)[at]  # what is in one set only isn't shared
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(left), len(right)))
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(left) + len(right), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        shared += has[: len(left)] @ has[len(left) :].T
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    return np.nonzero(shared >= least * union - 1e-9)


def _verified(least: float):
    """Edges of the verified pairs in each cell: rows of block ``lo`` against those of ``hi``."""

    def cell(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(rows).combine_chunks()
        own, node = np.asarray(t.column("own").combine_chunks()), np.asarray(t.column("node").combine_chunks())
        lists = t.column("hashes").combine_chunks()
        flat, cut = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        sets = [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(a) or not len(b):
            return node[:0], node[:0]
        i, j = similar([sets[k] for k in a], [sets[k] for k in b], least)
        u, v = node[a[i]], node[b[j]]
        return star_edges(u[u != v], v[u != v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            done = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(keys[a].tolist())
                if held and now != last:
                    done.append(cell(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in done])) for k in (0, 1)], ["u", "v"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cell(held)], ["u", "v"])

    return run


def _compared(cells: DataFrame, least: float) -> DataFrame:
    """Edges found in the cells (root, lo, hi) of rows own, node, hashes."""
    rows = cells.select("root", "lo", "hi", "own", "node", "hashes")
    dealt = rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return materialize(map_batches(dealt, lambda: _verified(least), "u long, v long", whole=True), "verified")


def verified_links(sets: DataFrame, least: float, block: int, block_bytes: int) -> DataFrame:
    """Edges (u, v) for a path between each pair of nodes of one root whose sets have
    that Jaccard similarity.

    What fits a block is compared pair by pair. In a larger component all are
    compared with some leaders first. Then only pairs of which one isn't in the
    component's largest class are left, and these are compared, block by block:
    work grows with the product of a component and what its leaders don't hold together.
    """
    size = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("hashes")).alias("items"))
    k = F.greatest(F.ceil(F.greatest(F.col("n") / block, 8 * F.col("items") / block_bytes)), F.lit(1)).cast("int")
    size = materialize(size.where("n > 1").select("root", "n", k.alias("k")), "sizes")
    small = sets.join(size.where("k = 1"), "root").select("root", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("own"), "node", "hashes")
    found = _compared(small, least)
    large = size.where("k > 1")
    if large.isEmpty():
        return found
    rows = sets.join(large, "root")
    leads = F.pmod(F.xxhash64("node"), F.col("n")) < LEADERS
    own = F.when(leads, F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.lit(1), "node"), F.col("k"))).cast("int")
    rows = rows.withColumn("own", own)
    blocks = F.when(F.col("own") < 0, F.sequence(F.lit(-1), F.col("k") - 1)).otherwise(F.array("own"))
    led = rows.select("root", F.lit(-1).alias("lo"), F.explode(blocks).alias("hi"), "own", "node", "hashes")
    found = found.unionByName(_compared(led, least))
    classes = connected_components(found)
    of = rows.select("root", "node", "k").join(classes.withColumnRenamed("root", "class"), "node", "left").select("root", "node", "k", F.coalesce("class", "node").alias("class"))
    of = materialize(of, "classes")
    most = of.groupBy("root", "class").count().groupBy("root").agg(F.max_by("class", F.struct("count", "class")).alias("largest"))
    left = materialize(of.join(most, "root").select("root", "node", "k", (F.col("class") != F.col("largest")).alias("apart")), "left")
    rest = materialize(left.where("apart").groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("r")), "rest")
    if rest.isEmpty():
        return found
    # blocks -1 to -r of what is apart, 0 to k - 1 of the largest class
    placed = left.join(rest, "root").select("root", "node", "k", "r", F.when(F.col("apart"), -1 - F.pmod(F.xxhash64("node"), F.col("r"))).otherwise(F.pmod(F.xxhash64(F.lit(1), "node"), F.col("k"))).cast("int").alias("own"))
    other = F.when(F.col("own") < 0, F.sequence(-F.col("r"), F.col("k") - 1)).otherwise(F.sequence(-F.col("r"), F.lit(-1)))
    cells = placed.select("root", "node", "own", F.explode(other).alias("j")).select("root", "node", "own", F.least("own", "j").alias("lo"), F.greatest("own", "j").alias("hi"))
    return found.unionByName(_compared(cells.join(sets, ["root", "node"]), least))


def drop_near_copies(docs: DataFrame, least: float = 0.8, width: int = 5, n_words: int = 4, max_bits: int = 64, block: int = 512, block_bytes: int = 8 << 20, block_rows: int = 8192) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest doc_id (of several
    texts of one doc_id in a group any one; of equal rows one).

    Documents are linked if their sets of shingles have a Jaccard similarity of
    ``least``. Codes of 256 bits only find who is compared, in ``likely`` segments
    whose radii make all pairs meet that differ in few bits, and others with
    a probability that the README states; the sets of what a component of codes holds are
    compared exactly. Texts without words are one group. A doc_id with texts in
    several groups keeps a row in each. A row without doc_id can't be told from
    others by name; it stays. Texts are moved only where they are compared, or
    where equal rows repeat; columns are handed on as they are, whatever their names.
    """
    fps = names(n_words)
    on = lambda keys: [a.eqNullSafe(keys[b]) for a, b in zip(text_keys(docs), KEY, strict=True)]
    with scratch(docs.sparkSession) as keep:
        each = materialize(sketches(docs, width, n_words).groupBy(*KEY).agg(F.count("*").alias("many"), *(F.first(c).alias(c) for c in (*SET, *fps))), "sketches")
        nodes = each.groupBy(*SET).agg(F.min(F.struct(*KEY)).alias("first"), *(F.first(f).alias(f) for f in fps))
        nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "first", *fps), "nodes")
        roots = connected_components(links(nodes, likely(nodes.count(), n_words), max_bits, block_rows, n_words))
        members = materialize(roots.join(nodes.select("node", "first.*"), "node"), "members")
        texts = docs.join(few(members), on(members)).select(members["root"], members["node"], docs["text"])
        sets = materialize(shingle_sets(texts, width), "sets")
        repeated = not each.where("many > 1").isEmpty()
        if repeated:
            sets = materialize(sets.dropDuplicates(["node"]), "sets")
        classes = connected_components(verified_links(sets, least, block, block_bytes))
        held = nodes.select("node", "first").join(classes, "node", "left")
        stay = materialize(held.groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("first").alias("first")).select("first.*"), "stay")
        again = materialize(each.where("many > 1").select(*KEY).join(stay, KEY, "left_semi"), "again")
        gone = materialize(each.select(*KEY).join(stay, KEY, "left_anti").unionByName(again), "gone")
        keep(again, gone)
    kept = docs.join(few(gone), on(gone), "left_anti")
    if not repeated:
        return kept
    once = docs.join(few(again), on(again), "left_semi")
    once = once.groupBy(*text_keys(once)).agg(F.first(F.struct(*(once[c] for c in docs.columns))).alias("row"))
    return kept.unionByName(once.select("row.*"))
