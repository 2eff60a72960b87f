"""Shared pieces of the llm operators: shared storage, Arrow batches, components."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path

#: Rows and bytes of an Arrow batch: documents are long, workers are small.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20

#: Rows of a few short columns that may be broadcast (about 50 MB).
BROADCAST_ROWS = 300_000

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])

#: The ASCII white space that ends a word (a fixed value of the word rule).
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds.

    The setting belongs to the session and stays lowered, as a lazy plan runs with
    what is set then; it changes no result. A lower one is left as it is. Also lets
    Python workers find this package where they share the driver's disk, from whatever
    folder the driver was started; on a cluster it is shipped with --py-files or installed.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Deletes the tables that are materialized within, but for those given to
    what it yields, which a later plan reads."""
    paths: list[str] = []
    kept: set[str] = set()
    token = _OPEN.set(paths)
    try:
        yield lambda *tables: kept.update(df._shared_path for df in tables)
    finally:
        _OPEN.reset(token)
        for path in paths:
            if path not in kept:
                delete(spark, path)
        if (outer := _OPEN.get()) is not None:
            outer += sorted(kept)


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    if (paths := _OPEN.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for df in tables:
        delete(df.sparkSession, df._shared_path)


def few(keys: DataFrame, n: int | None = None) -> DataFrame:
    """Slim rows of a join, to be broadcast if they are counted to be few."""
    n = keys.count() if n is None else n
    return F.broadcast(keys) if n <= BROADCAST_ROWS else keys


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded rows and bytes, whatever the session's settings are."""
    step = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def give_back() -> None:
    """Returns free memory to the machine: workers live on between tasks, and what
    one of them keeps the others on its executor lack."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str, whole: bool = False) -> DataFrame:
    """``mapInArrow`` of one function per slice of a batch, or (``whole``) of one that
    goes through all batches of a task; ``make`` builds it once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        if whole:
            yield from each(batches)
        else:
            for batch in batches:
                for part in parts(batch):
                    yield each(part)
        del each
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def to_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of all texts (null: none), which one stands at each place,
    and the text that each place is in."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
    text = np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths()))
    if b"" in words:  # where white space begins or ends a text
        there = at != words.index(b"")
        at, text = at[there], text[there]
    return words, at, text


class IdStore:
    """Ids of words in flat arrays, and other numbers of theirs by name.

    A word is known by its slot. Where words take more than ``limit`` bytes, the
    least used are forgotten between two batches, down to half of it: a bound on
    a worker's memory whatever the words are.
    """

    ENTRY = 160  # bytes of a word besides its letters and ids

    def __init__(self, limit: int = 32 << 20, **columns):
        self.limit, self.kinds = limit, {"start": np.int64, "size": np.int32, "uses": np.int32} | columns
        self.clear()

    def clear(self) -> None:
        self.slots, self.bytes, self.filled = {}, 0, 0
        self.flat = np.empty(1 << 12, np.uint32)
        self.columns = {k: np.zeros(1 << 10, t) for k, t in self.kinds.items()}

    def trim(self) -> None:
        """Slots that were given out before are void after this."""
        if self.bytes <= self.limit:
            return
        words, columns = list(self.slots), self.columns
        cost = self.ENTRY + 4 * columns["size"][: len(words)].astype(np.int64) + np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-columns["uses"][: len(words)], kind="stable")
        kept = order[: np.searchsorted(np.cumsum(cost[order]), self.limit // 2)]
        ids, size = self.gather(kept)
        self.clear()
        slots = self.of([words[k] for k in kept.tolist()])[0]
        self.put(slots, size, ids, **{k: columns[k][kept] for k in columns if k not in ("start", "size", "uses")})
        self.columns["uses"][slots] = columns["uses"][kept] // 2

    def of(self, words: list) -> tuple[np.ndarray, list]:
        """The slots of distinct words, and those of them that are new: without ids until ``put``."""
        got = np.fromiter(map(self.slots.get, words, repeat(-1)), np.int32, len(words))
        fresh = np.flatnonzero(got < 0)
        new = [words[k] for k in fresh.tolist()]
        if new:
            n = len(self.slots)
            got[fresh] = np.arange(n, n + len(new))
            self.slots.update(zip(new, range(n, n + len(new)), strict=True))
            self.bytes += self.ENTRY * len(new) + sum(map(len, new))
            for k, a in self.columns.items():
                if len(a) < len(self.slots):
                    self.columns[k] = np.concatenate([a, np.zeros((2 * len(self.slots) - len(a), *a.shape[1:]), a.dtype)])
        return got, new

    def used(self, slots: np.ndarray, times: np.ndarray) -> None:
        self.columns["uses"][slots] += times.astype(np.int32)

    def put(self, slots: np.ndarray, size: np.ndarray, flat: np.ndarray, **values: np.ndarray) -> None:
        stop = self.filled + len(flat)
        if stop > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(2 * stop - len(self.flat), np.uint32)])
        self.flat[self.filled : stop] = flat
        values |= {"start": self.filled + np.cumsum(size) - size, "size": size}
        for k, v in values.items():
            self.columns[k][slots] = v
        self.bytes += 4 * len(flat)
        self.filled = stop

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots one after another, and how many each has."""
        size = self.columns["size"][slots]
        stop = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.columns["start"][slots] - stop + size, size)
        at += np.arange(len(at))
        return self.flat[at], size


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a local edge list: its nodes and each one's smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[ia], lab[ib])
        new = lab.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        np.minimum.at(new, lab[ia], low)
        np.minimum.at(new, lab[ib], low)
        new = new[new]
        if np.array_equal(new, lab):
            return nodes, nodes[lab]
        lab = new


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges with the same components: each node with its smallest."""
    if not len(a):
        return a, b
    nodes, root = labels_of(a, b)
    keep = nodes != root
    return nodes[keep], root[keep]


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v longs); root: the smallest node.

    Alternating large-star and small-star rounds. Each round is written to the
    shared folder, so a lost executor costs one round; neither links nor labels
    come to the driver, which sees a count and a checksum a round. A node with
    very many links is first reduced by a partial minimum and then joined back
    in a plain equi-join, which the adaptive skew join splits.
    """
    now = materialize(_oriented(edges.select("u", "v")), "cc")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(now)
        discard(large)
        now, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def learn_side(column: str, modulus: int, held: int):
    """True for rows that the contract holds out: crc32(id as text) mod m = h."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == held, F.lit(False))
