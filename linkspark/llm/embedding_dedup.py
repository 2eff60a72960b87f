"""Operator 5, embedding near-duplicates by sorted projection passes.

Vectors of one label, less the label's mean, are ordered by the signs of their
projections on random directions, concatenated to a key; each is compared with those
within a window after it. Every pass has its own directions, so what one pass puts far
apart another brings together; verified pairs of all passes are united. Vectors in
dense places have more partners than a window holds: in a second step the vectors
of a found component are compared with each other, in blocks, which gives each
vector the exact number of its links. Only counts leave a block. Of a component that
fills more than a block, those so close to its centre that any two of them link are
counted and not compared; what is outside that core is compared with all it can link with.

Equal vectors are one class from the start. Classes are dealt by position in the
order, not by label, so a label of any size spreads evenly. A window ends where
its task's rows end; other passes cut elsewhere.

Null labels, and vectors that are null, empty, zero or hold null or non-finite
components, link with nothing (0 links, their own component); so do vectors of
different lengths. Long vectors are compared whole. A null vec_id names no component
where another is known, and its row isn't kept. Ties: rows that repeat a vec_id and
a vector are each a row of the result. Columns besides vec_id, embedding and label
aren't looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, map_batches, materialize, scratch, star_edges

KEY_BITS = 62
MEANS_BYTES = 16 << 20  # of the means that come to the driver, those of the largest labels


def _matrix(column: pa.Array, dim: int, single: bool) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), "<f4" if single else "<f8")
    return raw.reshape(-1, dim).astype(np.float64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, classes, single): every row with its class (null if it can't link),
    and a row per class of equal vectors: node, label, dim, vec (bytes), many, least."""
    kind = embeddings.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "label", "dim", "vec"]
        for batch in batches:
            vecs, dims, labels = [], [], []
            for label, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                v = None
                if label is not None and x.is_valid and len(x) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8") + 0.0  # no -0.0
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                vecs.append(None if v is None else v.tobytes())
                dims.append(None if v is None else len(v))
                labels.append(label)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names)

    picked = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["label"].cast("string").alias("label"), "embedding")
    every = map_batches(picked, lambda: run, "vec_id long, label string, dim int, vec binary", whole=True)
    digest = F.when(F.col("vec").isNotNull(), F.sha2(F.concat(F.col("label").cast("binary"), F.lit(b"\0"), F.col("vec")), 256))
    every = materialize(every.withColumn("class", digest), "vectors")
    found = every.where("class is not null").groupBy("class").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count("*").alias("many"), F.min("vec_id").alias("least"))
    nodes = materialize(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    return every, nodes, single


def label_means(nodes: DataFrame, single: bool, window: int) -> dict[tuple[str, int], np.ndarray]:
    """The mean unit vector of each (label, dim) that a window doesn't hold whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim, vec = batch.columns
            groups: dict[tuple[str, int], list[int]] = {}
            for k, g in enumerate(zip(label.to_pylist(), dim.to_pylist(), strict=True)):
                groups.setdefault(g, []).append(k)
            sums = [unit(_matrix(vec.take(pa.array(at)), g[1], single)).sum(axis=0).tolist() for g, at in groups.items()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.int32()), pa.array(sums, pa.list_(pa.float64()))], ["label", "dim", "sums"])

    size = nodes.groupBy("label", "dim").count().where(F.col("count") > window)
    order = [F.desc("count"), "label", "dim"]
    widest = nodes.agg(F.max("dim")).first()[0] or 1
    large = {(r.label, r.dim): r["count"] for r in size.orderBy(*order).limit(max(1, MEANS_BYTES // (8 * widest))).collect()}
    if not large:
        return {}
    picked = nodes.join(F.broadcast(nodes.sparkSession.createDataFrame(list(large), "label string, dim int")), ["label", "dim"], "left_semi")
    parts = map_batches(picked.select("label", "dim", "vec"), lambda: run, "label string, dim int, sums array<double>", whole=True)
    at = parts.select("label", "dim", F.posexplode("sums").alias("k", "x")).groupBy("label", "dim", "k").agg(F.sum("x").alias("x"))
    means = {g: np.zeros(g[1]) for g in large}
    for r in at.toLocalIterator():
        means[r.label, r.dim][r.k] = r.x / large[r.label, r.dim]
    return means


def _keys(passes: list[int], single: bool, seed: int, means: dict[tuple[str, int], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            node, label, dim, vec = batch.columns
            dims = np.asarray(dim)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                at = pa.array(rows)
                x = unit(_matrix(vec.take(at), d, single))
                names = label.take(at).to_pylist()
                for name in {n for n in names if (n, d) in means}:
                    x[[n == name for n in names]] -= means[name, d]
                for p in passes:
                    if (p, d) not in directions:
                        directions[p, d] = np.random.default_rng((seed, p, d)).normal(size=(d, KEY_BITS))
                    key = ((x @ directions[p, d]) > 0) @ (1 << np.arange(KEY_BITS, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), p, np.int32)), label.take(at), dim.take(at), pa.array(key), node.take(at), vec.take(at)], ["pass", "label", "dim", "key", "node", "vec"])

    return run


def _windows(window: int, least: float, single: bool):
    """Edges between vectors at most ``window`` apart in a task's sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            old = 0 if keep is None else keep.num_rows
            if old:
                batch = pa.Table.from_batches([keep, batch]).combine_chunks().to_batches()[0]
            p, label, dim, _, node, vec = batch.columns
            dims, nodes = np.asarray(dim), np.asarray(node)
            same = np.unique(np.array([f"{a}\0{b}\0{c}" for a, b, c in zip(p.to_pylist(), dims.tolist(), label.to_pylist(), strict=True)]), return_inverse=True)[1]
            u, v = [], []
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x, g, n = unit(_matrix(vec.take(pa.array(rows)), d, single)), same[rows], nodes[rows]
                for shift in range(1, min(window, len(rows) - 1) + 1):
                    i = np.flatnonzero((g[shift:] == g[:-shift]) & (rows[shift:] >= old))
                    ok = i[np.einsum("ij,ij->i", x[i], x[i + shift]) >= least]
                    u.append(n[ok])
                    v.append(n[ok + shift])
            keep = batch.slice(max(0, batch.num_rows - window))
            a, b = star_edges(np.concatenate(u or [nodes[:0]]), np.concatenate(v or [nodes[:0]]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    return run


def window_edges(nodes: DataFrame, single: bool, least: float, window: int, passes: int, passes_at_once: int, seed: int) -> DataFrame:
    """Edges of all passes. So many passes as one job sorts at once bound the disk."""
    found = None
    side = nodes.select("node", "label", "dim", "vec")
    shared = nodes.sparkSession.sparkContext.broadcast(label_means(nodes, single, window))  # of MEANS_BYTES at most
    for at in range(0, passes, passes_at_once):
        keyed = map_batches(side, lambda at=at: _keys(list(range(at, min(at + passes_at_once, passes))), single, seed, shared.value), "pass int, label string, dim int, key long, node long, vec binary", whole=True)
        order = ["pass", "label", "dim", "key", "node"]
        part = materialize(map_batches(keyed.repartitionByRange(*order).sortWithinPartitions(*order), lambda: _windows(window, least, single), "u long, v long", whole=True), "links")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _count(least: float, single: bool, block: int):
    """Links of each vector in its cell of one component's block, or of two."""

    def cell(rows: list[pa.RecordBatch], out: list) -> None:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        lo, hi, own = (np.asarray(t.column(k)) for k in (1, 2, 3))
        x = unit(_matrix(t.column(7), t.column(6)[0].as_py(), single))
        many, nodes = np.asarray(t.column(5)), np.asarray(t.column(4))
        if lo[0] == hi[0]:
            links = np.concatenate([((x[a : a + 512] @ x.T) >= least) @ many for a in range(0, len(x), 512)]) - many  # less its own class
            out.append((nodes, links))
        else:
            a, b = own == lo[0], own == hi[0]
            ok = (x[a] @ x[b].T) >= least
            out += [(nodes[a], ok @ many[b]), (nodes[b], ok.T @ many[a])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out: list = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(keys[a].tolist())
                if held and now != last:
                    cell(held, out)
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]))], ["node", "links"])
        if held:
            out = []
            cell(held, out)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]))], ["node", "links"])

    return run


def _by_root(single: bool):
    """Per batch and root the sum of unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, dim, vec = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
            roots, sums = [], []
            for r in np.unique(root).tolist():
                at = np.flatnonzero(root == r)
                roots.append(r)
                sums.append(unit(_matrix(vec.take(pa.array(at)), int(dim[at[0]]), single)).sum(axis=0).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], ["root", "sums"])

    return run


def _kinds(least: float, single: bool):
    """Adds ``kind``: 0 so close to the centre that any two of this kind link, 1 close
    enough to link with one of them, 2 farther away."""
    half = np.arccos(least) / 2
    core, far = np.cos(half) + 1e-9, np.cos(min(3 * half + 1e-6, np.pi))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            dim, kind = np.asarray(batch.column(3)), np.empty(batch.num_rows, np.int32)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                x = unit(_matrix(batch.column(4).take(pa.array(at)), d, single))
                c = np.asarray(batch.column(5).take(pa.array(at)).flatten()).reshape(-1, d)
                near = (x * c).sum(axis=1) / np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-300)
                kind[at] = np.where(near >= core, 0, np.where(near >= far, 1, 2))
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(kind)], ["root", "node", "many", "dim", "vec", "kind"])

        return each

    return make


def _counted(cells: DataFrame, single: bool, least: float, block: int) -> DataFrame:
    dealt = cells.select("root", "lo", "hi", "own", "node", "many", "dim", "vec").repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "node")
    return map_batches(dealt, lambda: _count(least, single, block), "node long, links long", whole=True)


def count_links(nodes: DataFrame, roots: DataFrame, single: bool, least: float, block: int) -> DataFrame:
    """node, links: rows linked with the class, without its own.

    What fits a block is compared pair by pair. In a larger component all vectors
    within half the angle of ``least`` of its centre link with each other without
    being compared (one far group of near copies is such a core); pairs with one
    outside the core are compared, block by block, but for those too far away to
    link with the core.
    """
    size = roots.groupBy("root").agg(F.count("*").alias("n"))
    joined = materialize(roots.join(size, "root").join(nodes.select("node", "many", "dim", "vec"), "node").select("root", "node", "many", "dim", "vec", "n"), "members")
    zero = F.lit(0)
    found = _counted(joined.where(F.col("n") <= block).select("*", zero.alias("lo"), zero.alias("hi"), zero.alias("own")), single, least, block)
    large = joined.where(F.col("n") > block)
    if large.isEmpty():
        return found.groupBy("node").agg(F.sum("links").alias("links"))
    sums = map_batches(large.select("root", "dim", "vec"), lambda: _by_root(single), "root long, sums array<double>", whole=True)
    cells = sums.select("root", F.posexplode("sums").alias("k", "x")).groupBy("root", "k").agg(F.sum("x").alias("x"))
    centre = materialize(cells.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("centre")), "centres")
    told = large.select("root", "node", "many", "dim", "vec").join(centre, "root").select("root", "node", "many", "dim", "vec", "centre")
    told = materialize(map_batches(told, _kinds(least, single), "root long, node long, many long, dim int, vec binary, kind int"), "kinds")
    of = lambda k: F.count(F.when(F.col("kind") == k, 1))
    blocks = lambda k: F.ceil(of(k) / block).cast("int")
    plan = told.groupBy("root").agg(blocks(0).alias("kc"), blocks(1).alias("rn"), blocks(2).alias("rf"), F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("many"))), F.lit(0)).alias("core"))
    plan = materialize(plan, "plan")
    placed = told.join(plan, "root")
    inner = placed.where("kind = 0").select("node", (F.col("core") - F.col("many")).alias("links"))
    # blocks 0 to kc - 1 of the core, -1 to -rn of those near, then rf of those far
    h = F.xxhash64("node")
    own = F.when(F.col("kind") == 0, F.pmod(h, F.col("kc"))).when(F.col("kind") == 1, -1 - F.pmod(h, F.col("rn"))).otherwise(-1 - F.col("rn") - F.pmod(h, F.col("rf")))
    lowest = -F.col("rn") - F.col("rf")
    other = F.when(F.col("kind") == 0, F.when(F.col("rn") > 0, F.sequence(-F.col("rn"), F.lit(-1)))).when(F.col("kind") == 1, F.sequence(lowest, F.col("kc") - 1)).otherwise(F.sequence(lowest, F.lit(-1)))
    outer = placed.withColumn("own", own.cast("int")).select("root", "node", "many", "dim", "vec", "own", F.explode(other).alias("j"))
    outer = outer.select("*", F.least("own", "j").alias("lo"), F.greatest("own", "j").alias("hi"))
    return found.unionByName(inner).unionByName(_counted(outer, single, least, block)).groupBy("node").agg(F.sum("links").alias("links"))


def embedding_components(embeddings: DataFrame, least: float = 0.98, window: int = 48, passes: int = 48, passes_at_once: int = 4, block: int = 1024, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings``."""
    with scratch(embeddings.sparkSession) as keep:
        rows, nodes, single = classes(embeddings)
        roots = materialize(connected_components(window_edges(nodes, single, least, window, passes, passes_at_once, seed)), "roots")
        links = count_links(nodes, roots, single, least, block)
        known = nodes.select("node", "class", "many", "least").join(roots, "node", "left").join(links, "node", "left")
        known = materialize(known.select("class", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")), "classes")
        low = materialize(known.groupBy("root").agg(F.min("least").alias("component_id")), "low")
        keep(known, low, rows)
    named = known.join(low, "root").select("class", "n_links", "component_id", F.lit(True).alias("linked"))
    out = rows.select("vec_id", "class").join(named, "class", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
