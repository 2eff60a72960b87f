"""What the two trained filters share: a bounded labelled sample and its texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, give_back, learn_side, materialize, scratch

SAMPLE_BYTES = 64 << 20  # of the texts of a class


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, per_class: tuple[int, int], of: Callable = str, sample_bytes: int = SAMPLE_BYTES) -> list[tuple]:
    """(doc_id, ``of`` the text, label) of at most ``per_class[y]`` rows of class y.

    Documents are taken in the order of a hash of their id, never those that the
    contract holds out (crc32(doc_id) mod ``modulus`` = ``held``), until there are enough
    or their texts have ``sample_bytes``; no text is too long to be one of them. Of
    several texts of a doc_id the smallest counts, of several labels the smallest.
    The ids come from the labels, with a margin for those that ``docs`` lacks, so texts
    are gone through once where the margin suffices (else again, with a wider one).
    Both bounds together bound what is broadcast and what comes to the driver,
    where the model is trained.
    """
    spark = docs.sparkSession
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[target].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~learn_side("doc_id", modulus, held)).groupBy("doc_id").agg(F.min("y").alias("y"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where("text <> ''")
    margin = 2
    while True:
        with scratch(spark):
            asked, n = [], []
            for y in (0, 1):
                rows = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(margin * per_class[y]).collect()
                asked += [(r.doc_id, r.y, k) for k, r in enumerate(rows)]
                n.append(len(rows))
            if not asked:
                return []
            ids = few(spark.createDataFrame(asked, "doc_id long, y int, nth int"), len(asked))
            found = materialize(texts.join(ids, "doc_id").groupBy("doc_id", "y", "nth").agg(F.min("text").alias("text")), "sample")
            sizes = sorted((r.y, r.nth, r.doc_id, r.n) for r in found.select("y", "nth", "doc_id", F.octet_length("text").alias("n")).collect())
            have = [sum(r[0] == y for r in sizes) for y in (0, 1)]
            if any(have[y] < per_class[y] and n[y] == margin * per_class[y] for y in (0, 1)):
                margin *= 4  # labels go on, and too many of these had no text
                continue
            picked, left, room = [], list(per_class), [sample_bytes, sample_bytes]
            for y, _, doc_id, size in sizes:
                if left[y] and room[y] > 0:
                    picked.append((doc_id,))
                    left[y] -= 1
                    room[y] -= size
            if not picked:
                return []
            rows = found.join(few(spark.createDataFrame(picked, "doc_id long"), len(picked)), "doc_id")
            out = [(r.doc_id, of(r.text), r.y) for r in rows.orderBy("doc_id").select("doc_id", "text", "y").toLocalIterator()]
            give_back()
            return out
