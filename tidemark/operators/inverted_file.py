"""Nearest topics by an inverted file, for so many topics that not every document can meet every topic.

Topics lie in lists, each around a coarse centroid (k-means on a bounded sample of topics). A document meets the topics
of its ``probes`` nearest lists. ``probes_for`` finds the fewest lists with which a bounded sample of documents, compared with
all topics, finds its nearest as often as a target says; ``measured_recall`` states the share found. ``nearest_topic`` compares
with all topics and stays the exact way.

Lists are of bounded size (``LIST`` topics: longer ones are cut), documents come to a list in packs, so a task holds a
list's part and a pack. The centroids, ``LISTS`` at most, are broadcast; topics are not.

Zero, null and non-finite vectors match nothing. Ties to nine digits go to the smallest topic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.discovery import stored
from tidemark.operators.topics import dot

#: The most coarse centroids, topics of a list's part, documents of a pack, rows of the samples, share of nearest topics to find.
LISTS, LIST, PACK, SAMPLE, RECALL = 4096, 4096, 8192, 1 << 14, 0.95
#: Documents of which recall is measured.
ASKED = 512


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """key, u: unit vectors of the rows that have one."""
    x = F.transform(vec, lambda e: e.cast("double"))
    fine = F.forall(vec, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(vec, lambda e: e != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).select(key, F.transform(x, lambda e: e / F.sqrt(dot(x, x))).alias("u"))


def coarse(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    c = x[np.random.default_rng(0).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (mine := near == j).any():
                c[j] = x[mine].sum(0)
        norm = np.linalg.norm(c, axis=1)
        c[norm > 0] /= norm[norm > 0, None]
    return c


class InvertedFile:
    def __init__(self, topics: DataFrame, key: str = "topic_id", vec: str = "centroid", lists: int | None = None):
        self.spark, self.key = topics.sparkSession, key
        rows = stored(unit_rows(topics, key, vec))
        count = rows.count()
        lists = lists or int(min(LISTS, max(1, round(count**0.5))))
        sample = rows.select("u").orderBy(F.xxhash64(key), key).limit(max(SAMPLE, 4 * lists)).toArrow()  # bounded, for the centroids only
        self.centroids = self.spark.sparkContext.broadcast(coarse(matrix(sample["u"]), lists) if count else np.zeros((0, 0)))
        shared, kind = self.centroids, rows.schema[key].dataType.simpleString()

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = (matrix(b["u"]) @ shared.value.T).argmax(1) if b.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int64))], names=[key, "u", "list"])

        filed = rows.mapInArrow(file, f"{key} {kind}, u array<double>, list long") if count else rows.withColumn("list", F.lit(0).cast("long"))
        parts = filed.groupBy("list").agg(F.ceil(F.count("*") / LIST).alias("parts"))
        self.lists = stored(filed.join(parts, "list").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts"))))

    def search(self, docs: DataFrame, probes: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
        """key, the topic's key, similarity: the nearest topic of the document's ``probes`` nearest lists."""
        shared, topic = self.centroids, self.key
        rows = unit_rows(docs, key, vec).select(F.col(key).alias("key"), "u")
        kind, topic_kind = rows.schema["key"].dataType.simpleString(), self.lists.schema[topic].dataType.simpleString()

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches if len(shared.value) else ():
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    s, n = matrix(part["u"]) @ shared.value.T, min(probes, len(shared.value))
                    near = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    out = part.take(pa.array(np.repeat(np.arange(part.num_rows), n)))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel().astype(np.int64))], names=["key", "u", "list"])

        asked = stored(rows.mapInArrow(probe, f"key {kind}, u array<double>, list long"))
        packs = asked.groupBy("list").agg(F.ceil(F.count("*") / PACK).alias("packs"))
        sizes = self.lists.select("list", "parts").distinct()
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        left = asked.join(packs, "list").join(sizes, "list").withColumn("pack", F.pmod(F.xxhash64("key"), F.col("packs"))).select("list", "pack", every(F.col("parts")).alias("part"), "key", "u")
        right = self.lists.join(packs, "list").select(F.col("list").alias("l"), every(F.col("packs")).alias("p"), F.col("part").alias("q"), F.col(topic).alias("ref"), F.col("u").alias("v"))

        def meet(docs: pa.Table, refs: pa.Table) -> pa.Table:
            if not docs.num_rows or not refs.num_rows:
                return pa.table({"key": docs["key"].slice(0, 0), "ref": refs["ref"].slice(0, 0), "similarity": pa.array([], pa.float64())})
            refs = refs.sort_by("ref")
            s = matrix(docs["u"]) @ matrix(refs["v"]).T
            at = np.round(s, 9).argmax(1)
            return pa.table({"key": docs["key"], "ref": refs["ref"].take(pa.array(at)), "similarity": pa.array(s[np.arange(len(at)), at])})

        met = left.groupBy("list", "pack", "part").cogroup(right.groupBy("l", "p", "q")).applyInArrow(meet, f"key {kind}, ref {topic_kind}, similarity double")
        best = met.groupBy("key").agg(F.min(F.struct((-F.round("similarity", 9)).alias("far"), "ref", "similarity")).alias("b"))
        return best.select(F.col("key").alias(key), F.col("b.ref").alias(topic), F.col("b.similarity").alias("similarity"))

    def _ranks(self, docs: DataFrame, vec: str) -> np.ndarray:
        """Of a bounded sample of documents: at which place among their nearest lists the list of their nearest topic comes."""
        asked = unit_rows(docs.select(F.xxhash64(F.col(vec)).alias("h"), vec), "h", vec).orderBy("h").limit(ASKED).toArrow()
        if not asked.num_rows or not len(self.centroids.value):
            return np.zeros(0, np.int64)
        q = self.spark.sparkContext.broadcast(matrix(asked["u"]))
        own = self.key

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, at = np.full(len(q.value), -2.0), np.zeros(len(q.value), np.int64)
            for b in batches:
                if b.num_rows:
                    s = q.value @ matrix(b["u"]).T
                    j = s.argmax(1)
                    better = s[np.arange(len(j)), j] > top
                    top[better], at[better] = s[np.arange(len(j)), j][better], b["list"].to_numpy()[j[better]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(top))), pa.array(top), pa.array(at)], names=["q", "s", "list"])

        near = self.lists.select(own, "u", "list").mapInArrow(best, "q long, s double, list long").groupBy("q").agg(F.max_by("list", "s").alias("list")).toArrow()
        order = (-(q.value @ self.centroids.value.T)).argsort(1, kind="stable")
        return (order[near["q"].to_numpy()] == near["list"].to_numpy()[:, None]).argmax(1)

    def probes_for(self, docs: DataFrame, target: float = RECALL, vec: str = "embedding") -> int:
        """The fewest probes with which the sample finds its nearest topic in a share of ``target``."""
        ranks = self._ranks(docs, vec)
        return int(np.sort(ranks)[max(0, int(np.ceil(target * len(ranks))) - 1)]) + 1 if len(ranks) else 1

    def measured_recall(self, docs: DataFrame, probes: int, vec: str = "embedding") -> float:
        ranks = self._ranks(docs, vec)
        return float((ranks < probes).mean()) if len(ranks) else 1.0
