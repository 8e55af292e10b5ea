"""Vectors and topics: nearest topic, assignment, drift, keywords, registry upkeep, clustering agreement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
#: References that go to a task as one matrix (at 384 doubles 25 MB).
REF_BLOCK = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def mean_vectors(rows: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Mean by component: positions are aggregated before the shuffle, vectors are never collected."""
    by = rows.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    return by.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def packed_vectors(rows: DataFrame, key: str, vec: str, block: int = REF_BLOCK) -> DataFrame:
    """Blocks of at most about ``block`` vectors: block, ids, vectors."""
    blocks = -(-rows.count() // block) or 1
    by = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).groupBy("block")
    return by.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vec).alias("v")))).alias("refs"))


def best_matches(docs: DataFrame, refs: DataFrame, key: str, ref_key: str, vec: str = "embedding", ref_vec: str = "centroid", block: int = REF_BLOCK) -> DataFrame:
    """key, ref_key, similarity: the reference of the highest cosine to each row (equal to 9 digits: the smallest), null without one.

    References come in blocks of bounded size, each a matrix that a task multiplies with its own rows, some at a time.
    One block, the common case, is broadcast; more blocks are dealt to tasks with a copy of the rows, and the best of
    each row's blocks is kept. Zero vectors match nothing.
    """
    packed = packed_vectors(refs, ref_key, ref_vec, block)
    rows = docs.select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    kind, ref_kind = rows.schema["key"].dataType.simpleString(), refs.schema[ref_key].dataType.simpleString()
    schema = f"key {kind}, ref {ref_kind}, similarity double"

    def unit(v: list) -> np.ndarray:
        x = np.array(v, float)
        norm = np.sqrt((x * x).sum(1))
        return np.where(norm[:, None] > 0, x / np.where(norm > 0, norm, 1)[:, None], np.nan)

    def best(ids: list, x: np.ndarray, keys: pa.Array, vectors: list) -> pa.RecordBatch:
        if not ids or not vectors:
            return pa.RecordBatch.from_arrays([keys, pa.nulls(len(keys), ref_type), pa.nulls(len(keys), pa.float64())], names=["key", "ref", "similarity"])
        s = unit(vectors) @ x.T
        at = np.where(np.isnan(s), -2.0, np.round(s, 9)).argmax(1)
        top = s[np.arange(len(at)), at]
        ref = pa.array(ids, ref_type).take(pa.array(at, mask=np.isnan(top)))
        return pa.RecordBatch.from_arrays([keys, ref, pa.array(top, mask=np.isnan(top))], names=["key", "ref", "similarity"])

    ref_type = _ARROW[ref_kind]
    if (blocks := packed.count()) <= 1:
        held = packed.first()
        own = held["refs"] if held else []
        shared = docs.sparkSession.sparkContext.broadcast(([r["id"] for r in own], unit([r["v"] for r in own]) if own else None))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    yield best(ids, x, part.column(0), part.column(1).to_pylist())

        out = rows.mapInArrow(scan, schema)
    else:
        dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(-(-docs.count() // 50_000))))
        parts = packed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-docs.count() // 50_000) - 1).cast("long"))))

        def meet(left, right):
            own = right["refs"].to_pylist()[0] if right.num_rows else []
            found = best([r["id"] for r in own], unit([r["v"] for r in own]) if own else None, left["key"].combine_chunks(), left["vec"].to_pylist())
            return pa.Table.from_batches([found])

        each = dealt.groupBy("block", "part").cogroup(parts.groupBy("block", "part")).applyInArrow(meet, schema)
        order = F.round(F.coalesce("similarity", F.lit(-2.0)), 9)
        top = each.groupBy("key").agg(F.max(order).alias("top"))
        out = each.join(top, "key").where(order == F.col("top")).groupBy("key").agg(F.min("ref").alias("ref"), F.max("similarity").alias("similarity"))
    return out.select(F.col("key").alias(key), F.col("ref").alias(ref_key), "similarity")


def nearest_topic(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """The best active topic of each document."""
    return best_matches(docs, topics, "vec_id", "topic_id").where("similarity is not null")


def assign_topics(nearest: DataFrame, least: float = 0.55) -> DataFrame:
    return nearest.where(F.col("similarity") >= least).withColumn("method", F.lit("centroid"))


def residue_pool(docs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Documents with a vector that no topic has; where they tell of relevance (``is_relevant``), the relevant ones."""
    rows = docs.where(F.col("embedding").isNotNull())
    rows = rows.where("is_relevant") if "is_relevant" in docs.columns else rows
    return rows.join(assignments.select("vec_id"), "vec_id", "left_anti")


def centroid_drift(assigned: DataFrame, topics: DataFrame, rate: float = 0.02) -> DataFrame:
    """The moving centroid's closed form: each vector weighs rate * (1 - rate) ** (vectors after it)."""
    w = Window.partitionBy("topic_id").orderBy(F.desc("vec_id"))
    after = assigned.withColumn("later", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("topic_id")))
    x = after.select("topic_id", "n", F.posexplode("embedding").alias("i", "x"), "later").groupBy("topic_id", "i").agg(F.sum(F.lit(rate) * F.pow(F.lit(1 - rate), F.col("later")) * F.col("x")).alias("moved"), F.first("n").alias("n"))
    c = topics.select("topic_id", F.posexplode("centroid").alias("i", "c"))
    met = c.join(x, ["topic_id", "i"]).withColumn("new", F.pow(F.lit(1 - rate), F.col("n")) * F.col("c") + F.col("moved"))
    return met.groupBy("topic_id").agg(F.first("n").cast("long").alias("doc_count"), F.sqrt(F.sum((F.col("new") - F.col("c")) * (F.col("new") - F.col("c")))).alias("moved"))


def drift_scores(assigned: DataFrame, topics: DataFrame, rate: float = 0.02, block: int = 512) -> DataFrame:
    """topic_id, doc_count, drift_score: the sum of rate * |c - x| over a topic's vectors in order, c the centroid before each step.

    A topic's vectors go in blocks. Each block's share of the moving centroid has a closed form, so the centroid at a
    block's start comes from the blocks before it, and the blocks then walk side by side, each in a task of its own.
    """
    order = Window.partitionBy("topic_id").orderBy("vec_id")
    placed = assigned.select("topic_id", "vec_id", "embedding", ((F.row_number().over(order) - 1) / block).cast("int").alias("block"))
    kind, dims = assigned.schema["topic_id"].dataType.simpleString(), "array<double>"

    def vectors(table: pa.Table) -> np.ndarray:
        table = table.sort_by("vec_id")
        return np.array(table["embedding"].to_pylist(), float).reshape(table.num_rows, -1)

    def added(key, table):
        x = vectors(table)
        weight = rate * (1 - rate) ** np.arange(len(x) - 1, -1, -1)
        return pa.table({"topic_id": pa.array([key[0].as_py()], _ARROW[kind]), "block": pa.array([key[1].as_py()], pa.int32()), "n": [len(x)], "add": [(weight[:, None] * x).sum(0).tolist()]})

    sums = placed.groupBy("topic_id", "block").applyInArrow(added, f"topic_id {kind}, block int, n long, add {dims}")
    lists = sums.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("block", "n", "add"))).alias("parts")).join(topics.select("topic_id", F.transform("centroid", lambda c: c.cast("double")).alias("c0")), "topic_id")
    step = lambda s, p: F.struct(F.zip_with(s["c"], p["add"], lambda c, a: c * F.pow(F.lit(1 - rate), p["n"]) + a).alias("c"), F.concat(s["at"], F.array(s["c"])).alias("at"))
    start = F.struct(F.col("c0").alias("c"), F.expr("cast(array() as array<array<double>>)").alias("at"))
    starts = lists.select("topic_id", F.posexplode(F.aggregate("parts", start, step, lambda s: s["at"])).alias("block", "c"))

    def walk(key, left, right):
        total = 0.0
        if right.num_rows:
            c = np.array(right["c"].to_pylist()[0], float)
            for x in vectors(left) if left.num_rows else []:
                total += rate * float(np.linalg.norm(c - x))
                c = (1 - rate) * c + rate * x
        return pa.table({"topic_id": pa.array([key[0].as_py()], _ARROW[kind]), "n": [left.num_rows], "score": [total]})

    walked = placed.groupBy("topic_id", "block").cogroup(starts.groupBy("topic_id", "block")).applyInArrow(walk, f"topic_id {kind}, n long, score double")
    return walked.groupBy("topic_id").agg(F.sum("n").alias("doc_count"), F.sum("score").alias("drift_score"))


def mark_dormant(topics: DataFrame, today: Column, days: int = 60) -> DataFrame:
    """Active topics that were last seen more than ``days`` before today become dormant; no topic is deleted."""
    late = (F.col("status") == "active") & (F.col("last_seen") < F.date_sub(today, days))
    return topics.withColumn("status", F.when(late, "dormant").otherwise(F.col("status")))


def touch_topics(topics: DataFrame, assigned: DataFrame, today: Column) -> DataFrame:
    """Topics that took a document today were last seen today."""
    seen = assigned.select("topic_id").distinct().withColumn("took", F.lit(True))
    return topics.join(seen, "topic_id", "left").withColumn("last_seen", F.when(F.col("took"), F.greatest("last_seen", today)).otherwise(F.col("last_seen"))).drop("took")


def refit(current: DataFrame, proposed: DataFrame, match: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(assignments, lineage) after a refit of (document_id, topic_id) by (document_id, cluster_id).

    Only where both labelings agree by an adjusted Rand index of ``least`` or more do documents move to the topic that
    their cluster matches; clusters without a topic move nothing. Lineage has a row for each pair of topics between
    which documents moved.
    """
    both = current.join(proposed, "document_id")
    agrees = adjusted_rand(both.select(F.col("topic_id").alias("a"), F.col("cluster_id").alias("b"))).select((F.col("ari") >= least).alias("agrees"))
    to = proposed.join(match.select("cluster_id", F.col("topic_id").alias("to_id")), "cluster_id").select("document_id", "to_id")
    met = current.join(to, "document_id", "left").join(F.broadcast(agrees), how="inner", on=F.lit(True))
    moves = F.col("agrees") & F.col("to_id").isNotNull() & (F.col("to_id") != F.col("topic_id"))
    out = met.select("document_id", F.when(moves, F.col("to_id")).otherwise(F.col("topic_id")).alias("topic_id"), F.when(moves, F.col("topic_id")).alias("moved_from"))
    lineage = out.where("moved_from is not null").groupBy(F.col("moved_from").alias("from_topic"), F.col("topic_id").alias("to_topic")).agg(F.count("*").alias("documents")).withColumn("event", F.lit("refit_remap"))
    return out, lineage


def merge_registry(topics: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, lineage) after merges: where A and B are active and differ, A's status is merged and it points to B.

    A topic that several requests name goes into the smallest of their targets.
    """
    active = topics.where("status = 'active'").select("topic_id")
    ok = requests.where("topic_id <> into_id").join(active, "topic_id", "left_semi").join(active.withColumnRenamed("topic_id", "into_id"), "into_id", "left_semi")
    ok = ok.groupBy("topic_id").agg(F.min("into_id").alias("into_id"))
    met = topics.join(ok, "topic_id", "left")
    gone = F.col("into_id").isNotNull()
    out = met.withColumn("status", F.when(gone, "merged").otherwise(F.col("status"))).withColumn("merged_into", F.coalesce("into_id", "merged_into")).drop("into_id")
    return out, ok.select(F.col("topic_id").alias("from_topic"), F.col("into_id").alias("to_topic"), F.lit("merge").alias("event"))


def coherence(rows: DataFrame, key: str) -> DataFrame:
    """Mean pairwise cosine of each group without pairs: (|sum u|^2 - n) / (n (n - 1)) on unit vectors; zero vectors are left out."""
    norm = F.nullif(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), F.lit(0.0))
    unit = rows.where(norm.isNotNull()).select(key, F.posexplode(F.transform("embedding", lambda x: x / norm)).alias("i", "u"))
    by = unit.groupBy(key, "i").agg(F.sum("u").alias("s"), F.count("*").alias("n"))
    by = by.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.first("n").alias("n")).where("n >= 2")
    return by.select(key, F.col("n").cast("long").alias("n"), ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """Of (a, b): one row, from the contingency table."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy("a", "b").agg(F.count("*").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(two("n").alias("ra"), F.sum("n").alias("all"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(two("n").alias("rb"))
    met = cells.agg(two("n").alias("rc")).crossJoin(rows).crossJoin(cols)
    expected = F.col("ra") * F.col("rb") / (F.col("all") * (F.col("all") - 1) / 2)
    top = (F.col("ra") + F.col("rb")) / 2 - expected
    return met.select(F.when(top == 0, 1.0).otherwise((F.col("rc") - expected) / top).alias("ari"))


def keywords(docs: DataFrame, group: str, text: str, stop: list[str], features: int = 2000, top: int = 8) -> DataFrame:
    """TF-IDF over one pseudo-document for each group: smoothed idf, unit length, the heaviest terms."""
    words = docs.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term")).where(~F.col("term").isin(stop))
    tf = words.groupBy(group, "term").agg(F.count("*").alias("tf"))
    corpus = tf.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "term").limit(features)
    groups = docs.select(group).distinct().agg(F.count("*").alias("groups"))
    met = tf.join(corpus, "term").crossJoin(groups).withColumn("w", F.col("tf") * (F.log((1 + F.col("groups")) / (1 + F.col("df"))) + 1))
    met = met.withColumn("weight", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group))), 6))
    order = Window.partitionBy(group).orderBy(F.desc("weight"), "term")
    return met.withColumn("place", F.row_number().over(order)).where((F.col("place") <= top) & (F.col("weight") > 0)).select(group, "place", "term", "weight")


def topic_labels(terms: DataFrame, topics: DataFrame, group: str) -> DataFrame:
    """The first three keywords of each topic as its label; a topic without any is unlabelled."""
    by = terms.where("place <= 3").groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]), ", ").alias("label"))
    return topics.select(group).distinct().join(by, group, "left").select(group, F.coalesce("label", F.lit("unlabelled topic")).alias("label"))


def resolve_merged(topics: DataFrame, cut=lambda df: df) -> DataFrame:
    """The survivor of each topic along merged_into, however long the chain; a topic that ends in a cycle or an unknown one has none.

    Each round doubles the links that are followed, so rounds are the logarithm of the longest chain; a topic
    that still moves after as many rounds as there can be goes round in a cycle. ``cut`` may end the lineage.
    """
    at = topics.select("topic_id", F.coalesce("merged_into", "topic_id").alias("at"))
    rounds = max(1, topics.count()).bit_length()
    for _ in range(rounds):
        step = at.select(F.col("topic_id").alias("from"), F.col("at").alias("on"))
        moved = cut(at.join(step, F.col("at") == F.col("from"), "left").select("topic_id", F.coalesce("on", "at").alias("at"), (F.col("on") != F.col("at")).alias("moves")))
        at = moved.select("topic_id", "at")
        if moved.where("moves").isEmpty():
            break
    ends = topics.where("merged_into is null").select(F.col("topic_id").alias("at"), F.lit(True).alias("ends"))
    return at.join(ends, "at", "left").select("topic_id", F.when(F.col("ends"), F.col("at")).alias("survivor"))


def assignment_precedence(assignments: DataFrame) -> DataFrame:
    """A manual assignment beats any other, then the newest wins."""
    order = Window.partitionBy("document_id").orderBy(F.desc(F.col("method") == "manual"), F.desc("assigned_at"))
    return assignments.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def representatives(docs: DataFrame, limit: int = 15) -> DataFrame:
    """Documents of (topic_id, source, vec_id, distance) in turns of one for each source, best sources first.

    A source gives at most ``limit`` documents, so each task first keeps that many of its own: a topic with most of
    all rows brings few of them to the window.
    """
    own = Window.partitionBy("topic_id", "source").orderBy("distance", "vec_id")
    met = docs.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= limit).withColumn("best", F.min("distance").over(Window.partitionBy("topic_id", "source")))
    order = Window.partitionBy("topic_id").orderBy("turn", "best", "source")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("topic_id", "place", "vec_id", "source")
