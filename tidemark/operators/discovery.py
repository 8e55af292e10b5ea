"""Topic discovery and upkeep: relevance to references, density clusters, candidates, matching, merges, snapshots."""

from __future__ import annotations

import gc
import hashlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import per_document
from tidemark.operators.topics import best_matches, cosine, dot

#: Relevance and candidate thresholds, the smallest pool and cluster, refit days.
RELEVANT, CANDIDATE, POOL, CLUSTER, REFIT_DAYS = 0.35, 0.75, 30, 5, 30
#: Rows of a tile where tiles of vectors meet, at least and at most; vectors that every row meets first.
TILE, HUBS = (2048, 32768), 2048


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own for a local session and an error for a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=prefix)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the session names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "spark-checkpoint-"))
    return df.checkpoint()


_FOLDER: list[str] = []
#: Where ``stored`` has put a table.
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """A table written to the folder that the session names and read again: computed once, where ``cut`` computes it twice."""
    if not _FOLDER or df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir"):
        _FOLDER[:] = [shared_folder(df.sparkSession, "spark-stored-")]
    path = f"{_FOLDER[0]}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        if path := _STORED.pop(df, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let go of finished jobs, so that Spark drops their shuffles from disk."""
    gc.collect()
    spark._jvm.System.gc()


def theme_relevance(docs: DataFrame, refs: DataFrame, least: float = RELEVANT) -> DataFrame:
    """The highest cosine to a reference vector; without references 0 and not relevant."""
    met = best_matches(docs.select("vec_id", "embedding"), refs.select(F.monotonically_increasing_id().alias("ref_id"), "centroid"), "vec_id", "ref_id")
    score = F.coalesce("similarity", F.lit(0.0))
    return met.select("vec_id", score.alias("relevance_score"), (score >= least).alias("is_relevant"))


def references_by_basis(themes: DataFrame, description: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """theme, basis and the reference rows of each theme: its description's, its accepted queries' or all of its corpus."""
    parts = [rows.withColumn("basis", F.lit(name)) for name, rows in (("description", description), ("queries", queries), ("corpus", corpus))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.join(themes.select("theme", "basis"), ["theme", "basis"])


def hashed_embedding(docs: DataFrame, dims: int = 384) -> DataFrame:
    """doc_id, dim, weight: words hashed to ``dims`` places, term counts times idf of the place, unit length; zeros left out.

    Texts are read and cut into words once; their counts by place are written, and both the places' frequencies and
    the weights come from those. The frequencies, ``dims`` numbers, go to every task.
    """

    def measure(start: np.ndarray, at: np.ndarray, words: list[str]) -> list[pa.Array]:
        place = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims for w in words], np.int64)
        row = np.repeat(np.arange(len(start) - 1), np.diff(start))
        cell, n = np.unique(row * dims + place[at], return_counts=True)
        off = pa.array(np.searchsorted(cell, np.arange(len(start)) * dims).astype(np.int32))
        return [pa.ListArray.from_arrays(off, pa.array((cell % dims).astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(n.astype(np.int32)))]

    tf = stored(per_document(docs, "doc_id", "text", r"[\p{L}\p{N}_]{2,}", "dims array<int>, tf array<int>", measure))

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(dims, np.int64), 0
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=dims)
            total += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.concatenate([[total], df]))], names=["dim", "n"])

    seen = tf.select("dims").mapInArrow(holding, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # dims + 1 rows
    df = np.zeros(dims + 1)
    for r in seen:
        df[r["dim"]] = r["n"]  # the last place holds the number of documents
    idf = docs.sparkSession.sparkContext.broadcast(np.log((df[-1] + 1) / (df[:-1] + 1)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                dim, n = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
                x = n * idf.value[dim]
                norm = np.sqrt(np.bincount(row, x * x, part.num_rows))[row]
                weight = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(dim.astype(np.int64)), pa.array(weight)], names=["doc_id", "dim", "weight"])

    kind = tf.schema["doc_id"].dataType.simpleString()
    return tf.mapInArrow(weigh, f"doc_id {kind}, dim long, weight double")


def _near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a and b have a product of ``least`` or more; at the edge terms are added in order, as a column would."""
    s = a @ b.T
    near = s >= least
    i, j = np.nonzero(np.abs(s - least) < 1e-9)
    if len(i):
        total = np.zeros(len(i))
        for k in range(a.shape[1]):
            total += a[i, k] * b[j, k]
        near[i, j] = total >= least
    return near


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(rows: DataFrame) -> DataFrame:
    """rows with ``u``, the vector at unit length; zero vectors are left out."""
    norm = F.nullif(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), F.lit(0.0))
    return rows.where(norm.isNotNull()).withColumn("u", F.transform("embedding", lambda x: x / norm)).drop("embedding")


def _meet(left: DataFrame, right: DataFrame, key: str, each, schema: str) -> DataFrame:
    """``each`` of every tile of left and tile of right rows, as tables. Tiles are large, so that few copies of a vector travel."""
    parts = [int(max(1, -(-n // min(TILE[1], max(TILE[0], -(-n // 8)))))) for n in (left.count(), right.count())]
    l, r = (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))) for df, own, other, n, m in ((left, "i", "j", *parts), (right, "j", "i", *parts[::-1])))
    l, r = (df.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *[F.col(c).alias(c) for c in cols]) for df, cols in ((l, left.columns), (r, right.columns)))
    return l.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInArrow(each, schema)


def _tiles(left: pa.Table, right: pa.Table, least: float, at_once: int = 2048) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first left row, first right row, near) of parts of a tile."""
    x, y = _rows(left["u"]), _rows(right["u"])
    for i in range(0, len(x), at_once):
        for j in range(0, len(y), at_once):
            yield i, j, _near(x[i : i + at_once], y[j : j + at_once], least)


def near_pairs(rows: DataFrame, least: float, among: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a <> b, of cosine ``least`` or more, of ``rows`` (vec_id, embedding) and those ``among`` (rows themselves).

    Exact: tiles of both are multiplied, so that a task holds two tiles and shuffles hold some copies of each vector, not pairs.
    Zero vectors are near nothing.
    """
    left = stored(_unit(rows.select("vec_id", "embedding")))
    right = left if among is None else stored(_unit(among.select("vec_id", "embedding")))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def each(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, found = (a["vec_id"].combine_chunks(), b["vec_id"].combine_chunks()), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, j, near in _tiles(a, b, least):
            x, y = np.nonzero(near)
            found.append((x + i, y + j))
        x, y = (ids[k].take(pa.array(np.concatenate([f[k] for f in found]))) for k in (0, 1))
        return pa.table({"a": x, "b": y}).filter(pc.not_equal(x, y))

    return _meet(left, right, "vec_id", each, f"a {kind}, b {kind}")


def _joined_parts(left: DataFrame, right: DataFrame, least: float, kind: str) -> DataFrame:
    """comp_a, comp_b: links between the components (column ``comp``) of rows that are near each other, as few as a tile needs."""

    def each(a: pa.Table, b: pa.Table) -> pa.Table:
        codes = pa.chunked_array([*a["comp"].chunks, *b["comp"].chunks], a["comp"].type).combine_chunks().dictionary_encode()
        at, names = codes.indices.to_numpy(), codes.dictionary
        of_a, of_b, up = at[: a.num_rows], at[a.num_rows :], np.arange(len(names))
        links = []
        for i, j, near in _tiles(a, b, least):
            ca, cb = up[of_a[i : i + near.shape[0]]], up[of_b[j : j + near.shape[1]]]
            near &= ca[:, None] != cb
            x, y = np.nonzero(near)
            for p, q in np.unique(np.stack([ca[x], cb[y]], 1), axis=0).tolist() if len(x) else []:
                if up[p] != up[q]:
                    links.append((p, q))
                    up[up == up[q]] = up[p]
        p, q = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
        return pa.table({"comp_a": names.take(p), "comp_b": names.take(q)})

    return _meet(left, right, "vec_id", each, f"comp_a {kind}, comp_b {kind}")


def density_clusters(rows: DataFrame, least: float, size: int = CLUSTER, pool: int = POOL, hubs: int = HUBS) -> DataFrame:
    """vec_id, cluster_id of rows that are no noise; nothing from a pool of fewer than ``pool`` rows.

    A core row has ``size`` - 1 or more near rows. Cores that are near each other share a cluster, named by its
    smallest id; another row joins the smallest cluster among its near cores. Ids are unique.

    Rows of equal vectors are near each other and to the same others, so one node stands for them and weighs as
    many as they are: a group of copies makes no pairs of its own. Zero vectors are near nothing, copies included.

    Exact, and without all pairs where rows have many near ones: every node meets some hubs, a sample that every task
    holds. Those with enough near hubs are cores for sure, and a hub near two cores joins them. Only the others meet all
    nodes to be counted, and of the cores only those outside the largest component meet the cores of other components.
    """
    from tidemark.operators.hierarchy import _joined

    spark, kind = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    rows = stored(rows.select("vec_id", "embedding"))
    none = rows.select("vec_id", F.col("vec_id").alias("cluster_id")).limit(0)
    if rows.count() < pool:
        return none
    some = rows.where(F.exists("embedding", lambda x: x != 0))
    nodes = stored(some.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")))
    units = stored(_unit(nodes))
    picked = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(hubs).toArrow()  # bounded
    if not picked.num_rows:
        return none
    hub = spark.sparkContext.broadcast((_rows(picked["u"]), picked["n"].to_numpy(), picked["vec_id"].combine_chunks()))

    def meet_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, n, ids = hub.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = _near(_rows(part.column(1)), u, least)
                own = pc.index_in(part.column(0), value_set=ids).fill_null(-1).to_numpy()
                near[np.flatnonzero(own >= 0), own[own >= 0]] = False
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near @ n)], names=["vec_id", "others"])

    seen = stored(units.select("vec_id", "u").mapInArrow(meet_hubs, f"vec_id {kind}, others long"))
    sure = nodes.select("vec_id", "n").join(seen, "vec_id").where(F.col("n") - 1 + F.col("others") >= size - 1).select("vec_id")
    sure = stored(sure)
    left = stored(nodes.join(sure, "vec_id", "left_anti"))
    pairs = stored(near_pairs(left, least, nodes))
    others = pairs.join(nodes.select(F.col("vec_id").alias("b"), "n"), "b").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("others"))
    late = left.join(others, "vec_id", "left").where(F.col("n") - 1 + F.coalesce("others", F.lit(0)) >= size - 1).select("vec_id")
    core = stored(sure.unionByName(late))
    core_hubs = core.where(F.col("vec_id").isin(picked["vec_id"].to_pylist())).toArrow()["vec_id"].combine_chunks()  # bounded
    on = spark.sparkContext.broadcast(pc.is_in(picked["vec_id"].combine_chunks(), core_hubs).to_numpy(zero_copy_only=False))

    def join_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, ids, up = hub.value[0][on.value], hub.value[2].filter(pa.array(on.value)), np.arange(on.value.sum())
        for batch in batches:
            for at in range(0, batch.num_rows if len(u) else 0, 2048):
                part = batch.slice(at, 2048)
                near = _near(_rows(part.column(1)), u, least)
                first = np.where(near.any(1), near.argmax(1), -1)
                links = []
                for f, row in zip(first, near, strict=True):
                    if f >= 0 and (up[row] != up[f]).any():  # hubs that no row before has joined
                        apart = [int(h) for h in np.flatnonzero(row & (up != up[f]))]
                        links += [(int(f), h) for h in apart]
                        up[np.isin(up, up[apart])] = up[f]
                some = np.flatnonzero(first >= 0)
                a = pa.concat_arrays([part.column(0).take(pa.array(some)), ids.take(pa.array([x for x, _ in links], pa.int64()))])
                b = pa.concat_arrays([ids.take(pa.array(first[some])), ids.take(pa.array([y for _, y in links], pa.int64()))])
                yield pa.RecordBatch.from_arrays([a, b], names=["comp_a", "comp_b"])

    core_units = stored(units.join(core, "vec_id").select("vec_id", "u"))
    both = pairs.join(core.select(F.col("vec_id").alias("a")), "a", "left_semi").join(core.select(F.col("vec_id").alias("b")), "b", "left_semi")
    links = core_units.mapInArrow(join_hubs, f"comp_a {kind}, comp_b {kind}").unionByName(both.select(F.col("a").alias("comp_a"), F.col("b").alias("comp_b")))
    label = stored(core.join(_joined(links.where("comp_a <> comp_b")), core["vec_id"] == F.col("comp"), "left").select("vec_id", F.coalesce("root", "vec_id").alias("comp")))
    # late cores have met every node; of the others only those outside the largest component may lack a link
    largest = label.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(1).select("comp")
    outside = stored(core_units.join(sure, "vec_id", "left_semi").join(label, "vec_id").join(F.broadcast(largest), "comp", "left_anti").select("vec_id", "u", "comp"))
    if not outside.isEmpty():
        step = _joined(_joined_parts(outside, core_units.join(label, "vec_id").select("vec_id", "u", "comp"), least, kind))
        label = stored(label.join(step, "comp", "left").select("vec_id", F.coalesce("root", "comp").alias("comp")))
    border = pairs.join(core, F.col("a") == F.col("vec_id"), "left_anti").join(label.withColumnRenamed("vec_id", "b"), "b").groupBy(F.col("a").alias("vec_id")).agg(F.min("comp").alias("comp"))
    named = label.unionByName(border)
    found = nodes.join(named, "vec_id").select("embedding", F.col("comp").alias("cluster_id"))
    return some.join(found, "embedding").select("vec_id", "cluster_id")


def candidate_resolution(candidates: DataFrame, topics: DataFrame, least: float = CANDIDATE, rate: float = 0.02) -> DataFrame:
    """Each candidate merges into its nearest topic when that is near enough and not pinned, and else founds a topic.

    ``moved`` is how far the one drift step takes the topic's centroid.
    """
    near = best_matches(candidates.select("candidate_id", F.col("centroid").alias("embedding")), topics.select("topic_id", "centroid"), "candidate_id", "topic_id")
    home = topics.select("topic_id", "pinned", F.col("centroid").alias("home"))
    met = near.join(candidates, "candidate_id").join(home, "topic_id", "left")
    best = met.select("candidate_id", F.struct("topic_id", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("similarity", F.lit(-1.0)).alias("s"), "centroid", "home").alias("x"))
    merges = (F.col("x.s") >= least) & ~F.col("x.pinned")
    apart = F.zip_with("x.centroid", "x.home", lambda a, b: a - b)
    return best.select(
        "candidate_id", F.when(merges, "merge").otherwise("new").alias("outcome"), F.when(merges, F.col("x.topic_id")).alias("topic_id"),
        F.when(merges, F.lit(least)).otherwise(1.0).alias("similarity"), F.when(merges, rate * F.sqrt(dot(apart, apart))).alias("moved"),
    )


def refit_window(assignments: DataFrame, today, size: int = CLUSTER, days: int = REFIT_DAYS) -> DataFrame:
    """Of each monitor: automatic assignments of the last days, and whether they are enough to refit."""
    inside = (F.col("method") != "manual") & (F.col("assigned_on") > F.date_sub(today, days)) & (F.col("assigned_on") <= today)
    by = assignments.groupBy("monitor_id").agg(F.count_if(inside).alias("in_window"))
    return by.withColumn("status", F.when(F.col("in_window") < size, "window_too_small").otherwise("ready"))


def match_one_to_one(similar: DataFrame) -> DataFrame:
    """(cluster_id, topic_id, s): pairs taken from the most alike down, each side once; ties to smaller ids.

    In each round every pair that is the best of both its sides is taken at once, which gives the same pairs.
    """
    order = (F.desc("s"), F.asc("cluster_id"), F.asc("topic_id"))
    left, out = cut(similar), None
    while not left.isEmpty():
        ranked = left.withColumn("p", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).withColumn("q", F.row_number().over(Window.partitionBy("topic_id").orderBy(*order)))
        took = cut(ranked.where("p = 1 and q = 1").select("cluster_id", "topic_id", "s"))
        out = took if out is None else out.unionByName(took)
        left = cut(left.join(took.select("cluster_id"), "cluster_id", "left_anti").join(took.select("topic_id"), "topic_id", "left_anti"))
    return similar.limit(0) if out is None else out


def merge_topics(assignments: DataFrame, topics: DataFrame, requests: DataFrame) -> DataFrame:
    """Assignments of topic A move to B where both are active and differ; other requests change nothing."""
    active = topics.where("status = 'active'")
    ok = requests.where("topic_id <> into_id").join(active.select("topic_id"), "topic_id", "left_semi").join(active.select(F.col("topic_id").alias("into_id")), "into_id", "left_semi")
    met = assignments.join(ok, "topic_id", "left")
    return met.select("document_id", F.coalesce("into_id", "topic_id").alias("topic_id"), F.when(F.col("into_id").isNotNull(), F.col("topic_id")).alias("merged_from"))


def replace_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old snapshots, but those of a monitor and day taken again, and the new ones."""
    again = new.select("monitor_id", "taken_on").distinct()
    return old.join(again, ["monitor_id", "taken_on"], "left_anti").unionByName(new)


def snapshot_pairs(snapshots: DataFrame, lookback: int) -> DataFrame:
    """The newest ``lookback`` pairs of adjacent snapshot days of each monitor."""
    w = Window.partitionBy("monitor_id").orderBy("taken_on")
    days = snapshots.select("monitor_id", "taken_on").distinct().withColumn("earlier", F.lag("taken_on").over(w)).where("earlier is not null")
    place = F.row_number().over(Window.partitionBy("monitor_id").orderBy(F.desc("taken_on")))
    return days.withColumn("place", place).where(F.col("place") <= lookback).select("monitor_id", "earlier", F.col("taken_on").alias("later"), "place")


def stability(snapshots: DataFrame, lookback: int) -> DataFrame:
    """Mean adjusted Rand index of each monitor's adjacent snapshots over shared documents; 0 where none is shared."""
    pairs = snapshot_pairs(snapshots, lookback)
    a = snapshots.select("monitor_id", F.col("taken_on").alias("earlier"), "document_id", F.col("topic_id").alias("a"))
    b = snapshots.select("monitor_id", F.col("taken_on").alias("later"), "document_id", F.col("topic_id").alias("b"))
    key = ["monitor_id", "later"]
    met = F.broadcast(pairs).join(a, ["monitor_id", "earlier"]).join(b, [*key, "document_id"])
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = met.groupBy(*key, "a", "b").agg(F.count("*").alias("n"))
    rc = cells.groupBy(*key).agg(two("n").alias("rc"), F.sum("n").alias("n"))
    ra = cells.groupBy(*key, "a").agg(F.sum("n").alias("n")).groupBy(*key).agg(two("n").alias("ra"))
    rb = cells.groupBy(*key, "b").agg(F.sum("n").alias("n")).groupBy(*key).agg(two("n").alias("rb"))
    x = pairs.join(rc, key, "left").join(ra, key, "left").join(rb, key, "left")
    expected = F.coalesce(F.col("ra") * F.col("rb") / F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0)), F.lit(0.0))
    top = (F.col("ra") + F.col("rb")) / 2 - expected
    ari = F.when(F.col("n").isNull(), 0.0).when(top == 0, 1.0).otherwise((F.col("rc") - expected) / top)
    return x.select("monitor_id", ari.alias("ari")).groupBy("monitor_id").agg(F.avg("ari").alias("stability"), F.count("*").alias("pairs"))
