"""Exact top-k inner-product search in M-trees.

Components become integers, floor(256 x). An extra component makes all data vectors equally long, so the
largest inner product is the smallest Euclidean distance, a metric. Data vectors go to the nearest routing
object (a bounded sample, spread out; their number follows the number of blocks up to ``ROUTES``) and, within
one, to blocks of bounded size. A block is an M-tree: pages of entries with their distance to the page's
routing object, pages with covering radius and distance to their parent.

Queries search in packs, best page first: stored distances and the triangle inequality rule out pages and
entries for each query of a pack before a distance is computed, and what is left of a page meets what is left
of the pack in one matrix product. First each query searches one block of its nearest routing object; then its
k-th score rules out routing objects by their covering radius, and it visits all blocks of the others. What is
broadcast are the routing objects. A group holds ``BLOCK`` data vectors and some ``GROUP`` queries at most.

Of equal vectors only the k + 1 smallest ids can be among the results (one may be the query's own), so the
rest leave before the search. Scores are integers; bounds keep a margin over rounding, and equal scores are
told apart by id, so results are exact. Vectors too long for exact machine integers (a squared length of
2**62 or more) go a way of their own, block by block with integers of any size; a score beyond a long's range
stands at its end.

A row given several times is searched once and counts as often as it is given, for queries and results alike, as
in the SQL: its copies take several ranks. Several vectors of one id are results of their own, and as queries
share one list of results.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows of a null vec_id;
vectors of unequal length meet as if the shorter were padded with zeros. A row is no result of a query of the
same vec_id. Fewer candidates give fewer results; empty tables none. Extra columns, whatever their names, play
no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import column, materialize

LEAST_ROUTES, ROUTES, BLOCK, PAGE, PACK, GROUP = 32, 2048, 4096, 96, 256, 1 << 14
#: Squared lengths up to which all inner products are exact as longs, and as doubles.
LONG, EXACT = float(1 << 62), float(1 << 53)
_NONE = np.iinfo(np.int64).min


def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, x array<double>, v array<long> (null where the vector is too long for longs)."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    length = F.aggregate("x", F.lit(0.0), lambda a, e: a + F.pow(F.abs(e * 256) + 1, F.lit(2.0)))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.when(length < LONG, F.transform("x", lambda e: F.floor(e * 256))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), flat.dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Data vectors with the component that makes their squared length ``top``."""
    f = v.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(0.0, top - (f * f).sum(1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def spread_routes(v: np.ndarray, top: float, routes: int) -> np.ndarray:
    """Farthest-first choice among a sample."""
    x = lifted(v, top)
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(routes, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return v[chosen]


class Best:
    """The k best (score, smaller id first) of each query of a pack, as far as seen. A bound stands for k results just below it."""

    def __init__(self, bound: list, k: int):
        start = np.array([_NONE if b is None else int(b) - 1 for b in bound], np.int64)
        self.score = np.repeat(start[:, None], k, axis=1)
        self.id = np.full(self.score.shape, np.iinfo(np.int64).max)
        self.row = np.full(self.score.shape, -1, np.int64)

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores of the queries ``at`` (rows) and some entries (columns)."""
        better = np.flatnonzero((score >= self.score[at, -1:]).any(1) & (score != _NONE).any(1))
        if not len(better):
            return
        at, k = at[better], self.score.shape[1]
        wide = lambda x: np.broadcast_to(x, (len(at), len(x)))
        score, ids, rows = np.hstack([self.score[at], score[better]]), np.hstack([self.id[at], wide(ids)]), np.hstack([self.row[at], wide(rows)])
        rows = np.where(score == _NONE, -1, rows)
        order = np.lexsort((ids, -score.astype(np.longdouble) if (score == _NONE).any() else -score), axis=-1)[:, :k]
        self.score[at], self.id[at], self.row[at] = (np.take_along_axis(x, order, 1) for x in (score, ids, rows))


class Tree:
    """An M-tree over a block. A node is (routing object, radius, distance to parent, children or entries)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, top: float, page: int = PAGE):
        self.ids, self.v, self.top, self.page = ids, v, top, page
        self.exact = v.astype(np.float64) if top < EXACT else None
        self.x = lifted(v, top)
        self.computed = self.skipped = 0
        self.root = self._build(np.arange(len(ids)), self.x.mean(0), 0.0) if len(ids) else None

    def _build(self, at: np.ndarray, centre: np.ndarray, to_parent: float):
        away = np.linalg.norm(self.x[at] - centre, axis=1)
        node = {"x": centre, "radius": float(away.max()), "to_parent": to_parent}
        if len(at) <= self.page or away.max() == 0:
            return node | {"at": at, "away": away}
        k = min(self.page, -(-len(at) // self.page) + 1)
        order = np.linspace(0, len(at) - 1, k).astype(int)
        heads = self.x[at[np.argsort(away, kind="stable")[order]]]
        for _ in range(2):
            near = ((self.x[at] @ heads.T) * -2 + (heads * heads).sum(1)).argmin(1)
            heads = np.stack([self.x[at[near == j]].mean(0) if (near == j).any() else heads[j] for j in range(k)])
        near = ((self.x[at] @ heads.T) * -2 + (heads * heads).sum(1)).argmin(1)
        groups = [at[near == j] for j in range(k) if (near == j).any()]
        if len(groups) == 1:
            groups = np.array_split(at, k)
        kids = [self._build(g, c := self.x[g].mean(0), float(np.linalg.norm(c - centre))) for g in groups]
        return node | {"kids": kids, "kid_x": np.stack([c["x"] for c in kids]), "kid_r": np.array([c["radius"] for c in kids]), "kid_p": np.array([c["to_parent"] for c in kids])}

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products: as doubles where all partial sums are whole doubles, else as longs."""
        return np.rint(q.astype(np.float64) @ self.exact[at].T).astype(np.int64) if self.exact is not None else q @ self.v[at].T

    def search(self, own: np.ndarray, q: np.ndarray, best: Best) -> Best:
        """Offer the block's entries to a pack of queries ``q`` of ids ``own``; an entry of a query's own id is none of its results."""
        if self.root is None or not len(q):
            return best
        qx = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        base = self.top + (qx * qx).sum(1)
        slack = 1e-7 * np.sqrt(base) + 1e-6

        def reach(at: np.ndarray) -> np.ndarray:
            kth = best.score[at, -1]
            return np.where(kth == _NONE, np.inf, np.sqrt(np.maximum(0.0, base[at] - 2.0 * kth.astype(np.float64)))) + slack[at]

        every = np.arange(len(q))
        first = distances(qx, self.root["x"][None])[:, 0]
        queue, count = [(0.0, 0, self.root, every, np.maximum(0.0, first - self.root["radius"]), first)], 0
        while queue:
            _, _, node, at, low, away = heapq.heappop(queue)
            go = low <= reach(at)
            if not go.any():
                self.skipped += len(at)
                continue
            at, away = at[go], away[go]
            if "at" in node:
                ahead = np.abs(away[:, None] - node["away"]) <= reach(at)[:, None]
                some = np.flatnonzero(ahead.any(0))
                self.skipped += ahead.size - len(at) * len(some)
                self.computed += len(at) * len(some)
                if len(some):
                    rows = node["at"][some]
                    score = self.scores(q[at], rows)
                    best.offer(at, np.where(self.ids[rows] == own[at, None], _NONE, score), self.ids[rows], rows)
                continue
            ahead = np.abs(away[:, None] - node["kid_p"]) - node["kid_r"] <= reach(at)[:, None]
            some = np.flatnonzero(ahead.any(0))
            self.skipped += ahead.size - len(at) * len(some)
            self.computed += len(at) * len(some)
            far = distances(qx[at], node["kid_x"][some])
            for n, j in enumerate(some.tolist()):
                mine = ahead[:, j]
                low = np.maximum(0.0, far[mine, n] - node["kid_r"][j])
                count += 1
                heapq.heappush(queue, (float(low.min()), count, node["kids"][j], at[mine], low, far[mine, n]))
        return best


_HIT = "query_id long, qh long, qn long, vec_id long, h long, n long, score long"
_HIT_TYPES = pa.schema([(f.split()[0], pa.int64()) for f in _HIT.split(", ")])


def _hits(queries: pa.Table, data: pa.Table, place: np.ndarray, best: Best) -> pa.Table:
    """The filled places of a pack's results (``place``: the pack's rows of queries)."""
    i, j = np.nonzero(best.row >= 0)
    left, right = queries.take(pa.array(place[i])), data.take(pa.array(best.row[i, j]))
    return pa.Table.from_arrays([left["query_id"], left["qh"], left["qn"], right["vec_id"], right["h"], right["n"], pa.array(best.score[i, j])], schema=_HIT_TYPES)


def _whole(x: float) -> int:
    """floor(256 x) of any finite double."""
    a, b = x.as_integer_ratio()
    return 256 * a // b


def _long_way(queries: DataFrame, data: DataFrame, k: int, block: int, group: int, name: str) -> DataFrame:
    """All of queries with all of data, in blocks of bounded size, by integers of any size: for the few vectors that need them."""
    blocks, parts = -(-data.count() // block) or 1, -(-queries.count() // group) or 1
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "query_id", "x", "qh", "qn")
    right = data.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "x", "h", "n")

    def meet(q: pa.Table, d: pa.Table) -> pa.Table:
        ids, rows = d["vec_id"].to_pylist(), [[_whole(e) for e in x] for x in d["x"].to_pylist()]
        top, low = np.iinfo(np.int64).max, _NONE + 1
        out = {f: [] for f in _HIT_TYPES.names}
        for own, x, qh, qn in zip(*(q[c].to_pylist() for c in ("query_id", "x", "qh", "qn")), strict=True):
            mine = [_whole(e) for e in x]
            found = [(max(low, min(top, sum(a * b for a, b in zip(mine, row, strict=False)))), -i, at) for at, (i, row) in enumerate(zip(ids, rows, strict=True)) if i != own]
            for score, i, at in heapq.nlargest(k, found):
                for f, value in zip(out, (own, qh, qn, -i, d["h"][at].as_py(), d["n"][at].as_py(), score), strict=True):
                    out[f].append(value)
        return pa.table(out, schema=_HIT_TYPES)

    return materialize(left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, _HIT), name)


def top_k(spark: SparkSession, embeddings: DataFrame, every: int = 50, k: int = 5, routes: int | None = None, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score of each query (vec_id divisible by ``every``)."""
    rows = materialize(taking_part(embeddings), "vectors")
    normal = F.col("v").isNotNull()
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    facts = rows.agg(F.max(length).alias("top"), F.max(F.when(normal, F.size("v"))).alias("width"), F.count_if(normal).alias("n"), F.count_if(~normal).alias("long")).first()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # ids are counted, not rows, so copies of one id leave room for the others
    ids = rows.groupBy("v", "vec_id", F.when(~normal, F.col("x")).alias("x")).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.coalesce("v", F.array()), F.coalesce("x", F.array())))
    few = ids.withColumn("place", F.row_number().over(Window.partitionBy("v", "x").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    asked = ids.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "x", F.col("h").alias("qh"), F.col("n").alias("qn"))
    found = spark.createDataFrame([], _HIT)
    if facts["long"]:
        whole = lambda df: df.withColumn("x", F.coalesce("x", F.transform("v", lambda e: e.cast("double") / 256)))
        long_queries, long_data = whole(asked).where("v is null"), whole(few).where("v is null")
        found = _long_way(long_queries, whole(few), k, block, group, "search-long").unionByName(_long_way(whole(asked).where("v is not null"), long_data, k, block, group, "search-for-long"))
    if facts["n"]:
        found = found.unionByName(_tree_way(spark, rows.where(normal), few.where("v is not null"), asked.where("v is not null"), facts, k, routes, block, group))
    times = F.least("qn", F.lit(k)) * F.least("n", F.lit(k))
    both = found.distinct().select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least(times, F.lit(k)).cast("int"))))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _tree_way(spark: SparkSession, rows: DataFrame, few: DataFrame, asked: DataFrame, facts, k: int, routes: int | None, block: int, group: int) -> DataFrame:
    top, width = float(facts["top"]), int(facts["width"])
    routes = routes or int(min(ROUTES, max(LEAST_ROUTES, 2 * facts["n"] // block)))
    sample = rows.select("v").orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(16 * routes).toArrow()  # a bounded sample, for routing objects only
    heads = spread_routes(matrix(sample["v"], width), top, routes)
    shared = spark.sparkContext.broadcast(heads)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hx = lifted(shared.value, top)
        for b in batches:
            if b.num_rows:
                far = distances(lifted(matrix(column(b, "v"), width), top), hx)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *b.columns, pa.array(far[np.arange(len(near)), near])], names=["route", *b.schema.names, "away"])

    placed = few.select("vec_id", "v", "h", "n").mapInArrow(route, "route int, vec_id long, v array<long>, h long, n long, away double")
    placed = materialize(placed, "vectors-placed")
    sizes = {r["route"]: (-(-r["n"] // block), r["radius"]) for r in placed.groupBy("route").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # a row for each route
    blocks = F.element_at(F.create_map(*[F.lit(x) for r, (b, _) in sizes.items() for x in (r, b)]), F.col("route"))
    data = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    queries = materialize(asked.select("query_id", "v", "qh", "qn"), "search-queries")
    parts = -(-queries.count() // group) or 1

    def query_routes(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        hx = lifted(shared.value, top)
        radius = np.array([sizes.get(r, (0, -np.inf))[1] for r in range(len(hx))])
        for b in batches:
            q = matrix(column(b, "v"), width).astype(float)
            qx = np.hstack([q, np.zeros((len(q), 1))])
            low = distances(qx, hx) - radius
            bound = column(b, "bound").to_pylist()
            if first:
                go = np.zeros_like(low, bool)
                go[np.arange(len(q)), low.argmin(1)] = True
            else:
                base = top + (qx * qx).sum(1)
                slack = 1e-7 * np.sqrt(base) + 1e-6
                reach = np.array([np.inf if x is None else np.sqrt(max(0.0, z - 2.0 * x)) for x, z in zip(bound, base, strict=True)]) + slack
                go = (low <= reach[:, None]) & np.isfinite(radius)
            i, r = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), *b.take(pa.array(i)).columns], names=["route", *b.schema.names])

    kinds = "route int, query_id long, v array<long>, qh long, qn long, bound long"

    def visit(q: pa.Table, d: pa.Table) -> pa.Table:
        out = [_HIT_TYPES.empty_table()]
        if q.num_rows and d.num_rows:
            tree = Tree(d["vec_id"].to_numpy(), matrix(d["v"], width), top)
            vectors, own, bound = matrix(q["v"], width), q["query_id"].to_numpy(), q["bound"].to_pylist()
            near = np.argsort(distances(vectors.astype(float), vectors[:1].astype(float))[:, 0], kind="stable")  # like queries share a pack
            for at in np.array_split(near, -(-len(near) // PACK)):
                out.append(_hits(q, d, at, tree.search(own[at], vectors[at], Best([bound[i] for i in at], k))))
        return pa.concat_tables(out)

    def run(q: DataFrame, only_first: bool, name: str) -> DataFrame:
        q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(0) if only_first else (blocks - 1).cast("int")))).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        own = data.where("block = 0") if only_first else data
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return materialize(q.groupBy("route", "block", "part").cogroup(own.groupBy("route", "block", "part")).applyInArrow(visit, _HIT), name)

    start = queries.withColumn("bound", F.lit(None).cast("long")).mapInArrow(lambda b: query_routes(b, True), kinds)
    found = run(start, True, "search-found")
    kth = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("qh").alias("of_h"), F.col("score").alias("bound"))
    bounded = queries.join(kth, (F.col("query_id") == F.col("of")) & (F.col("qh") == F.col("of_h")), "left").select("query_id", "v", "qh", "qn", "bound")
    return found.unionByName(run(bounded.mapInArrow(lambda b: query_routes(b, False), kinds), False, "search-more"))
