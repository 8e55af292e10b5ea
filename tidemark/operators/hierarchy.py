"""Density clusters of any scale: the tree of all density levels, and the clusters of it that last longest.

Vectors are compared by the distance of their unit vectors. A row's core distance reaches its ``least``-th row, itself
counted. Two rows join at their mutual reachability: the largest of both core distances and their own. Its minimum
spanning tree holds all levels at once: edges in order of weight merge groups, groups of ``size`` rows or more are
clusters, smaller ones join or leave them. A cluster's stability adds up, over its rows, the spell of 1 / weight in
which each belongs to it; a cluster is taken where it is at least as stable as the clusters below it together. The
whole pool is no cluster unless ``whole`` says so. Rows of no cluster are noise.

Equal vectors are one node that weighs as many rows; zero, null and non-finite vectors are noise. Edges are ordered by (weight,
smaller id, larger id), so the tree is the only one there is.

How it is spread out. Nodes lie in blocks around routing objects (a bounded sample, far apart). A block keeps the range
of its nodes' distances to some far pivots and its radius: triangle inequalities rule out blocks for a node. Blocks lie
in tiles; nodes travel to tiles, some tiles at a time, and what travelled goes before the next ones come, so that disk
holds a few copies of each vector, however many blocks it must visit. First each node finds its nearest ones
(``NEAR``), in its own tile and then in all within reach. Then the tree grows in Boruvka's rounds: every component
takes its lightest edge to another. Known neighbours give a first edge; only nodes that could have a lighter one than
their component's best so far search, and only blocks within that weight; what they find bounds later searches. The
levels are built from ranges of at most ``EDGES`` edges by weight; within a range each connected part is a group
of its own, and between ranges a component is one row: size, cluster, and the nodes of one too small to be a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.discovery import CLUSTER, POOL, drop, release, stored
from tidemark.operators.topics import dot

#: Nodes of a block and the most routing objects; far pivots; neighbours kept of each node; edges of a range.
BLOCK, ROUTES, PIVOTS, NEAR, EDGES = 2048, 1024, 12, 16, 1 << 20
#: Tiles, unless that makes one of more nodes than this; rows that travel at once, or else a tile's and its visitors.
TILES, TILE, TRAVEL = 8, 1 << 15, 1 << 18
#: The least weight of an edge. Rows nearer than this count as one place, so that a few copies don't outweigh what lies around them.
FINEST = 0.01


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, near ones without cancellation."""
    near = 2 - 2 * (a @ b.T)
    i, j = np.nonzero(near < 1e-3)
    if len(i):
        near[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.sqrt(np.maximum(0.0, near))


def spread(x: np.ndarray, k: int) -> np.ndarray:
    """Places of k rows, each the farthest from those before it."""
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(k, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return np.array(chosen)


def units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors of a column of vectors. The terms of a norm are added in order, as a column's are."""
    x = matrix(column).astype(float)
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * x[:, k]
    return x / np.sqrt(total)[:, None]


def nodes_of(rows: DataFrame, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """(key, node of each row that has one; node, v (a vector of its direction), n). Unit vectors are told apart by 96 bits of hashes."""
    fine = F.coalesce(F.forall(vec, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(vec, lambda e: e != 0), F.lit(False))
    x = F.transform(vec, lambda e: e.cast("double"))
    unit = lambda v: F.transform(v, lambda e: e / F.sqrt(dot(v, v)) + F.lit(0.0))
    short = dict(rows.dtypes)[vec] == "array<float>"  # half as wide as doubles, and the same vectors
    some = rows.where(fine).select(F.col(key).alias("id"), (F.col(vec) if short else x).alias("v"), unit(x).alias("u"))
    some = some.select("id", "v", F.xxhash64("u").alias("h"), F.hash("u").alias("g"))
    nodes = stored(some.groupBy("h", "g").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")))
    named = stored(some.select("id", "h", "g").join(nodes.select("h", "g", "node"), ["h", "g"]).select(F.col("id").alias(key), "node"))
    return named, nodes


class Places:
    """Routing objects and the ranges of their blocks, in order of their tiles, as every task needs them."""

    def __init__(self, routes: np.ndarray):
        self.routes, self.pivots = routes, routes[:PIVOTS]
        self.block = self.tile = np.zeros(0, np.int64)
        self.low = self.high = np.zeros((0, len(self.pivots)))
        self.route, self.radius = np.zeros(0, np.int64), np.zeros(0)

    def apart(self, u: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The least distance that any node of some blocks (by place) has to each row."""
        far = distances(u, self.routes)
        bound = np.maximum(0.0, far[:, self.route[some]] - self.radius[some])
        for p in range(len(self.pivots)):
            np.maximum(bound, far[:, p, None] - self.high[some, p], out=bound)
            np.maximum(bound, self.low[some, p] - far[:, p, None], out=bound)
        return bound - 1e-9


def place(spark: SparkSession, nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, Places]:
    """(node, v, n, block, tile, start (a distance within which NEAR others lie); places)."""
    count = nodes.count()
    routes = int(min(ROUTES, max(8, 4 * count // block)))
    sample = nodes.select("v").orderBy(F.xxhash64("node"), "node").limit(16 * routes).toArrow()  # bounded, for routing objects
    x = units(sample["v"])
    places = Places(x[spread(x, routes)])
    shared = spark.sparkContext.broadcast(places)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                far = distances(units(part["v"]), shared.value.routes)
                near = far.argmin(1)
                start = np.sort(far, axis=1)[:, NEAR] if far.shape[1] > NEAR else np.full(len(far), np.inf)
                pd = np.ascontiguousarray(far[:, : len(shared.value.pivots)])
                yield pa.RecordBatch.from_arrays([part["node"], part["v"], part["n"], pa.array(near), pa.array(far[np.arange(len(far)), near]), pa.array(start), pa.array(list(pd), pa.list_(pa.float64()))], names=["node", "v", "n", "route", "away", "start", "pd"])

    kind, vector = (nodes.schema[c].dataType.simpleString() for c in ("node", "v"))
    dealt = nodes.mapInArrow(deal, f"node {kind}, v {vector}, n long, route long, away double, start double, pd array<double>")
    sizes = stored(dealt.groupBy("route").agg(F.ceil(F.count("*") / block).alias("parts")))
    dealt = dealt.join(F.broadcast(sizes), "route").withColumn("block", F.col("route") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts")))
    ends = [f(F.col("pd")[p]).alias(f"{name}{p}") for name, f in (("low", F.min), ("high", F.max)) for p in range(len(places.pivots))]
    held = dealt.groupBy("block").agg(F.first("route").alias("route"), F.count("*").alias("rows"), F.max("away").alias("radius"), *ends).toArrow()  # a row for each block of up to ``block`` nodes
    # blocks of like places are neighbours in their order, which is cut into tiles
    home = distances(places.routes, places.pivots).argmin(1)[held["route"].to_numpy()]
    held = held.take(pa.array(np.lexsort((held["block"].to_numpy(), home))))
    rows = held["rows"].to_numpy()
    most = min(TILE, max(block, -(-count // TILES)))
    places.tile = np.unique((np.cumsum(rows) - rows) // most, return_inverse=True)[1]
    places.block, places.route, places.radius = (held[c].to_numpy() for c in ("block", "route", "radius"))
    places.low, places.high = (np.stack([held[f"{name}{p}"].to_numpy() for p in range(len(places.pivots))], 1) for name in ("low", "high"))
    tiles = spark.createDataFrame(list(zip(places.block.tolist(), places.tile.tolist(), strict=True)), "block long, tile int")
    return stored(dealt.join(F.broadcast(tiles), "block").select("node", "v", "n", "block", "tile", "start")), places


def strips(places: Places, nodes: int, visitors: int) -> tuple[int, list[tuple[int, int]]]:
    """How many packs visitors come in, each about a tile's worth, and ranges of tiles that travel at once: about ``TRAVEL`` rows, or one tile's."""
    tiles = int(places.tile.max()) + 1
    packs = max(1, min(tiles, -(-visitors * tiles // nodes)))
    step = max(1, TRAVEL // (visitors + nodes * packs // tiles + 1))
    return packs, [(i, min(tiles, i + step)) for i in range(0, tiles, step)]


def visiting(spark: SparkSession, nodes: DataFrame, places, bound: str, low: int, high: int) -> DataFrame:
    """nodes with ``to``: each tile from low up to high that may hold a node within the column ``bound``. places is a broadcast."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = places.value
        some = np.flatnonzero((held.tile >= low) & (held.tile < high))
        first = np.flatnonzero(np.diff(held.tile[some], prepend=-1))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                near = held.apart(units(part["v"]), some) <= part[bound].to_numpy(zero_copy_only=False)[:, None]
                i, j = np.nonzero(np.logical_or.reduceat(near, first, axis=1))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(i)).columns, pa.array(held.tile[some][first][j].astype(np.int32))], names=[*part.schema.names, "to"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", to int"
    return nodes.mapInArrow(go, schema)


def meet(visitors: DataFrame, members: DataFrame, tiles: int, packs: int, low: int, high: int, each, schema: str) -> DataFrame:
    """``each`` of a pack of visitors and the members of a tile from low up to high, as tables.

    So a node travels to tiles, not to each of their blocks, and a tile to packs of its visitors.
    """
    left = visitors.withColumn("pack", F.floor(F.col("tile") * packs / tiles).cast("int"))
    right = members.where((F.col("tile") >= low) & (F.col("tile") < high)).withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    right = right.select(*[F.col(c).alias("to" if c == "tile" else c) for c in right.columns])  # columns of its own, where both sides are of one table
    return left.groupBy("pack", "to").cogroup(right.groupBy("pack", "to")).applyInArrow(each, schema)


def _parts(held: Places, left: pa.Table, right: pa.Table, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left rows, right rows, distances): each block of the right rows' tile with those that may be within their bound of it.

    ``bound`` may sink meanwhile; blocks come in the order of their distance, so that it soon does.
    """
    at = right["block"].to_numpy()
    order = np.argsort(at, kind="stable")
    names, first = np.unique(at[order], return_index=True)
    rows = np.split(order, first[1:])
    places = np.argsort(held.block, kind="stable")
    places = places[np.searchsorted(held.block[places], names)]
    y = units(right["v"])
    for start in range(0, left.num_rows, 2048):
        x = units(left["v"].slice(start, 2048))
        apart = held.apart(x, places)
        for b in np.argsort(apart.mean(0), kind="stable"):
            i = np.flatnonzero(apart[:, b] <= bound[start : start + len(x)])
            if len(i):
                yield i + start, rows[b], distances(x[i], y[rows[b]])


def neighbours(spark: SparkSession, placed: DataFrame, places: Places, near: int = NEAR) -> DataFrame:
    """node, others (its ``near`` nearest as (d, id, n), nearest first), compared: first in its own tile, then in all within reach.

    Strip by strip of tiles: what one strip finds bounds the visits to the next, and its shuffles go before that.
    """
    kind, vector = (placed.schema[c].dataType.simpleString() for c in ("node", "v"))
    other = f"array<struct<d: double, id: {kind}, n: long>>"
    shared, tiles = spark.sparkContext.broadcast(places), int(places.tile.max()) + 1

    def closest(left: pa.Table, right: pa.Table) -> pa.Table:
        item = pa.struct([("d", pa.float64()), ("id", right["node"].type), ("n", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return pa.table({"node": left["node"].slice(0, 0), "others": pa.array([], pa.list_(item)), "compared": pa.array([], pa.int64())})
        left = left.sort_by("block")
        own, ids, done = left["node"].to_numpy(), right["node"].to_numpy(), np.zeros(left.num_rows, np.int64)
        bound = left["bound"].to_numpy().copy()
        best, at = np.full((len(own), near), np.inf), np.zeros((len(own), near), np.int64)
        for i, j, d in _parts(shared.value, left, right, bound):
            done[i] += len(j)
            d[own[i][:, None] == ids[j]] = np.inf
            r, c = np.nonzero((d <= bound[i][:, None] + 1e-9) & (d < np.inf))
            n = np.bincount(r, minlength=len(i))
            some = np.flatnonzero(n)
            if not len(some):
                continue
            # what is near enough, packed to the left, beside the nearest so far
            fresh, of = np.full((len(i), n.max()), np.inf), np.zeros((len(i), n.max()), np.int64)
            spot = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            fresh[r, spot], of[r, spot] = d[r, c], j[c]
            d, to = np.concatenate([best[i[some]], fresh[some]], 1), np.concatenate([at[i[some]], of[some]], 1)
            first = np.argpartition(d, near - 1, axis=1)[:, :near]
            best[i[some]], at[i[some]] = np.take_along_axis(d, first, 1), np.take_along_axis(to, first, 1)
            bound[i[some]] = np.minimum(bound[i[some]], best[i[some]].max(1))
        first = np.argsort(best, axis=1, kind="stable")
        best, at = np.take_along_axis(best, first, 1), np.take_along_axis(at, first, 1)
        real = best < np.inf
        off = np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(best[real]), right["node"].combine_chunks().take(pa.array(at[real])), right["n"].combine_chunks().take(pa.array(at[real]))], fields=list(item))
        return pa.table({"node": left["node"], "others": pa.ListArray.from_arrays(pa.array(off), found), "compared": pa.array(done)})

    schema, members = f"node {kind}, others {other}, compared long", placed.select("tile", "block", "node", "v", "n")
    left = placed.select("tile", "block", "node", "v", F.col("start").alias("bound"), F.col("tile").alias("to"))
    right = members.select(F.col("tile").alias("to"), "block", "node", "v", "n")
    best = stored(left.groupBy("to").cogroup(right.groupBy("to")).applyInArrow(closest, schema))
    reach = F.when(F.size("others") == near, F.least(F.element_at("others", -1)["d"], "start")).otherwise(F.col("start"))
    packs, ranges = strips(places, count := placed.count(), count)
    for low, high in ranges if tiles > 1 else []:
        asked = placed.join(best.select("node", "others"), "node").select("tile", "block", "node", "v", reach.alias("bound"))
        more = meet(visiting(spark, asked, shared, "bound", low, high).where("to <> tile"), members, tiles, packs, low, high, closest, schema)
        by = best.unionByName(more).groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("others"))), 1, near).alias("others"), F.sum("compared").alias("compared"))
        before, best = best, stored(by)
        drop(before)
        release(spark)
    return best


def spanning_tree(spark: SparkSession, placed: DataFrame, places: Places, found: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(a, b, w: the edges of the minimum spanning tree of mutual reachability, by (w, a, b), a < b; how many pairs were compared)."""
    # the core distance: the first of the nearest at which it and they make ``least`` rows
    reached = F.aggregate("others", F.struct(F.col("n").alias("rows"), F.lit(0.0).alias("d")), lambda s, e: F.when(s["rows"] >= least, s).otherwise(F.struct((s["rows"] + e["n"]).alias("rows"), e["d"].alias("d"))))
    met = placed.select("node", "n").join(found, "node").withColumn("at", reached)
    core = F.when(F.col("at.rows") >= least, F.col("at.d")).otherwise(F.lit(float("inf")))
    end = F.when(F.size("others") == NEAR, F.element_at("others", -1)["d"]).otherwise(F.lit(float("inf")))  # all nodes nearer than this are among the others
    points = stored(met.select("node", core.alias("core"), F.greatest(end, core).alias("low")))
    cores = points.select("node", "core")
    pairs = found.select(F.col("node").alias("a"), F.explode("others").alias("o")).select("a", F.col("o.id").alias("b"), "o.d")
    pairs = pairs.join(cores.toDF("a", "core_a"), "a").join(cores.toDF("b", "core_b"), "b")
    weight = F.greatest("d", "core_a", "core_b", F.lit(FINEST))
    edges = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), weight.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w")))
    label, tree, compared = stored(points.select("node", F.col("node").alias("comp"))), None, 0
    drop(found)
    kind, count, shared = placed.schema["node"].dataType.simpleString(), points.count(), spark.sparkContext.broadcast(places)

    def lightest(left: pa.Table, right: pa.Table) -> pa.Table:
        node, done = right["node"].type, 0
        left = left.sort_by("block")
        own, mine, here, bound = (left[c].to_numpy() for c in ("node", "core", "comp", "best"))
        ids, core, comp = (right[c].to_numpy() for c in ("node", "core", "comp"))
        bound = bound.copy()
        best = [np.zeros(0, np.int64), np.zeros(0), ids[:0], ids[:0]]

        def add(fresh: list[np.ndarray]) -> list[np.ndarray]:
            """Of each row the lightest; of equal weights the smallest pair (smaller id, larger id)."""
            row, w, lo, hi = (np.concatenate(x) for x in zip(best, *fresh, strict=True))
            first = np.lexsort((hi, lo, w, row))
            first = first[np.diff(row[first], prepend=-1) != 0]
            return [x[first] for x in (row, w, lo, hi)]

        fresh, held = [], 0
        for i, j, d in _parts(shared.value, left, right, bound) if left.num_rows and right.num_rows else ():
            done += d.size
            w = np.maximum(np.maximum(d, core[j]), np.maximum(mine[i][:, None], FINEST))
            r, c = np.nonzero((w <= bound[i][:, None]) & (here[i][:, None] != comp[j]) & (w < np.inf))
            if len(r):
                np.minimum.at(bound, i[r], w[r, c])
                fresh.append([i[r], w[r, c], np.minimum(own[i[r]], ids[j[c]]), np.maximum(own[i[r]], ids[j[c]])])
                held += len(r)
            if held > 1 << 20:
                best, fresh, held = add(fresh), [], 0
        row, w, lo, hi = add(fresh)
        # the last row tells how many were compared
        none = lambda values, kind: pa.array([*values.tolist(), None], kind)
        return pa.table({"node": none(own[row], node), "a": none(lo, node), "b": none(hi, node), "w": none(w, pa.float64()), "compared": pa.array([0] * len(row) + [done], pa.int64())})

    while True:
        of = lambda end: label.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))  # noqa: B023, E731
        before, edges = edges, stored(edges.select("a", "b", "w").join(of("a"), "a").join(of("b"), "b").where("comp_a <> comp_b").select("a", "b", "w", "comp_a", "comp_b"))
        drop(before)
        both = edges.select(F.explode(F.array("comp_a", "comp_b")).alias("comp"), F.struct("w", "a", "b").alias("e"))
        best = both.groupBy("comp").agg(F.min("e").alias("e"))
        here = points.join(label, "node")
        # any routing object of another component bounds the lightest edge, too; here a component that knows none takes it
        known = stored(here.join(best, "comp", "left").select("node", "core", "comp", "low", F.col("e.w").alias("best")))
        lost = known.where("best is null")
        asked = known
        if not lost.isEmpty():
            vectors = placed.select("node", "v")
            asked = known.join(_pivot_bound(spark, here.join(vectors, "node"), lost.join(vectors, "node"), places), "comp", "left").withColumn("best", F.coalesce("best", "other")).drop("other")
        asked = stored(asked.select("node", "core", "comp", "low", F.when(F.col("low") <= F.col("best"), F.col("best")).alias("best")))
        drop(known)
        if many := asked.where("best is not null").count():
            full = stored(placed.select("tile", "block", "node", "v").join(asked.select("node", "core", "comp", "best"), "node"))
            packs, ranges = strips(places, count, many)
            seen, members = [], full.drop("best")
            for low, high in ranges:
                to = visiting(spark, full.where("best is not null"), shared, "best", low, high)
                seen.append(stored(meet(to, members, int(places.tile.max()) + 1, packs, low, high, lightest, f"node {kind}, a {kind}, b {kind}, w double, compared long")))
                release(spark)
            every = reduce(DataFrame.unionByName, seen)
            compared += every.agg(F.sum("compared")).first()[0] or 0
            light = stored(every.where("node is not null").groupBy("node").agg(F.min(F.struct("w", "a", "b")).alias("e")))
            # whatever lies outside the component is now known to be this far at least, now and later
            bound = asked.where("best is not null").join(light, "node", "left").select("node", F.least("best", F.coalesce("e.w", F.lit(float("inf")))).alias("now"))
            spent, points = points, stored(points.join(bound, "node", "left").withColumn("low", F.greatest("low", F.coalesce(F.col("now") + 0.0, "low"))).drop("now"))
            more = light.select("e.a", "e.b", "e.w").join(of("a"), "a").join(of("b"), "b")
            before, edges = edges, stored(edges.unionByName(more.select(edges.columns)).groupBy("a", "b", "comp_a", "comp_b").agg(F.min("w").alias("w")))
            drop(full, light, spent, before, *seen)
            both = edges.select(F.explode(F.array("comp_a", "comp_b")).alias("comp"), F.struct("w", "a", "b").alias("e"))
            best = both.groupBy("comp").agg(F.min("e").alias("e"))
        drop(asked)
        took = stored(best.select("e.a", "e.b", "e.w").distinct())
        if took.isEmpty():
            break
        tree = took if tree is None else tree.unionByName(took)
        step = took.join(of("a"), "a").join(of("b"), "b").select("comp_a", "comp_b")
        before, label = label, stored(label.join(_joined(step), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
        drop(before)
    return (points.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w")).limit(0) if tree is None else tree), compared


def _pivot_bound(spark: SparkSession, here: DataFrame, lost: DataFrame, places: Places) -> DataFrame:
    """comp, other: for each lost component the least mutual reachability to the nodes at the pivots that lie in others."""
    shared = spark.sparkContext.broadcast(places)
    kind, vector = (here.schema[c].dataType.simpleString() for c in ("node", "v"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.flatnonzero((distances(units(b["v"]), shared.value.pivots) < 1e-9).any(1)) if b.num_rows else []
            yield b.take(pa.array(hit, pa.int64()))

    at = here.select("node", "v", "core", "comp").mapInArrow(pick, f"node {kind}, v {vector}, core double, comp {kind}").toArrow()  # PIVOTS rows
    pivots = spark.sparkContext.broadcast((units(at["v"]), at["core"].to_numpy(), at["comp"].to_numpy()))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, core, comp = pivots.value
        for b in batches:
            w = np.maximum(np.maximum(distances(units(b["v"]), u), core), np.maximum(b["core"].to_numpy()[:, None], FINEST))
            w[b["comp"].to_numpy()[:, None] == comp] = np.inf
            yield pa.RecordBatch.from_arrays([b["comp"], pa.array(w.min(1))], names=["comp", "other"])

    least = lost.select("v", "core", "comp").mapInArrow(bound, f"comp {kind}, other double").groupBy("comp").agg(F.min("other").alias("other"))
    return least.where(F.col("other") < float("inf"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of one task as (comp, root), the smallest that links reach."""
    parts = list(batches)
    a, b = (np.concatenate([p.column(i).to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(u) and not (label[u] == label[v]).all():
        x, y = label[u], label[v]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["comp", "root"])


def _joined(links: DataFrame, local: int = EDGES) -> DataFrame:
    """comp, root (the smallest that links (comp_a, comp_b) reach) of each linked component.

    ``local`` links at most (16 MB) are joined by one task; more of them in rounds over all.
    """
    links = stored(links.select("comp_a", "comp_b"))
    kind = links.schema["comp_a"].dataType.simpleString()
    if kind in ("int", "bigint") and links.count() <= local:
        return stored(links.coalesce(1).mapInArrow(_stars, f"comp {kind}, root {kind}"))
    both = stored(links.unionByName(links.select(F.col("comp_b").alias("comp_a"), F.col("comp_a").alias("comp_b"))).distinct())
    label = both.select("comp_a").distinct().select("comp_a", F.col("comp_a").alias("c"))
    while True:
        near = both.join(label.select(F.col("comp_a").alias("comp_b"), F.col("c").alias("m")), "comp_b").groupBy("comp_a").agg(F.min("m").alias("m"))
        step = label.join(near, "comp_a").select("comp_a", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = step.select(F.col("comp_a").alias("c"), F.col("c").alias("root"))
        step = stored(step.join(jump, "c").select("comp_a", "old", F.least("c", "root").alias("c")))
        label = step.select("comp_a", "c")
        if step.where("old <> c").isEmpty():
            return label.select(F.col("comp_a").alias("comp"), F.col("c").alias("root"))


def condensed(nodes: DataFrame, tree: DataFrame, size: int = CLUSTER, edges: int = EDGES) -> tuple[DataFrame, DataFrame]:
    """(node, cluster; cluster, parent, stability, below, rows) from the spanning tree: which cluster took a node, and the clusters.

    A cluster is named by the edge at which it begins. ``below`` is the best total stability of what it splits into; the
    root's parent is null.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    ranked = tree.select(F.greatest("w", F.lit(FINEST)).alias("w"), "a", "b")
    ranges = max(1, -(-ranked.count() // edges))
    number = F.lit(0)
    if ranges > 1:
        ends = ranked.agg(F.expr(f"percentile_approx(w, array({', '.join(str(i / ranges) for i in range(1, ranges))}), 100000)")).first()[0]
        number = sum((F.when(F.col("w") > e, 1).otherwise(0) for e in sorted(set(ends))), F.lit(0))
    ranked = stored(ranked.withColumn("range", number))
    big = F.col("n") >= size
    pending = F.when(~big, F.array(F.struct("node", "n")))
    # a node that weighs as much as a cluster is one from the start
    own = F.when(big, F.col("node").cast("string"))
    state = stored(nodes.select(F.col("node").alias("comp"), F.col("n").alias("size"), own.alias("cluster"), F.when(big, F.col("n") / FINEST).otherwise(0.0).alias("sum"), F.lit(0.0).alias("below"), pending.alias("pending")))
    label, rows, clusters = nodes.select("node", F.col("node").alias("comp")), [nodes.where(big).select("node", own.alias("cluster"))], []
    held = f"size long, cluster string, sum double, below double, pending array<struct<node:{kind},n:long>>"
    schema = f"kind string, comp {kind}, to {kind}, parent string, stability double, {held}"

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("size", "cluster", "sum", "below", "pending")
        at = dict(zip(right["comp"].to_pylist(), zip(*(right[c].to_pylist() for c in names), strict=True), strict=True))
        up, out = {c: c for c in at}, []

        def find(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for w, a, b, ca, cb in sorted(zip(*(left[c].to_pylist() for c in ("w", "a", "b", "comp_a", "comp_b")), strict=True)):
            x, y, level, name = find(ca), find(cb), 1 / w, f"{a}-{b}"
            if at[x][1] is None:
                x, y = y, x
            (xn, xc, xs, xb, xp), (yn, yc, ys, yb, yp) = at[x], at[y]
            if yc is not None:  # two clusters end, a new one begins
                best = 0.0
                for n, c, s, below in ((xn, xc, xs, xb), (yn, yc, ys, yb)):
                    stability = s - n * level
                    best += max(stability, below)
                    out.append({"kind": "cluster", "cluster": c, "parent": name, "stability": stability, "below": below, "size": n})
                now = (xn + yn, name, (xn + yn) * level, best, None)
            elif xc is not None:  # rows join a cluster
                out += [{"kind": "row", "comp": p["node"], "cluster": xc} for p in yp]
                now = (xn + yn, xc, xs + yn * level, xb, None)
            elif xn + yn >= size:  # a cluster begins
                out += [{"kind": "row", "comp": p["node"], "cluster": name} for p in [*xp, *yp]]
                now = (xn + yn, name, (xn + yn) * level, 0.0, None)
            else:
                now = (xn + yn, None, 0.0, 0.0, [*xp, *yp])
            root = min(x, y)
            up[x] = up[y] = root
            at[root] = now
        for c in up:
            if (root := find(c)) == c:
                out.append({"kind": "state", "comp": c, **dict(zip(names, at[c], strict=True))})
            else:
                out.append({"kind": "label", "comp": c, "to": root})
        id_type = right["comp"].type
        types = [("kind", pa.string()), ("comp", id_type), ("to", id_type), ("parent", pa.string()), ("stability", pa.float64()), ("size", pa.int64()), ("cluster", pa.string()), ("sum", pa.float64()), ("below", pa.float64()), ("pending", pa.list_(pa.struct([("node", id_type), ("n", pa.int64())])))]
        return pa.Table.from_pylist(out, schema=pa.schema(types))

    for r in range(ranges):
        part = ranked.where(F.col("range") == r)
        for end in ("a", "b"):
            part = part.join(label.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}")), end)
        part = stored(part)
        if part.isEmpty():
            continue
        root = _joined(part)
        left = part.join(root, part["comp_a"] == root["comp"]).select("root", "w", "a", "b", "comp_a", "comp_b")
        told = stored(left.groupBy("root").cogroup(state.join(root, "comp").select(*state.columns, F.col("root").alias("top")).groupBy("top")).applyInArrow(merge, schema))
        state = stored(state.join(root, "comp", "left_anti").unionByName(told.where("kind = 'state'").select(state.columns)))
        label = stored(label.join(told.where("kind = 'label'").select("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        rows.append(told.where("kind = 'row'").select(F.col("comp").alias("node"), "cluster"))
        clusters.append(told.where("kind = 'cluster'").select("cluster", "parent", "stability", "below", F.col("size").alias("rows")))
    none = F.lit(None).cast("string")
    clusters.append(state.where("cluster is not null").select("cluster", none.alias("parent"), F.col("sum").alias("stability"), "below", F.col("size").alias("rows")))
    return reduce(DataFrame.unionByName, rows), stored(reduce(DataFrame.unionByName, clusters))


def chosen(clusters: DataFrame, whole: bool = False) -> DataFrame:
    """cluster, taken: the topmost stable cluster that holds it (null: none). Each round doubles how far up a cluster looks."""
    stable = (F.col("stability") >= F.col("below")) & (F.lit(whole) | F.col("parent").isNotNull())
    at = clusters.select("cluster", F.col("parent").alias("up"), F.when(stable, F.col("cluster")).alias("taken"))
    while True:
        above = at.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("taken").alias("higher"))
        at = stored(at.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "taken").alias("taken")))
        if at.where("up is not null").isEmpty():
            return at.select("cluster", "taken")


def density_hierarchy(rows: DataFrame, key: str = "vec_id", vec: str = "embedding", size: int = CLUSTER, least: int = CLUSTER, pool: int = POOL, whole: bool = False, block: int = BLOCK, edges: int = EDGES, tell: dict | None = None) -> DataFrame:
    """key, cluster_id (its smallest key) of the rows that are no noise; nothing from a pool of fewer than ``pool`` rows.

    ``tell`` gets the number of pairs whose distance was computed, and of those that there are.
    """
    if not 1 <= least <= NEAR:
        raise ValueError(f"least is 1 to {NEAR}")
    spark = rows.sparkSession
    nothing = rows.select(key, F.col(key).alias("cluster_id")).limit(0)
    if rows.count() < pool:
        return nothing
    named, nodes = nodes_of(rows, key, vec)
    if nodes.isEmpty():
        return nothing
    placed, places = place(spark, nodes, block)
    drop(nodes)
    release(spark)
    found = neighbours(spark, placed, places)
    if tell is not None:
        count = placed.count()
        tell |= {"compared": found.agg(F.sum("compared")).first()[0], "pairs": count * count}
    tree, compared = spanning_tree(spark, placed, places, found, least)
    if tell is not None:
        tell["compared"] += compared
    weights = stored(placed.select("node", "n"))
    drop(placed)
    took, clusters = condensed(weights, tree, size, edges)
    in_cluster = took.join(chosen(clusters, whole), "cluster").where("taken is not null").select("node", "taken")
    met = stored(named.join(in_cluster, "node").select(key, "taken"))
    return met.join(met.groupBy("taken").agg(F.min(key).alias("cluster_id")), "taken").select(key, "cluster_id")
