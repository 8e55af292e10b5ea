"""Embedding near-duplicates by an inverted multi-index.

Vectors of unit length are cut in two halves. Each half has a codebook of its own (k-means on a bounded sample); the
product of both is a grid, and every vector lies in the cell of its nearest code words. A vector meets those of its own
cell and visits others, nearest first (the multi-sequence order over both halves' code words), then all pairs that met
are verified by their cosine in double precision, and only those count.

How near a cell is: a partner can lie with code word j instead of a vector's own code word i only if it is beyond the
plane halfway between both, at the distance (d_j^2 - d_i^2) / (2 |c_i - c_j|) of the vector. Both halves' distances,
squared and added, bound the partner's squared distance from below. At the cosine's own radius the traversal is
exact; it ends earlier, at the reach that finds the target share of true links: those that a bounded sample of
vectors has among all rows, found by brute force, and those of made-up partners of the sample at just that cosine in
random directions. ``SPARE`` times the reach of these is taken, never more than the exact radius; a target of 1 takes
the farthest of them. ``recall`` measures the share of links found.

Only vectors of equal, non-null labels meet: a cell belongs to a label. Equal vectors of a label are one node, so a
group of copies makes no pairs. A cell of more than ``BLOCK`` nodes is cut into blocks, its visitors into packs, and
each block meets each pack in a task of its own. A task adds up each node's links and contracts them to stars, so
pairs are never written.

Vectors that are null, zero or hold null or non-finite components, and rows of a null label, link with nothing.
Vectors of unequal length meet as if the shorter were padded with zeros. Rows of a null vec_id link and count like
others but lend no id (a component of none but null ids has none). Repeated rows count each other. Labels are compared
as text; extra columns, whatever their names, play no part; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import column, materialize
from tidemark.llm.metric_search import matrix
from tidemark.llm.ngram_join import components, contracted

#: Components of the codebooks' sample (its rows are this by the width), rows of the sample for the reach, nodes that a cell should hold, the most code words of a half.
SAMPLE, ASKED, OCCUPANCY, WORDS = 1 << 21, 256, 64, 1024
#: Nodes of a cell's block and of its visitors' pack, rows of a task's group, steps of the reach's histogram, and what is added to the reach.
BLOCK, GROUP, STEPS, SPARE = 2048, 8192, 1024, 1.25


def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, tag, x, h1, h2 (two hashes of tag and x) of the rows that can link."""
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("tag"), F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0)
    hashed = lambda seed: F.xxhash64(F.lit(seed), "tag", "x")
    return rows.withColumn("fine", F.coalesce(F.col("tag").isNotNull() & fine, F.lit(False))).withColumn("h1", hashed(1)).withColumn("h2", hashed(2))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, initial=1e-300)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means: code words of the rows."""
    words = np.unique(x, axis=0)
    words = words[np.random.default_rng(0).permutation(len(words))[:k]].copy()
    for _ in range(rounds):
        near = squares(x, words).argmin(1)
        for j in range(len(words)):
            if (mine := near == j).any():
                words[j] = x[mine].mean(0)
    return words


def squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] + (words * words).sum(1) - 2 * x @ words.T)


class Grid:
    """Both codebooks; cells are numbers, first half's word times the second's count plus the second's."""

    def __init__(self, sample: np.ndarray, words: int):
        self.half = (sample.shape[1] + 1) // 2
        self.books = [codebook(sample[:, : self.half], words), codebook(sample[:, self.half :], words)]
        self.apart = [np.sqrt(squares(b, b)) for b in self.books]

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each half: each row's nearest word, and to each word the squared distance of the plane halfway."""
        near, far = [], []
        for h, (book, apart) in enumerate(zip(self.books, self.apart, strict=True)):
            d = squares(x[:, : self.half] if h == 0 else x[:, self.half :], book)
            own = d.argmin(1)
            gap = d - d[np.arange(len(d)), own][:, None]
            width = 2 * apart[own]
            plane = np.divide(gap, width, out=np.where(gap > 0, np.inf, 0.0), where=width > 0)
            near.append(own)
            far.append(plane * plane)
        return near, far

    def cell(self, i, j):
        return i * len(self.books[1]) + j

    def visited(self, a: np.ndarray, b: np.ndarray, reach: float) -> Iterator[int]:
        """Cells by the sum of both halves' bounds, nearest first, up to ``reach``."""
        i, j = (np.flatnonzero(h <= reach) for h in (a, b))
        i, j = i[np.argsort(a[i], kind="stable")], j[np.argsort(b[j], kind="stable")]
        left, right, down = a[i].tolist(), b[j].tolist(), {}
        queue = [(left[0] + right[0], 0, 0)] if left and right else []
        while queue:
            bound, p, q = heapq.heappop(queue)
            if bound > reach:
                return
            yield int(self.cell(i[p], j[q]))
            down[p] = q + 1
            if q + 1 < len(right) and (p == 0 or down.get(p - 1, 0) > q + 1):
                heapq.heappush(queue, (left[p] + right[q + 1], p, q + 1))
            if p + 1 < len(left) and down.get(p + 1, 0) == q:
                heapq.heappush(queue, (left[p + 1] + right[q], p + 1, q))


def nodes_of(rows: DataFrame) -> DataFrame:
    """node, tag, x, n, rep (smallest vec_id), h1, h2: equal vectors of a label are one."""
    by = rows.where("fine").groupBy("h1", "h2", "tag").agg(F.first("x").alias("x"), F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    return materialize(by.withColumn("node", F.monotonically_increasing_id()), "near-nodes")


def fit(spark: SparkSession, nodes: DataFrame, least: float, target: float) -> tuple[Grid, float, int]:
    """(grid, reach, width): the codebooks and how far, as a squared distance, the traversal goes."""
    width = int(nodes.agg(F.max(F.size("x"))).first()[0])
    most = nodes.groupBy("tag").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    limit = max(ASKED, SAMPLE // width)
    sample = nodes.select("tag", "x", "node").orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(limit).toArrow()  # bounded, for the codebooks and the reach
    x = unit(matrix(sample["x"], width))
    grid = Grid(x, max(2, min(WORDS, round((most / OCCUPANCY) ** 0.5))))
    asked, tags, own = x[:ASKED], np.array(sample["tag"].to_pylist()[:ASKED], object), sample["node"].to_numpy()[:ASKED]
    _, far = grid.bounds(asked)
    exact = 2 - 2 * least
    rng = np.random.default_rng(1)
    aside = rng.standard_normal((16, *asked.shape))
    aside -= (aside * asked).sum(2, keepdims=True) * asked
    aside /= np.sqrt((aside * aside).sum(2, keepdims=True)) + 1e-300
    made = (least * asked + (1 - least**2) ** 0.5 * aside).reshape(-1, width)
    made_near, _ = grid.bounds(made)
    row = np.tile(np.arange(len(asked)), 16)
    shared = spark.sparkContext.broadcast((grid, asked, tags, own, far))

    def step(bound: np.ndarray) -> np.ndarray:
        return np.minimum(STEPS - 1, np.ceil(bound / exact * (STEPS - 1))).astype(np.int64)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, asked, tags, own, far = shared.value
        seen = np.zeros(STEPS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                other = unit(matrix(column(part, "x"), width))
                cosine = asked @ other.T
                q, r = np.nonzero(cosine >= least)
                same = (tags[q] == np.array(column(part, "tag").to_pylist(), object)[r]) & (own[q] != column(part, "node").to_numpy()[r])
                q, r = q[same], r[same]
                near, _ = grid.bounds(other[r])
                seen += np.bincount(step(far[0][q, near[0]] + far[1][q, near[1]]), minlength=STEPS)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["step", "n"])

    found = nodes.select("tag", "x", "node").mapInArrow(links, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toArrow()  # STEPS rows at most
    seen = np.zeros(STEPS, np.int64)
    seen[found["step"].to_numpy()] = found["n"].to_numpy()
    made_seen = np.bincount(step(far[0][row, made_near[0]] + far[1][row, made_near[1]]), minlength=STEPS)
    reach = max(int(np.searchsorted(np.cumsum(h), target * h.sum())) for h in (seen, made_seen)) / (STEPS - 1) * exact
    return grid, min(exact, reach * SPARE) + 1e-9, width


def visits(spark: SparkSession, nodes: DataFrame, grid: Grid, reach: float, width: int) -> DataFrame:
    """tag, cell, home, node, n, x: a row for each cell in which a node is at home or that it visits.

    Of two cells only the one of the smaller number visits the other, so that a pair meets once.
    """
    shared = spark.sparkContext.broadcast((grid, reach))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, reach = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near, far = grid.bounds(unit(matrix(column(part, "x"), width)))
                home = grid.cell(near[0], near[1])
                cells = [[c for c in grid.visited(far[0][r], far[1][r], reach) if c > home[r]] for r in range(part.num_rows)]
                row = np.concatenate([np.arange(part.num_rows), np.repeat(np.arange(part.num_rows), [len(c) for c in cells])])
                cell = np.concatenate([home, *[np.array(c, np.int64) for c in cells]])
                own = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([column(own, "tag"), pa.array(cell), pa.array(np.arange(len(row)) < part.num_rows), column(own, "node"), column(own, "n"), column(own, "x")], names=["tag", "cell", "home", "node", "n", "x"])

    return nodes.select("tag", "node", "n", "x").mapInArrow(deal, "tag string, cell long, home boolean, node long, n long, x array<double>")


def linked(met: DataFrame, least: float, width: int, block: int = BLOCK) -> DataFrame:
    """node, links, other: of each node with a link in a cell, the rows that it links to there and a node that links reach from it."""
    met = materialize(met, "near-visits")
    sizes = met.groupBy("tag", "cell").agg(F.count_if("home").alias("inside"), F.count("*").alias("all"))
    # a cell of one lone node has no pairs; blocks are cut from those at home, packs from all that come
    sizes = sizes.where("inside > 0 and all > 1").select("tag", "cell", F.ceil(F.col("inside") / block).alias("blocks"), F.ceil(F.col("all") / block).alias("packs"))
    met = met.join(sizes, ["tag", "cell"])
    own, at = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node"), F.col("packs"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    data = met.where("home").select("tag", "cell", own.alias("block"), F.explode(every(F.col("packs"))).alias("pack"), F.lit(True).alias("data"), "home", "node", "n", "x")
    came = met.select("tag", "cell", F.explode(every(F.col("blocks"))).alias("block"), at.alias("pack"), F.lit(False).alias("data"), "home", "node", "n", "x")
    both = data.unionByName(came).withColumn("bucket", F.pmod(F.xxhash64("tag", "cell", "block", "pack"), F.lit(max(1, -(-met.count() // GROUP)))))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("tag", "cell", "block", "pack", "data", "node")]).combine_chunks()
        tag = table["tag"].combine_chunks().dictionary_encode().indices.to_numpy()
        key = np.stack([tag, *[table[c].to_numpy() for c in ("cell", "block", "pack")]], 1)
        edge = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
        x, node, n = unit(matrix(table["x"], width)), table["node"].to_numpy(), table["n"].to_numpy()
        is_data, home = table["data"].to_numpy(zero_copy_only=False), table["home"].to_numpy(zero_copy_only=False)
        out = []
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(node)], strict=True):
            cut = a + int((~is_data[a:b]).sum())
            if cut in (a, b):
                continue
            links = (x[a:cut] @ x[cut:b].T) >= least
            # two at home in the cell meet twice, as visitor and as data: once is enough
            links &= ~home[a:cut, None] | (node[a:cut, None] < node[None, cut:b])
            if links.any():
                i, j = np.nonzero(links)
                moved, to = contracted(node[a:cut][i], node[cut:b][j])
                mine = np.concatenate([node[a:cut][rows := links.any(1)], node[cut:b][cols := links.any(0)]])
                count = np.concatenate([(links @ n[cut:b])[rows], (n[a:cut] @ links)[cols]])
                ids, at = np.unique(mine, return_inverse=True)
                total = np.zeros(len(ids), np.int64)
                np.add.at(total, at, count)
                other = ids.copy()
                other[np.searchsorted(ids, moved)] = to
                out.append((ids, total, other))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pa.table(dict(zip(("node", "links", "other"), cols, strict=True)))

    return materialize(both.groupBy("bucket").applyInArrow(meet, "node long, links long, other long"), "near-links")


def near_duplicates(spark: SparkSession, embeddings: DataFrame, least: float = 0.98, target: float = 1.0, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    rows = materialize(taking_part(embeddings).select("vec_id", "tag", F.when(F.col("fine"), F.col("x")).alias("x"), "fine", "h1", "h2"), "near-rows")
    nodes = nodes_of(rows)
    if nodes.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    grid, reach, width = fit(spark, nodes, least, target)
    met = linked(visits(spark, nodes, grid, reach, width), least, width, block)
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(met.select(F.col("node").alias("a"), F.col("other").alias("b")), "near-components")
    root = nodes.select("node", "h1", "h2", "tag", "n", "rep").join(found, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    root = root.where("links is not null or n > 1")
    least_id = root.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = root.join(least_id, "component").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("tag").alias("gt"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("joined"))
    out = rows.select("vec_id", "h1", "h2", "tag", "fine").join(known, F.col("fine") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("tag") == F.col("gt")), "left")
    component = F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def recall(spark: SparkSession, embeddings: DataFrame, least: float = 0.98, target: float = 1.0, every: int = 100) -> DataFrame:
    """vec_id, true_links, found_links of the rows whose vec_id ``every`` divides: brute force over all rows, in blocks, against the index.

    The rows asked for are broadcast, so ``every`` must leave few of them.
    """
    rows = taking_part(embeddings).where("fine")
    width = int(rows.agg(F.max(F.size("x"))).first()[0] or 0)
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "tag", "x", F.pmod(F.xxhash64("vec_id"), F.lit(-(-rows.count() // (every * BLOCK)) or 1)).alias("part"))
    packs = asked.groupBy("part").agg(F.collect_list(F.struct("vec_id", "tag", "x")).alias("asked"))
    shared = spark.sparkContext.broadcast([(np.array([r["tag"] for r in p], object), unit(np.array([r["x"] + [0.0] * (width - len(r["x"])) for r in p])), [r["vec_id"] for r in p]) for (p,) in packs.select("asked").collect()])  # the stated query set

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, tag = unit(matrix(column(batch, "x"), width)), np.array(column(batch, "tag").to_pylist(), object)
            for tags, q, ids in shared.value:
                n = ((q @ x.T >= least) & (tags[:, None] == tag)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n)], names=["vec_id", "n"])

    true = rows.select("tag", "x").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("true_links"))
    return true.join(near_duplicates(spark, embeddings, least, target).select("vec_id", F.col("n_links").alias("found_links")), "vec_id")
