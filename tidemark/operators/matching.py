"""Clusters and topics one to one, with the largest total similarity: an auction.

Within a monitor, rows of the smaller side bid for those of the other. A bidder takes the row of the best similarity less
price and raises its price by what it would lose with the second best, and a little more (``step``); whoever held it
bids again. Steps go from coarse to fine with the prices kept. Similarities are whole millionths, times one more
than the rows of a side, so the last step of 1 leaves no better assignment.

Monitors never meet: similarities are joined within a monitor, and each monitor is a group of its own, whose topics
are assumed to be few (its matrix is what a task holds). Prices, owners and the step of every monitor are a table
between rounds; a round makes at most ``BIDS`` bids of each monitor, and monitors that are done leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.discovery import stored
from tidemark.operators.topics import cosine

#: Bids of a monitor in a round, the unit of similarity, and by what a step shrinks.
BIDS, UNIT, SHRINK = 200_000, 1_000_000, 5


def similarities(clusters: DataFrame, topics: DataFrame, monitor: str = "monitor_id") -> DataFrame:
    """monitor, cluster_id, topic_id, s: the cosine of each cluster's centroid to each topic's of its own monitor."""
    home = topics.select(monitor, "topic_id", F.col("centroid").alias("home"))
    return clusters.join(home, monitor).select(monitor, "cluster_id", "topic_id", cosine(F.col("centroid"), F.col("home")).alias("s"))


class Auction:
    """One monitor's matrix, padded to a square: rows that stand for nobody, and pairs that are not given, are worth nothing."""

    def __init__(self, worth: np.ndarray):
        n = max(worth.shape)
        self.worth = np.zeros((n, n), np.int64)
        self.worth[: worth.shape[0], : worth.shape[1]] = worth
        self.worth *= n + 1
        self.price, self.owner, self.step = np.zeros(n, np.int64), np.full(n, -1), max(1, int(self.worth.max()) // 4)

    def run(self, bids: int) -> bool:
        """At most ``bids`` bids; whether the assignment is final."""
        while True:
            free = sorted(set(range(len(self.owner))) - set(self.owner.tolist()))
            while free:
                if not bids:
                    return False
                bids -= 1
                i = free.pop()
                gain = self.worth[i] - self.price
                j = int(gain.argmax())
                best = gain[j]
                gain[j] = np.iinfo(np.int64).min
                self.price[j] += (best - gain.max() if len(gain) > 1 else 0) + self.step
                if self.owner[j] >= 0:
                    free.append(int(self.owner[j]))
                self.owner[j] = i
            if self.step == 1:
                return True
            self.step = max(1, self.step // SHRINK)
            self.owner[:] = -1


def optimal_match(similar: DataFrame, by: tuple[str, ...] = ("monitor_id",), bids: int = BIDS) -> DataFrame:
    """by, cluster_id, topic_id, s of the pairs taken: as many as the smaller side has, of the largest total similarity.

    Pairs that ``similar`` lacks, or of a null similarity, are taken last and not returned.
    """
    rows = stored(similar.select(*by, "cluster_id", "topic_id", "s"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + f", cluster_id {kinds['cluster_id']}, topic_id {kinds['topic_id']}, done boolean, step long, price array<long>, owner array<long>"

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        c, t = (left[x].combine_chunks().dictionary_encode() for x in ("cluster_id", "topic_id"))
        # in order of ids, whatever order rows come in
        rank = [np.argsort(np.argsort(np.array(x.dictionary.to_pylist(), object), kind="stable"), kind="stable") for x in (c, t)]
        i, j = (r[x.indices.to_numpy()] for r, x in zip(rank, (c, t), strict=True))
        s = left["s"].to_numpy(zero_copy_only=False).astype(float)
        worth = np.zeros((len(rank[0]), len(rank[1])), np.int64)
        worth[i, j] = np.where(np.isnan(s), 0, np.rint(np.nan_to_num(s) * UNIT) + 2 * UNIT)
        turned = worth.shape[0] > worth.shape[1]
        auction = Auction(worth.T if turned else worth)
        if right.num_rows:
            auction.step, auction.price, auction.owner = right["step"][0].as_py(), np.array(right["price"][0].as_py()), np.array(right["owner"][0].as_py())
        done = auction.run(bids)
        out = {**{b: [] for b in by}, "cluster_id": [], "topic_id": []}
        if done:
            names = [np.array(x.dictionary.to_pylist(), object)[np.argsort(r)] for x, r in zip((c, t), rank, strict=True)]
            for object_, bidder in enumerate(auction.owner.tolist()):
                a, b = (object_, bidder) if turned else (bidder, object_)
                if a < worth.shape[0] and b < worth.shape[1] and worth[a, b]:
                    out["cluster_id"].append(names[0][a])
                    out["topic_id"].append(names[1][b])
        else:
            out["cluster_id"], out["topic_id"] = [None], [None]
        n = len(out["cluster_id"])
        cols = {b: pa.array([k.as_py()] * n, left[b].type) for b, k in zip(by, key, strict=True)}
        cols |= {x: pa.array(out[x], left[x].type) for x in ("cluster_id", "topic_id")}
        lists = pa.list_(pa.int64())
        keep = lambda x: pa.array([x] * n, lists)
        return pa.table({**cols, "done": pa.array([done] * n, pa.bool_()), "step": pa.array([auction.step] * n, pa.int64()), "price": keep(None if done else auction.price.tolist()), "owner": keep(None if done else auction.owner.tolist())})

    todo, state, took = rows, rows.sparkSession.createDataFrame([], schema), []
    while True:
        told = stored(todo.groupBy(*by).cogroup(state.groupBy(*by)).applyInArrow(meet, schema))
        took.append(told.where("done").select(*by, "cluster_id", "topic_id"))
        state = told.where("not done")
        if state.isEmpty():
            break
        todo = rows.join(state.select(*by), list(by), "left_semi")
    pairs = took[0]
    for more in took[1:]:
        pairs = pairs.unionByName(more)
    return pairs.join(rows, [*by, "cluster_id", "topic_id"]).select(*by, "cluster_id", "topic_id", "s")
