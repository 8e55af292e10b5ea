"""The auction against exhaustive search."""

import itertools

import numpy as np
import pytest

from tidemark.operators import matching


def best_total(s):
    s = s if s.shape[0] <= s.shape[1] else s.T
    return max(sum(s[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(s.shape[1]), s.shape[0]))


@pytest.mark.parametrize("bids", [matching.BIDS, 7])
def test_total_equals_exhaustive_search(spark, bids):
    rng, rows, want = np.random.default_rng(1), [], {}
    shapes = [(1, 1), (1, 4), (4, 1), (5, 5), (3, 7), (7, 3), (6, 6)]
    for m, (n, k) in enumerate(shapes):
        s = np.round(rng.uniform(-1, 1, (n, k)), 6)
        if m == 3:
            s[:, 2:] = -1.0  # all want the same two
        if m == 6:
            s = np.round(s, 0)  # ties
        want[f"m{m}"] = (min(n, k), best_total(s))
        rows += [(f"m{m}", i, f"t{j}", float(s[i, j])) for i in range(n) for j in range(k)]
    df = spark.createDataFrame(rows, "monitor_id string, cluster_id long, topic_id string, s double")
    got = matching.optimal_match(df, bids=bids).collect()
    for m, (n, total) in want.items():
        own = [r for r in got if r["monitor_id"] == m]
        assert len(own) == len({r["cluster_id"] for r in own}) == len({r["topic_id"] for r in own}) == n
        assert abs(sum(r["s"] for r in own) - total) < 1e-9
    # greedy is worse somewhere, so the test can tell them apart
    worse = 0
    for m, (_, total) in want.items():
        greedy, s = 0.0, {(r[1], r[2]): r[3] for r in rows if r[0] == m}
        while s:
            (i, j), x = max(s.items(), key=lambda e: e[1])
            greedy, s = greedy + x, {k: v for k, v in s.items() if k[0] != i and k[1] != j}
        worse += greedy < total - 1e-6
    assert worse


def test_missing_and_null_pairs(spark):
    df = spark.createDataFrame([("a", 1, 10, 0.5), ("a", 1, 11, None), ("a", 2, 10, 0.9)], "monitor_id string, cluster_id long, topic_id long, s double")
    assert [tuple(r) for r in matching.optimal_match(df).collect()] == [("a", 2, 10, 0.9)]
    assert matching.optimal_match(df.limit(0)).count() == 0
    big = np.random.default_rng(2).uniform(-1, 1, (120, 150))
    a = matching.Auction(np.rint(big * matching.UNIT).astype(np.int64) + 2 * matching.UNIT)
    assert a.run(10**7)
    own = {int(i): j for j, i in enumerate(a.owner) if i < 120}
    gain = (a.worth - a.price).max(1)
    assert len(own) == 120 and all(a.worth[i, j] - a.price[j] >= gain[i] - 1 for i, j in own.items())
