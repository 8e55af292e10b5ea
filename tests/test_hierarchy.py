"""The density hierarchy against a plain one, and what it need not compare."""

import numpy as np
import pytest

from tidemark.operators import hierarchy


def plain(data, size, least, whole=False):
    """Clusters from all pairs: mutual reachability, Kruskal's tree, merges top down."""
    ids = [i for i, _ in data]
    x = np.array([v for _, v in data], float)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, least - 1]
    w = np.maximum(np.maximum(np.maximum(d, core[:, None]), core), hierarchy.FINEST)
    top = list(range(len(ids)))

    def find(c):
        while top[c] != c:
            c = top[c]
        return c

    tree = {i: (None, None, None, [i]) for i in range(len(ids))}
    for weight, _, _, i, j in sorted((w[i, j], ids[i], ids[j], i, j) for i in range(len(ids)) for j in range(i + 1, len(ids))):
        a, b = find(i), find(j)
        if a != b:
            top[a] = b
            tree[b] = (1 / weight, tree[a], tree[b], tree[a][3] + tree[b][3])

    def grow(t, birth):
        total, every = 0.0, t[3]
        while t[0] is not None:
            level, left, right = t[0], t[1], t[2]
            small, big = sorted((left, right), key=lambda x: len(x[3]))
            if len(small[3]) >= size:
                return total + len(t[3]) * (level - birth), every, [grow(left, level), grow(right, level)]
            if len(big[3]) < size:
                return total + len(t[3]) * (level - birth), every, []
            total, t = total + len(small[3]) * (level - birth), big
        return total + 1 / hierarchy.FINEST - birth, every, []

    def pick(c):
        got = [pick(k) for k in c[2]]
        below = sum(g[0] for g in got)
        return (c[0], [c[1]]) if c[0] >= below else (below, [m for g in got for m in g[1]])

    root = grow(tree[find(0)], 0.0)
    groups = pick(root)[1] if whole else [m for k in root[2] for m in pick(k)[1]]
    return {ids[i]: min(ids[j] for j in g) for g in groups for i in g}


def two_densities(seed, dims=8):
    rng, rows, truth = np.random.default_rng(seed), [], []
    for c, (n, wide) in enumerate([(40, 0.02), (60, 0.15), (25, 0.02)]):
        base = rng.standard_normal(dims)
        rows += [(base + wide * rng.standard_normal(dims)).tolist() for _ in range(n)]
        truth += [c] * n
    rows += [rng.standard_normal(dims).tolist() for _ in range(40)]
    rows += [rows[130]] * 6
    return list(enumerate(rows)), truth


@pytest.mark.parametrize("options", [{"block": 16, "edges": 20}, {"size": 12, "least": 3, "whole": True}])
def test_equals_the_plain_tree(spark, options):
    data, truth = two_densities(1)
    got = dict(map(tuple, hierarchy.density_hierarchy(spark.createDataFrame(data, "vec_id long, embedding array<double>"), **options).collect()))
    assert got == plain(data, options.get("size", 5), options.get("least", 5), options.get("whole", False))
    if "whole" not in options:  # groups of two densities, each in a cluster of its own
        for c in range(3):
            own = [got.get(i) for i, t in enumerate(truth) if t == c]
            main = max({x for x in own if x is not None}, key=own.count)
            assert own.count(main) >= 0.8 * len(own) and all(got.get(i) != main for i, t in enumerate(truth) if t != c)


def test_compares_far_fewer_than_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(g * 40 + i, (b + 0.02 * rng.standard_normal(12)).tolist()) for g, b in enumerate(rng.standard_normal((75, 12))) for i in range(40)]
    told = {}
    got = dict(map(tuple, hierarchy.density_hierarchy(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64, tell=told).collect()))
    assert told["compared"] < 0.2 * told["pairs"] and len(got) > 2900
    assert len({got[i] for i, _ in rows if i in got}) == 75 and all(got[i] // 40 == i // 40 for i in got)


def test_vectors_travel_to_tiles_not_to_each_block(spark, monkeypatch):
    rng, went, visiting = np.random.default_rng(9), [], hierarchy.visiting
    data = [(i, rng.standard_normal(16).tolist()) for i in range(200)]  # nothing that a bound could rule out

    def counted(*args):
        went.append(visiting(*args).count())
        return visiting(*args)

    monkeypatch.setattr(hierarchy, "visiting", counted)
    monkeypatch.setattr(hierarchy, "TRAVEL", 1000, raising=False)  # two tiles at a time
    got = dict(map(tuple, hierarchy.density_hierarchy(spark.createDataFrame(data, "vec_id long, embedding array<double>"), size=3, least=2, block=8).collect()))
    assert got == plain(data, 3, 2) and max(went) <= 2 * len(data)


def test_odd_pools(spark):
    v = [1.0, 0.0]
    df = spark.createDataFrame([(i, v) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0])], "vec_id long, embedding array<double>")
    assert hierarchy.density_hierarchy(df).count() == 0 and hierarchy.density_hierarchy(df, whole=True).count() == 40
    assert hierarchy.density_hierarchy(df.where("vec_id >= 100"), pool=1).count() == 0 and hierarchy.density_hierarchy(df.limit(0)).count() == 0
