"""Near-duplicates of vectors, ranked search and the manifest against plain versions, on odd rows and empty tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical_search, merkle, multi_index

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def linked_plainly(rows, least=0.98):
    ok = lambda l, v: l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    width = max([len(v) for _, _, v in rows if v], default=0)
    unit = [np.array(v + [0.0] * (width - len(v))) / np.linalg.norm(v) if ok(l, v) else None for _, l, v in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and unit[i] @ unit[j] >= least:
            links[i], links[j] = links[i] + 1, links[j] + 1
            root[find(j)] = find(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    smallest = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], links[i], smallest[find(i)], smallest[find(i)] == rows[i][0]) for i in range(len(rows))]


def clustered(seed, groups, dims, spread):
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = rng.standard_normal(dims)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), int(rng.integers(3)), (base + spread * rng.standard_normal(dims)).tolist()))
    return rows


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("dims,spread,block", [(16, 0.1, 2048), (7, 0.06, 4), (1, 0.5, 3)])
def test_near_vectors_equal_all_pairs(spark, dims, spread, block):
    rows = clustered(dims, 60, dims, spread)
    got = multi_index.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), block=block)
    assert order(map(tuple, got.collect())) == order(linked_plainly(rows)) and sum(r[1] for r in linked_plainly(rows)) > 50


def test_near_vectors_odd_rows(spark):
    v = [0.3, -0.2, 0.9]
    rows = [(5, 1, v), (4, 1, [x * 7 for x in v]), (3, 2, v), (2, None, v), (1, 1, None), (6, 1, [0.0, 0.0, 0.0]), (7, 1, [float("nan"), 1.0, 0.0]), (8, 1, [None, 1.0, 0.0]), (9, 1, [float("inf"), 1.0, 0.0]),
            (None, 1, v), (None, 3, [1.0, 0.0]), (None, 3, [1.0, 0.001]), (10, 4, [1.0, 0.0]), (11, 4, [1.0, 0.0, 0.0]), (12, 4, []), (13, 5, v), (13, 5, v), (14, 6, [1e300, 1e300, 0.0]), (15, 6, [1e-300, 1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("node", F.lit("clash")).withColumn("tag", F.lit(1)).withColumn("x", F.lit(2))
    plain = linked_plainly([(i, l, v and [(x / 1e300 if x and abs(x) > 1e200 else x * 1e300 if x and abs(x) < 1e-200 else x) for x in v]) for i, l, v in rows])
    assert order(map(tuple, multi_index.near_duplicates(spark, df).collect())) == order(plain)
    assert multi_index.near_duplicates(spark, df.limit(0)).count() == 0 and multi_index.near_duplicates(spark, df.where("embedding is null")).count() == 1


def test_a_third_of_all_vectors_are_copies_or_near_copies(spark):
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(8)
    rows = [(i, 0, (hot if i % 2 else hot + 0.01 * rng.standard_normal(8)).tolist()) for i in range(300)] + [(i, i % 2, rng.standard_normal(8).tolist()) for i in range(300, 900)]
    got = multi_index.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), block=32)
    assert order(map(tuple, got.collect())) == order(linked_plainly(rows))


def test_recall_is_measured_and_cells_are_visited_nearest_first(spark):
    rows = clustered(9, 300, 24, 0.06)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    met = multi_index.recall(spark, df, target=0.95, every=3).agg(F.sum("true_links"), F.sum("found_links")).first()
    assert met[0] > 100 and 0.9 * met[0] <= met[1] <= met[0]
    grid = multi_index.Grid(multi_index.unit(np.random.default_rng(2).standard_normal((400, 6))), 7)
    near, far = grid.bounds(multi_index.unit(np.random.default_rng(4).standard_normal((50, 6))))
    for r in range(50):
        bound = {grid.cell(i, j): far[0][r, i] + far[1][r, j] for i in range(7) for j in range(7)}
        seen = list(grid.visited(far[0][r], far[1][r], 0.3))
        assert seen[0] == grid.cell(near[0][r], near[1][r]) and sorted(seen) == sorted(c for c, b in bound.items() if b <= 0.3)
        assert all(bound[a] <= bound[b] for a, b in itertools.pairwise(seen))


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical_search.TERM, low)


def ranked_plainly(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    held = [c for _, c in counts if c]
    n, length = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, own in asked.items():
        found = []
        for doc, c in counts:
            m = 25 + 75 * sum(c.values()) * n // max(1, length)
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in own.items() if t in c)
            if s > 0:
                found.append((-s, doc is None, doc or 0))
        out += [(i, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("postings", [1 << 20, 12])
def test_search_equals_plain_ranking(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical_search, "CELLS", 40)
    rng = np.random.default_rng(5)
    vocab = ["sol", "Sol", "ñandú", "x1", "the", "você", "été", "a", "bb", "ccc", "straße", "ÀÉ", "Z9"]
    text = lambda n: "".join(w + s for w, s in zip(rng.choice(vocab, n), rng.choice([" ", "-", ".\n", "\x00", "\x7f", "_"], n), strict=True))
    docs = [(i, text(rng.integers(1, 30))) for i in range(150)] + [(200, None), (201, ""), (202, " .- "), (None, "sol a bb"), (203, "sol a bb"), (203, "sol a bb"), (204, "Bb" * 3000)]
    items = [(i, text(rng.integers(1, 9))) for i in range(12)] + [(20, None), (21, ""), (22, "unseen"), (None, "sol"), (3, "more sol"), (23, "bb" * 3000), (24, "sol a bb")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("item_id", F.lit("clash"))
    got = lexical_search.search(spark, d, spark.createDataFrame(items, "item_id long, text string").withColumn("times", F.lit("clash")), 10, postings)
    assert order(map(tuple, got.collect())) == order(ranked_plainly(docs, items, 10))


def test_search_long_texts_other_ids_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 100)
    long = "sun moon " * 3000 + "star" * 400 + " sun"
    docs = [("b", long), ("a", "sun"), ("ü", "moon star"), ("c", "earth " * 50)]
    d, i = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(1, "sun moon"), (2, "star" * 400)], "item_id int, text string")
    plain = ranked_plainly([(n, t) for n, (_, t) in enumerate(docs)], [(1, "sun moon"), (2, "star" * 400)], 10)
    got = sorted((r["item_id"], r["doc_id"], r["score"]) for r in lexical_search.search(spark, d, i).collect())
    assert got == sorted((i, docs[n][0], s) for i, _, n, s in plain)
    assert lexical_search.search(spark, d.limit(0), i).count() == 0 and lexical_search.search(spark, d, i.limit(0)).count() == 0
    raw = d.limit(1).select("doc_id", F.expr("cast(X'ff4142' as string)").alias("text"))
    assert lexical_search.search(spark, raw, i).count() == 0


def manifest_plainly(rows):
    H = lambda *p: hashlib.sha256(b"".join(p)).hexdigest().encode()  # noqa: E731, N806
    field = lambda v: b"-" if v is None else str(len(e := str(v).encode())).encode() + b":" + e
    leaf = lambda r: H(*map(field, r))
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                b = i // 16 * 16
                paths[k].append((b"".join(nodes[b:i]), b"".join(nodes[i + 1 : b + 16])))
            nodes, at = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
        return nodes[0], paths

    by, subs, out = {}, {}, []
    for r in rows:
        by.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    for g in sorted(by):
        own = sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[g] = (own, *climb([leaf(r) for r in own]))
    root, tops = climb([subs[g][1] for g in sorted(subs)]) if subs else (None, [])
    for g, top in zip(sorted(subs), tops, strict=True):
        for r, path in zip(subs[g][0], subs[g][2], strict=True):
            path = path + top
            a = leaf((*r[:4], low(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for left, right in path:
                a = H(left, a, right)
            out.append((r[0], *(x.decode() for x in (leaf(r), subs[g][1], root, H(*[x for p in path for x in p]), a)), a == root))
    return out


@pytest.mark.parametrize("hot", [1, 15, 16, 17, 256, 257, 4200])
def test_manifest_equals_plain_tree(spark, hot):
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(hot)] + [(10_000 + i, f"s{i % 19}", None, None, "ß Éa" * (i % 3)) for i in range(60)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(manifest_plainly(rows))


def test_manifest_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", None, 1, "X"), (3, "", "en", 1, None), (5, "a", "en", 0, ""), (5, "a", "en", 0, "Other"), (5, "a", "en", 0, "Other"), (-7, "=", "en", 2, "A" * 100_000), (8, "é", "de", 3, "ß"), (9, None, "de", 3, "QQ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("grp", F.lit("clash")).withColumn("place", F.lit(1)).withColumn("digest", F.lit("x"))
    assert order(map(tuple, merkle.manifest(df).collect())) == order(manifest_plainly(rows))
    assert merkle.manifest(df.limit(0)).count() == 0
    lone = merkle.manifest(df.where("doc_id = 8")).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] and lone["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    raw = df.limit(1).select("doc_id", "source", "lang", "n_chars", F.expr("cast(X'ff4142' as string)").alias("text"))
    assert merkle.manifest(raw).first()["leaf"] == hashlib.sha256(b"----3:\xffAB").hexdigest()


@pytest.mark.parametrize("few", [4096, 1])
def test_manifest_stores_no_paths(spark, monkeypatch, few):
    stored, write = [], merkle.materialize
    monkeypatch.setattr(merkle, "materialize", lambda *a: stored.append(write(*a)) or stored[-1])
    monkeypatch.setattr(merkle, "FEW", few, raising=False)
    rows = [(i, ("hot", "warm")[i % 4 == 0], "en", i, f"Text {i}") for i in range(3000)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(manifest_plainly(rows))
    for df in stored:  # a block's row holds its nodes' digests, not some kB for each
        size = F.length(F.to_json(F.struct("*")))
        most, total = df.agg(F.max(size), F.sum(size)).first()
        assert most < 100_000 and total < 3000 * 400
