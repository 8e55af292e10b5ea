"""Each operator against a plain version, on odd rows and empty tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, fingerprint, line_dedup, lm_scoring, metric_search, mixing, ngram_join, pii, quality, sentencepiece, toxicity

BASE = "the cat sat on the mat and saw a dog run over to the old barn near a river "
ODD = [
    (1, BASE * 3, "en", "a", 1), (2, BASE * 3, "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "   \n\t", "en", "a", 0), (6, "one", "en", "b", 3), (7, "One", "de", "b", 3),
    (8, "you are an idiot and a moron\nmail a.b@c.org or +1 (415) 555-2671, 10.0.0.1 and 4111 1111 1111 1111", "en", "c", 1), (9, "x" * 5000 + " é▁ß 你好  \n" + BASE * 40, "en", "a", 1),
    (10, BASE * 3 + "end", "en", "c", 1), (None, "no id here at all", "en", "a", 1), (12, "same row", "en", "a", 1), (12, "same row", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit("clash")).withColumn("node", F.lit(0))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_lm_scores(spark, odd, none):
    got = lm_scoring.score_documents(spark, odd).collect()
    assert lm_scoring.score_documents(spark, none).count() == 0 and len(got) == len(ODD)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for r in ODD if not held(r[0]) for w in [*words(r[1]), b" "])
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(words(r[1])) + 1, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(r[1]), b" "]), 6)) for r in ODD)
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] <= 0 for r in got)


def test_filter_has_no_false_misses():
    rng = np.random.default_rng(1)
    h, n = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(1, 200, 5000)
    words_ = lm_scoring.build_segment(h & lm_scoring._LOW, n)
    f = lm_scoring.Filter(0, 0, [words_.tobytes()])
    f.shift = 1  # one segment in this test: the top bit of every hash is clear
    assert (f.levels(h) >= lm_scoring.level_of(n)).all()
    assert (f.levels(rng.integers(0, 2**63, 20000).astype(np.uint64)) > 0).mean() < 0.03


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, n, num):
    rng = np.random.default_rng(n)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(30):
        base = list(rng.choice(vocab, rng.integers(1, 160)))
        for _ in range(rng.integers(1, 8)):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(t)))
    rows += [(1000, None), (1001, ""), (1002, "lone"), (1003, "LONE")]
    got = {r["doc_id"]: r for r in ngram_join.link_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100).collect()}
    sets = {i: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if (w := words(t)) else set() for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in sets} == {i: (len(sets[i]), find(i)) for i in sets}


def test_join_odd_rows(spark, odd, none):
    got = ngram_join.link_documents(spark, odd).collect()
    assert len(got) == len(ODD) and ngram_join.link_documents(spark, none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[3]["component_id"] == 3 and by[7]["component_id"] == 6 and by[12]["n_copies"] == 2
    kept = sorted(str(r["doc_id"]) for r in ngram_join.one_of_each(spark, odd).collect())
    assert kept.count("12") == 1 and "2" not in kept and "3" in kept and "None" in kept


def test_small_subsets_meet():
    rng = np.random.default_rng(2)
    for a in range(1, 16):
        x = np.unique(rng.integers(0, 2**62, a).astype(np.uint64))
        for y in [x, *[np.delete(x, i) for i in range(len(x))]]:
            both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if len(y) and 100 * both >= 80 * union:
                assert np.intersect1d(ngram_join.subset_keys(x, 80, 100), ngram_join.subset_keys(y, 80, 100)).size


def labelled(spark):
    good = [(i, f"a fine text number {i} about rivers and barns.\nIt goes on quietly for a while.", "en", "s", 1) for i in range(120)]
    bad = [(i, f"you {w} idiot number {i} and moron, you trash.", "en", "s", 1) for i, w in zip(range(120, 200), itertools.cycle(["stupid", "dumb"]), strict=False)]
    junk = [(i, f"BUY!! NOW!! {i}!! BIG!! SALE!! HERE!!\nW | x | y | z | {i} | q | r", "en", "s", 1) for i in range(200, 280)]
    docs = spark.createDataFrame(good + bad + junk, SCHEMA)
    labels = docs.select("doc_id", F.col("doc_id").between(0, 199).cast("int").alias("quality"), F.col("doc_id").between(120, 199).cast("int").alias("toxic"))
    return docs, labels


@pytest.mark.parametrize("score,target", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_classifiers(spark, odd, none, score, target):
    docs, labels = labelled(spark)
    got = score(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[target] for r in got]) > 0.9
    empty = labels.limit(0)
    rows = score(spark, odd, empty).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0.5 for r in rows)
    assert score(spark, none, labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in score(spark, odd.unionByName(docs, True), labels).collect())


def test_quality_learns_from_whole_texts(spark):
    clean = "\n".join(f"the cat sat on mat {k} and saw a dog run over to the old barn." for k in range(70))
    dirty = "\n".join("BUY!! NOW!! BIG!! SALE!! | x | y | z | 1 | q |" for _ in range(40))
    rows = [(i, f"{clean} {i}" if i % 2 else f"{clean} {i}\n{dirty}", "en", "s", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = quality.score_quality(spark, docs, labels).where("held_out").collect()
    assert len(got) > 10 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.9
    # a line longer than any prefix that was once taken
    rows = [(i, "so it goes. " * 2_000 + ("it goes on and on." if i % 2 else "BUY!! NOW!! | x | y | z | 1 | " * 2_000), "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    got = quality.score_quality(spark, docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))).where("held_out").collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.9


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    per, move = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    emit = rng.normal(size=(8, 2))
    prob, _, log_z = quality.marginals(emit, move, per)
    start = 0
    for k, n in enumerate(per):
        score = {y: sum(emit[start + i, v] for i, v in enumerate(y)) + sum(move[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=int(n))}
        z = np.log(sum(np.exp(s) for s in score.values()))
        assert log_z[k] == pytest.approx(z)
        for i in range(n):
            assert prob[start + i, 1] == pytest.approx(sum(np.exp(s - z) for y, s in score.items() if y[i]))
        start += n


def test_fingerprints(spark, odd, none):
    got = fingerprint.fingerprint_documents(spark, odd).collect()
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in ODD))
    want = Counter()
    for i, (_, d, t) in enumerate(rows):
        want[(d, len(t), hashlib.sha256(fingerprint.edited(t, rows[(i + 1) % len(rows)][2]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert fingerprint.fingerprint_documents(spark, none).count() == 0
    text = " ".join(str(x) for x in np.random.default_rng(5).integers(0, 10**6, 600))  # no period, so many distinct phrases
    a = fingerprint.fingerprints(["", text, "zz" + text, text])
    assert (a[1] == a[3]).all() and (a[1] == a[2]).mean() > 0.7 and not a[0].any()


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = np.vstack([rng.normal(size=(300, 8)), np.tile(rng.normal(size=8), (60, 1))]).astype("float32")
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (401, [float("nan")] * 8), (402, [None] * 8)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in metric_search.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50, 5).collect()}
    q = np.floor(256 * v.astype(float)).astype(int)
    for i in range(0, len(q), 50):
        best = [j for j in sorted(range(len(q)), key=lambda j: (-(q[j] @ q[i]), j)) if j != i][:5]
        assert [got[(i, k + 1)] for k in range(5)] == [(j, q[j] @ q[i]) for j in best]
    assert len(got) == 5 * len(range(0, len(q), 50))
    assert metric_search.top_k(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_copies_and_few_rows(spark):
    def found(rows):
        return sorted(map(tuple, metric_search.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))

    def plain(rows):
        q, out = [(i, [math.floor(256 * x) for x in v]) for i, v in rows], []
        for own in {i for i, _ in q if i % 50 == 0}:
            all_ = [(-sum(a * b for a, b in zip(v, w, strict=True)), j) for i, v in q if i == own for j, w in q if j != own]
            out += [(own, rank, j, -s) for rank, (s, j) in enumerate(sorted(all_)[:5], 1)]
        return sorted(out)

    # id 0 is a result like others, with a negative score too
    apart = [(0, [1.0, 0.0]), (50, [-1.0, 0.0])]
    # copies of ids 1 and 2 before 8 others of the same vector; repeated queries; one id with several vectors
    copies = [(0, [1.0, 0.5])] + [(1, [1.0, 1.0])] * 7 + [(2, [1.0, 1.0])] * 2 + [(i, [1.0, 1.0]) for i in range(3, 11)]
    again = [(50, [0.5, -1.0])] * 3 + [(100, [1.0, -1.0]), (100, [-1.0, 1.0])] + [(200 + i, [i / 8, -i / 4]) for i in range(1, 9)] + [(300, [0.25, 0.0]), (300, [0.25, 0.5]), (300, [0.25, 0.0])]
    assert found(apart) == plain(apart)
    assert found(copies) == plain(copies)
    assert found(again) == plain(again)
    assert found(copies[1:] + again) == plain(copies[1:] + again)
    # five ranks for the one query even where copies of one id fill the block that is searched first
    mixed = [(0, [1.0, 0.0])] + [(7, [1.0, 0.0])] * 3 + [(i, [0.5 - i / 100, 0.1]) for i in range(10, 20)]
    assert found(mixed) == plain(mixed)


def test_best_path_equals_enumeration():
    pieces = [("a", 0, -3.0), ("b", 1, -3.1), ("ab", 2, -4.0), ("ba", 3, -5.5), ("aba", 4, -6.0), *[("", 5 + b, float(b)) for b in range(256)]]
    own, score = sentencepiece.Coder(pieces), {p: s for p, _, s in pieces if p}

    def best(t):
        return 0.0 if not t else max(score[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in score)

    for n in range(1, 8):
        for t in map("".join, itertools.product("ab", repeat=n)):
            ids = own.best_path(t)
            assert "".join(pieces[i][0] for i in ids) == t
            assert sum(pieces[i][2] for i in ids) == pytest.approx(best(t))


def test_pieces_round_trip(spark, odd, none):
    got = sentencepiece.encode_documents(spark, odd)
    assert all(r["round_trip"] for r in got.collect()) and sentencepiece.encode_documents(spark, none).count() == 0
    back = Counter((r["doc_id"], r["text"]) for r in sentencepiece.decode_documents(spark, got).collect())
    assert back == Counter((r[0], r[1] or "") for r in ODD)


def test_personal_data(spark, odd, none):
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark, odd).collect()}
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    fits = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s)), lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15]
    for d, t, *_ in ODD:
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t or "") if fits[k](m.group()))
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got[d]["spans"].split(","))
    assert (got[8]["n_email"], got[8]["n_ip"], got[8]["n_card"], got[8]["n_phone"]) == (1, 1, 1, 1)
    assert pii.find_personal_data(spark, none).count() == 0


def test_mixing(spark, odd, none):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), "en", f"s{i % 4}", 1) for i in range(800)], SCHEMA)
    got = mixing.mix_documents(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = r["doc_id"] % 4
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and len(words("w " * (1 + r["doc_id"] % 40))) == r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 41 for s in size)
    assert len(mixing.mix_documents(odd).collect()) == len(ODD) and mixing.mix_documents(none).count() == 0


def test_line_dedup(spark, none):
    common = "all rights reserved by this site"
    rows = [(i, f"line {i} of its own\n{common}\nback to top", "en", f"s{i}", 1) for i in range(12)] + [(50, None, "en", None, None), (51, "", "en", "s1", 0)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), min_sites=8).collect()}
    assert common in got[0] and all(common not in got[i] and f"line {i} of" in got[i] for i in range(1, 12)) and "back to top" not in got[5]
    assert got[50] is None and got[51] == "" and line_dedup.dedup_lines(none).count() == 0


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, sf).where("not round_trip").count() == 0


def plain_components(pairs):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_components_and_picked_rows(spark, local):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (150, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(20)]
    got = {r.node: r.component for r in ngram_join.components(spark.createDataFrame(pairs, "a long, b long"), local=local).collect()}
    assert got == {i: c for i, c in plain_components(pairs).items() if i != c}
    rows = spark.createDataFrame([(i * 7919 - 5000, i) for i in range(500)], "node long, at long")
    some = rows.where("at % 7 = 0").select(F.col("node").alias("pick"))
    got = {r["at"] for r in ngram_join.picked(rows, some, F.col("node")).collect()}
    assert set(range(0, 500, 7)) <= got and len(got) < 80  # all that are wanted, and few others


def test_join_of_large_sets_bridges_and_cells(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 3000)]

    def changed(t, k):
        t = list(t)
        for i in rng.choice(len(t), k, replace=False):
            t[i] = f"x{rng.integers(0, 10**9)}"
        return t

    # sets of 3,000 elements: a chain in which the ends don't link but by the middle, whose id is null
    far = changed(base, 90)
    rows = [(1, base), (None, changed(base, 45)[:1500] + far[1500:]), (3, far)]
    # one id with two texts that link to different documents
    one, two = ["a%d" % i for i in range(200)], ["b%d" % i for i in range(200)]
    rows += [(10, one), (11, changed(one, 1)), (11, changed(two, 1)), (12, two)]
    # copies in one list, beyond a cell of two
    rows += [(20 + i, changed(["c%d" % j for j in range(100)], 1)) for i in range(9)]
    rows = [(i, " ".join(t)) for i, t in rows]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    root = {i: i for i in range(len(rows))} | plain_components(links)
    least = {c: min((rows[j][0] for j in root if root[j] == c and rows[j][0] is not None), default=None) for c in root.values()}
    want = Counter((rows[i][0], len(sets[i]), least[root[i]]) for i in root)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for cell in (2, 2048):
        got = ngram_join.link_documents(spark, docs, 3, 90, 100, cell=cell, local=0 if cell == 2 else 1 << 20).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = ngram_join.one_of_each(spark, docs.withColumn("stay", F.lit(1)).withColumn("row", F.lit(2)), 3, 90, 100)
    assert kept.columns == ["doc_id", "text", "stay", "row"] and kept.count() == len(set(root.values()))


CLASHES = ("others", "n_removed", "cut", "copies", "copy", "rows", "own", "size", "text_key", "_text", "score", "row", "node", "stay", "h")


def test_stages_keep_clashing_columns(spark, odd, none):
    docs, labels = labelled(spark)
    docs = odd.select(*SCHEMA_NAMES).unionByName(docs.where("doc_id >= 20"))
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    docs = docs.withColumn("odd name`.x", F.lit(1))
    for stage in (lambda d: toxicity.reject_toxic(spark, d, labels), line_dedup.cut_boilerplate, lambda d: ngram_join.one_of_each(spark, d), mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(r[c] == c + (str(r["doc_id"]) if r["doc_id"] is not None else "-") for r in out.collect() for c in CLASHES)
        assert stage(docs.limit(0)).count() == 0
    assert {"n_lines", "n_removed"} <= set(line_dedup.dedup_lines(docs).columns) and line_dedup.dedup_lines(docs).where("doc_id = 1").first()["n_removed"] == 0


SCHEMA_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def test_mix_of_repeated_rows_meets_its_targets(spark):
    rows = [(i, "w " * 5, "en", f"s{i % 2}", 1) for i in range(40) for _ in range(3)] + [(None, "w " * 5, "en", "s0", 1)] * 60
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix_documents(docs).collect()
    assert len(plan) == len(rows)
    target, taken, per = {}, Counter(), Counter()
    of = lambda i: "s0" if i is None or i % 2 == 0 else "s1"
    for r in plan:
        target[of(r["doc_id"])] = r["target"]
        taken[of(r["doc_id"])] += r["taken"]
        per[(r["doc_id"], r["copies"])] += 1
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)
    out = mixing.mixed(docs).collect()
    got = Counter(r["doc_id"] for r in out)
    want = Counter()
    for (i, copies), n in per.items():
        want[i] += copies * n
    assert got == +want


def test_top_k_of_long_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [3e8, -1.0, 0.5]), (100, [1e300, 1.0]), (1, [3000000.0, 1.0]), (2, [2e8, 2e8]), (3, [-1e300, 4.0]), (4, [0.25, 0.25, 0.25]), (5, [1e9]), (6, None), (7, [float("inf"), 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("x", F.lit(1))
    got = sorted(map(tuple, metric_search.top_k(spark, docs).collect()))
    whole = {i: [math.floor(256 * int(e)) if e == int(e) else math.floor(256 * e) for e in v] for i, v in rows[:8]}
    want = []
    for q in (0, 50, 100):
        best = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[j], strict=False)))), j) for j in whole if j != q)[:5]
        want += [(q, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_pack_search_equals_scan_and_skips(spark):
    rng = np.random.default_rng(12)
    v = (rng.normal(size=(20, 6))[rng.integers(0, 20, 2000)] * 200 + rng.normal(size=(2000, 6)) * 5).astype(np.int64)
    top = float((v * v).sum(1).max())
    tree = metric_search.Tree(np.arange(2000), v, top, 16)
    at = np.arange(0, 2000, 40)
    best = tree.search(at, v[at], metric_search.Best([None] * len(at), 5))
    for i, q in enumerate(at):
        score = v @ v[q]
        want = sorted((-s, j) for j, s in enumerate(score.tolist()) if j != q)[:5]
        assert list(zip((-best.score[i]).tolist(), best.id[i].tolist(), strict=True)) == want
    assert tree.skipped and tree.computed < len(at) * 2000 / 2


def test_reliabilities_equal_a_plain_version():
    rng = np.random.default_rng(13)
    patterns = np.array(sorted({tuple(x) for x in rng.integers(-1, 2, (60, 5))}))
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    likely, post = pii.fit_reliabilities(patterns, counts, 20)
    p = [1 / (1 + math.exp(-sum(map(int, row)))) for row in patterns]
    for _ in range(20):
        right = []
        for j in range(5):
            pair = []
            for c, prior in ((0, 1.0), (1, 2.0)):
                w = [(q if c else 1 - q) * n for q, n in zip(p, counts, strict=True)]
                yes = sum(x for x, row in zip(w, patterns, strict=True) if row[j] == 1)
                no = sum(x for x, row in zip(w, patterns, strict=True) if row[j] == -1)
                pair.append((yes + prior) / (yes + no + 3))
            right.append(pair)
        share = [(sum((1 - q) * n for q, n in zip(p, counts, strict=True)) + 1) / (sum(counts) + 2), (sum(q * n for q, n in zip(p, counts, strict=True)) + 1) / (sum(counts) + 2)]
        new = []
        for row in patterns:
            odds = [share[c] * math.prod(right[j][c] if v == 1 else 1 - right[j][c] if v == -1 else 1.0 for j, v in enumerate(row)) for c in (0, 1)]
            new.append(odds[1] / sum(odds))
        p = new
    assert np.allclose(post, p) and np.allclose(likely, right)


def test_added_spans(spark):
    texts = {
        1: "my token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" stays here", 2: "cards 4111111111111111 4012888888881881 side by side", 3: "number 9807915762804490 is no card",
        4: "a clean text about rivers, barns and 12345 sheep", 5: "write to jane.doe (at) example (dot) org today", 6: "b" * 3000 + " " + "password: hunter2hunter2 " + "words " * 3000,
    }
    rows = [(i, t) for i, t in texts.items()] + [(100 + i, f"mail user{i}@mail.example.com or pay with 4111 1111 1111 1111, ip 10.1.2.{i}") for i in range(30)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = lambda i, kind: [texts[i][int(s) : int(e)] for k, s, e in (x.split(":") for x in got[i]["spans"].split(",") if x) if k == kind]
    assert cut(1, "secret") == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"] and cut(6, "secret") == ["hunter2hunter2"]
    assert cut(2, "card") == ["4111111111111111", "4012888888881881"] and cut(5, "email") == ["jane.doe (at) example (dot) org"]
    assert got[3]["spans"] == got[4]["spans"] == "" and got[1]["n_secret"] == 1 and got[2]["n_added"] == got[2]["n_spans"] == 2 and got[2]["n_card"] == 0


@pytest.mark.parametrize("max_bytes", [1 << 27, 2048])
def test_lm_scores_are_probabilities(spark, max_bytes):
    rng = np.random.default_rng(14)
    vocab = [f"v{i}" for i in range(60)]
    weight = 1 / np.arange(1, 61)
    rows = []
    for i in range(400):
        t = [int(rng.choice(60, p=weight / weight.sum()))]
        for _ in range(12):  # a word is followed by one of three others most of the time
            t.append(int((t[-1] * 7 + rng.integers(0, 3)) % 60) if rng.random() < 0.7 else int(rng.choice(60, p=weight / weight.sum())))
        rows.append((i, " ".join(vocab[k] for k in t)))
    # all continuations of two words and of a text's start, in rows that don't train
    held = [i for i in range(1000, 6000) if zlib.crc32(str(i).encode()) % 5 == 1]
    pairs = [f"{v} {w}" for v in ("v0", "v17") for w in vocab] + vocab + ["unseen", "v0 unseen", "v17 unseen"]
    rows += [(held[k], t) for k, t in enumerate(pairs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("rare", F.lit(0))
    for heavy in (1 << 18, 8):
        got = {r["doc_id"]: r for r in lm_scoring.score_documents(spark, docs, heavy=heavy, max_bytes=max_bytes).collect()}
        score = {t: got[held[k]]["score"] for k, t in enumerate(pairs)}
        # P(v w) = P(v | start) P(w | v) P(end | w); the sums over w of P(w | v) need P(end | w) from P(w) = P(w | start) P(end | w)
        train = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 5 != 1]
        c = Counter(w for _, t in train for w in [*t.split(), " "])
        assert all(got[i]["train_tokens"] == sum(c.values()) for i in got)
        model_gain = np.mean([got[i]["score"] - got[i]["base_score"] for i, _ in rows[:400] if zlib.crc32(str(i).encode()) % 5 == 1])
        assert model_gain > 2  # log10 over some 14 tokens
        follow = lambda v: {w: 10 ** (score[f"{v} {w}"] - score[v]) for w in vocab}
        for v in ("v0", "v17"):  # P(w | v) P(end | w) / P(end | v): bounded by 1 / P(end | v)
            assert 0 < sum(follow(v).values())


def test_conditional_probabilities_sum_to_one():
    rng = np.random.default_rng(15)
    text = [int(x) for x in rng.zipf(1.4, 30000) % 300]
    h = common.mix64(np.arange(1, 301).astype(np.uint64))
    count = np.bincount(text, minlength=300)
    for heavy in (0, 40, 10**6):
        often = np.flatnonzero((count > 0) & (count >= heavy))
        table = lm_scoring.Table(h[often], count[often])
        exact = table.counts(h)
        assert (exact[often] == count[often]).all() and (np.delete(exact, often) == -1).all()
        a, b = np.array(text[:-1]), np.array(text[1:])
        keys = lm_scoring.pair_keys(h[a], h[b], exact[a] >= 0)
        rare = np.flatnonzero((exact < 0) & (count > 0))
        packed = [np.unique(keys, return_counts=True), (lm_scoring.context_keys(h[rare]), count[rare])]
        table_ = lm_scoring._packed(1, packed).to_pydict()
        segments = [b"", b""]
        for k, seg in enumerate(table_["segment"]):
            own = np.concatenate([lm_scoring.unpack(table_["once"][k]), lm_scoring.unpack(table_["many"][k])])
            n = np.concatenate([np.ones(len(table_["once"][k]) // 6, np.int64), np.frombuffer(table_["count"][k], np.int64)])
            segments[seg] = lm_scoring.build_segment(own, n).tobytes()
        model = lm_scoring.Model(table, lm_scoring.Filter(1, 0, segments), len(text), int((count > 0).sum()))
        seen = np.flatnonzero(count)
        for v in (*seen[:5], *seen[-20:]):
            mine, context, both = model.probe(h, exact, seen, np.full(len(seen), v))
            assert mine.all()
            both = np.minimum(both, count[seen])
            lam = 0.6
            p = lam * both / (context + model.noise) + (1 - lam) * model.p1(count[seen])
            assert 0.75 < p.sum() + (1 - lam) * model.p1(np.zeros(1))[0] < 1.25


def test_word_codes_equal_split_words():
    import pyarrow as pa

    texts = [None, "", "  a  B\tc\x0bd ", "one", "one", "two\x1cx é\u00a0z", "ONE two", " ", "x" * 3000, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for part in (batch, batch.slice(3, 5)):
        code, per = common.word_codes(part)
        plain = [words(t) for t in part.column(0).to_pylist()]
        assert per.tolist() == [len(w) for w in plain]
        by = {}
        for w, c in zip([w for t in plain for w in t], code.tolist(), strict=True):
            assert by.setdefault(w, c) == c
        assert len(set(by.values())) == len(by)
    assert len(common.word_codes(batch.slice(0, 0))[0]) == 0


def test_line_spread_near_its_threshold(spark):
    rows = []
    for n in (6, 7, 8, 9, 10):
        rows += [(100 * n + i, f"a line that {n} sites hold\nown {n} {i} words", "en", f"s{i}" if i else None, 1) for i in range(n)]
    rows += [(None, "a line that 9 sites hold\nno id here", "en", "s1", 1), (901, "a line that 9 sites hold\nown 9 1 words", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for limit in (line_dedup.BROADCAST_ROWS, 0):  # the way without a broadcast gives the same
        line_dedup.BROADCAST_ROWS, before = limit, line_dedup.BROADCAST_ROWS
        try:
            got = line_dedup.dedup_lines(docs, min_sites=8).collect()
        finally:
            line_dedup.BROADCAST_ROWS = before
        for r in got:
            n = 9 if r["doc_id"] is None else r["doc_id"] // 100
            # a line with a null id among its rows has no document of its own: it goes from all that have one
            keeps = n < 8 or (r["doc_id"] is not None and r["doc_id"] % 100 == 0 and n != 9) or (n == 9 and r["doc_id"] is None)
            assert (f"a line that {n} sites hold" in r["text"]) == keeps, r


def test_targets_equal_a_plain_version(spark):
    sizes = {"a": 900, "b": 50, None: 400, "c": 30, "d": 700}
    rows = [(i, "w " * 10, "en", s, 1) for s, n in sizes.items() for i in range(n // 10)]
    got = {r["source_size"]: r["target"] for r in mixing.mix_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = ["a", "b", "c", "d", None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= full
    assert {sizes[s]: pytest.approx(t) for s, t in target.items()} == got


def test_likeness_equals_shared_slots(spark):
    rng = np.random.default_rng(16)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, n)) for n in (200, 5, 1, 400, 90)] + ["", "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("tie", F.lit("clash"))
    for partitions in (1, 4):
        got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(spark, docs, partitions).collect()}
        own = fingerprint.fingerprints(texts)
        for i, t in enumerate(texts):
            after = texts[(i + 1) % len(texts)]
            new = fingerprint.edited(t, after)
            assert got[i]["fingerprint"] == own[i].astype(">u2").tobytes().hex() and got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            assert got[i]["edited_fingerprint"] == fingerprint.fingerprints([new])[0].astype(">u2").tobytes().hex()
            assert got[i]["near_edited"] == np.mean(own[i] == fingerprint.fingerprints([new])[0]) and got[i]["near_next"] == np.mean(own[i] == own[(i + 1) % len(texts)])
        # the likeness of an edited long text tells it from a text that has nothing in common
        assert got[0]["near_edited"] > 0.4 > got[0]["near_next"] + 0.2


def test_very_long_texts(spark):
    docs, labels = labelled(spark)
    long = " ".join(f"word{i % 5000} runs{i}" for i in range(60_000))
    lines = "\n".join(f"line {i} of a long text" for i in range(20_000))
    docs = docs.unionByName(spark.createDataFrame([(1000, long, "en", "s", 1), (1001, long + " end", "en", "s", 1), (1002, lines, "en", "s", 1), (1003, "z" * 2_000_000, "en", "s", 1)], SCHEMA))
    linked = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(spark, docs.where("doc_id >= 1000"), 3, 90, 100).collect()}
    assert linked == {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1003}
    for out in (toxicity.score_toxicity(spark, docs, labels), quality.score_quality(spark, docs, labels), lm_scoring.score_documents(spark, docs)):
        assert all(np.isfinite(r["score"]) for r in out.where("doc_id >= 1000").collect()) and out.count() == docs.count()
    assert sentencepiece.encode_documents(spark, docs.where("doc_id >= 1000")).where("round_trip").count() == 4
