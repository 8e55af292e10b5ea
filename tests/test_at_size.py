"""Steps whose work or disk once outgrew their input."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry, registry_store
from tidemark.functions import language_model, text
from tidemark.llm import ngram_join
from tidemark.operators import discovery, sketches
from tidemark.plans import views
from tidemark.sources import daily_table


def joined_rows(spark, df):
    """The result, and the most rows that a join of it gave."""
    rows, store = df.collect(), spark._jsparkSession.sharedState().statusStore()
    last = max(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))
    told, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for i in range(nodes.size()):
        if "Join" in nodes.apply(i).name():
            of = nodes.apply(i).metrics()
            for j in range(of.size()):
                if of.apply(j).name() == "number of output rows" and told.contains(of.apply(j).accumulatorId()):
                    most = max(most, int(told.apply(of.apply(j).accumulatorId()).replace(",", "")))
    return rows, most


def test_evidence_of_many_events_of_one_day(spark):
    start, n = dt.datetime(2024, 1, 5), 1200
    docs = [(i, "m", "t", start + dt.timedelta(seconds=97 * i % 500_000), i % 9 != 0, (i * 37 % 101 - 50) / 50 if i % 5 else None) for i in range(n)]
    events = [(i, "m", "t", dt.date(2024, 1, 5 + i % 6), ("pelt", "ctfidf", "robust_z", None)[i % 4]) for i in range(n)]
    want = {}
    for e, _, _, day, method in events:
        span = 7 if method == "pelt" else 1
        inside = [d for d in docs if d[4] and 0 <= (day - d[3].date()).days < span]
        inside.sort(key=lambda d: (-abs(d[5] or 0) if method == "ctfidf" else 0, -d[3].timestamp(), d[0]))
        want[e] = [d[0] for d in inside[:5]]
    # an event of two rows takes the best of both windows, as they are
    twice = [(0, "m", "t", dt.date(2024, 1, 9), "pelt")]
    both = sorted([*want[0], *[d[0] for d in sorted((d for d in docs if d[4] and 0 <= (dt.date(2024, 1, 9) - d[3].date()).days < 7), key=lambda d: (-d[3].timestamp(), d[0]))[:5]]], key=lambda i: (-docs[i][3].timestamp(), i))
    want[0] = both[:5]
    d = spark.createDataFrame(docs, "document_id long, monitor_id string, topic_id string, published_at timestamp, is_relevant boolean, sentiment_score double")
    e = spark.createDataFrame(events + twice, "event_id long, monitor_id string, topic_id string, detected_on date, method string")
    got, most = joined_rows(spark, views.event_evidence(e, d))
    assert {r["event_id"]: r["evidence_ids"] for r in got} == {k: v for k, v in want.items() if v}
    assert most <= 5 * (n + 1)


def test_authors_of_halves_are_exact_beyond_any_sketch(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit("m").alias("k"), F.when(F.col("id") % 10 < 7, 1).otherwise(2).alias("half"), F.when(F.col("id") > 0, F.sha2((F.col("id") * 7 % 13_001).cast("string"), 256)).alias("author"))
    rows = rows.unionByName(rows.limit(5000))
    a, b = ({(None if i == 0 else i * 7 % 13_001) for i in range(n) if (i % 10 < 7) == w} for w in (True, False))
    got = sketches.in_both(sketches.distinct_values(rows, ["k", "half"], "author"), ["k"], "author", F.col("half") == 1).first()
    assert tuple(got)[1:] == (len(a), len(b), len(a | b), len(a & b))


@pytest.mark.parametrize("hubs", [1, 12, 2048])
def test_clusters_equal_all_pairs_whatever_the_hubs(spark, monkeypatch, hubs):
    monkeypatch.setattr(discovery, "TILE", (16, 64))
    rng = np.random.default_rng(hubs)
    x = np.concatenate([h + rng.normal(scale=0.25, size=(25, 6)) for h in rng.normal(size=(6, 6))] + [rng.normal(size=(40, 6))])
    x = np.concatenate([x, x[:3], x[:3]])
    ids = (rng.permutation(len(x)) * 3).tolist()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {i: {j for j in range(len(u)) if j != i and u[i] @ u[j] >= 0.9} for i in range(len(u))}
    core = {i for i in near if len(near[i]) >= 4}
    want = {i: ids[i] for i in core}
    for _ in core:
        want = {i: min([want[i], *[want[j] for j in near[i] & core]]) for i in core}
    want |= {i: min(want[j] for j in near[i] & core) for i in set(near) - core if near[i] & core}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    assert dict(map(tuple, discovery.density_clusters(rows, 0.9, 5, 30, hubs).collect())) == {ids[i]: c for i, c in want.items()}
    assert len(set(want.values())) > 2


def test_clusters_need_no_pairs_where_rows_have_many_near_ones(spark, monkeypatch):
    made, pairs = [], discovery.near_pairs
    monkeypatch.setattr(discovery, "near_pairs", lambda *a: made.append(pairs(*a)) or made[-1])
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, (rng.normal(size=8) + 1).tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    assert discovery.density_clusters(rows, 0.25).count() > 1400 and made[0].count() < 1500


def counted(df):
    """df, and how many of its rows were computed."""
    n = df.sparkSession.sparkContext.accumulator(0)

    def see(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return df.mapInArrow(see, df.schema), n


def test_steps_compute_their_input_once(spark, monkeypatch, tmp_path):
    texts = [(i, f"word{i % 7} alpha beta {'x' * (i % 5)}" if i % 11 else ("" if i % 2 else None), ("en", "de", None)[i % 3]) for i in range(60)]
    docs, make, seen = spark.createDataFrame(texts, "doc_id long, text string, lang string"), text.simhash, []

    def once(*args):
        df, n = counted(make(*args))
        seen.append(n)
        return df

    monkeypatch.setattr(text, "simhash", once)
    monkeypatch.setattr(registry, "table", lambda *a: docs)
    monkeypatch.setattr(registry_store, "table", lambda *a: docs)
    a, b = ({tuple(r) for r in registry.queries()[q](spark, "").collect()} for q in ("near_dups", "near_dups_by_day"))
    assert a == b and [n.value for n in seen] == [60, 60]
    counts, n = counted(language_model.trigram_counts(docs, "lang"))
    rows = counts.count()
    n.value = 0
    model = language_model.fit(counts, "lang")
    assert n.value == rows and model.names == ["de", "en"]
    table = daily_table.DayTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "day string, k long").schema, ("day",))
    new, n = counted(spark.createDataFrame([(str(i % 3), i) for i in range(30)], "day string, k long"))
    table.upsert(new, ["day", "k"])
    assert n.value == 30 and table.read().count() == 30 and not list((tmp_path / "t").glob("_pending/*"))


def sent_rows(spark, df):
    """The result, and how many rows were shuffled for it where no join broadcasts unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, store, sent = df.collect(), spark._jsparkSession.sharedState().statusStore(), 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    last = max(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))
    told, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    for i in range(nodes.size()):
        of = nodes.apply(i).metrics()
        for j in range(of.size()):
            if of.apply(j).name() == "shuffle records written" and told.contains(of.apply(j).accumulatorId()):
                sent += int(told.apply(of.apply(j).accumulatorId()).replace(",", ""))
    return rows, sent


def test_only_sets_of_pairs_and_texts_that_may_go_travel(spark):
    sets = spark.range(600).select(F.col("id").alias("node"), F.sequence(F.col("id") * 10, F.col("id") * 10 + 99).alias("elements"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (5, 599)], "a long, b long")
    rows, sent = sent_rows(spark, ngram_join.verify(pairs, sets, 80, 100))
    assert sorted(map(tuple, rows)) == [(1, 2)] and 0 < sent < 100
    words = lambda i: " ".join(f"w{i}_{k}" for k in range(20))
    docs = [(i, words(i)) for i in range(600)] + [(1000 + i, words(i)) for i in range(5)] + [(7, words(7)), (2000, None), (2000, None)]
    rows, sent = sent_rows(spark, ngram_join.one_of_each(spark, spark.createDataFrame(docs, "doc_id long, text string")))
    assert sorted(map(tuple, rows), key=str) == sorted([*docs[:600], *docs[-2:]], key=str) and sent < 200


def test_of_long_sets_only_likely_ones_are_fetched_and_in_parts(spark, monkeypatch):
    fetched, whole = [], ngram_join.fetch_sets

    def counted(*args):
        fetched.append((out := whole(*args)).count())
        return out

    monkeypatch.setattr(ngram_join, "fetch_sets", counted)
    monkeypatch.setattr(ngram_join, "LEAST_PART", 1)
    words = lambda name, n: [f"{name}_{k}" for k in range(n)]
    shared = words("s", 300)
    apart = [words(f"a{i}", 2700) + shared for i in range(20)]
    # copies but for one word, and a pair whose parities are of two widths
    alike = [t for i in range(20) for t in (words(f"b{i}", 3000), [*words(f"b{i}", 2999), "x"])] + [words("c", 2050), words("c", 2070)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(apart + alike)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(spark, docs, 5, 80, 100).collect()}
    assert got == {i: i if i < 20 else i - i % 2 for i in range(62)}
    assert sum(fetched) == 42 and max(fetched) < 30


def test_keys_of_sets_that_do_not_repeat_stay(spark):
    signed = spark.range(600).select(F.when(F.col("id") < 595, F.col("id")).otherwise(F.col("id") - 590).alias("node"), F.col("id").alias("at"), F.lit(1).alias("n_shingles"), F.array("id").alias("keys"))
    nodes = signed.groupBy("node").agg(F.count("*").alias("n_copies"), F.min("at").alias("first"))
    rows, sent = sent_rows(spark, ngram_join.first_rows(signed, nodes)[0])
    assert sorted(r["at"] for r in rows) == list(range(595)) and sent < 100


def broadcasts(spark, run):
    """What ``run`` gives, and how many broadcasts its plans hold."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    before, out, sent = ids(), run(), 0
    for i in ids() - before:
        nodes = store.planGraph(i).allNodes()
        sent += sum("Broadcast" in nodes.apply(k).name() for k in range(nodes.size()))
    return out, sent


def alike_hashes(n):
    """doc_id, simhash, near_duplicate_of by all pairs: groups within 3 bits of each other, and beyond."""
    rng = np.random.default_rng(n)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 20)
    rows = [(i, int(base[rng.integers(20)] ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 63, rng.integers(1, 5))))) for i in range(n)]
    return [(i, h, next((j for j, g in rows[:i] if ((h ^ g) & ((1 << 64) - 1)).bit_count() <= 3), None)) for i, h in rows]


def test_bands_of_a_small_file_of_hashes_are_not_broadcast(spark):
    rows = alike_hashes(300)
    hashes = discovery.stored(spark.createDataFrame(rows, "doc_id long, simhash long, n long").drop("n"))
    got, sent = broadcasts(spark, lambda: text.near_duplicates(hashes).collect())
    assert {r["doc_id"]: r["near_duplicate_of"] for r in got} == {i: n for i, _, n in rows} and len(got) == 300
    assert len({n for *_, n in rows}) > 5 and not sent


def test_days_meet_stored_bands_without_broadcasts(spark, monkeypatch):
    rows = alike_hashes(303)
    hashes = spark.createDataFrame(rows, "doc_id long, simhash long, n long").drop("n")
    monkeypatch.setattr(registry_store, "table", lambda *a: hashes)
    monkeypatch.setattr(text, "simhash", lambda df: df)
    got, sent = broadcasts(spark, lambda: registry.queries()["near_dups_by_day"](spark, "").collect())
    assert {r["doc_id"]: r["near_duplicate_of"] for r in got} == {i: n for i, _, n in rows} and len(got) == 303
    assert not sent
