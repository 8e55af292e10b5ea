"""Ids of other types, bytes that are no UTF-8, and long secrets."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprint, pii, sentencepiece

BAD = "cast(X'ff4142' as string)"


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string", "decimal(10,0)"])
def test_fingerprints_of_any_id(spark, kind):
    df = spark.createDataFrame([(i, f"text number {i} of a river and a mill " * 4) for i in range(9)], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = fingerprint.fingerprint_documents(spark, df, 3)
    assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType and sorted(str(r["doc_id"]) for r in got.collect()) == [str(i) for i in range(9)]


def test_bytes_that_are_no_text(spark):
    rows = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr(BAD).alias("text")).unionByName(spark.createDataFrame([(2, "�AB")], "doc_id int, text string"))
    a, b = sorted(fingerprint.fingerprint_documents(spark, rows).collect(), key=lambda r: r["doc_id"])
    assert a["fingerprint"] == b["fingerprint"] and a["n_chars"] == 3
    assert {r["n_spans"] for r in pii.find_personal_data(spark, rows).collect()} == {0}
    x, y = sorted(sentencepiece.encode_documents(spark, rows).collect(), key=lambda r: r["doc_id"])
    assert x["piece_ids"] == y["piece_ids"] and x["round_trip"]


def test_secrets_of_any_length_keep_their_whole_span(spark):
    long = "a1B2c3D4e5" * 200
    rows = [(1, f"token = {long} end"), (2, f"see {long} there"), (3, "api_key: " + "k9" * 5), (4, "plain words only")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r["doc_id"]: [(c["start"], c["end"]) for c in r["found"] if pii.KINDS[c["kind"]] == "secret"] for r in pii.find_candidates(docs).collect()}
    assert found == {1: [(8, 8 + len(long))], 2: [(4, 4 + len(long))], 3: [(9, 19)], 4: []}
    assert pii.find_candidates(spark.createDataFrame([(1, "a" * 2_000_000), (2, "password=" + "x" * 2_000_000)], "doc_id int, text string")).count() == 2
