"""Line dedup by distinct-site spread.

A line's spread is the number of distinct sites that hold it. One HyperLogLog sketch for each line hash is
merged by aggregation (partly before the shuffle, so a line that is everywhere sends a sketch from each
task); lines whose estimate lies near the threshold get an exact distinct count. Lines of at least
``min_words`` words on ``min_sites`` or more sites are boilerplate: they stay in the document of the
smallest id and are cut from all others. So no line vanishes from the corpus.

Sites are the values of ``source``; a null source is a site of its own. Null texts stay null, empty ones
empty. Repeated rows of the smallest id all keep the line. Other columns, whatever their names, pass untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import OTHERS, WORD, fold_others, materialize, unfold_others

MIN_SITES, MIN_WORDS, LG_K = 8, 3, 12
#: Most common lines that are broadcast (24 bytes each), and the copies of each beyond that.
BROADCAST_ROWS, SALTS = 1 << 18, 64
CORE, COUNTS = ("doc_id", "text", "source"), ("n_lines", "n_removed")


def spread_lines(occurrences: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Of (h, doc_id, site): h, first_doc, spread of the lines on min_sites or more sites.

    The band in which the exact count decides is six standard errors wide on either side, two sites at
    least; a sketch of few sites is exact anyway.
    """
    band = max(2.0, 6 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    lines = occurrences.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_doc"), F.count_if(F.col("doc_id").isNull()).alias("no_id"))
    lines = lines.select("h", F.when(F.col("no_id") == 0, F.col("first_doc")).alias("first_doc"), F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites - band)
    lines = materialize(lines, "lines-spread")
    near = lines.where(F.col("estimate") <= min_sites + band).select("h")
    exact = occurrences.join(near, "h", "left_semi").groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("sites"))
    spread = F.coalesce("sites", "estimate")
    return lines.join(exact, "h", "left").where(spread >= min_sites).select("h", "first_doc", spread.alias("spread"))


def occurrences_of(common: DataFrame, found: DataFrame) -> DataFrame:
    """found joined to the common lines by h. One line may hold a great part of all rows, so no key is one task's.

    Common lines are few and go to every task up to ``BROADCAST_ROWS`` of them; beyond that each is copied
    ``SALTS`` times and its occurrences are dealt over the copies by document.
    """
    if common.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(common), "h")
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, lg_k: int = LG_K) -> DataFrame:
    """doc_id, text with the boilerplate cut, source, others (see ``fold_others``), n_lines, n_removed."""
    docs = fold_others(docs, *CORE)
    key = F.xxhash64("text")
    parts = F.split("text", "\n", -1)
    lines = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("\u0000")).alias("site"), key.alias("text_key"), F.posexplode(parts).alias("pos", "line"))
    lines = lines.where(F.size(F.split(F.trim("line"), r"[\x20\x09-\x0D]+")) >= min_words).where(F.regexp_count("line", F.lit(WORD)) >= min_words)
    found = materialize(lines.select("doc_id", "site", "text_key", "pos", F.xxhash64("line").alias("h")), "lines")
    common = materialize(spread_lines(found, min_sites, lg_k), "lines-common")
    cut = occurrences_of(common, found).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    cut = cut.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("cut")).select(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"), "cut")
    out = docs.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (key == F.col("cut_key")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.array_size(parts) - 1), F.col("cut"))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_sort(kept), lambda i: F.get(parts, i)), "\n"))
    return out.select(
        "doc_id", text.alias("text"), "source", "others",
        F.coalesce(F.array_size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_size("cut"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, lg_k: int = LG_K) -> DataFrame:
    """All columns of docs with the boilerplate cut from ``text``, and n_lines, n_removed, which replace columns of these names."""
    out = without_boilerplate(docs, min_sites, min_words, lg_k)
    return out.select(*[c for c, name in zip(unfold_others(docs, *CORE), docs.columns, strict=True) if name not in COUNTS], *COUNTS)


def cut_boilerplate(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs with the boilerplate cut from ``text``; ``n_chars``, where there is one, follows the text."""
    out = without_boilerplate(docs, **options)
    own = {}
    if "n_chars" in docs.columns:
        before = F.col(OTHERS)[f"f{docs.columns.index('n_chars')}"]
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(before)
    return out.select(*unfold_others(docs, *CORE, **own))
