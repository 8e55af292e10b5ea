"""Text columns: cleaning, hashing, personal data, language, relevance, sentiment, simhash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns whose results must match, stop words by language, sentiment words and their valence.
EMAIL, PHONE, LINK = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", r"(?U)(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", r"(?U)https?://\S+"
STOP_WORDS = {
    "en": "the of and to in is that for it with as was on are by this be from or an at".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur pas au par avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
VALENCE = {"good": 1.9, "great": 3.1, "love": 3.2, "bad": -2.5, "terrible": -2.1, "hate": -2.7, "idiot": -2.3, "stupid": -2.4, "worthless": -1.9, "pathetic": -2.7, "disgusting": -2.4, "trash": -1.6, "loser": -2.4}
TOKEN = r"[\p{L}\p{N}_]+"
#: Tokens that are measured at once (a longer text stands alone).
TOKENS_AT_ONCE = 1 << 17
#: Bytes of input for each core below which rows are dealt to all cores.
SMALL = 1 << 24


def clean_text(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def strip_pii(c: Column) -> Column:
    """E-mail, then telephone, then link: an address must not leave digits for the next pattern."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, EMAIL, "[email]"), PHONE, "[phone]"), LINK, "[link]")


def author_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def word_count(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, " ")))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def spread_small(docs: DataFrame) -> DataFrame:
    """Rows of so few and small files that Spark would read them in fewer tasks than there are cores, dealt to all cores.

    A file of one row group is one task, however long its texts take. Larger inputs fill the cores as they are read and
    are left where they lie.
    """
    spark, files = docs.sparkSession, docs.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return docs
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return docs.repartition(cores) if size < cores * SMALL else docs


def per_document(docs: DataFrame, key: str, text: str, pattern: str, schema: str, measure: Callable[[np.ndarray, np.ndarray, list[str]], list[pa.Array]]) -> DataFrame:
    """``key`` and the columns of ``schema`` for each row, from the row's own tokens: nothing is shuffled, repeated keys stay apart.

    The JVM finds the tokens, so that letters and cases are those of every other text column. ``measure`` gets,
    for some rows at a time, where each row's tokens start, the place of each token among the distinct ones, and those.
    """
    docs = spread_small(docs.select(F.col(key).alias(key), F.col(text).alias(text)))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array()).alias("tokens"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = np.cumsum(pc.list_value_length(batch.column(1).slice(at)).to_numpy(zero_copy_only=False))
                n = max(1, int(np.searchsorted(size, TOKENS_AT_ONCE, side="right")))
                part = batch.slice(at, n)
                coded = part.column(1).flatten().dictionary_encode()
                start = np.concatenate([[0], size[:n]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *measure(start, coded.indices.to_numpy(), coded.dictionary.to_pylist())], names=["key", *names])
                at += n

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """64-bit simhash over word tokens with repetition; a distinct token is hashed once for some rows at a time."""

    def measure(start: np.ndarray, at: np.ndarray, words: list[str]) -> list[pa.Array]:
        digest = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:8] for w in words), np.uint8).reshape(-1, 8)
        sign = np.unpackbits(digest, axis=1).astype(np.int8) * 2 - 1
        some, one = start[1:] > start[:-1], np.zeros((len(start) - 1, 64), bool)
        if some.any():
            one[some] = np.add.reduceat(sign[at], start[:-1][some], axis=0, dtype=np.int32) > 0
        return [pa.array(np.packbits(one, axis=1).view(">i8").ravel().astype(np.int64))]

    return per_document(docs, key, text, TOKEN, "simhash long", measure)


def band_keys(simhash: Column) -> Column:
    """Of six blocks of 10 or 11 bits each choice of three, as a key; hashes that differ in 3 bits at most have one in common."""
    edges = [0, 11, 22, 33, 44, 54, 64]
    block = [F.shiftrightunsigned(simhash, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return F.array(*[F.shiftleft(F.shiftleft(block[x], 11).bitwiseOR(block[y]), 11).bitwiseOR(block[z]) for x, y, z in combinations(range(6), 3)])


def linked(hashes: DataFrame, key: str = "doc_id", distance: int = 3) -> DataFrame:
    """key, simhash, near_duplicate_of: the first earlier document within the distance (3 at most).

    Of six blocks of 10 or 11 bits, three agree where 3 bits differ: each choice of three is a key of 31 bits
    or more, so that hundreds of millions of hashes still spread thin. Equal hashes meet once as a group, not in
    pairs: only distinct hashes are joined. Joins merge: Spark takes the twenty bands of a hash to be no larger than
    the file of hashes, and would broadcast them through the driver.
    """
    one = hashes.groupBy("simhash").agg(F.min(key).alias("first"))
    bands = one.select("simhash", "first", F.posexplode(band_keys(F.col("simhash"))).alias("band", "part"))
    a, b = bands.alias("a"), bands.alias("b")
    met = a.hint("merge").join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash"))) <= distance))
    least = met.groupBy(F.col("a.simhash").alias("simhash")).agg(F.min("b.first").alias("m"))
    return hashes.hint("merge").join(least, "simhash").select(key, "simhash", F.when(F.col("m") < F.col(key), F.col("m")).alias("near_duplicate_of"))


def near_duplicates(hashes: DataFrame, key: str = "doc_id", distance: int = 3) -> DataFrame:
    """key, near_duplicate_of of each row of hashes."""
    return linked(hashes, key, distance).drop("simhash")


def language(docs: DataFrame, key: str = "doc_id", text: str = "text", profiles: dict[str, list[str]] | None = None) -> DataFrame:
    """The language whose profile words (stop words by default) make up most of a text, and their share of all found; none is null."""
    profiles = profiles or STOP_WORDS
    names = sorted(profiles)
    own = {w: [w in profiles[g] for g in names] for g in names for w in profiles[g]}
    none = [False] * len(names)

    def measure(start: np.ndarray, at: np.ndarray, words: list[str]) -> list[pa.Array]:
        hit = np.array([own.get(w, none) for w in words], np.int64).reshape(-1, len(names))
        total = np.zeros((len(at) + 1, len(names)), np.int64)
        np.cumsum(hit[at], axis=0, out=total[1:])
        count = total[start[1:]] - total[start[:-1]]
        best, every = count.argmax(1), count.sum(1)
        share = np.round(count[np.arange(len(best)), best] / np.maximum(every, 1), 6)
        return [pa.array([names[i] for i in best], pa.string(), mask=every == 0), pa.array(share, mask=every == 0)]

    return per_document(docs, key, text, TOKEN, "language string, confidence double", measure)


def sentiment(docs: DataFrame, key: str = "doc_id", text: str = "text", lexicon: dict[str, float] | None = None) -> DataFrame:
    """Lexicon sum normalised to (-1, 1), and its label. A lexicon of any size a worker can hold may take the place of the short one."""
    valence = lexicon or VALENCE

    def measure(start: np.ndarray, at: np.ndarray, words: list[str]) -> list[pa.Array]:
        own = np.array([valence.get(w, 0.0) for w in words], float)
        hit = own[at] != 0 if len(at) else np.zeros(0, bool)
        row = np.repeat(np.arange(len(start) - 1), np.diff(start))[hit]
        total = np.bincount(row, own[at[hit]], len(start) - 1) if len(row) else np.zeros(len(start) - 1)
        return [pa.array(np.round(total, 9))]

    scored = per_document(docs, key, text, TOKEN, "s double", measure)
    score = F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15), 6)
    return scored.select(key, score.alias("sentiment_score"), F.when(score >= 0.05, "positive").when(score <= -0.05, "negative").otherwise("neutral").alias("sentiment_label"))


def page_text(c: Column) -> Column:
    """Visible text of an HTML page; nothing left is null, an unusable page."""
    bare = F.regexp_replace(c, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return clean_text(bare)


def outlet(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.coalesce(F.nullif(host, F.lit("")), F.lit("outlet:unknown"))


def local_day(ts: Column, zone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_bounds(bucket: Column, zone: Column) -> tuple[Column, Column]:
    """The local day as a half-open UTC range: 23 or 25 hours where clocks change."""
    return F.to_utc_timestamp(bucket.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(bucket, 1).cast("timestamp"), zone)


def language_gate(docs: DataFrame, accepted: list[str], later: list[str], language: str = "language") -> DataFrame:
    """docs with ``accepted`` and with the columns of later stages null where a verdict lies outside the accepted set."""
    ok = F.col(language).isNull() | F.col(language).isin(accepted)
    return docs.select(*[F.when(ok, F.col(c)).alias(c) if c in later else F.col(c) for c in docs.columns], ok.alias("accepted"))


def relevance(c: Column, least: int = 3) -> Column:
    """1 for a text of ``least`` words or more, else 0; relevant is what is above 0."""
    return F.when(word_count(c) >= least, 1.0).otherwise(0.0)


def attach_intents(docs: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """docs with the intent of the landed verdict of the same keys (content hash and prompt version); none stays null."""
    own = verdicts.groupBy(*keys).agg(F.min(F.struct("intent", "intent_confidence")).alias("v"))
    return docs.join(own, keys, "left").withColumn("intent", F.col("v.intent")).withColumn("intent_confidence", F.col("v.intent_confidence")).drop("v")


def verdict_batches(docs: DataFrame, group: str, order: list[str], size: int = 40) -> DataFrame:
    """docs with the batch of at most ``size`` in which each goes out for a verdict, by group in order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return docs.withColumn("batch", F.ceil(place / size).cast("int"))


def rerun_stages(old: DataFrame, new: DataFrame, key: str, stages: dict[str, list[str]]) -> DataFrame:
    """old with the columns of the stages that ran again from new, where new has the row; other columns stay.

    ``stages``: columns of each stage that ran. ``model_versions`` takes new's versions of these stages and keeps the others.
    """
    columns = {c for cols in stages.values() for c in cols}
    other = new.select(F.col(key), F.lit(True).alias("ran"), *[F.col(c).alias(f"new_{c}") for c in columns], F.col("model_versions").alias("new_versions"))
    keep = lambda e: ~F.map_contains_key("new_versions", e["key"])
    ours = F.map_filter("new_versions", lambda k, v: k.isin(list(stages)))
    merged = F.when(F.col("ran"), F.map_from_entries(F.concat(F.filter(F.map_entries("model_versions"), lambda e: keep(e) | ~e["key"].isin(list(stages))), F.map_entries(ours)))).otherwise(F.col("model_versions"))
    met = old.join(other, key, "left")
    pick = lambda c: F.when(F.col("ran"), F.col(f"new_{c}")).otherwise(F.col(c)) if c in columns else merged if c == "model_versions" else F.col(c)
    return met.select(*[pick(c).alias(c) for c in old.columns])
