"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of words from a fixed lexicon and of stems learned on the training
rows, how many of them stand near a second-person word, shares of capitals, punctuation, marks and digits,
and rates of obfuscation (letters swapped for digits or marks, spelled-out words, stretched letters).

Trees and calibration are fitted on at most ``TRAIN_ROWS`` labelled documents (those of the smallest id
hash, one for each distinct text), never on held-out rows. One fifth of them is kept from the trees and
fits the isotonic curve. Everything else, the learned lexicon's counts aside, covers all documents.

Null texts count as empty; every text gets a score. Labels of repeated ids or with nulls are ignored unless
they are 0 or 1 (repeated labels all count). Without rows of both classes the score is the smoothed share of
toxic labels (one half without any). Extra columns, whatever their names, play no part, nor do lang, source and doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, fold_of, fold_others, materialize, slices, span_sums, text_bytes, unfold_others

TRAIN_ROWS, LEARNED_WORDS, MIN_DOCS, TREES, DEPTH = 12_000, 60, 8, 20, 4
# Insults and second-person words of the languages at hand.
LEXICON = (
    "idiot moron stupid dumb loser pathetic disgusting worthless trash scum clown fool imbecile jerk bastard bitch asshole shit fuck crap "
    "garbage filth vermin retard freak pig ugly hate kill die shut dipshit cunt whore slut cretin dimwit dolt nitwit scumbag "
    "dumm dummkopf trottel arschloch scheisse abschaum widerlich idiota imbécil estúpido estúpida basura asqueroso payaso "
    "connard salaud imbécile stupide ordure déchet dégoûtant"
).split()
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú ti eres".split())
LEET = bytes.maketrans(b"013457@$!|*#", b"oieastasii**")
FEATURES = ("hits", "density", "learned_hits", "learned_density", "near_you", "capitals", "punctuation", "marks", "digits", "exclaim", "masked_hits", "masked_rate", "spelled", "stretched", "log_words", "word_length")
#: Names that no column of documents has.
COLUMNS = tuple(f"_toxic_{f}" for f in FEATURES)
_NOT_WORD = bytes(c if chr(c).isalnum() or c >= 128 or c in b"@$!*#|" else 32 for c in range(256))
_EDGES = b"@$!*#|"
# A run of letters is tried once, from its start: very long ones stay linear.
_MASKED = re.compile(rb"(?<![a-z])[a-z]++[0-9@$!*#|]+[a-z][a-z0-9@$!*#|]*|[@$!0-9][a-z]{2,}[0-9@$!*]*[a-z]*")
_SPELLED = re.compile(rb"(?<![a-z])(?:[a-z][ .*_-]){3,}[a-z](?![a-z])")
_STRETCHED = re.compile(rb"([a-z])\1{3,}")
_CLASS = np.zeros(256, np.uint8)
for _c in range(128):
    _CLASS[_c] = 1 if 65 <= _c <= 90 else 2 if chr(_c) in ".,;:'\"()-?" else 3 if chr(_c) in "@#$%^&*_+=<>|~/\\[]{}" else 4 if 48 <= _c <= 57 else 5 if _c == 33 else 0


def text_features(batch: pa.RecordBatch, learned: frozenset[bytes], name: str = "text") -> np.ndarray:
    """One row of FEATURES for each text of a batch."""
    data, off = text_bytes(batch, name)
    size = np.maximum(np.diff(off), 1)
    kind = _CLASS[data]
    share = [span_sums(kind == i, off) / size for i in range(1, 6)]
    fixed, lengths = _LEXICON, sorted({len(w) for w in learned})
    heads = frozenset(w[:3] for w in learned)

    def listed(words: list[bytes]) -> list[int]:
        return [k for k, w in enumerate(words) if w in fixed or (w[:3] in heads and any(w[:n] in learned for n in lengths))]

    out = np.zeros((batch.num_rows, len(FEATURES)))
    for i, raw in enumerate(as_bytes(batch, name)):
        low = raw.lower()
        words = low.translate(_NOT_WORD).split()
        if not words:
            continue
        n = len(words)
        hits = listed(words)
        if any(c in low for c in (b"!", b"*", b"$", b"@", b"#", b"|")):
            words = [w.strip(_EDGES) for w in words]
            hits = listed(words)
        own = sum(words[k] in fixed for k in hits)
        near = sum(any(w in SECOND_PERSON for w in words[max(0, k - 3) : k + 4]) for k in hits)
        masked = [m.translate(LEET) for m in _MASKED.findall(low)]
        found = sum(_holds(m, fixed) for m in masked) + len(listed(masked))
        spelled = [re.sub(rb"[^a-z]", b"", m) for m in _SPELLED.findall(low)]
        told = len(listed(spelled))
        out[i, :5] = own, own / n, len(hits) - own, (len(hits) - own) / n, near / n
        out[i, 10:] = found + told, len(masked) / n, len(spelled) / n, len(_STRETCHED.findall(low)) / n, np.log1p(n), len(low) / n
    out[:, 5:10] = np.stack(share, axis=1)
    return out


_LEXICON = frozenset(w.encode() for w in LEXICON)


def _holds(masked: bytes, lexicon: frozenset[bytes]) -> bool:
    """Whether a word of the lexicon fits where stars stand for any letter."""
    word = masked.strip(b"*")
    if b"*" not in word or len(word) < 4:
        return False
    pattern = re.compile(re.escape(word).replace(rb"\*", b"."))
    return any(pattern.fullmatch(w) for w in lexicon)


def add_features(docs: DataFrame, learned: frozenset[bytes], keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns and one column for each feature; text itself may be kept."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], docs["text"].alias("_text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            x = text_features(batch, learned, "_text")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(x[:, j]) for j in range(len(FEATURES))]], names=[*keep, *COLUMNS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(measure, kinds + "".join(f", {f} double" for f in COLUMNS))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled documents outside the held-out fold, a fixed choice.

    The chosen ids and labels, ``rows`` of them at most, are broadcast, so that other documents' texts are not shuffled.
    """
    marked = labels.where(F.col(target).isin(0, 1)).where(F.col("doc_id").isNotNull()).where(fold_of() != 0).select("doc_id", F.col(target).cast("double").alias("label"))
    order = F.xxhash64("doc_id", F.lit(3))
    few = marked.orderBy(order, "doc_id", "label").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    # of equal texts the smallest id stays, so that reruns choose alike
    return found.groupBy(F.xxhash64("text").alias("key"), "label").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text", "label")


def learn_lexicon(train: DataFrame, size: int = LEARNED_WORDS, least: int = MIN_DOCS) -> frozenset[bytes]:
    """Word beginnings of 4 to 6 letters that stand out among toxic documents, so that endings don't hide a stem.

    Ranked by the log odds over their standard error; one that begins another, or begins with it, adds nothing.
    """
    count = train.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, pos = count["n"] or 0, count["pos"] or 0.0
    if not pos or pos == n:
        return frozenset()

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            seen: dict[str, list[int]] = {}
            for raw, toxic in zip(as_bytes(batch), batch.column(1).to_pylist(), strict=True):
                for w in {w[:k] for w in set(raw.lower().translate(_NOT_WORD).decode("utf-8", "replace").split()) for k in range(4, 7) if len(w) >= k}:
                    x = seen.setdefault(w, [0, 0])
                    x[0] += toxic == 1
                    x[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["w", "p", "a"])

    by = train.select("text", "label").mapInArrow(stems, "w string, p long, a long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("a").alias("a")).where(F.col("p") >= least)
    q = F.col("a") - F.col("p")
    odds = F.log((F.col("p") + 0.5) / (pos - F.col("p") + 0.5)) - F.log((q + 0.5) / (n - pos - q + 0.5))
    rank = odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (q + 0.5))
    chosen: list[str] = []
    for r in by.where(odds > 2.5).orderBy(rank.desc(), F.length("w").desc(), "w").limit(20 * size).collect():
        if len(chosen) < size and not any(c.startswith(r["w"]) or r["w"].startswith(c) for c in chosen):
            chosen.append(r["w"])
    return frozenset(w.encode() for w in chosen)


def _scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], train_rows: int, target: str) -> DataFrame:
    """The ``keep`` columns and _toxic_score."""
    train = materialize(training_rows(docs, labels, target, train_rows), "toxicity-train")
    learned = learn_lexicon(train)
    known = materialize(add_features(train, learned, ("doc_id", "label")), "toxicity-features").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)))
    by = {(r["label"], r["cal"]): r["count"] for r in known.groupBy("label", (F.col("part") == 0).alias("cal")).count().collect()}
    pos = sum(v for (y, _), v in by.items() if y == 1)
    total = sum(by.values())
    rows = add_features(docs, learned, keep)
    if min(by.get((y, c), 0) for y in (0.0, 1.0) for c in (True, False)) < 2:
        return rows.withColumn("_toxic_score", F.lit((pos + 0.5) / (total + 1)))
    join = VectorAssembler(inputCols=list(COLUMNS), outputCol="_toxic_x")
    trees = GBTClassifier(featuresCol="_toxic_x", labelCol="label", predictionCol="_toxic_class", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=4, seed=7, maxMemoryInMB=64)
    trees.set(trees.rawPredictionCol, "_toxic_raw")
    trees.set(trees.probabilityCol, "_toxic_p")
    model = trees.fit(join.transform(known.where("part <> 0")).select("_toxic_x", "label").coalesce(4))

    def margin(df: DataFrame) -> DataFrame:
        return model.transform(join.transform(df)).withColumn("_toxic_margin", vector_to_array("_toxic_raw")[1])

    curve = IsotonicRegression(featuresCol="_toxic_margin", labelCol="label", predictionCol="_toxic_iso")
    curve = curve.fit(margin(known.where("part = 0")).select("_toxic_margin", "label").coalesce(1))
    return curve.transform(margin(rows)).withColumn("_toxic_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_toxic_iso")))


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, target: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = F.col("_toxic_score")
    return _scored(spark, docs, labels, ("doc_id",), train_rows, target).select("doc_id", (fold_of() == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def reject_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, target: str = "toxic", least: float = 0.5) -> DataFrame:
    """docs without the rows that score ``least`` or more; all columns, texts untouched and not shuffled."""
    core = ("doc_id", "text")
    kept = _scored(spark, fold_others(docs, *core), labels, (*core, "others"), train_rows, target).where(F.col("_toxic_score") < least)
    return kept.select(*unfold_others(docs, *core))
