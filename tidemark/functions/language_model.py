"""Language of a text by character trigrams: a model fitted on labelled rows in one aggregation.

A text counts as its letters in lower case, runs of anything else being one blank, with a blank at either end. ``trigram_counts``
adds trigrams up by language; ``fit`` keeps the ``grams`` most frequent ones of all languages together, so the table is of a
bounded size whatever the corpus, and it is that table that goes to every task. A trigram's probability in a language is
smoothed by ``SMOOTH`` for each kept trigram and one for all others; a text's language is the one of the largest sum of
logarithms (equal sums: the first in order of names), its confidence that language's share of all (priors alike). Texts
without letters have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams of the model, what is added to each count, and characters that are measured at once (a longer text is cut with two characters over).
GRAMS, SMOOTH, AT_ONCE = 20_000, 0.5, 1 << 20


def letters(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code of each trigram of some texts): three code points of 21 bits."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = row[:-2] == row[2:]
    return row[:-2][whole], ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[whole]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
    """Some rows at a time: a batch whose last column is text, its trigrams, and whether the row, a long text, goes on in the next part."""
    for batch in batches:
        at, size = 0, pc.utf8_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(total[at:] - (total[at - 1] if at else 0), AT_ONCE, side="right")))
            part = batch.slice(at, n)
            texts, at = part.column(part.num_columns - 1), at + n
            if n == 1 and size[at - 1] > AT_ONCE:
                long = texts[0].as_py()
                for i in range(0, len(long) - 2, AT_ONCE):
                    yield part, *_codes(pa.array([long[i : i + AT_ONCE + 2]])), i + AT_ONCE < len(long) - 2
            else:
                yield part, *_codes(texts), False


def trigram_counts(docs: DataFrame, label: str, text: str = "text") -> DataFrame:
    """label, code (of a trigram), n over the rows that have both."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), letters(F.col(text)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, code, _ in _parts(batches):
            names = part.column(0).dictionary_encode()
            label, own, found = names.indices.to_numpy()[row], [], []
            for i in range(len(names.dictionary)):  # hashed by language: the pairs need no sort
                grams = pc.value_counts(pa.array(code[label == i]))
                own.append(np.full(len(grams), i))
                found.append(grams)
            if found:
                grams = pa.concat_arrays(found)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(np.concatenate(own))), grams.field(0), grams.field(1)], names=["label", "code", "n"])

    by = rows.mapInArrow(count, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    return by.select(F.col("label").alias(label), "code", "n")


def gram_of(code: Column) -> Column:
    """The three characters of a code."""
    point = lambda shift: F.decode(F.unhex(F.lpad(F.hex(F.shiftright(code, shift).bitwiseAND(F.lit((1 << 21) - 1))), 8, "0")), "UTF-32")
    return F.concat(point(42), point(21), point(0))


class LanguageModel:
    """Languages, codes of the kept trigrams (ascending), and a row of log probabilities for each and one for all others."""

    def __init__(self, names: list[str], codes: np.ndarray, logs: np.ndarray):
        self.names, self.codes, self.logs = names, codes, logs

    def sums(self, rows: int, row: np.ndarray, code: np.ndarray) -> np.ndarray:
        # a trigram is looked up once, however often it occurs
        some = pa.array(code).dictionary_encode()
        code, again = some.dictionary.to_numpy(), some.indices.to_numpy()
        at = np.searchsorted(self.codes, code)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == code[known]
        at = np.where(known, at, len(self.codes))[again]
        out = np.zeros((rows, len(self.names)))
        for j in range(len(self.names)):
            out[:, j] = np.bincount(row, self.logs[at, j], rows)
        return out


def fit(counts: DataFrame, label: str, grams: int = GRAMS) -> LanguageModel:
    """From ``trigram_counts``, which are computed once; at most ``grams`` trigrams, the most frequent (ties: the smaller code points), come to the driver."""
    from tidemark.operators.discovery import stored

    counts = stored(counts)
    totals = counts.groupBy(label).agg(F.sum("n").alias("n")).orderBy(label).collect()  # a row for each language
    kept = counts.groupBy("code").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "code").limit(grams)
    table = counts.join(F.broadcast(kept.select("code")), "code").select(label, "code", "n").toArrow()  # grams x languages
    names = [r[0] for r in totals]
    codes = np.unique(table["code"].to_numpy())
    seen = np.zeros((len(codes) + 1, len(names)))
    place = {n: i for i, n in enumerate(names)}
    seen[np.searchsorted(codes, table["code"].to_numpy()), [place[x] for x in table[label].to_pylist()]] = table["n"].to_numpy()
    n = np.array([r[1] for r in totals], float)
    return LanguageModel(names, codes, np.log((seen + SMOOTH) / (n + SMOOTH * (len(codes) + 1))) if names else np.zeros((1, 0)))


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, language, confidence; both null without a letter, or without a model. Repeated keys stay apart."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), letters(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, before = shared.value, None

        def told(keys: pa.Array, sums: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
            if not model.names:
                return pa.RecordBatch.from_arrays([keys, pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.float64())], names=["key", "language", "confidence"])
            best = sums.argmax(1)
            share = 1 / np.exp(sums - sums.max(1)[:, None]).sum(1)
            return pa.RecordBatch.from_arrays([keys, pa.array([model.names[i] for i in best], pa.string(), mask=~some), pa.array(np.round(share, 6), mask=~some)], names=["key", "language", "confidence"])

        for part, row, code, more in _parts(batches):
            sums = model.sums(part.num_rows, row, code) + (0 if before is None else before)
            before = sums if more else None
            if not more:
                yield told(part.column(0), sums, (sums < 0).any(1))

    return rows.mapInArrow(guess, f"key {kind}, language string, confidence double").withColumnRenamed("key", key)
