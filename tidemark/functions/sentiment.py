"""Sentiment of a text by a lexicon and the order of its words.

A fold over each row's tokens: a word of the lexicon weighs more after a booster, less after a damper, more in capitals
among other words, and turns after a negation; what follows the last "but" outweighs what stands before it; exclamation
and question marks add to the sum's own direction. Lexicon, boosters and negations are parameters; a lexicon may be a table
(word, valence), of at most ``WORDS`` rows, which goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published weights of boosters, capitals, negations, contrast and marks, and the words that carry them.
BOOST, CAPITALS, NEGATED, BEFORE, AFTER, EXCLAIM, QUESTION, MANY = 0.293, 0.733, -0.74, 0.5, 1.5, 0.292, 0.18, 0.96
FADE = (1.0, 0.95, 0.9)
BOOSTERS = {"very": BOOST, "really": BOOST, "extremely": BOOST, "so": BOOST, "totally": BOOST, "completely": BOOST, "absolutely": BOOST, "slightly": -BOOST, "somewhat": -BOOST, "barely": -BOOST, "hardly": -BOOST, "partly": -BOOST}
NEGATIONS = frozenset("not no never none nobody nothing neither nor cannot can't don't doesn't didn't isn't wasn't aren't won't wouldn't without".split())
VALENCE = {"good": 1.9, "great": 3.1, "love": 3.2, "nice": 1.8, "excellent": 2.7, "happy": 2.7, "fast": 0.6, "helpful": 1.8, "bad": -2.5, "terrible": -2.1, "hate": -2.7, "slow": -0.6, "broken": -1.9, "crash": -1.7, "useless": -1.8, "idiot": -2.3, "stupid": -2.4, "worthless": -1.9, "pathetic": -2.7, "disgusting": -2.4, "trash": -1.6, "loser": -2.4}
TOKEN = r"[\p{L}\p{N}_']+|[!?]"
#: Rows of a lexicon, and tokens that are scored at once (a longer text stands alone).
WORDS, AT_ONCE = 200_000, 1 << 17


def lexicon_of(table: DataFrame) -> dict[str, float]:
    """A lexicon from (word, valence); more than ``WORDS`` rows are an error."""
    rows = table.select("word", "valence").limit(WORDS + 1).collect()
    if len(rows) > WORDS:
        raise ValueError(f"a lexicon holds at most {WORDS} words")
    return {r["word"]: float(r["valence"]) for r in rows}


def totals(row: np.ndarray, n: int, valence: np.ndarray, boost: np.ndarray, negates: np.ndarray, capitals: np.ndarray, words: np.ndarray, but: np.ndarray, exclaims: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """The weighted sum of each of n rows, from what each token (``row``: whose) is."""
    count = lambda x: np.bincount(row, x, n)
    shouting = count(capitals)
    mixed = (shouting > 0) & (shouting < count(words))  # capitals stand out only among other words
    v = valence + np.sign(valence) * CAPITALS * (capitals & mixed[row])
    negated = np.zeros(len(v), bool)
    # a word's place among the words of its row: marks don't count as words between
    at = np.flatnonzero(words)
    for back, fade in enumerate(FADE, 1):
        if len(at) > back:
            here, there = at[back:], at[:-back]
            same = row[here] == row[there]
            here, there = here[same], there[same]
            v[here] += np.sign(valence[here]) * boost[there] * fade * (valence[there] == 0)
            negated[here] |= negates[there]
    v = np.where(negated, v * NEGATED, v)
    last = np.full(n, -1)
    np.maximum.at(last, row[but], np.flatnonzero(but))
    turn = last[row]
    v = np.where(turn < 0, v, np.where(np.arange(len(v)) < turn, v * BEFORE, np.where(np.arange(len(v)) > turn, v * AFTER, v)))
    total = count(v)
    marks, questions = np.minimum(count(exclaims), 4) * EXCLAIM, count(asks)
    marks = marks + np.where(questions > 3, MANY, np.where(questions > 1, questions * QUESTION, 0.0))
    return np.round(total + np.sign(np.round(total, 9)) * marks, 9)


def sentiment(docs: DataFrame, key: str = "doc_id", text: str = "text", lexicon: dict[str, float] | None = None, boosters: dict[str, float] | None = None, negations: frozenset[str] = NEGATIONS) -> DataFrame:
    """key, sentiment_score in (-1, 1), sentiment_label of each row; a text without words of the lexicon is neutral. Repeated keys stay apart."""
    valence, boost = VALENCE if lexicon is None else lexicon, BOOSTERS if boosters is None else boosters
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array()).alias("tokens"))
    kind = rows.schema["key"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = np.cumsum(pc.list_value_length(batch.column(1).slice(at)).to_numpy(zero_copy_only=False))
                n = max(1, int(np.searchsorted(size, AT_ONCE, side="right")))
                part, at = batch.slice(at, n), at + n
                coded = part.column(1).flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                low = [w.lower() for w in words]
                is_word = [w not in "!?" for w in words]
                facts = (
                    [float(valence.get(w, 0.0)) for w in low], [boost.get(w, 0.0) for w in low], [w in negations for w in low], [len(w) > 1 and w.isupper() for w in words],
                    is_word, [w == "but" for w in low], [w == "!" for w in words], [w == "?" for w in words],
                )
                code = coded.indices.to_numpy()
                row = np.repeat(np.arange(n), np.diff(np.concatenate([[0], size[:n]])))
                each = [np.array(f, float if i < 2 else bool)[code] for i, f in enumerate(facts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(totals(row, n, *each))], names=["key", "s"])

    scored = rows.mapInArrow(score, f"key {kind}, s double")
    s = F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15), 6)
    return scored.select(F.col("key").alias(key), s.alias("sentiment_score"), F.when(s >= 0.05, "positive").when(s <= -0.05, "negative").otherwise("neutral").alias("sentiment_label"))
