"""Quality by a linear-chain conditional random field over lines.

Each line has features of its own (length, capitals, marks, bars, digits, word length, repetition) and those
of its neighbours. The field labels lines good or bad; forward-backward marginals, weighted by line length,
give a document's share of bad text, and a logistic curve turns that into a probability of good quality.

Labels are of documents, so lines of bad documents are first taken as bad, then labelled anew by the field
itself (at least the worst line stays bad) and the field fitted again. Fields and curve are fitted on at most
``TRAIN_ROWS`` labelled documents outside the held-out fold, each of them whole. Executors build the features of
their lines; the driver gets 120 bytes for each line and no text, but nothing bounds the lines of a document.
A fit walks as many steps as the longest of these documents has lines.

Null texts count as one empty line, as empty ones do. Labels other than 0 and 1 are ignored. Without rows
of both classes the score is the smoothed share of good labels. A line feed ends a line; equal texts get
equal scores. Extra columns play no part, nor do lang, source and doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import column, fold_of, materialize, slices, span_sums, text_bytes
from tidemark.llm.toxicity import training_rows

TRAIN_ROWS = 6_000
_KINDS, _OWN = 9, 14
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 1 if 65 <= _c <= 90 else 2 if 97 <= _c <= 122 or _c >= 128 else 3 if 48 <= _c <= 57 else 4 if _ch in ".,;:'\"?()-" else 5 if _ch in "|\t" else 6 if _ch == "!" else 7 if 33 <= _c < 127 else 8 if _ch in " \r\x0b\x0c" else 0


def own_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line alone, line lengths, lines of each document) of texts laid end to end."""
    feed = data == 10
    ends = np.flatnonzero(feed)
    docs = len(off) - 1
    per = span_sums(feed, off) + 1
    first = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
    start = np.zeros(per.sum(), np.int64)
    is_first = np.zeros(len(start), bool)
    is_first[first] = True
    start[first] = off[:-1]
    start[~is_first] = ends + 1
    stop = np.zeros(len(start), np.int64)
    is_last = np.zeros(len(start), bool)
    is_last[first + per - 1] = True
    stop[is_last] = off[1:]
    stop[~is_last] = ends
    kind = _CLASS[data]
    size = stop - start
    count = []
    for k in range(1, _KINDS):
        run = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == k, out=run[1:])
        count.append((run[stop] - run[start]).astype(float))
    upper, lower, digit, stops, bars, exclaim, marks, blank = count
    letters = upper + lower
    n, words = np.maximum(size, 1), np.maximum(blank + 1, 1)
    own = np.stack([
        np.log1p(size) / 10, size == 0, upper / np.maximum(letters, 1), digit / n, stops / words, np.minimum(bars / words, 1), np.minimum(exclaim / words, 2),
        np.minimum(marks / words, 4), n / words / 10, (upper > 0.6 * np.maximum(letters, 1)) & (letters > 8), bars > 3, marks > words, words < 4,
    ], axis=1).astype(float)
    # repetition: a line that its document holds before
    doc = np.repeat(np.arange(docs), per)
    code = _line_codes(data, start, stop)
    order = np.lexsort((np.arange(len(code)), code, doc))
    again = np.zeros(len(code), bool)
    again[order[1:]] = (code[order][1:] == code[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.hstack([own, (again & (size > 0))[:, None]]), size, per


def with_neighbours(own: np.ndarray, per: np.ndarray) -> np.ndarray:
    """All features of lines: their own, those of the lines before and after, and whether a document starts or ends there."""
    first = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
    is_first, is_last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    is_first[first], is_last[first + per - 1] = True, True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[first + per - 1] = 0, 0
    return np.hstack([np.ones((len(own), 1)), own, before, after, is_first[:, None], is_last[:, None]])


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, line lengths, lines of each document) of texts laid end to end."""
    own, size, per = own_features(data, off)
    return with_neighbours(own, per), size, per


def _line_codes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each line's bytes: sums of scrambled (byte, place) words."""
    place = np.arange(len(data), dtype=np.uint64)
    line = np.zeros(len(data), np.int64)
    full = start < len(data)
    np.add.at(line, start[full], 1)
    base = start[np.maximum(np.cumsum(line) - 1, 0)] if len(data) and (np.diff(start) > 0).all() else None
    if base is None:
        return np.array([hash(data[a:b].tobytes()) & 0xFFFFFFFFFFFF for a, b in zip(start, stop, strict=True)], np.uint64)
    word = (place - base.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + data.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    word ^= word >> np.uint64(29)
    word *= np.uint64(0x94D049BB133111EB)
    word[data == 10] = 0
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(word, out=run[1:])
    return run[stop] - run[start]


def _by_step(per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents from the longest to the shortest, their first lines, and how many reach each step."""
    order = np.argsort(-per, kind="stable")
    first = np.concatenate([[0], np.cumsum(per)[:-1]])[order]
    reach = np.searchsorted(-per[order], -np.arange(per.max(initial=0)), side="left")
    return order, first.astype(np.int64), reach


def marginals(emit: np.ndarray, move: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``emit`` are two scores for each line, ``move`` those of the four transitions. Returns P(label) of each
    line, the expected transitions, and the log partition of each chain. Chains walk in step, the longest first,
    so no padding is kept.
    """
    order, first, reach = _by_step(per)
    ahead = np.zeros_like(emit)
    back = np.zeros_like(emit)
    for t, n in enumerate(reach):
        at = first[:n] + t
        ahead[at] = emit[at] if t == 0 else emit[at] + np.logaddexp(ahead[at - 1][:, :1] + move[0], ahead[at - 1][:, 1:] + move[1])
    for t in range(len(reach) - 2, -1, -1):
        at = first[: reach[t + 1]] + t
        nxt = emit[at + 1] + back[at + 1]
        back[at] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
    last = np.cumsum(per) - 1
    log_z = np.logaddexp(ahead[last, 0], ahead[last, 1])
    z = np.repeat(log_z, per)
    prob = np.exp(ahead + back - z[:, None])
    inner = np.ones(len(emit), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    both = ahead[at][:, :, None] + move[None] + (emit[at + 1] + back[at + 1])[:, None, :] - z[at][:, None, None]
    return prob, np.exp(both).sum(0), log_z


def fit_field(x: np.ndarray, per: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, ridge: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights of label 1 and transition scores, by Adam on the penalised likelihood. ``weight`` is by chain."""
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    last = np.cumsum(per) - 1
    inner = np.ones(len(x), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    by_line = np.repeat(weight, per)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at], y[at + 1]), 1.0)
    m, v, scale = np.zeros(len(w) + 4), np.zeros(len(w) + 4), 1.0 / max(1, len(x))
    for k in range(1, rounds + 1):
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ w
        prob, moved, _ = marginals(emit, move, per)
        grad = np.concatenate([x.T @ (by_line * (y - prob[:, 1])), (seen - moved).ravel()]) * scale - ridge * scale * np.concatenate([w, move.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, move = w + step[: len(w)], move + step[len(w) :].reshape(2, 2)
    return w, move


def bad_share(x: np.ndarray, size: np.ndarray, per: np.ndarray, w: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted mean of P(bad) of each document, and the marginals."""
    emit = np.zeros((len(x), 2))
    emit[:, 1] = x @ w
    prob = marginals(emit, move, per)[0][:, 1]
    weight = size + 1.0
    first = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
    return np.add.reduceat(prob * weight, first) / np.add.reduceat(weight, first), prob


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, label and, as bytes, the lines' own features and lengths of whole texts."""
    for batch in slices(batches, "text"):
        own, size, per = own_features(*text_bytes(batch))
        cut = np.cumsum(per)[:-1]
        packed = [pa.array([a.tobytes() for a in np.split(part, cut)], pa.binary()) for part in (own, size)]
        yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "label"), *packed], names=["key", "label", "own", "size"])


def fit(own: np.ndarray, size: np.ndarray, per: np.ndarray, good: np.ndarray, rounds: int = 2) -> dict:
    """Field and curve from the lines of whole documents."""
    x = with_neighbours(own, per)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    mean[0], spread[0] = 0.0, 1.0
    x -= mean
    x /= spread
    y = np.repeat(1 - good, per).astype(np.int64)
    doc = np.repeat(np.arange(len(per)), per)
    first = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
    weight = np.ones(len(per))
    for k in range(rounds + 1):
        w, move = fit_field(x, per, y, weight)
        share, prob = bad_share(x, size, per, w, move)
        if k < rounds:
            top = np.maximum.reduceat(prob, first)
            y = ((1 - good)[doc] * ((prob >= 0.5) | (prob >= top[doc] - 1e-12))).astype(np.int64)
    lift = np.stack([np.ones(len(share)), np.log((share + 0.01) / (1.01 - share)), share], axis=1)
    curve = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(lift @ curve, -30, 30)))
        curve -= np.linalg.solve((lift * (p * (1 - p))[:, None]).T @ lift + 0.1 * np.eye(3), lift.T @ (p - good) + 0.1 * curve)
    return {"mean": mean, "spread": spread, "w": w, "move": move, "curve": curve}


def score_batch(data: np.ndarray, off: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(P(good), share of bad text) of each document."""
    x, size, per = line_features(data, off)
    share, _ = bad_share((x - model["mean"]) / model["spread"], size, per, model["w"], model["move"])
    lift = np.stack([np.ones(len(share)), np.log((share + 0.01) / (1.01 - share)), share], axis=1)
    return 1 / (1 + np.exp(-np.clip(lift @ model["curve"], -30, 30))), share


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, target: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted, bad_share."""
    train = training_rows(docs, labels, target, train_rows)
    lines = train.select(F.xxhash64("text").alias("key"), "label", "text").mapInArrow(_training_lines, "key long, label double, own binary, size binary")
    known = materialize(lines, "quality-train").orderBy("key", "label").toArrow()  # a bounded number of documents
    good = known["label"].to_numpy()
    model = None
    if 0 < good.sum() < len(good):
        own, size = (np.frombuffer(b"".join(x for c in known[name].chunks for x in c.to_pylist()), kind) for name, kind in (("own", np.float64), ("size", np.int64)))
        per = pc.binary_length(known["size"]).to_numpy().astype(np.int64) // 8
        model = fit(own.reshape(-1, _OWN), size, per, good)
    prior = (float(good.sum()) + 0.5) / (len(good) + 1)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if shared.value is None:
                p, share = np.full(batch.num_rows, prior), np.zeros(batch.num_rows)
            else:
                p, share = score_batch(*text_bytes(batch), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(share)], names=["doc_id", "score", "bad_share"])

    scored = rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, bad_share double")
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "bad_share")
