"""Language-model scoring with a log-frequency Bloom filter.

An n-gram's count is quantised to 1 + floor(log_b count) levels; the filter holds (n-gram, level) for every
level up to that. A query probes levels 1, 2, ... until one is missing, and takes the mean count of the last
level found. Bigrams live in the filter, and so do the counts of contexts too rare for the exact table; the table
holds the words that make up at least 1 / ``HEAVY`` of all training tokens, ``HEAVY`` words at most, exactly. Words
are told apart by 64-bit hashes throughout.

P(w | v) = lam * min(c(v, w), c(v), c(w)) / (c(v) + noise) + (1 - lam) * P1(w), P1 the add-half unigram of the
contract. ``noise`` is what false hits would add to a context's counts over the whole vocabulary: the mean
estimate of absent n-grams, measured on the filter at hand, times the number of words. So the probabilities
after a context sum to about 1. ``lam`` depends on the level of c(v) and is fitted by expectation-maximisation
on a histogram of all training tokens by level and by likelihood ratio, each with its own occurrence left out.

Filters are built where counts meet: tasks send packed hashes by segment of the hash space, and a segment's
task writes its part of the filter. A bigram's segment is that of its context where the context is rare, so
that both counts are at hand together, and its own where the context is frequent. The filter is cut into shards of
at most ``MAX_BYTES``, whatever the corpus, and each shard is broadcast in passes of its own over the texts; a
token is scored in the pass that holds its bigram.

Rare words' own counts are exact: they are joined to the tokens that need them, which are too rare to be skewed,
for ``base_score`` and ``score`` alike.

Null and empty texts are one end token. A null doc_id counts as the empty text for the fold. Repeated rows
are scored each, and each counts in training. Without training rows P1 is 1 for every token and scores are 0.
Extra columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import column, fold_of, materialize, mix64, slices, word_codes

HEAVY, MAX_BYTES, BITS, BASE, TASK_TOKENS = 1 << 18, 192 << 20, 14, 1.5, 2 << 20
_U = np.uint64
#: The end token, which no word's hash is likely to meet.
END = _U(0x5BD1E995A3C59AC3)
_LOW = _U((1 << 48) - 1)
#: The top bits of a key choose its segment, the others tell n-grams apart.
_TOP, _REST = _U(0xFFFFF00000000000), _U(0x00000FFFFFFFFFFF)
_LEVELS, _BINS, _LEAST, _WIDTH = 80, 400, -8.0, 0.05
_FLOOR = np.array([int(np.ceil(BASE**q - 1e-9)) for q in range(_LEVELS)], float)
#: Mean count of a level: what a query that stops there takes.
MEAN = np.concatenate([[0.0], [(lo + max(lo, hi - 1)) / 2 for lo, hi in zip(_FLOOR[:-1], _FLOOR[1:], strict=True)]])


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log_b count)."""
    return np.searchsorted(_FLOOR, count.astype(float), side="right")


def pack(h: np.ndarray) -> bytes:
    """The low 48 bits of hashes, six bytes each."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def probes(key: np.ndarray, level: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two places and two masks of four bits."""
    g = mix64(key + np.asarray(level, np.uint64) * _U(0xD6E8FEB86659FD93))
    k = mix64(g + _U(0x9E3779B97F4A7C15))
    words = np.asarray(words, np.uint64)

    def bits(x):
        out = _U(1) << (x & _U(63))
        for s in (6, 12, 18):
            out |= _U(1) << ((x >> _U(s)) & _U(63))
        return out

    return (g >> _U(26)) % words, (k >> _U(26)) % words, bits(g), bits(k)


def build_segment(key: np.ndarray, count: np.ndarray, bits: float = BITS) -> np.ndarray:
    """A segment's words, from distinct keys."""
    top = level_of(count)
    words = np.zeros(max(1, int(np.ceil(bits * top.sum() / 64))), np.uint64)
    for q in range(1, int(top.max(initial=0)) + 1):
        a, b, x, y = probes(key[top >= q], q, len(words))
        np.bitwise_or.at(words, a.astype(np.int64), x)
        np.bitwise_or.at(words, b.astype(np.int64), y)
    return words


class Filter:
    """Segments first .. first + len(sizes) - 1 of 2**shift in all, end to end."""

    def __init__(self, shift: int, first: int, segments: list[bytes]):
        self.shift, self.first = shift, first
        self.sizes = np.array([len(s) // 8 for s in segments], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.words = np.frombuffer(b"".join(segments), np.uint64)

    def false_mean(self, tries: int = 1 << 16) -> float:
        """The mean count that a query for an absent n-gram takes."""
        some = mix64(np.arange(1, tries + 1, dtype=np.uint64))
        seg = np.arange(tries) % max(1, len(self.sizes)) + self.first
        return float(MEAN[self.levels((seg.astype(np.uint64) << _U(64 - self.shift)) | (some & _REST))].mean())

    def holds(self, h: np.ndarray) -> np.ndarray:
        seg = (h >> _U(64 - self.shift)).astype(np.int64) - self.first
        return (seg >= 0) & (seg < len(self.sizes))

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram: probe upwards until one is missing."""
        out = np.zeros(len(h), np.int64)
        if not len(self.words):
            return out
        seg = np.clip((h >> _U(64 - self.shift)).astype(np.int64) - self.first, 0, len(self.sizes) - 1)
        key, size, start = h & _LOW, self.sizes[seg], self.start[seg]
        alive = np.flatnonzero(size > 0)
        for q in range(1, _LEVELS):
            a, b, x, y = probes(key[alive], q, size[alive])
            at = start[alive]
            hit = (self.words[at + a.astype(np.int64)] & x) == x
            hit &= (self.words[at + b.astype(np.int64)] & y) == y
            alive = alive[hit]
            if not len(alive):
                break
            out[alive] = q
        return out


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(mix64(v + _U(0x632BE59BD9B4E019)) ^ w)


def pair_keys(v: np.ndarray, w: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys of bigrams from the hashes of their words; ``frequent`` tells of which context."""
    pair = pair_hash(v, w)
    return (np.where(frequent, pair, v) & _TOP) | (pair & _REST)


def context_keys(v: np.ndarray) -> np.ndarray:
    """Keys of rare contexts' own counts."""
    return (v & _TOP) | (mix64(v ^ _U(0x8CB92BA72F3D8DD7)) & _REST)


class Table:
    """Hashes of frequent words, in order, and their counts."""

    def __init__(self, h: np.ndarray, count: np.ndarray):
        order = np.argsort(h)
        self.h, self.count = h[order], np.asarray(count, np.int64)[order]

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Exact counts, -1 for words that the table does not hold."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.count[at], -1)


def prepare(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (hashes); tokens of all texts end to end as places among them, those before, tokens of each text."""
    words, per = word_codes(batch)
    size = per + 1
    ends = np.cumsum(size) - 1
    inner = np.ones(len(words) + len(per), bool)
    inner[ends] = False
    token = np.full(len(inner), END, np.uint64)
    token[inner] = words
    distinct, at = np.unique(token, return_inverse=True)
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[ends - per] = np.searchsorted(distinct, END)
    return distinct, at, before, size


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their counts."""
    h, n = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _packed(shift: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each segment: keys counted once, keys counted more often, their counts."""
    h, n = _merged(held)
    seg = (h >> _U(64 - shift)).astype(np.int64)
    names, start = np.unique(seg, return_index=True)
    stop = np.append(start[1:], len(h))
    once, many, count = [], [], []
    for a, b in zip(start, stop, strict=True):
        single = n[a:b] == 1
        once.append(pack(h[a:b][single]))
        many.append(pack(h[a:b][~single]))
        count.append(n[a:b][~single].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(once, pa.binary()), pa.array(many, pa.binary()), pa.array(count, pa.binary())], names=["segment", "once", "many", "count"])


_PACKED = "segment long, once binary, many binary, count binary"


def filter_segments(packed: DataFrame, bits: float = BITS) -> DataFrame:
    """segment, words, size in bytes."""

    def build(key, table):
        h = [unpack(x) for name in ("once", "many") for x in table.column(name).to_pylist()]
        n = [np.ones(len(x) // 6, np.int64) for x in table.column("once").to_pylist()] + [np.frombuffer(x, np.int64) for x in table.column("count").to_pylist()]
        h, back = np.unique(np.concatenate(h), return_inverse=True)
        words = build_segment(h, np.bincount(back, np.concatenate(n), len(h)).astype(np.int64), bits)
        return pa.table({"segment": [key[0].as_py()], "words": pa.array([words.tobytes()], pa.binary()), "size": [len(words) * 8]})

    return materialize(packed.groupBy("segment").applyInArrow(build, "segment long, words binary, size long"), "lm-filter")


def load_filter(segments: DataFrame, shift: int, first: int, last: int) -> Filter:
    """Segments first .. last - 1 as one filter: one shard comes to the driver at once."""
    found = [b""] * (last - first)
    for r in segments.where((F.col("segment") >= first) & (F.col("segment") < last)).select("segment", "words").toLocalIterator():
        found[r["segment"] - first] = bytes(r["words"])
    return Filter(shift, first, found)


def count_words(rows: DataFrame) -> DataFrame:
    """token (a word's hash), c over (text); tasks add up their own counts first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows_of(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "c"])

        for batch in slices(batches, "text"):
            words, at, _, _ = prepare(batch)
            held.append((words, np.bincount(at, minlength=len(words))))
            if sum(len(h) for h, _ in held) > TASK_TOKENS:
                held = [_merged(held)]
                if len(held[0][0]) > TASK_TOKENS // 2:
                    yield rows_of(*held.pop())
        if held:
            yield rows_of(*_merged(held))

    return rows.select("text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def pack_pairs(rows: DataFrame, shift: int, shared) -> DataFrame:
    """Counts of bigrams and of rare contexts of (text), each text led and closed by the end token; ``shared``: the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in slices(batches, "text"):
            h, at, before, _ = prepare(batch)
            frequent = shared.value.counts(h) >= 0
            pairs, n = np.unique(pair_keys(h[before], h[at], frequent[before]), return_counts=True)
            held.append((pairs, n))
            own = np.bincount(before, minlength=len(h))
            rare = ~frequent & (own > 0)
            held.append((context_keys(h[rare]), own[rare]))
            size += len(pairs) + int(rare.sum())
            if size > TASK_TOKENS:
                yield _packed(shift, held)
                held, size = [], 0
        if held:
            yield _packed(shift, held)

    return rows.select("text").mapInArrow(count, _PACKED)


class Model:
    """What a worker needs in one pass: the exact table and one shard of the filter."""

    def __init__(self, table: Table, grams: Filter, n: int, v: int):
        self.table, self.grams, self.n, self.v = table, grams, n, v
        self.noise = grams.false_mean() * v

    def p1(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.n + 0.5 * (self.v + 1))

    def probe(self, h: np.ndarray, exact: np.ndarray, at: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tokens this shard tells of, and for these the counts of context and bigram (at most that of either word as far as known)."""
        keys = pair_keys(h[before], h[at], exact[before] >= 0)
        mine = self.grams.holds(keys)
        a, b = at[mine], before[mine]
        context = exact[b].astype(float)
        rare = np.flatnonzero(context < 0)
        if len(rare):
            some, back = np.unique(b[rare], return_inverse=True)
            context[rare] = MEAN[self.grams.levels(context_keys(h[some]))][back]
        both = np.minimum(MEAN[self.grams.levels(keys[mine])], context)
        return mine, context, np.where(exact[a] >= 0, np.minimum(both, exact[a]), both)


def histogram(rows: DataFrame, shared, rare_mean: float) -> np.ndarray:
    """Training tokens by level of c(v) and by bin of ml / P1, each with its own occurrence left out (bin 0: no bigram is left).

    A rare word's P1 is that of ``rare_mean``; the ratio of a bigram that is left is then far above 1 anyway.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cells = shared.value, np.zeros(_LEVELS * _BINS, np.int64)
        for batch in slices(batches, "text"):
            h, at, before, _ = prepare(batch)
            exact = model.table.counts(h)
            mine, context, both = model.probe(h, exact, at, before)
            own = exact[at[mine]].astype(float)
            p1 = model.p1(np.maximum(np.where(own < 0, rare_mean, own) - 1, 0))
            ratio = np.maximum(both - 1, 0) / (np.maximum(context - 1, 0) + model.noise + 1e-9) / p1
            place = np.where(ratio > 0, np.clip((np.log10(np.maximum(ratio, 1e-30)) - _LEAST) / _WIDTH, 1, _BINS - 1), 0).astype(np.int64)
            cells += np.bincount(level_of(np.maximum(context, 0)) * _BINS + place, minlength=len(cells))
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], names=["cell", "n"])

    found = rows.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # _LEVELS * _BINS rows at most
    out = np.zeros(_LEVELS * _BINS)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(_LEVELS, _BINS)


def fit_weights(counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Interpolation weight for each level of c(v), from a histogram by level and ratio."""
    lam = np.full(_LEVELS, 0.3)
    ratio = np.concatenate([[0.0], 10 ** (_LEAST + _WIDTH * (np.arange(1, _BINS) + 0.5))])
    total = counts.sum(1)
    for _ in range(rounds):
        mix = lam[:, None] * ratio
        lam = ((counts * (mix / (mix + 1 - lam[:, None]))).sum(1) + 0.01) / (total + 1.0)
    return np.minimum(lam, 0.999)


def _scorer(shared, weights: np.ndarray, leads: bool):
    """Partial sums of each row over the tokens of one shard; rare words wait for their counts.

    A rare word adds log10(1 - lam) now and log10(P1 + k * min(est, c)) when its count c is known.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        kind = pa.struct([("token", pa.int64()), ("k", pa.float64()), ("est", pa.float64())])
        for batch in slices(batches, "text"):
            h, at, before, size = prepare(batch)
            exact = model.table.counts(h)
            doc = np.repeat(np.arange(len(size)), size)
            mine, context, both = model.probe(h, exact, at, before)
            a, doc = at[mine], doc[mine]
            lam = np.where(context > 0, weights[level_of(np.maximum(context, 0))], 0.0)
            k = lam / np.maximum(context + model.noise, 1e-9)
            told = exact[a] >= 0
            p1 = model.p1(np.maximum(exact[a], 0))
            total = np.where(told, k * both + (1 - lam) * p1, 1 - lam)
            each = np.bincount(doc, np.log10(total), len(size)).astype(float)
            base = np.bincount(doc[told], np.log10(p1[told]), len(size)).astype(float)
            known = np.bincount(doc[told], minlength=len(size))
            wait = ~told
            entries = pa.StructArray.from_arrays([pa.array(h[a[wait]].view(np.int64)), pa.array((k / (1 - lam))[wait]), pa.array(both[wait])], fields=list(kind))
            per = np.bincount(doc[wait], minlength=len(size))
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), entries)
            lead = np.full(len(size), int(leads))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text_key"), pa.array(lead), pa.array(size * lead), pa.array(known), pa.array(base), pa.array(each), rare], names=["doc_id", "text_key", "rows", "n_tokens", "known", "base", "score", "rare"])

    return score


def score_documents(spark: SparkSession, docs: DataFrame, train_fold: int = 1, heavy: int = HEAVY, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows of fold ``train_fold`` don't train."""
    rows = docs.select("doc_id", "text")
    training = rows.where(fold_of() != train_fold)
    vocabulary = materialize(count_words(training), "lm-words")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(1, -(-n // heavy))
    frequent = vocabulary.where(F.col("c") >= least).toArrow()  # ``heavy`` words at most
    table = Table(frequent["token"].to_numpy().view(np.uint64), frequent["c"].to_numpy())
    rare = vocabulary.where(F.col("c") < least)
    rare_mean = rare.agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] or 1.0
    shift = min(20, max(10, int(np.ceil(np.log2(max(1, n / (1 << 20)))))))
    shared = spark.sparkContext.broadcast(table)
    segments = filter_segments(pack_pairs(training, shift, shared))
    size = segments.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = min(1 << shift, -(-5 * size // (4 * max_bytes)) if size > max_bytes else 1)
    edges = [round(i * (1 << shift) / shards) for i in range(shards + 1)]
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = []
    for i in range(shards):
        model = Model(table, load_filter(segments, shift, edges[i], edges[i + 1]), n, v)
        held = spark.sparkContext.broadcast(model)
        lam = fit_weights(histogram(training, held, rare_mean)) if n else np.zeros(_LEVELS)
        parts.append(materialize(keyed.mapInArrow(_scorer(held, lam, i == 0), f"doc_id {kind}, text_key long, rows long, n_tokens long, known long, base double, score double, rare array<struct<token:bigint,k:double,est:double>>"), "lm-pass"))
        held.unpersist()
    return _joined(parts, rare, n, v, train_fold)


def _joined(parts: list[DataFrame], rare: DataFrame, n: int, v: int, train_fold: int) -> DataFrame:
    """Sums by document, with the exact counts of rare tokens. Rows alike in id and text are summed as one, then shared out again."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    each = every.select("doc_id", "text_key", F.explode("rare").alias("x")).select("doc_id", "text_key", "x.*")
    met = each.join(rare.hint("shuffle_hash"), "token", "left")
    c = F.coalesce("c", F.lit(0))
    p1 = (c + 0.5) / F.lit(n + 0.5 * (v + 1))
    nothing = F.lit(0).cast("long")
    late = met.select("doc_id", "text_key", nothing.alias("rows"), nothing.alias("n_tokens"), F.col("c").isNotNull().cast("long").alias("known"), F.log10(p1).alias("base"), F.log10(p1 + F.col("k") * F.least(F.col("est"), c.cast("double"))).alias("score"))
    sums = [F.sum(x).alias(x) for x in ("rows", "n_tokens", "known", "base", "score")]
    by = every.drop("rare").unionByName(late).groupBy("doc_id", "text_key").agg(*sums)
    out = by.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(
        "doc_id", (fold_of() == train_fold).alias("held_out"), (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"), (F.col("known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
    )
