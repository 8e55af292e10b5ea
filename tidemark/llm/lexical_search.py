"""Ranked lexical search, reversed: the items are indexed, the documents stream past.

Terms of all items form an inverted index (term: items that hold it, how often), broadcast to the workers. A first
pass over the texts counts documents, terms and how many documents hold each indexed term. In the second each
document's counts of indexed terms go through the index: every posting adds to the item's score, and each task keeps
a heap of the ``k`` best documents for each item. The tasks' heaps are merged in two steps, so that no item meets all
of them at once.

What is broadcast is bounded: items go in blocks of at most ``POSTINGS`` (item, term) pairs (an item of more is a block
of its own), and each block streams the documents anew. Terms meet the index by a 64-bit hash and are then compared
byte by byte, so counts are exact. All scores are 64-bit integers. Long texts are cut at the ends of terms, some
``PIECE`` bytes at a time.

Rows of one item_id are one item, their terms added up; rows of a null item_id, and items without terms, rank nothing. A
null or empty text has no terms; it counts neither as a document nor otherwise. Repeated documents count and rank as
often as they are given; among equal scores null ids come last. Items with fewer documents of a score above 0 get
fewer rows; empty tables none. Extra columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import column, lower_ascii, materialize, run_codes, slices, text_bytes

#: What a term is, in characters; the weights of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, LENGTH, RATE = 1_000_000_000, 75, 8
#: Postings of a broadcast index, bytes of a text that are cut into terms at once, sums of documents and items kept at once, and
#: parts in which heaps are merged first.
POSTINGS, PIECE, CELLS, PARTS = 1 << 20, 1 << 22, 1 << 21, 16

_BYTE = np.arange(256)
#: Bytes of a term: digits, letters and all bytes of characters beyond ASCII.
_INSIDE = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)
_MAYBE = 1 << 16


class Index:
    """Terms, sorted by hash, and their postings: items' numbers and how often each holds the term."""

    def __init__(self, terms: list[bytes], item: np.ndarray, term: np.ndarray, times: np.ndarray):
        data = np.frombuffer(b" ".join(terms), np.uint8)
        code = run_codes(data, np.array([0, len(data)]), _INSIDE[data])[0]
        order = np.argsort(code)
        if len(np.unique(code)) < len(code):
            raise ValueError("two terms of the items share a hash")
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        self.code, self.terms = code[order], [terms[i] for i in order]
        self.size = np.array([len(t) for t in self.terms], np.int64)
        self.bytes, self.start = np.frombuffer(b"".join(self.terms), np.uint8), np.cumsum(self.size) - self.size
        term = place[term]
        by = np.argsort(term, kind="stable")
        self.item, self.times = item[by], times[by]
        self.first = np.searchsorted(term[by], np.arange(len(terms) + 1))
        self.maybe = np.zeros(_MAYBE, bool)
        self.maybe[(self.code % np.uint64(_MAYBE)).astype(np.int64)] = True

    def found(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many terms each text has; the text and the place in the index of each indexed term that occurs)."""
        inside = _INSIDE[data]
        code, start, size = run_codes(data, off, inside)
        per = np.diff(np.searchsorted(start, off))
        some = np.flatnonzero(self.maybe[(code % np.uint64(_MAYBE)).astype(np.int64)])
        at = np.searchsorted(self.code, code[some])
        at[at == len(self.code)] = 0
        some, at = (x[hit] for hit in [(self.code[at] == code[some]) & (self.size[at] == size[some])] for x in (some, at))
        row, n = np.searchsorted(off, start[some], side="right") - 1, size[some]
        if len(some):
            ends = np.cumsum(n)
            k = np.arange(ends[-1]) - np.repeat(ends - n, n)
            same = _LOWER[data[np.repeat(start[some], n) + k]] == self.bytes[np.repeat(self.start[at], n) + k]
            true = np.logical_and.reduceat(same, ends - n)
            row, at = row[true], at[true]
        return per, row, at


def pieces(data: np.ndarray, off: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts as they are, or a lone long one cut between terms."""
    if len(off) != 2 or len(data) <= limit:
        yield data, off
        return
    gaps, at = np.flatnonzero(~_INSIDE[data]), 0
    while at < len(data):
        j = np.searchsorted(gaps, at + limit)
        end = int(gaps[j]) if j < len(gaps) else len(data)
        yield data[at:end], np.array([0, end - at])
        at = end


def term_counts(batch: pa.RecordBatch, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text; text, term and count of each indexed term that a text holds)."""
    total, held = np.zeros(batch.num_rows, np.int64), []
    for data, off in pieces(*text_bytes(batch), PIECE):
        per, row, at = index.found(data, off)
        total += per
        held.append(np.unique(row * len(index.code) + at, return_counts=True))
    key = np.concatenate([k for k, _ in held])
    cell, back = np.unique(key, return_inverse=True)
    times = np.bincount(back, np.concatenate([n for _, n in held]), len(cell)).astype(np.int64)
    return total, cell // len(index.code), cell % len(index.code), times


class Heaps:
    """The ``k`` best documents of each item so far: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def offer(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least[item]
        if not good.any():
            return
        item, score = np.concatenate([self.item, item[good]]), np.concatenate([self.score, score[good]])
        ids = np.concatenate([self.id, ids[good]])
        null = np.array([x is None for x in ids])
        rank = np.zeros(len(ids), np.int64)
        rank[~null] = np.unique(ids[~null], return_inverse=True)[1]
        order = np.lexsort((rank, null, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.item, self.score, self.id = item[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.least[item[full]] = score[full]


def scores(index: Index, weight: np.ndarray, m: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, items: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, score) of every document and item of a score above 0: each count goes through its term's postings.

    Rows ascend; some of them, with all items, are added up at once.
    """
    x = weight[term] * (SCALE * times // (1000 * times + RATE * m[row]))
    some = max(1, CELLS // max(1, items))
    for low in range(0, len(m), some):
        a, b = np.searchsorted(row, (low, low + some))
        own = term[a:b]
        n = index.first[own + 1] - index.first[own]
        ends = np.cumsum(n)
        posting = np.repeat(index.first[own] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        total = np.zeros((min(some, len(m) - low), items), np.int64)
        np.add.at(total, (np.repeat(row[a:b] - low, n), index.item[posting]), np.repeat(x[a:b], n) * index.times[posting])
        at = np.nonzero(total > 0)
        yield at[0] + low, at[1], total[at]


def blocks_of(counts: DataFrame, postings: int) -> DataFrame:
    """item_id, block of the item's terms (item_id, term, times): at most ``postings`` rows, or one item, in each block."""
    sizes = counts.groupBy("item_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= postings:
        return sizes.select("item_id", F.lit(0).alias("block"))
    # half of a block's rows on average; a block that comes out larger is cut again by place
    blocks = 2 * -(-total // postings)
    dealt = sizes.withColumn("b", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    run = F.sum("n").over(Window.partitionBy("b").orderBy("item_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.select("item_id", (F.col("b") + blocks * F.floor((run - 1) / postings)).alias("block"))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (bytes), times."""
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))
    each = items.where("item_id is not null and text is not null").select("item_id", F.explode(words).alias("term"))
    return each.groupBy("item_id", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("times"))


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``k`` best documents."""
    counts = materialize(item_terms(items), "search-terms")
    blocks = materialize(blocks_of(counts, postings), "search-blocks")
    found = None
    for (block,) in blocks.select("block").distinct().orderBy("block").collect():  # a row for each pass over the documents
        own = counts.join(blocks.where(F.col("block") == block).select("item_id"), "item_id")
        heaps = materialize(_pass(spark, docs, own, k), "search-heaps")
        found = heaps if found is None else found.unionByName(heaps)
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    found = spark.createDataFrame([], kinds) if found is None else found
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    few = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("place", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("place") <= k)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _pass(spark: SparkSession, docs: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, score: every task's heaps for a block of items."""
    held = own.toArrow()  # at most ``POSTINGS`` rows, or one item's
    ids, item = np.unique(np.array(held["item_id"].to_pylist(), object), return_inverse=True)
    terms, term = np.unique(np.array(held["term"].to_pylist(), object), return_inverse=True)
    shared = spark.sparkContext.broadcast(Index(terms.tolist(), item, term, held["times"].to_numpy()))
    rows = docs.select("doc_id", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        holding, n, length = np.zeros(len(index.code), np.int64), 0, 0
        for batch in slices(batches, "text"):
            total, _, at, _ = term_counts(batch, index)
            n, length = n + int((total > 0).sum()), length + int(total.sum())
            holding += np.bincount(at, minlength=len(holding))
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, length], holding[some]]))], names=["term", "n"])

    facts = rows.select("text").mapInArrow(measure, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each indexed term
    facts = dict(zip(facts["term"].to_pylist(), facts["n"].to_pylist(), strict=True))
    n, length = facts.get(-2, 0), facts.get(-1, 0)
    df = np.array([facts.get(i, 0) for i in range(len(terms))], np.float64)
    weight = np.floor(1000 * np.log((2.0 * n + 2) / (2 * df + 1))).astype(np.int64)
    known = spark.sparkContext.broadcast((weight, n, length, ids))
    id_type, item_type = rows.schema["doc_id"].dataType.simpleString(), own.schema["item_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (weight, n, length, ids) = shared.value, known.value
        heaps, kind = Heaps(len(ids), k), None
        for batch in slices(batches, "text"):
            total, row, term, times = term_counts(batch, index)
            kind = column(batch, "doc_id").type
            m = np.array([100 - LENGTH + LENGTH * t * n // max(1, length) for t in total.tolist()], np.int64)
            names = np.array([*column(batch, "doc_id").to_pylist(), None], object)
            for at, item, score in scores(index, weight, m, row, term, times, len(ids)):
                heaps.offer(item, score, names[at])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[heaps.item].tolist()).cast(held["item_id"].type), pa.array(heaps.id.tolist(), kind), pa.array(heaps.score)], names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(stream, f"item_id {item_type}, doc_id {id_type}, score long")
