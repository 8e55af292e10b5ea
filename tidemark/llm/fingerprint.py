"""Document fingerprints by locally consistent parsing.

A text is a row of symbols. At each level, deterministic coin tossing shortens the symbols' labels until few
are left (each label becomes the place and value of the lowest bit in which it differs from its left
neighbour's); local maxima of the labels open phrases of two to a few symbols; a phrase's name is a hash of
its symbols. Runs of one symbol become a phrase of their own first. Names are the symbols of the next level,
until one is left. Where phrases open depends on a few symbols to the left and one to the right, so equal
substrings get equal phrases except near their ends, whatever their offset.

The fingerprint is a one-permutation MinHash of the phrase names from level ``level`` on: 128 slots of 16
bits, hex. Empty slots take the nearest filled slot's value on the right. Likeness is the share of equal
slots. Empty and null texts have the fingerprint of no names (all zero), which is alike to itself only.

The next document is the one of the next doc_id (null ids first, equal ids in order of a hash of their texts);
rows are range-partitioned by id and that hash and neighbours meet inside a partition, and only partitions'
edges meet in a second step. Fingerprints and hashes stay bytes until the end.
Equal rows are alike in every column. Bytes that are no UTF-8 count as replacement characters; ids may be of any type
that orders. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, materialize, mix64, slices

SLOTS, LEVEL, ROUNDS = 128, 3, 3
#: Bytes of text parsed at once: arrays of that many code points stay in a core's cache.
BATCH = 1 << 18
_U = np.uint64


def _low_bit(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit of nonzero words."""
    low = (x & (~x + _U(1))).astype(np.float64)
    return (np.frexp(low)[1] - 1).astype(np.int64)


def parse_level(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases open. ``first`` marks where documents begin; a phrase never crosses that."""
    n = len(names)
    same = np.zeros(n, bool)
    same[1:] = (names[1:] == names[:-1]) & ~first[1:]
    opens = first.copy()
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = same[:-1] & ~same[1:]
    opens[1:] |= ends_run[:-1]  # what follows a run opens a phrase
    opens[:-1] |= same[1:] & ~same[:-1]  # and so does the run
    label = names
    for _ in range(ROUNDS):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[0] = ~label[0] if n else 0
        differ = label ^ before
        edge = opens | same | (differ == 0)
        low = _low_bit(np.where(edge, _U(1), differ))
        label = np.where(edge, label & _U(1), (low.astype(np.uint64) << _U(1)) | ((label >> low.astype(np.uint64)) & _U(1)))
    left, right = np.empty_like(label), np.empty_like(label)
    left[1:], right[:-1] = label[:-1], label[1:]
    left[:1], right[-1:] = 0, 0
    peak = (label > left) & (label >= right) & ~same
    # a peak next to a phrase that is already open would leave a phrase of one symbol
    near = opens.copy()
    near[1:] |= opens[:-1]
    peak &= ~near
    peak[1:] &= ~peak[:-1].copy()
    return opens | peak


def phrase_sets(codes: np.ndarray, lengths: np.ndarray, level: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """(document, name) of the phrases at ``level`` and above, and of the top of lower hierarchies."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    names = mix64(codes.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    docs_out, names_out, depth = [], [], 0
    while len(names):
        first = np.ones(len(names), bool)
        first[1:] = doc[1:] != doc[:-1]
        alone = first.copy()
        alone[:-1] &= first[1:]
        take = np.ones(len(names), bool) if depth >= level else alone
        docs_out.append(doc[take])
        names_out.append(names[take])
        if alone.any():
            names, doc, first = names[~alone], doc[~alone], first[~alone]
            if not len(names):
                break
        depth += 1
        opens = parse_level(names, first)
        start = np.flatnonzero(opens)
        place = np.arange(len(names)) - np.repeat(start, np.diff(np.append(start, len(names))))
        salted = mix64(names + mix64(place.astype(np.uint64) * _U(0xD1B54A32D192ED03) + _U(depth)))
        names = mix64(np.add.reduceat(salted, start) + _U(depth))
        doc = doc[start]
    if not docs_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs_out), np.concatenate(names_out)


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of slots for each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc, name = phrase_sets(codes, lengths)
    mixed = mix64(name ^ _U(0xA5A5A5A5DEADBEEF))
    slot = doc * SLOTS + (mixed >> _U(57)).astype(np.int64)
    least = np.full(len(texts) * SLOTS, 0x1FFFFFFFFFFFFFF, np.uint64)
    np.minimum.at(least, slot, mixed & _U(0x1FFFFFFFFFFFFFF))
    least = least.reshape(-1, SLOTS)
    empty = least == _U(0x1FFFFFFFFFFFFFF)
    filled = np.where(empty, 10 * SLOTS, np.arange(SLOTS))
    twice = np.hstack([filled, np.where(empty, 10 * SLOTS, np.arange(SLOTS) + SLOTS)])
    nearest = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :SLOTS]
    has = nearest[:, 0] < 10 * SLOTS
    value = np.take_along_axis(least, np.where(has[:, None], nearest % SLOTS, 0), axis=1)
    value = mix64(value) & _U(0xFFFF)
    value = np.where(value == 0, _U(1), value)
    return np.where(has[:, None], value, _U(0)).astype(np.uint16)


def as_bytes_of(row: np.ndarray) -> bytes:
    """Slots as big-endian bytes; their hex is the fingerprint's text."""
    return row.astype(">u2").tobytes()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_OUT = "doc_id {id}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_BYTES = ("edited_sha256", "fingerprint", "edited_fingerprint")


def _rows(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> dict:
    new = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    prints = fingerprints(new)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in new],
        "fingerprint": [as_bytes_of(x) for x in own], "edited_fingerprint": [as_bytes_of(x) for x in prints], "near_edited": likeness(own, prints), "near_next": likeness(own, after),
    }


def fingerprint_documents(spark: SparkSession, docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each document, compared with its edited text and with the next document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    out_schema = _OUT.format(id=kind) + ", part int, edge int, edge_text string"
    fields = pa.schema([("doc_id", pa.null()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.int32()), ("edge_text", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in slices(batches, "text", BATCH):
            schema = fields.set(0, batch.schema.field("doc_id"))
            ids, texts = batch.column(0).to_pylist(), [x.decode("utf-8", "replace") for x in as_bytes(batch)]
            own = fingerprints(texts)
            edge: dict = {k: [] for k in schema.names}
            if held is None:
                edge = {k: [None] for k in schema.names} | {"doc_id": [ids[0]], "part": [part], "edge": [0], "edge_text": [texts[0]]}
            else:
                ids, texts, own = [held[0], *ids], [held[1], *texts], np.vstack([held[2][None], own])
            held = (ids[-1], texts[-1], own[-1])
            if len(ids) > 1:
                made = _rows(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:])
                for k in schema.names:
                    edge[k] = list(edge[k]) + list(made.get(k, [part if k == "part" else -1 if k == "edge" else None] * (len(ids) - 1)))
            yield pa.RecordBatch.from_pydict(edge, schema)
        if held is not None:
            last = {k: [None] for k in schema.names} | {"doc_id": [held[0]], "part": [part], "edge": [1], "edge_text": [held[1]]}
            yield pa.RecordBatch.from_pydict(last, schema)

    walked = materialize(ordered.mapInArrow(walk, out_schema), "fingerprints")
    names = [f.strip().split(" ")[0] for f in _OUT.split(",")]
    # two rows for each partition: its first text follows the last text of the partition before
    firsts = walked.where("edge = 0").select("part", F.col("edge_text").alias("following"))
    order = Window.orderBy("part")
    after = firsts.select("part").select(F.lag("part").over(order).alias("before"), "part")  # numbers only: no text meets another part's
    after = after.join(firsts, "part").select(F.col("before").alias("part"), "following")
    whole = firsts.agg(F.max("part").alias("part"), F.min_by("following", "part").alias("following"))
    after = after.where("part is not null").unionByName(whole)
    lasts = walked.where("edge = 1").join(after, "part").select("doc_id", "edge_text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (c.to_pylist() for c in batch.columns)
            made = _rows(ids, texts, following, fingerprints(texts), fingerprints(following))
            yield pa.RecordBatch.from_pydict({k: made[k] for k in names}, pa.schema([batch.schema.field(0), *[fields.field(k) for k in names[1:]]]))

    both = walked.where("edge = -1").select(*names).unionByName(lasts.mapInArrow(close, _OUT.format(id=kind)))
    return both.select(*[F.lower(F.hex(c)).alias(c) if c in _BYTES else c for c in names])
