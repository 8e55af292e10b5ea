"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The vocabulary is read from a public model file (a path parameter); nothing is trained. A piece's score is
the natural logarithm of Zipf's law over its place in the vocabulary, because the file holds merge ranks
rather than probabilities. The automaton reports, at each position, every piece that ends there (the match
itself and those behind its output links), and each of them relaxes the best score of that position.

No piece holds a space mark after another character, and none holds a line feed, so the best path of a text
is the best paths of its space-led segments put end to end; segments repeat, and each is searched once.

Null and empty texts have no pieces and decode to the empty text. Characters that no piece covers, and a
literal space mark, become byte pieces, so decoding gives back every text exactly. Bytes that are no UTF-8 count as
replacement characters. Repeated rows are encoded alike. Of other columns ``encode_documents`` keeps those it is
told to, untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import as_bytes, list_column, slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments kept while a task runs, and the longest one worth keeping.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 48
MARK = "▁"
SEGMENT = re.compile(f"[\n{MARK}]| *[^ \n{MARK}]+| +")


def load_pieces(path: str = MODEL_PATH) -> list[tuple[str, int, float]]:
    """(piece, id, log score) of all ordinary pieces, then ("", id of byte b, b) for the 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary, byte = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte.append(("", i, float(int(piece[1:-1], 16))))
        elif not (model.is_control(i) or model.is_unknown(i)):
            ordinary.append((piece, i, -float(np.log(len(ordinary) + 2.0))))
    if bad := [p for p, _, _ in ordinary if re.search(f"[^{MARK}]{MARK}|\n", p)]:
        raise ValueError(f"pieces that cross a segment's edge: {bad[:3]}")
    return ordinary + byte


class Coder:
    """Encodes and decodes one text at a time."""

    def __init__(self, pieces: list[tuple[str, int, float]]):
        self.auto = ahocorasick.Automaton()
        self.byte = [0] * 256
        self.surface: dict[int, bytes] = {}
        lowest = 0.0
        for piece, i, score in pieces:
            if piece:
                self.auto.add_word(piece, (i, len(piece), score))
                self.surface[i] = piece.replace(MARK, " ").encode()
                lowest = min(lowest, score)
            else:
                self.byte[int(score)] = i
                self.surface[i] = bytes([int(score)])
        self.auto.make_automaton()
        self.single = {p for p, _, _ in pieces if len(p) == 1}
        self.unknown = lowest - 10.0
        self.cache: dict[str, bytes] = {}

    def best_path(self, segment: str) -> list[int]:
        """Ids of the best segmentation; ties go to the longest last piece. Uncovered characters become bytes."""
        n = len(segment)
        best, back = [0.0] + [-1e300] * n, [None] * (n + 1)
        gaps = [] if self.single.issuperset(segment) else [i for i, c in enumerate(segment) if c not in self.single]
        at = 0
        for end, hit in self.auto.iter(segment):
            while at < len(gaps) and gaps[at] <= end:
                self._gap(segment, best, back, gaps[at])
                at += 1
            j, i = end + 1, end + 1 - hit[1]
            score = best[i] + hit[2]
            if score > best[j]:
                best[j], back[j] = score, hit
        for g in gaps[at:]:
            self._gap(segment, best, back, g)
        ids, j = [], n
        while j:
            hit = back[j]
            if hit[1] > 0:
                ids.append(hit[0])
                j -= hit[1]
            else:
                ids += reversed([self.byte[b] for b in segment[j - 1].encode()])
                j -= 1
        return ids[::-1]

    def _gap(self, segment, best, back, i) -> None:
        if best[i] + self.unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + self.unknown, (-1, 0, 0.0)

    def segment_ids(self, segment: str) -> bytes:
        if (kept := self.cache.get(segment)) is None:
            marked = segment.replace(" ", MARK)
            ids = [self.byte[b] for b in segment.encode()] if segment in (MARK, "\n") else self.best_path(marked)
            kept = np.array(ids, np.int32).tobytes()
            if len(segment) <= CACHE_CHARS and len(self.cache) < CACHE_ENTRIES:
                self.cache[segment] = kept
        return kept

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit integers."""
        return b"".join(map(self.segment_ids, SEGMENT.findall(" " + text))) if text else b""

    def decode(self, ids) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str = MODEL_PATH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then piece_ids array<int>, n_pieces, n_byte_pieces and whether decoding gave the text back.

    The vocabulary, whose size is fixed, is broadcast; a task builds its automaton and drops it, with its cache, at its end.
    """
    shared = spark.sparkContext.broadcast(load_pieces(model_path))
    rows = docs.select(*keep, docs["text"].alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(shared.value)
        is_byte = np.zeros(max(own.surface) + 1, bool)
        is_byte[own.byte] = True
        for batch in slices(batches, "_text"):
            packed, exact = [], []
            for raw in as_bytes(batch, "_text"):
                text = raw.decode("utf-8", "replace")
                packed.append(own.encode(text))
                exact.append(own.decode(np.frombuffer(packed[-1], np.int32).tolist()) == text)
            size = np.array([len(x) // 4 for x in packed], np.int64)
            flat = np.frombuffer(b"".join(packed), np.int32)
            run = np.concatenate([[0], np.cumsum(is_byte[flat])]) if len(flat) else np.zeros(1, np.int64)
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], list_column(flat, size, pa.int32()), pa.array(size), pa.array(run[ends] - run[ends - size]), pa.array(exact)],
                names=[*keep, "piece_ids", "n_pieces", "n_byte_pieces", "round_trip"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(encode, f"{kinds}, piece_ids array<int>, n_pieces long, n_byte_pieces long, round_trip boolean")


def decode_documents(spark: SparkSession, encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text from doc_id and piece_ids (null ids: the empty text)."""
    shared = spark.sparkContext.broadcast(load_pieces(model_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(shared.value)
        for batch in batches:
            texts = [own.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", "piece_ids")
    return rows.mapInArrow(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
