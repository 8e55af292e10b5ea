"""A Merkle manifest of a data set: a leaf for each document, a subroot for each source, one root, and proofs.

A leaf is the hash of a row's fields. Leaves of a source ascend by doc_id; every 16 consecutive nodes become the
hash of their concatenation, until one node is left. Subroots, by source, do the same.

A block holds ``BLOCK`` consecutive nodes of a group (two levels, so blocks end where runs do), 32 bytes for each
digest; only the task that works on it has its levels as text: its nodes' digests end to end, 64 characters each, and
their parents', hashes of 1,024 characters each. What stands left and right of a node in its run is cut from these. The
blocks' roots are nodes of the next round, with a 256th of the rows; rounds end when every group is one block. Then a
node's path is what its own block gives, followed by the path of the block's root, which travels once for each block.
A node's whole path, some kB, is made where its hashes are, and neither stored nor sent. No row meets more than a
block's other rows, however large the source.

Places are dealt without a window over a source's rows: these are range-partitioned by source, doc_id and leaf (a
row's own number breaks ties, so that repeated rows are spread out too), and a row's place is its place in its part
and the sum of the counts of the source's earlier parts.

Nulls are '-' in a leaf; rows of a null source are a source of their own, before all others; rows of a null doc_id
come first in their source and are not tampered with. Rows of one doc_id are ordered by their leaves; repeated rows
are leaves of their own, each with its own proof. A column of the five that the table lacks counts as null, other
columns play no part. An empty table gives none. Texts are hashed as the bytes they hold, valid UTF-8 or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, materialize

#: The fields of a leaf, nodes of a run, characters of a digest.
FIELDS, RUN, HEX = ("doc_id", "source", "lang", "n_chars", "text"), 16, 64
#: Nodes of a block: two levels.
BLOCK = RUN * RUN
#: Sources up to which their paths to the root are broadcast, some kB for each.
FEW = 4096
_PATH = "array<struct<l:binary,r:binary>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(docs: DataFrame, **instead: Column) -> Column:
    """The hash of a row's fields, each '-' or its length in bytes, ':' and itself."""
    own = {f: F.col(f).cast("string") if f in docs.columns else F.lit(None).cast("string") for f in FIELDS}
    fields = [instead.get(f, own[f]) for f in FIELDS]
    return hashed(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in fields])


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with ``place`` (from 0) and ``total`` within ``grp``, ordered by the columns given; no group passes through one task."""
    rows = materialize(rows.withColumn("own", F.monotonically_increasing_id()), f"{name}-rows")
    keys = [F.col("grp"), *order, F.col("own")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()).drop("own"), f"{name}-ranged").withColumn("part", F.shiftright("at", 33))
    # a row for each source and part: what stands before it in the source, and the source's total
    parts = ranged.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select("grp", "part", F.sum("n").over(whole).alias("total"), (before - F.col("start")).alias("shift"))
    return ranged.join(shifts, ["grp", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "shift", "part")


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _runs(level: Column) -> Column:
    """The parents of a level's nodes, as one text."""
    count = F.ceil(F.octet_length(level) / F.lit(RUN * HEX)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.sha2(F.substring(level, i * RUN * HEX + 1, F.lit(RUN * HEX)), 256)), "").cast("binary")


def _beside(level: Column, i: Column) -> Column:
    """What stands left and right of node i in its run."""
    start = F.floor(i / RUN).cast("int") * RUN
    left = F.substring(level, start * HEX + 1, (i - start) * HEX)
    return F.struct(left.alias("l"), F.substring(level, (i + 1) * HEX + 1, (start + RUN - 1 - i) * HEX).alias("r"))


def _levels(blocks: DataFrame) -> DataFrame:
    """blocks with l0 and l1, the text of their nodes and of these's parents, as bytes."""
    blocks = blocks.withColumn("l0", F.array_join(F.transform("nodes", lambda x: _text(x["digest"])), "").cast("binary"))
    return blocks.withColumn("l1", F.when(F.col("total") > 1, _runs(F.col("l0"))))


def climbed(nodes: DataFrame, name: str, depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Of (grp, place, total, digest, item): the blocks, and grp, block, top (the group's root), rest (the path of the block's root).

    A block has grp, block, total, root and nodes (slot, digest and item of each); ``item`` is any column to keep.
    """
    slot = F.pmod("place", F.lit(BLOCK)).cast("int")
    kept = F.struct(slot.alias("slot"), F.col("digest"), F.col("item"))
    blocks = nodes.groupBy("grp", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(kept)).alias("nodes"))
    root = F.when(F.col("total") <= 1, F.col("nodes")[0]["digest"]).when(F.col("total") <= RUN, F.unhex(F.col("l1").cast("string"))).otherwise(F.unhex(F.sha2("l1", 256)))
    blocks = materialize(_levels(blocks).select("grp", "block", "total", root.alias("root"), "nodes"), f"{name}-blocks")
    none = F.array().cast(_PATH)
    more = blocks.where(F.col("total") > BLOCK).select("grp", F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("root").alias("digest"), F.col("block").alias("item"))
    if more.isEmpty():
        return blocks, blocks.select("grp", "block", F.col("root").alias("top"), none.alias("rest"))
    above = materialize(paths(*climbed(more, f"{name}-{depth + 1}", depth + 1), lambda x, path: F.struct(x["item"].alias("block"), path.alias("rest"))), f"{name}-above")
    heads = blocks.select("grp", "block", "root").join(above.hint("merge"), ["grp", "block"], "left")
    return blocks, heads.select("grp", "block", F.coalesce("top", "root").alias("top"), F.coalesce("rest", none).alias("rest"))


def paths(blocks: DataFrame, heads: DataFrame, of: Callable[[Column, Column], Column]) -> DataFrame:
    """For each node of the blocks, the heads' columns but block and rest, and the fields of ``of(node, its whole path)``.

    The join merges: Spark would size paths by their files, where most of them repeat, and broadcast them.
    """

    def each(x: Column) -> Column:
        i = x["slot"]
        first = _beside(F.col("l0"), i)
        own = F.when(F.col("total") <= 1, F.array().cast(_PATH)).when(F.col("total") <= RUN, F.array(first)).otherwise(F.array(first, _beside(F.col("l1"), F.floor(i / RUN).cast("int"))))
        return F.transform(F.array(F.concat(own, F.col("rest"))), lambda path: of(x, path))[0]

    met = _levels(blocks.select("grp", "block", "total", "nodes").join(heads.hint("merge"), ["grp", "block"]))
    return met.select(*[c for c in heads.columns if c not in ("block", "rest")], F.inline(F.transform("nodes", each)))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf.cast("binary"), lambda a, s: F.sha2(F.concat(s["l"], a, s["r"]), 256).cast("binary")).cast("string")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    # '' is the null source and '=...' any other, so the order of bytes is the order of sources
    grp = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaves = docs.select(grp.alias("grp"), "doc_id", F.unhex(leaf_of(docs)).alias("digest"), F.when(tampers, F.unhex(leaf_of(docs, text=lower_ascii(text)))).alias("tampered"))
    nodes = placed(leaves, [F.col("doc_id"), F.col("digest")], "manifest")
    blocks, heads = climbed(nodes.select("grp", "place", "total", "digest", F.struct("doc_id", "tampered").alias("item")), "manifest")
    subroots = heads.where("block = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("item"), F.col("top").alias("digest"))
    tops = paths(*climbed(placed(subroots, [F.col("item")], "manifest-top"), "manifest-top"), lambda x, path: F.struct(x["item"].alias("source"), path.alias("onward")))
    tops = materialize(tops.select(F.col("source").alias("grp"), F.col("top").alias("root"), "onward"), "manifest-tops")
    met = heads.join(F.broadcast(tops) if tops.count() <= FEW else tops.hint("merge"), "grp").select("grp", "block", "top", "root", F.concat("rest", "onward").alias("rest"))

    def proved(x: Column, path: Column) -> Column:
        proof = F.sha2(F.aggregate(path, F.lit("").cast("binary"), lambda a, s: F.concat(a, s["l"], s["r"])), 256)
        folded = fold(path, _text(F.coalesce(x["item"]["tampered"], x["digest"])))
        return F.struct(x["item"]["doc_id"].alias("doc_id"), _text(x["digest"]).alias("leaf"), proof.alias("proof_sha256"), folded.alias("folded_root"))

    out = paths(blocks, met, proved).select("doc_id", "leaf", _text(F.col("top")).alias("subroot"), _text(F.col("root")).alias("root"), "proof_sha256", "folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
