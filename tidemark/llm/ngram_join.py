"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set is its distinct word shingles. Documents of equal sets are one node. Two nodes link when
their Jaccard similarity reaches num/den; a node's component is what links reach.

Small sets (up to a size at which both ways cost the same, chosen from the sizes at hand) enumerate their
subsets of the sizes that a link would have in common; two linked sets share such a subset. Large sets, and
the small ones within reach of them, enter inverted lists of their prefix: the fewest elements that any
linked set must hit, rarest first; of a pair, the smaller set meets the other with fewer still, which are marked.
The order comes from a sketch of element counts over all documents; any order gives whole results, a good one
short lists. Entries leave a list at once where sizes and marks leave them no partner in it.

A node carries parity words: for each of some hash buckets, whether its set has an odd number of elements
there. Two sets differ in at least as many elements as their parities differ in bits, so parities rule out
nearly all pairs that don't link before their sets meet. Sets of more elements than a node's parity has bits fill it, so
these have a wide parity besides, of at least a bit for each element, by which pairs are tested once they are told apart.

Disk: keys stay where they were made but for those of repeated sets; their lists are made some keys at a time, and sets
meet some pairs at a time, each part's shuffles and sets dropped before the next.

Within a list, neighbours in an order of its own (size classes, shuffled within) are compared first; what they
link is contracted. Only nodes of different components are then compared, each pair that sizes and parities
allow, a long list cut into cells that meet two by two; the likeliest pairs of each node come first, so that
what they link spares the rest. So a group of copies costs some chains, and no link between components is lost.
Every link is verified on whole sets, as integers.

A null or empty text, or one without words, has an empty set, size 0, no links and its own doc_id as
component. Texts shorter than a shingle have one element, all their words. Repeated rows are one node; rows
of a null doc_id link like others but lend no id (a component of none but null ids has none). Several texts of
one id are nodes of their own. Extra columns, whatever their names, play no part. Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import column, discard, fold_others, list_column, materialize, mix64, release, slices, unfold_others, word_codes

#: Buckets of the count sketch, the least count that a task reports, and the most subsets of one small set.
SKETCH_BITS, SKETCH_LEAST, MOST_SUBSETS = 22, 5, 512
#: Words of 64 parity bits, the nodes of a list's cell, and the occurrences by which a hot list is cut for its chains.
PARITY, CELL, CHAIN = 16, 2048, 1 << 16
#: Parts in which keys go to their lists; the share of all elements, one of so many, that a part's pairs hold; most such parts; elements that need no parts.
KEY_PARTS, SET_SHARE, MOST_PARTS, LEAST_PART = 4, 8, 64, 1 << 20
#: Bits of the map that picks texts to fetch, and edges that one task contracts at the end.
WANTED_BITS, LOCAL_EDGES = 25, 1 << 20
#: Which of a node's neighbours in its lists, likeliest first, are verified at a time.
CHAINS = ((0, 1), (1, 8), (8, 1 << 31))
_U = np.uint64


def shingle_sets(batch: pa.RecordBatch, n: int, name: str = "text") -> list[np.ndarray]:
    """For each text of a batch, the sorted distinct 64-bit hashes of its word n-grams (of all its words, where these are fewer)."""
    h, per = word_codes(batch, name)

    def grams(words: np.ndarray, m: int) -> np.ndarray:
        out = np.full(len(words) - m + 1, m, np.uint64)
        for i in range(m):
            out = mix64(out * _U(0x9E3779B97F4A7C15) + words[i : len(words) - m + 1 + i])
        return out

    def distinct(x: np.ndarray) -> np.ndarray:
        x = np.sort(x)
        keep = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        return x[keep]

    whole = grams(h, n) if len(h) >= n else np.zeros(0, np.uint64)
    start = np.cumsum(per) - per
    return [distinct(whole[s : s + k - n + 1]) if k >= n else grams(h[s : s + k], k) if k else np.zeros(0, np.uint64) for s, k in zip(start.tolist(), per.tolist(), strict=True)]


def node_of(own: np.ndarray) -> int:
    """A set's hash; 0 for the empty set."""
    return xxhash.xxh64_intdigest(own.tobytes()) if len(own) else 0


def least_common(a: int, b: int, num: int, den: int) -> int:
    """The smallest intersection of linked sets of sizes a and b."""
    return -(-num * (a + b) // (num + den))


def partners(a: int, num: int, den: int) -> range:
    return range(max(1, -(-num * a // den)), den * a // num + 1)


def prefix_size(a: int, num: int, den: int) -> int:
    """Any linked set shares one of this many first elements, whichever order holds."""
    return a - -(-num * a // den) + 1


def index_size(a: int, num: int, den: int) -> int:
    """Of a linked pair the smaller set (either of equal ones) shares one of this many first elements with the other's prefix.

    All that both share from their first common element on lies behind it, and a set of this size or more must share
    as much as with one of its own size.
    """
    return a - least_common(a, a, num, den) + 1


def parity_words(own: np.ndarray, words: int) -> np.ndarray:
    """For each of 64 * words hash buckets a bit: whether the set has an odd number of elements there. Words: a power of two, or 0."""
    if not words:
        return np.zeros(0, np.int64)
    bit = np.bincount((own & _U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bit.astype(np.uint8)).view(np.int64)


def wide_words(a: int) -> int:
    """Words of a wide parity: a bit or more for each element; none where the narrow one has as many."""
    return 1 << (-(-a // 64) - 1).bit_length() if a > 64 * PARITY else 0


def subset_sizes(a: int, num: int, den: int) -> list[int]:
    return sorted({c for b in partners(a, num, den) if (c := least_common(a, b, num, den)) <= min(a, b)})


def subset_count(a: int, num: int, den: int) -> int:
    return sum(comb(a, c) for c in subset_sizes(a, num, den))


def subset_keys(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of all subsets that a linked set may share: sums of scrambled elements, so that leaving some out is cheap."""
    from itertools import combinations

    a = len(own)
    word = mix64(own ^ _U(0x5851F42D4C957F2D))
    total, out = word.sum(dtype=np.uint64), []
    for c in subset_sizes(a, num, den):
        gone = np.array([word[list(x)].sum(dtype=np.uint64) for x in combinations(range(a), a - c)], np.uint64)
        out.append(mix64(np.full(len(gone), total, np.uint64) - gone + _U(c)))
    return np.unique(np.concatenate(out))


def choose_boundary(sizes: dict[int, int], mean_list: float, num: int, den: int) -> int:
    """The largest size of a small set: where subsets and lists together cost least over the sizes at hand.

    A subset costs one row. A prefix element costs its row and, for each, the mean length of a list.
    """
    best, boundary, cost = 0.0, 0, 0.0
    for a in range(1, 64):
        if subset_count(a, num, den) > MOST_SUBSETS:
            break
        cost += sizes.get(a, 0) * (subset_count(a, num, den) - prefix_size(a, num, den) * (1 + mean_list))
        if cost <= best:
            best, boundary = cost, a
    return boundary


def sketch_counts(rows: DataFrame, n: int) -> DataFrame:
    """bucket, total: counts of elements by hash bucket as far as a task saw them often, and (-1 - size, documents)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sizes = np.zeros(1 << SKETCH_BITS, np.int32), np.zeros(64, np.int64)
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch, n)
            for s in sets:
                sizes[min(len(s), 63)] += 1
            np.add.at(seen, (np.concatenate(sets) >> _U(64 - SKETCH_BITS)).astype(np.int64), np.int32(1))
        often = np.flatnonzero(seen >= SKETCH_LEAST)
        some = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([often, -1 - some]).astype(np.int64)), pa.array(np.concatenate([seen[often], sizes[some]]).astype(np.int64))], names=["bucket", "total"])

    return rows.select("text").mapInArrow(count, "bucket long, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def signatures(spark: SparkSession, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, text_key, node, n_shingles, keys, tags, parity, wide, at: what the candidate search needs of each document.

    ``at`` numbers the rows. A tag is twice a salt, which cuts the lists of very frequent elements, and one more for a marked key. What comes to the driver is the sketch, 2^SKETCH_BITS
    buckets at most, packed.
    """
    counts = sketch_counts(rows, n).select(F.col("bucket").cast("int"), F.least(F.col("total"), F.lit(1 << 30)).cast("int").alias("total")).toArrow()
    bucket, total = counts["bucket"].to_numpy(), counts["total"].to_numpy().astype(np.int64)
    often = bucket >= 0
    rank, cuts = np.zeros(1 << SKETCH_BITS, np.uint8), np.zeros(1 << SKETCH_BITS, np.uint16)
    rank[bucket[often]] = np.frexp(total[often].astype(float))[1]
    cuts[bucket[often]] = np.minimum(total[often] // CHAIN, 60_000)
    sizes = dict(zip((-1 - bucket[~often]).tolist(), total[~often].tolist(), strict=True))
    mean_list = float((total[often] ** 2).sum() / max(1, total[often].sum()) / max(1, often.sum()))
    boundary = choose_boundary(sizes, mean_list, num, den)
    shared = spark.sparkContext.broadcast((rank, cuts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, cut = shared.value
        for batch in slices(batches, "text"):
            node, size, keys, tags, length, parity, wide = [], [], [], [], [], [], []
            for own in shingle_sets(batch, n):
                a = len(own)
                size.append(a)
                node.append(node_of(own))
                mine, tag = [], []
                if 0 < a <= boundary:
                    mine.append(subset_keys(own, num, den))
                    tag.append(np.ones(len(mine[0]), np.int32))
                if a and partners(a, num, den)[-1] > boundary:
                    slot = (own >> _U(64 - SKETCH_BITS)).astype(np.int64)
                    p = min(a, prefix_size(a, num, den))
                    place = (order[slot].astype(np.uint64) << _U(56)) | (mix64(own) >> _U(8))
                    first = np.argpartition(place, p - 1)[:p] if p < a else np.arange(a)
                    first = first[np.argsort(place[first])]
                    slot = slot[first]
                    mine.append(own[first])
                    cell = np.where(cut[slot] > 0, 1 + (node[-1] >> 1) % np.maximum(cut[slot].astype(np.int64), 1), 0)
                    tag.append((2 * cell + (np.arange(p) < index_size(a, num, den))).astype(np.int32))
                keys += mine
                tags += tag
                length.append(sum(map(len, mine)))
                parity.append(parity_words(own, PARITY))
                wide.append(parity_words(own, wide_words(a)))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            flat_tags = np.concatenate(tags) if tags else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "text_key"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(np.array(size, np.int64)), list_column(flat, np.array(length), pa.int64()),
                 list_column(flat_tags, np.array(length), pa.int32()), list_column(np.concatenate(parity), np.full(len(parity), PARITY), pa.int64()),
                 list_column(np.concatenate(wide), np.array([len(w) for w in wide]), pa.int64())],
                names=["doc_id", "text_key", "node", "n_shingles", "keys", "tags", "parity", "wide"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(sign, f"doc_id {kind}, text_key long, node long, n_shingles long, keys array<long>, tags array<int>, parity array<long>, wide array<long>")
    return materialize(signed.withColumn("at", F.monotonically_increasing_id()), "join-signatures")


def node_sets(rows: DataFrame, n: int) -> DataFrame:
    """node, elements of (text)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch, n)
            node = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), list_column(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64())], names=["node", "elements"])

    return rows.select("text").mapInArrow(whole, "node long, elements array<long>")


def mapped(rows: DataFrame, picks: DataFrame, names: Column) -> DataFrame:
    """rows with ``passes``: whether ``names`` (a long) is in picks (``pick``), or one of few others that a map over hash slots lets pass.

    The map goes to every task: 2^WANTED_BITS bits at most (4 MB), whatever the number of picks. Where it is
    full it lets every row pass. Nothing is shuffled.
    """
    slot = lambda c: F.pmod(c, F.lit(1 << WANTED_BITS))
    bits = picks.select(slot(F.col("pick")).alias("slot")).groupBy(F.shiftright("slot", 15).alias("slots")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(1 << 15))).alias("bits"))
    placed = rows.withColumn("named", names).withColumn("slot", slot(F.col("named")))
    at = F.pmod("slot", F.lit(1 << 15))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = placed.join(F.broadcast(bits), F.shiftright("slot", 15) == F.col("slots"), "left").withColumn("byte", byte)
    return met.select(*rows.columns, F.coalesce(F.expr("getbit(byte, CAST(slot % 8 AS INT)) = 1"), F.lit(False)).alias("passes"))


def picked(rows: DataFrame, picks: DataFrame, names: Column) -> DataFrame:
    """The rows that ``mapped`` lets pass."""
    return mapped(rows, picks, names).where("passes").select(rows.columns)


def fetch_sets(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """node, elements of the nodes of pairs (a, b): one text of each is fetched, by a hash of its id and text."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(nodes.select("node", "pick").join(wanted, "node", "left_semi"), "join-picks")
    picks, wanted = wanted.select("pick"), wanted.select("node")
    texts = picked(rows.select("doc_id", "text"), picks, F.xxhash64("doc_id", F.xxhash64("text"))).select("text")
    found = node_sets(texts, n).join(wanted.hint("shuffle_hash"), "node", "left_semi")
    out = materialize(found.groupBy("node").agg(F.first("elements").alias("elements")), "join-sets")
    release(rows.sparkSession)
    return out


def _size_room(na: Column, nb: Column, num: int, den: int) -> Column:
    return (na * den >= nb * num) & (nb * den >= na * num)


def _differ(pa_: Column, pb: Column) -> Column:
    return sum((F.bit_count(pa_[i].bitwiseXOR(pb[i])).cast("long") for i in range(PARITY)), F.lit(0).cast("long"))


def _spare(na: Column, nb: Column, num: int, den: int) -> Column:
    """The most elements in which linked sets of these sizes differ."""
    return (na + nb) - 2 * F.ceil((na + nb) * num / (num + den))


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Of the sets only those travel that are an end of a pair, each to its own ends."""
    of = lambda end: picked(sets, pairs.select(F.col(end).alias("pick")), F.col("node")).select(F.col("node").alias(end), F.col("elements").alias(f"e{end}"))
    left, right = of("a"), of("b")
    both = F.size(F.array_intersect("ea", "eb")).cast("long")
    union = F.size("ea") + F.size("eb") - both
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(both * den >= union * num).select("a", "b")


def wide_apart(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, ...) but for those whose wide parities (node, size, wide) differ in more bits than linked sets differ in elements.

    The longer of two parities is folded to the shorter; the few pairs for which one fold is not enough stay.
    """
    of = lambda end: picked(wide, pairs.select(F.col(end).alias("pick")), F.col("node")).select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("wide").alias(f"wide_{end}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    x, y = F.col("wide_a"), F.col("wide_b")

    def fold(w: Column) -> Column:
        half = (F.size(w) / 2).cast("int")
        return F.zip_with(F.slice(w, 1, half), F.slice(w, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    differ = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    bits = F.when(F.size(x) == F.size(y), differ(x, y)).when(F.size(x) == 2 * F.size(y), differ(fold(x), y)).when(2 * F.size(x) == F.size(y), differ(x, fold(y)))
    return met.where(F.coalesce(bits <= _spare(F.col("size_a"), F.col("size_b"), num, den), F.lit(True))).select(pairs.columns)


def verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, num: int, den: int, total: int) -> list[DataFrame]:
    """Tables of the pairs (a, b, elements: of both sets) that link, some pairs at a time; none where there are no pairs. total: elements of all nodes."""
    out, elements = [], pairs.agg(F.sum("elements")).first()[0]
    parts = min(MOST_PARTS, -(-elements // max(LEAST_PART, -(-total // SET_SHARE)))) if elements else 0
    for part in range(parts):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == part)
        sets = fetch_sets(rows, nodes, some, n)
        out.append(materialize(verify(some, sets, num, den), "join-edges"))
        discard(sets)
    return out


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that edges reach) of all nodes but the smallest ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (up := label[label])).any():
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's edges (u, v) as stars around the smallest nodes, some edges at a time."""
    u = v = np.zeros(0, np.int64)
    for batch in batches:
        u, v = np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()])
        if len(u) > 2 * LOCAL_EDGES:
            u, v = contracted(u, v)
            if len(u) > LOCAL_EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                u = v = np.zeros(0, np.int64)
    u, v = contracted(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, name: str = "components", local: int = LOCAL_EDGES) -> DataFrame:
    """node, component (the smallest node that edges reach; that node itself has no row).

    Tasks contract their own edges first. What is left, where it is ``local`` edges at most (16 MB), one task
    contracts; more than that goes through alternating large and small stars, in which each step aggregates
    neighbours' minima before the shuffle, so a hub sends one row from each task.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, before = materialize(pairs.mapInArrow(_contract, "u long, v long"), name), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        if now[0] <= local:
            edges = materialize(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), name)
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.where("m <> u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def first_rows(signed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The row of each node that has the smallest ``at``, its ``first``; and the others' ``at``. Only rows that go, and few others, are shuffled with their keys."""
    again = nodes.where("n_copies > 1").select("node", "first")
    spare = picked(signed.select("node", "at"), again.select(F.col("node").alias("pick")), F.col("node")).join(again, "node").where("at <> first")
    spare = materialize(spare.select("at"), "join-spare")
    seen = mapped(signed.where("n_shingles > 0"), spare.select(F.xxhash64("at").alias("pick")), F.xxhash64("at"))
    some = seen.where("passes").select(signed.columns)
    return seen.where("not passes").select(signed.columns).unionByName(some.join(spare, "at", "left_anti")), spare


def with_partners(listed: DataFrame, num: int, den: int) -> DataFrame:
    """key, node, size, marked, prev of the entries (key, node, size, tag) that may have a partner in their list.

    A larger set needs a marked entry of a size within reach before it, in order of size; a marked one any within reach
    after it. ``prev`` is the neighbour in the list's own order: by size class, shuffled within. Hot lists are cut by
    salt for this, and all their entries stay.
    """
    entry = listed.select("key", "node", F.col("size").cast("long").alias("size"), F.shiftright("tag", 1).alias("salt"), (F.col("tag") % 2 == 1).alias("marked"))
    by_size = Window.partitionBy("key", "salt").orderBy("size", F.desc("marked"))
    before = F.last(F.when(F.col("marked"), F.col("size")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("size").over(by_size)
    stays = (F.col("salt") > 0) | F.coalesce(F.col("before") * den >= F.col("size") * num, F.lit(False)) | (F.col("marked") & F.coalesce(F.col("after") * num <= F.col("size") * den, F.lit(False)))
    entry = entry.withColumn("before", before).withColumn("after", after).where(stays)
    band = F.floor(F.log("size") * F.lit(2 / np.log(den / num)))
    order = Window.partitionBy("key", "salt").orderBy(band, F.xxhash64("node", "key"))
    return entry.select("key", "node", F.col("size").cast("int").alias("size"), "marked", F.lag("node").over(order).alias("prev"))


def still_apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose ends are of different components."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return met.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select(pairs.columns)


def pairs_apart(lists: DataFrame, facts: DataFrame, found: DataFrame, num: int, den: int, cell: int = CELL) -> DataFrame:
    """a, b, differ, elements: the pairs of different components that share a list and whose sizes and parities leave room for a link.

    A list of more than ``cell`` nodes is cut into cells; each meets itself and every other, in tasks of their own.
    """
    apart = lists.join(found, "node", "left").select("key", "node", "size", "marked", F.coalesce("component", "node").alias("component"))
    # a list is aggregated task by task and joined back, so that a long one is never one task's
    open_lists = apart.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    apart = apart.join(open_lists.select("key", F.ceil(F.col("n") / cell).alias("cells")), "key")
    apart = apart.join(facts.select("node", "parity"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")))
    apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    apart = apart.select("key", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "own", "node", F.col("size").cast("long").alias("size"), "marked", "component", "parity")
    x, y = apart.alias("x"), apart.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.c1") == F.col("y.c1")) & (F.col("x.c2") == F.col("y.c2"))
    once = (F.col("x.node") < F.col("y.node")) & ((F.col("x.own") != F.col("y.own")) | (F.col("x.c1") == F.col("x.c2")))
    na, nb = F.col("x.size"), F.col("y.size")
    differ = _differ(F.col("x.parity"), F.col("y.parity"))
    marked = (F.col("x.marked") & (na <= nb)) | (F.col("y.marked") & (nb <= na))
    met = x.join(y, same & once & marked & (F.col("x.component") != F.col("y.component")) & _size_room(na, nb, num, den) & (differ <= _spare(na, nb, num, den)))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), differ.alias("differ"), (na + nb).alias("elements")).groupBy("a", "b").agg(F.first("differ").alias("differ"), F.first("elements").alias("elements"))


def link_nodes(spark: SparkSession, docs: DataFrame, n: int, num: int, den: int, cell: int = CELL, local: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, node, n_shingles of each row; node, n_copies, component, component_id of each node)."""
    rows = docs.select("doc_id", "text")
    signed = signatures(spark, rows, n, num, den)
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.min(F.xxhash64("doc_id", "text_key")).alias("pick"), F.min("at").alias("first"),
        F.first("n_shingles").alias("size"), F.first("parity").alias("parity"), F.first("wide").alias("wide"),
    )
    nodes = materialize(nodes, "join-facts")
    known = materialize(signed.select("doc_id", "text_key", "node", "n_shingles"), "join-rows")
    release(spark)
    (firsts, spare), lists = first_rows(signed, nodes), []
    total = nodes.agg(F.sum("size")).first()[0] or 0
    parts = KEY_PARTS if total > LEAST_PART else 1
    for part in range(parts):
        entries = F.expr(f"filter(arrays_zip(keys, tags), x -> pmod(x.keys, {parts}L) = {part})")
        listed = firsts.select("node", F.col("n_shingles").cast("int").alias("size"), F.explode(entries).alias("x"))
        lists.append(materialize(with_partners(listed.select(F.col("x.keys").alias("key"), "node", "size", F.col("x.tags").alias("tag")), num, den), "join-lists"))
        release(spark)
    discard(signed, spare)
    passed, lists = lists, reduce(DataFrame.unionByName, lists)

    facts, wide = nodes.select("node", "size", "parity"), nodes.where(F.size("wide") > 0).select("node", "size", "wide")
    side = lambda s: facts.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("parity").alias(f"parity_{s}"))
    chain = lists.where("prev is not null").select(F.least("node", "prev").alias("a"), F.greatest("node", "prev").alias("b")).distinct()
    differ = _differ(F.col("parity_a"), F.col("parity_b"))
    sizes = F.col("size_a"), F.col("size_b")
    chain = chain.join(side("a"), "a").join(side("b"), "b").where(_size_room(*sizes, num, den) & (differ <= _spare(*sizes, num, den)))
    passed.append(met := materialize(chain.select("a", "b", differ.alias("differ"), (sizes[0] + sizes[1]).alias("elements")), "join-met"))
    likely = Window.partitionBy("a").orderBy("differ", "b")
    chain = materialize(wide_apart(met, wide, num, den).withColumn("nth", F.row_number().over(likely)), "join-chain")
    release(spark)
    # the likeliest neighbours of each node first; of the others only those that are still apart
    linked, found, tested = [], None, None
    passed.append(chain)
    for low, high in CHAINS:
        part = chain.where((F.col("nth") > low) & (F.col("nth") <= high)).drop("nth")
        passed.append(todo := materialize(part if found is None else still_apart(part, found), "join-todo"))
        more = verified(rows, nodes, todo, n, num, den, total)
        linked += more
        tested = todo.select("a", "b") if tested is None else tested.unionByName(todo.select("a", "b"))
        if more or found is None:
            edges = reduce(DataFrame.unionByName, linked) if linked else todo.select("a", "b")
            found = components(edges, "join-components", local)
        release(spark)
    passed.append(met := materialize(pairs_apart(lists, facts, found, num, den, cell).join(tested, ["a", "b"], "left_anti"), "join-met"))
    release(spark)
    passed.append(more := materialize(wide_apart(met, wide, num, den), "join-more"))
    quota = 4
    while not more.isEmpty():
        passed.append(todo := materialize(more.withColumn("nth", F.row_number().over(likely)), "join-likely"))
        last = todo.where(F.col("nth") > quota).isEmpty()
        todo = todo.where(F.col("nth") <= quota).drop("nth")
        linked += verified(rows, nodes, todo, n, num, den, total)
        found = components(reduce(DataFrame.unionByName, linked), "join-components", local)
        if last:
            break
        release(spark)
        tested, quota = tested.unionByName(todo.select("a", "b")), quota * 16
        more = still_apart(more, found).join(tested, ["a", "b"], "left_anti")
    root = nodes.join(found, "node", "left").select("node", "rep", "n_copies", F.coalesce("component", "node").alias("component"))
    least = root.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = materialize(root.join(least, "component").select("node", "n_copies", "component", "component_id"), "join-nodes")
    discard(*linked, *passed, nodes)
    return known, out


def link_documents(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (rows of the same set) for each row of docs."""
    rows, nodes = link_nodes(spark, docs, n, num, den, **options)
    out = rows.join(nodes, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, and of its texts and repetitions one.

    Rows without shingles all stay. A component of none but null ids keeps one row, others none of a null id.
    Only rows that go, by id and text, are joined to the texts, and only repeated ones are grouped.
    """
    core = ("doc_id", "text")
    folded = fold_others(docs, *core)
    rows, nodes = link_nodes(spark, folded, n, num, den)
    linked = materialize(rows.where("n_shingles > 0").join(nodes.select("node", "component"), "node").select("doc_id", "text_key", "component"), "join-linked")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_key"))
    stays = linked.groupBy("component").agg(F.min(name).alias("stay"))
    by = linked.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("rows")).join(stays, "component")
    by = by.select("doc_id", "text_key", "rows", (F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("text_key") == F.col("stay.text_key"))).alias("stays"))
    by = materialize(by.where("rows > 1 or not stays").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "stays"), "join-gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    # texts that surely stay don't travel
    seen = mapped(folded, by.select(F.xxhash64("gone_id", "gone_key").alias("pick")), F.xxhash64("doc_id", F.xxhash64("text")))
    some = seen.where("passes").select(folded.columns)
    kept = seen.where("not passes").select(folded.columns).unionByName(some.join(by, same, "left_anti"))
    if not by.where("stays").isEmpty():
        again = some.join(by.where("stays"), same, "left_semi").withColumn("row", F.struct(*folded.columns))
        again = again.groupBy("doc_id", F.xxhash64("text").alias("text_key")).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.unionByName(again.select("row.*"))
    return kept.select(*unfold_others(docs, *core))
