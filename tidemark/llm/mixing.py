"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be copied target / source size times on average. Its whole part is taken
by all; the fractions are rounded by pivotal sampling: two fractions meet, mass moves from one to the other
at random until one of them is whole, and the other goes on. Documents meet within small blocks of like
size first; what each block leaves over meets in blocks of blocks, and so on up to one remainder for each
source, which is drawn. So the number of copies of a source hardly strays, nor, as sizes are alike where
documents meet, do its words. Draws come from hashes of the document ids: reruns agree.

A null text has size 0. A null source is a source of its own, last in order. Rows alike in id, source and
size, null ids too, are one unit of the rounding and share its copies evenly. Sources without words have target 0, and their documents take none. An empty table gives an
empty result. Columns besides doc_id, source and text, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import OTHERS, WORD, fold_others, materialize, unfold_others

#: Fixed by the contract: weights by the order of sources, the mix's share of all words, most copies of a word.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Fractions that meet in one block, and the width of a size class (a power).
FAN_IN, CLASS_BASE, SEED = 64, 1.1, 17


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, size, rows). One row for each source goes through one window; documents never do.

    Targets share ``share`` of all words by weight and stop at ``most`` times their source. With sources in
    order of limit / weight, those that stop are a prefix: a source stops when the level that is left for it
    and all after it lies above its own limit.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    by = by.withColumn("level", (total - before) / left)
    by = by.withColumn("stops", F.col("level") * F.col("weight") >= F.col("limit"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(Window.partitionBy())
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(Window.partitionBy())
    by = by.withColumn("level", F.coalesce(first["level"], level, F.lit(0.0)))
    return by.select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _fold(seed: int) -> str:
    """SQL that lets the rows of an array meet one after another: what remains, its fraction, what is settled.

    ``a`` and ``b`` are the words that may move to the one that has waited (``acc``) or to the newcomer (``x``)
    until a fraction is whole; they move with chances b / (a + b) and a / (a + b), so no expectation changes.
    """
    draw = f"(pmod(xxhash64(acc.cur.doc_id, acc.cur.size, x.d.doc_id, x.d.size, {seed}), 9007199254740992L) / 9007199254740992D)"
    s, z = "greatest(acc.cur.size, 1L)", "greatest(x.d.size, 1L)"
    return f"""aggregate(
        slice(items, 2, size(items)),
        named_struct('cur', items[0].d, 'p', items[0].p, 'done', slice(transform(items, i -> named_struct('d', i.d, 'up', 0)), 1, 0)),
        (acc, x) -> transform(transform(
            array(named_struct('a', least((1D - acc.p) * {s}, x.p * {z}), 'b', least(acc.p * {s}, (1D - x.p) * {z}), 'u', {draw})),
            t -> named_struct('a', t.a, 'b', t.b, 'to', t.u * (t.a + t.b) < t.b,
                'out', IF(t.u * (t.a + t.b) < t.b, (1D - acc.p) * {s} <= x.p * {z}, acc.p * {s} <= (1D - x.p) * {z}))),
            t -> named_struct(
                'cur', IF(t.out, x.d, acc.cur),
                'p', greatest(0D, least(1D, CASE WHEN t.out THEN x.p + IF(t.to, -t.a, t.b) / {z} ELSE acc.p + IF(t.to, t.a, -t.b) / {s} END)),
                'done', concat(acc.done, array(named_struct('d', IF(t.out, acc.cur, x.d), 'up', CAST(t.out = t.to AS int))))))[0])"""


def mix_units(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, rows, source_size, target, copies: rows alike in doc_id, size and source are one unit, and share its copies.

    A unit is one fraction in the rounding, so rows of one id, however many, are never gathered.
    """
    sizes = docs.select("doc_id", "source", word_count().alias("size"))
    sizes = materialize(sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(sizes, weights, share, most).withColumn("rate", rate)
    size_class = F.floor(F.log1p(F.col("size").cast("double")) / F.log(F.lit(CLASS_BASE))).cast("int")
    classes = sizes.groupBy("source", size_class.alias("class")).count()
    classes = classes.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "class", F.ceil(F.col("count") / fan_in).alias("blocks"), "source_size", "target", "rate")
    classes = materialize(classes, "mix-classes")
    blocks = classes.agg(F.max("blocks")).first()[0] or 0
    rows = sizes.withColumn("class", size_class).alias("s").join(classes.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.class") == F.col("c.class")))
    rows = rows.withColumn("due", F.col("rows") * F.col("rate")).withColumn("whole", F.floor(F.col("due") + 1e-12))
    level = rows.select(
        "s.source", "s.class", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("blocks")).alias("block"),
        F.struct("doc_id", "size", F.col("s.source").alias("source"), "rows", "source_size", "target", "whole").alias("d"), F.greatest(F.lit(0.0), F.col("due") - F.col("whole")).alias("p"),
    )
    settled, step = [], 0
    while True:
        met = level.groupBy("source", "class", "block").agg(F.array_sort(F.collect_list(F.struct(F.col("d.size").alias("z"), F.col("d.doc_id").alias("i"), "d", "p"))).alias("items"))
        met = materialize(met.select("source", "class", "block", F.expr(_fold(seed + step)).alias("m")), f"mix-level{step}")
        settled.append(met.select(F.explode("m.done").alias("x")).select("x.d.*", F.col("x.up").alias("up")))
        level = met.select("source", "class", "block", F.col("m.cur").alias("d"), F.col("m.p").alias("p"))
        if blocks > 1:
            blocks = -(-blocks // fan_in)
            level = level.withColumn("block", F.floor(F.col("block") / fan_in)) if blocks > 1 else level.withColumn("block", F.lit(0).cast("long"))
        elif step < 90:
            step = 90
            level = level.withColumn("class", F.floor(F.col("class") / 32).cast("int"))
        elif step == 90:
            step = 91
            level = level.withColumn("class", F.lit(0))
        else:
            break
        step += 1 if step < 90 else 0
    draw = F.pmod(F.xxhash64("d.doc_id", "d.size", F.lit(seed + 99)), F.lit(2**53)) / F.lit(float(2**53))
    settled.append(level.select("d.*", (draw < F.col("p")).cast("int").alias("up")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "size", "source", "rows", "source_size", "target", (F.col("whole") + F.col("up")).cast("long").alias("copies"))


def word_count() -> Column:
    """Words of ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _share(nth: Column) -> Column:
    """Copies of the nth row (from 1) of a unit: as even as whole copies can be."""
    return (F.floor(F.col("copies") / F.col("rows")) + (nth <= F.col("copies") % F.col("rows")).cast("long")).cast("int")


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs."""
    units = mix_units(docs, weights, share, most, fan_in, seed)
    each = units.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).withColumn("own", _share(F.col("nth")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("own")).alias("taken"), F.col("own").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it.

    Rows alike in doc_id, source and size are numbered first: within the parts in which they are written, then
    over the counts of these parts, so that no unit's rows pass through one task.
    """
    units = materialize(mix_units(docs, **options), "mix-units")
    core = ("doc_id", "text", "source")
    rows = fold_others(docs, *core).withColumn("size", word_count())
    same = ["doc_id", "source", "size"]

    def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        right = right.select(*[F.col(c).alias(f"own_{c}") if c in keys else c for c in right.columns])
        alike = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in keys]
        condition = alike[0]
        for more in alike[1:]:
            condition = condition & more
        return left.join(right, condition, how)

    single = met(rows, units.where("rows = 1 and copies > 0").select(*same, "copies"), same).withColumn("own", F.col("copies"))
    out = single.select(*core, OTHERS, "own")
    if not (many := units.where("rows > 1 and copies > 0")).isEmpty():
        numbered = met(rows, many.select(*same, "rows", "copies"), same).select(*core, "size", OTHERS, "rows", "copies", F.monotonically_increasing_id().alias("at"))
        numbered = materialize(numbered, "mix-repeats").withColumn("part", F.shiftright("at", 33))
        parts = numbered.groupBy(*same, "part").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.select(*same, "part", before.alias("before"))
        local = numbered.withColumn("place", F.row_number().over(Window.partitionBy(*same, "part").orderBy("at")))
        again = met(local, parts, [*same, "part"]).withColumn("own", _share(F.col("before") + F.col("place")))
        out = out.unionByName(again.select(*core, OTHERS, F.col("own").cast("long").alias("own")).where("own > 0"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own")))).select(*unfold_others(docs, *core))
