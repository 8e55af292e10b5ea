"""Landed batches to document rows: cursors, quotas, natural keys, ledgers, payload checks, feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import author_hash, content_hash, outlet

# Paths of the landed JSON payload kinds.
ITEM_SCHEMAS = {
    "play": "array<struct<reviewId:string,userName:string,content:string,score:int,at:timestamp,appVersion:string>>",
    "appstore": "struct<feed:struct<entry:array<struct<id:struct<label:string>,author:struct<name:struct<label:string>>,content:struct<label:string>,`im:rating`:struct<label:string>,updated:struct<label:string>,`im:version`:struct<label:string>>>>>",
    "discourse": "struct<posts:array<struct<id:bigint,username:string,blurb:string,cooked:string,created_at:string,like_count:int>>>",
    "hackernews": "struct<hits:array<struct<objectID:string,title:string,author:string,created_at:string,points:int,url:string>>>",
}


def parse_payloads(landed: DataFrame, kind: str) -> DataFrame:
    """Items of (payload string) of one kind in the common schema; fields that the kind lacks stay null."""
    x = landed.select(F.from_json("payload", ITEM_SCHEMAS[kind]).alias("p"))
    none = lambda t: F.lit(None).cast(t)
    if kind == "play":
        i = x.select(F.explode("p").alias("i"))
        cols = (F.col("i.reviewId"), F.coalesce("i.userName", F.lit("")), F.col("i.content"), none("string"), F.coalesce("i.score", F.lit(0)), F.col("i.at"), F.col("i.appVersion"), none("int"), none("string"))
    elif kind == "appstore":
        i = x.select(F.explode("p.feed.entry").alias("i"))
        cols = (F.col("i.id.label"), F.col("i.author.name.label"), F.col("i.content.label"), none("string"), F.coalesce(F.col("i.`im:rating`.label").cast("int"), F.lit(0)), F.to_timestamp("i.updated.label"), F.col("i.`im:version`.label"), none("int"), none("string"))
    elif kind == "discourse":
        i = x.select(F.explode("p.posts").alias("i"))
        cols = (F.col("i.id").cast("string"), F.col("i.username"), F.coalesce(F.nullif("i.blurb", F.lit("")), "i.cooked"), none("string"), none("int"), F.to_timestamp("i.created_at"), none("string"), F.col("i.like_count"), none("string"))
    else:
        i = x.select(F.explode("p.hits").alias("i"))
        cols = (F.col("i.objectID"), F.col("i.author"), none("string"), F.col("i.title"), none("int"), F.to_timestamp("i.created_at"), none("string"), F.col("i.points"), F.col("i.url"))
    names = ("external_id", "author", "body", "title", "rating", "published_at", "app_version", "engagement", "url")
    return i.select(F.lit(kind).alias("source_name"), *[c.alias(n) for c, n in zip(cols, names, strict=True)])


_RSS_DATE, _ENTRY = "d MMM yyyy HH:mm:ss Z", "id:string,guid:string,link:{link},title:string,description:string,summary:string,pubDate:string,published:string,updated:string"


def parse_feed(landed: DataFrame) -> DataFrame:
    """Entries of (payload string), RSS items and Atom entries alike: id else link, published else updated; a missing date stays null."""
    rss = f"struct<channel:struct<item:array<struct<{_ENTRY.format(link='string')}>>>>"
    atom = f"struct<entry:array<struct<{_ENTRY.format(link='struct<_href:string>')}>>>"
    feeds = landed.withColumn("is_atom", F.lower("payload").rlike(r"^\s*(<\?xml[^>]*\?>\s*)?<feed\b"))
    r = feeds.where("not is_atom").select(F.explode(F.from_xml("payload", rss)["channel"]["item"]).alias("i")).select("i", F.col("i.link").alias("link"))
    a = feeds.where("is_atom").select(F.explode(F.from_xml("payload", atom)["entry"]).alias("i")).select("i", F.col("i.link._href").alias("link"))

    def entries(x: DataFrame) -> DataFrame:
        text = lambda *names: F.coalesce(*[F.nullif(F.trim(f"i.{n}"), F.lit("")) for n in names])
        # "Tue, 30 Jan 2024 ..." without its weekday, which the date tells and the parser may not take; else ISO
        short = lambda c: F.regexp_extract(c, r"^(?:\w{3}, *)?(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})$", 1)
        at = lambda c: F.when(short(c) != "", F.try_to_timestamp(short(c), F.lit(_RSS_DATE))).otherwise(F.try_to_timestamp(c))
        when = F.coalesce(at(text("published", "pubDate")), at(text("updated")))
        link = F.nullif(F.trim("link"), F.lit(""))
        return x.select(F.lit("rss").alias("source_name"), F.coalesce(text("id", "guid"), link).alias("external_id"), text("title").alias("title"), text("summary", "description").alias("body"), when.alias("published_at"), link.alias("url"))

    return entries(r).unionByName(entries(a))


def news_articles(entries: DataFrame, landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, counts): feed entries with the text of the page that their link resolved to.

    ``landed``: link, resolved_url, page_text. An entry without a resolved address or without text is filtered, and
    counted, not failed.
    """
    met = entries.join(landed.select(F.col("link").alias("url"), "resolved_url", "page_text").dropDuplicates(["url"]), "url", "left")
    usable = F.coalesce((F.col("resolved_url") != "") & (F.col("page_text") != ""), F.lit(False))
    counts = met.groupBy(F.lit("news").alias("source_name")).agg(F.count_if(usable).alias("articles"), F.count_if(~usable).alias("filtered"))
    articles = met.where(usable).select(F.lit("news").alias("source_name"), "external_id", "title", F.col("page_text").alias("body"), "published_at", F.col("resolved_url").alias("url"))
    return articles, counts


ITEM = ("source_name", "external_id", "author", "title", "body", "published_at", "url", "rating", "app_version", "engagement")


def unify_items(parts: list[DataFrame]) -> DataFrame:
    """Items of all kinds in one schema; a field that a kind lacks stays null, and the outlet stands in for a missing author."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    out = out.withColumns({c: F.lit(None).cast("string") for c in ITEM if c not in out.columns})
    author = F.when(F.col("source_name").isin("rss", "news"), outlet(F.col("url"))).otherwise(F.col("author"))
    return out.withColumn("author", author).select(*ITEM)


def document_rows(items: DataFrame) -> DataFrame:
    """Items as document rows: the title where there is no body, hashed author, hash of body and rating."""
    body = F.coalesce(F.nullif("body", F.lit("")), F.nullif("title", F.lit("")))
    return items.withColumn("body", body).withColumn("author_hash", author_hash(F.col("author"))).withColumn("content_hash", content_hash(F.col("body"), F.col("rating"))).drop("author", "title")


def payload_validation(payloads: DataFrame, path: str, floor: int, required: tuple[str, ...] = ()) -> DataFrame:
    """The first check that a payload of (payload_id, content_type, body) fails: type, JSON, path to the items, required
    fields of every item, floor of items. A path to one value that is no list is one item."""
    doc = F.try_parse_json("body")
    found = F.try_variant_get(doc, path, "variant")
    items = F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.when(found.isNotNull(), F.array(found)))

    def incomplete(item: Column) -> Column:
        return reduce(Column.__or__, [F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit("")) == "" for name in required], F.lit(False))

    lacks = F.exists(items, incomplete)
    failed = (
        F.when(~F.col("content_type").isin("application/json", "text/json"), "content_type").when(doc.isNull(), "malformed")
        .when(items.isNull(), "path_missing").when(lacks, "field_missing").when(F.size(items) < floor, "below_floor")
    )
    return payloads.select("payload_id", failed.alias("failed_check"))


def cursor_increment(items: DataFrame, cursors: DataFrame) -> DataFrame:
    """Items newer than their source's cursor; a source without one gives all."""
    return items.join(cursors, "source_name", "left").where(F.col("cursor_at").isNull() | (F.col("published_at") > F.col("cursor_at"))).drop("cursor_at")


def items_until_cursor(items: DataFrame, cursors: DataFrame) -> DataFrame:
    """Items that a fetch from the newest down takes before it stops.

    It stops at the item whose external_id the cursor names (``last_external_id``) and at the first that is not newer than
    ``last_published_at``; either may be null, so a cursor may be an id only, and an id that is not among the items stops
    nothing. Items of one instant go in order of external_id. One row for each source is joined, no window is needed.
    """
    named = F.col("external_id") == F.col("last_external_id")
    at = items.join(cursors, "source_name").where(named).groupBy("source_name").agg(F.max("published_at").alias("stop_at"), F.first("external_id").alias("stop_id"))
    met = items.join(cursors.join(at, "source_name", "left"), "source_name", "left")
    newer = F.col("last_published_at").isNull() | (F.col("published_at") > F.col("last_published_at"))
    before = F.col("stop_at").isNull() | (F.col("published_at") > F.col("stop_at")) | ((F.col("published_at") == F.col("stop_at")) & (F.col("external_id") < F.col("stop_id")))
    return met.where(newer & before).select(items.columns)


def quota_topk(items: DataFrame, key: list[str], quota: int, adapter: str | None = None) -> DataFrame:
    """The items of each key up to a shared allowance, and whether it was reached. Rank limits apply before the shuffle.

    Adapters, where there are several, use the allowance up in their order; within one the newest items come first.
    """
    order = Window.partitionBy(*key).orderBy(*([adapter] if adapter else []), F.desc("published_at"), "external_id")
    kept = items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota)
    return kept.withColumn("allowance_reached", F.count("*").over(Window.partitionBy(*key)) >= quota)


def cursor_advance(outcomes: DataFrame, old: DataFrame) -> DataFrame:
    """The newest item of each source; held back when any of its fetches failed, and nulls never overwrite."""
    by = outcomes.groupBy("source_name").agg(F.max_by(F.struct("external_id", "published_at"), F.struct("published_at", "external_id")).alias("x"), F.max("failed").alias("any_failed"))
    new = lambda c: F.when(~F.col("any_failed"), F.col(f"x.{c}"))
    return old.join(by, "source_name", "left").select("source_name", F.coalesce(new("external_id"), "last_external_id").alias("last_external_id"), F.coalesce(new("published_at"), "last_published_at").alias("last_published_at"))


def natural_key_dedup(batch: DataFrame, existing: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Rows to insert: one for each key, none that the table holds."""
    w = Window.partitionBy(*key).orderBy(order)
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(existing.select(*key), key, "left_anti")


def fetch_ledger(sources: DataFrame, attempted: DataFrame, written: DataFrame, errors: DataFrame | None = None, run: str | None = None) -> DataFrame:
    """One row for each enabled source (and run, where ``run`` names its column), with or without items: attempted,
    kept, duplicates, outcome. Where a fetch failed (``errors``: the keys, error) nothing counts as kept."""
    key = ["source_name", *([run] if run else [])]
    a = attempted.groupBy(*key).agg(F.count("*").alias("attempted"))
    k = written.groupBy(*key).agg(F.count("*").alias("kept"))
    met = sources.join(a, key, "left").join(k, key, "left").na.fill(0, ["attempted", "kept"])
    if errors is not None:
        met = met.join(errors.groupBy(*key).agg(F.min("error").alias("error")), key, "left")
        failed = F.col("error").isNotNull()
        met = met.withColumn("kept", F.when(failed, 0).otherwise(F.col("kept"))).withColumn("duplicates", F.when(failed, 0).otherwise(F.col("attempted") - F.col("kept")))
        outcome = F.when(failed, "failed").when(F.col("attempted") == 0, "empty").when(F.col("kept") == 0, "duplicates_only").otherwise("collected")
        return met.select(*key, "attempted", F.col("kept").cast("long").alias("kept"), F.col("duplicates").cast("long").alias("duplicates"), outcome.alias("outcome_kind"), "error")
    return met.select(*key, "attempted", "kept", (F.col("attempted") - F.col("kept")).alias("duplicates"), F.when(F.col("attempted") == 0, "empty").when(F.col("kept") == 0, "duplicates_only").otherwise("collected").alias("outcome_kind"))


def candidate_antijoin(found: DataFrame, rejected: DataFrame, existing: DataFrame) -> DataFrame:
    """New candidates only: neither rejected before nor known."""
    key = ["source_name", "entity_ref"]
    return found.dropDuplicates(key).join(rejected, key, "left_anti").join(existing, key, "left_anti")


def discovery(found: DataFrame, queries: DataFrame, rejected: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates to insert, outcome of each monitor) of what searches found: (monitor_id, source_name, entity_ref, query, display_name).

    Only accepted queries (monitor_id, query, accepted) count. A result that was rejected before is counted and not proposed;
    one that is known stays as it was reviewed. The outcome tells how many results were proposed and how many
    rejected ones were met, and why nothing was: no accepted query, or every search came back empty.
    """
    key = ["monitor_id", "source_name", "entity_ref"]
    asked = queries.where("accepted").select("monitor_id", "query").distinct()
    results = found.join(asked, ["monitor_id", "query"], "left_semi").join(rejected.select(*key).distinct().withColumn("known_bad", F.lit(True)), key, "left")
    fresh = results.where("known_bad is null").drop("known_bad")
    first = fresh.groupBy(*key).agg(F.min(F.struct("query", "display_name")).alias("x"))
    new = first.join(existing, key, "left_anti").select(*key, F.col("x.display_name").alias("display_name"), F.col("x.query").alias("proposed_by_query"), F.concat(F.lit("matched query "), F.col("x.query")).alias("reason"))
    by = results.groupBy("monitor_id").agg(F.count_if(F.col("known_bad").isNull()).alias("proposed"), F.count_if("known_bad").alias("rejected_known"))
    met = queries.groupBy("monitor_id").agg(F.count_if("accepted").alias("queries")).join(by, "monitor_id", "left").na.fill(0, ["proposed", "rejected_known"])
    reason = F.when(F.col("queries") == 0, "no_queries").when(F.col("proposed") == 0, "every_surface_empty")
    return new, met.select("monitor_id", "proposed", "rejected_known", reason.alias("reason"))


def run_history(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each monitor's runs, newest first, with how many sources took part and what they kept."""
    by = ledger.groupBy("monitor_id", "bucket").agg(F.count("*").alias("sources"), F.sum("kept").alias("kept"))
    met = runs.join(by, ["monitor_id", "bucket"], "left").na.fill(0, ["sources", "kept"])
    return met.select("monitor_id", "bucket", "status", "sources", "kept").orderBy("monitor_id", F.desc("bucket"))


def run_ledger(ledger: DataFrame, monitor: str, day: str) -> DataFrame:
    """The ledger's rows of one run, by source."""
    return ledger.where((F.col("monitor_id") == monitor) & (F.col("bucket") == F.lit(day).cast("date"))).orderBy("source_name")
