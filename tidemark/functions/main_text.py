"""Main text of a web page: its blocks, told apart by how many words they have and how many of those are links.

A page is cut at block elements. A block's link density is the share of its characters that lie inside links. Whether a
block is text follows a published decision tree over the words and link densities of the block and its two neighbours: long
blocks without links are text, short ones only beside such. Scripts, styles, forms and elements that say themselves that they
are navigation, footers or asides go first. What is left, in order, one block a line; null where nothing is.
Everything is column expressions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are never text, elements that bound blocks, the tree's thresholds, entities.
NEVER = "script|style|noscript|template|head|nav|footer|aside|form|button|select|iframe|svg"
BOUNDS = "address|article|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|h[1-6]|header|hr|html|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
DENSE, DENSE_BEFORE, SHORT, SHORT_AFTER, SHORT_BEFORE, LONG, LONG_AFTER = 0.333333, 0.555556, 16, 15, 4, 40, 17
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Marks of a block's end, a link's start and its end, which text never holds.
_END, _OPEN, _SHUT = "\x1d", "\x1e", "\x1f"


def blocks(html: Column) -> Column:
    """The page's blocks in order, as structs of text, words and density (links' share of the characters)."""
    bare = F.translate(html, _END + _OPEN + _SHUT, "   ")
    bare = F.regexp_replace(bare, rf"(?is)<({NEVER})\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", _END)
    bare = F.regexp_replace(bare, r"(?is)<a\b[^>]*>", _OPEN)
    bare = F.regexp_replace(bare, r"(?is)</a\s*>", _SHUT)
    bare = F.regexp_replace(bare, rf"(?is)</?({BOUNDS})\b[^>]*>", _END)
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", "")
    for name, sign in ENTITIES:
        bare = F.replace(bare, F.lit(name), F.lit(sign))

    def told(raw: Column) -> Column:
        linked = F.array_join(F.regexp_extract_all(raw, F.lit(f"{_OPEN}([^{_SHUT}]*)"), F.lit(1)), "")
        clean = lambda c: F.trim(F.regexp_replace(F.translate(c, _OPEN + _SHUT, ""), r"(?U)\s+", " "))
        text = clean(raw)
        size = F.length(text)
        return F.struct(text.alias("text"), F.when(size > 0, F.size(F.split(text, " "))).otherwise(0).alias("words"), F.when(size > 0, F.length(clean(linked)) / size).otherwise(0.0).alias("density"))

    return F.filter(F.transform(F.split(bare, _END), told), lambda b: b["words"] > 0)


def is_text(before: Column, block: Column, after: Column) -> Column:
    words, of, next_words = F.coalesce(before["words"], F.lit(0)), F.coalesce(before["density"], F.lit(0.0)), F.coalesce(after["words"], F.lit(0))
    beside = F.when(block["words"] <= SHORT, (next_words > SHORT_AFTER) | (words > SHORT_BEFORE)).otherwise(True)
    alone = F.when(block["words"] <= LONG, next_words > LONG_AFTER).otherwise(True)
    return (block["density"] <= DENSE) & F.when(of <= DENSE_BEFORE, beside).otherwise(alone)


def main_text(html: Column) -> Column:
    found = blocks(html)
    none = F.array(F.lit(None).cast("struct<text:string,words:int,density:double>"))
    before = F.concat(none, F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))))
    after = F.concat(F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(0))), none)
    pairs = F.zip_with(F.slice(before, F.lit(1), F.greatest(F.size(found), F.lit(0))), found, lambda p, b: F.struct(p.alias("p"), b.alias("b")))
    told = F.zip_with(pairs, F.slice(after, F.lit(1), F.greatest(F.size(found), F.lit(0))), lambda x, n: F.struct(x["b"]["text"].alias("text"), is_text(x["p"], x["b"], n).alias("kept")))
    return F.nullif(F.array_join(F.transform(F.filter(told, lambda b: b["kept"]), lambda b: b["text"]), "\n"), F.lit(""))
