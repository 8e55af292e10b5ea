"""Language by trigrams, sentiment by order, main text of pages: against plain versions and hand-computed cases."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions import language_model, main_text, sentiment
from tidemark.functions import text as tx

SF = "/root/testdata/sf0.01"
WORDS = {"en": "the river runs by an old mill and they watch the boats".split(), "de": "der fluss fließt an einer alten mühle und sie sehen die boote".split(), "es": "el río corre por un viejo molino y ellos miran los barcos".split()}


def grams(text):
    t = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    return [t[i : i + 3] for i in range(len(t) - 2)]


def sentences(n):
    return [(f"{g}{i}", " ".join(ws[(i * k) % len(ws)] for k in range(1, 8)), g) for g, ws in WORDS.items() for i in range(1, n)]


def test_trigram_model_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(language_model, "AT_ONCE", 50)
    rows = sentences(12)
    docs = spark.createDataFrame([*rows, ("n", None, "en"), ("x", "no label", None)], "doc_id string, text string, lang string")
    counts = language_model.trigram_counts(docs, "lang")
    want = Counter((g, x) for _, t, g in rows for x in grams(t))
    assert {(r["lang"], r["gram"]): r["n"] for r in counts.select("lang", language_model.gram_of(F.col("code")).alias("gram"), "n").collect()} == want
    model = language_model.fit(counts, "lang", 40)
    total = Counter()
    for (_, x), n in want.items():
        total[x] += n
    kept = sorted(total, key=lambda x: (-total[x], x))[:40]
    size = Counter()
    for (g, _), n in want.items():
        size[g] += n
    logs = {g: {x: math.log((want[g, x] + 0.5) / (size[g] + 0.5 * 41)) for x in kept} for g in WORDS}
    rest = {g: math.log(0.5 / (size[g] + 0.5 * 41)) for g in WORDS}
    asked = [("a", "Die alten Boote"), ("b", "los viejos barcos!"), ("c", None), ("d", "12 34 -"), ("e", "the old mill " * 60), ("a", "watch"), ("f", "")]
    got = sorted((r["doc_id"], r["language"], r["confidence"]) for r in language_model.predict(spark.createDataFrame(asked, "doc_id string, text string"), model).where("language is not null").collect())

    def plain(text):
        s = {g: sum(logs[g].get(x, rest[g]) for x in grams(text)) for g in WORDS}
        best = max(sorted(s), key=lambda g: s[g])
        return best, round(1 / sum(math.exp(v - s[best]) for v in s.values()), 6)

    assert got == sorted((k, *plain(t)) for k, t in asked if t and any(c.isalpha() for c in t))
    assert language_model.predict(spark.createDataFrame(asked, "doc_id string, text string"), model).count() == len(asked)
    none = language_model.fit(language_model.trigram_counts(docs.limit(0), "lang"), "lang")
    assert language_model.predict(spark.createDataFrame(asked, "doc_id string, text string"), none).where("language is not null").isEmpty()


def test_held_out_accuracy_is_above_the_stop_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_model.fit(language_model.trigram_counts(docs.where("doc_id % 5 <> 0"), "lang"), "lang")
    held = docs.where("doc_id % 5 = 0").select("doc_id", "lang", "text")
    share = lambda told: {r["lang"]: r["s"] for r in held.join(told, "doc_id").groupBy("lang").agg(F.avg((F.coalesce("language", F.lit("")) == F.col("lang")).cast("int")).alias("s")).collect()}
    ours, words = share(language_model.predict(held, model)), share(tx.language(held))
    assert sum(ours.values()) / len(ours) > sum(words.values()) / len(words) and all(ours[g] >= words[g] - 0.02 for g in ours)
    assert sum(ours.values()) / len(ours) > 0.9


LEX = {"good": 2.0, "bad": -2.0, "great": 3.0}


@pytest.mark.parametrize(
    "text,total",
    [
        ("good", 2.0), ("very good", 2.293), ("slightly good", 1.707), ("very bad", -2.293), ("very very good", 2 + 0.293 + 0.293 * 0.95), ("not good", -1.48), ("not very good", (2 + 0.293) * -0.74),
        ("not at all that good", 2.0), ("it is GOOD", 2.733), ("IT IS GOOD", 2.0), ("it is NOT bad", 2 * 0.74), ("good but bad", 2 * 0.5 - 2 * 1.5), ("good!", 2.292), ("good!!!!!!", 2 + 4 * 0.292), ("bad!", -2.292),
        ("good??", 2.36), ("good ?????", 2.96), ("very, very! good", 2 + 0.293 + 0.293 * 0.95 + 0.292), ("nothing here", 0.0), ("!!", 0.0), ("", 0.0), ("don't say bad", 1.48), ("great very good", 3 + 2.293),
    ],
)
def test_sentiment_by_hand(spark, text, total):
    r = sentiment.sentiment(spark.createDataFrame([(1, text)], "doc_id int, text string"), lexicon=LEX).first()
    assert r["sentiment_score"] == pytest.approx(total / math.sqrt(total * total + 15), abs=2e-6)
    assert r["sentiment_label"] == ("positive" if r["sentiment_score"] >= 0.05 else "negative" if r["sentiment_score"] <= -0.05 else "neutral")


def test_sentiment_rows_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(sentiment, "AT_ONCE", 3)
    rows = [(1, "very"), (1, "good"), (2, None), (3, "not"), (4, "bad"), (5, "but"), (6, "good good good good good")]
    lex = sentiment.lexicon_of(spark.createDataFrame(list(LEX.items()), "word string, valence double"))
    got = sorted((r[0], r[2]) for r in sentiment.sentiment(spark.createDataFrame(rows, "doc_id int, text string"), lexicon=lex).collect())
    assert got == [(1, "neutral"), (1, "positive"), (2, "neutral"), (3, "neutral"), (4, "negative"), (5, "neutral"), (6, "positive")]
    assert "the" not in tx.VALENCE and "of" not in tx.VALENCE and "and" not in tx.VALENCE
    monkeypatch.setattr(sentiment, "WORDS", 2)
    with pytest.raises(ValueError):
        sentiment.lexicon_of(spark.createDataFrame(list(LEX.items()), "word string, valence double"))


def main_text_plainly(html):
    bare = re.sub(rf"<({main_text.NEVER})\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "\x1d", html, flags=re.I | re.S)
    bare = re.sub(r"<a\b[^>]*>", "\x1e", bare, flags=re.I)
    bare = re.sub(r"</a\s*>", "\x1f", bare, flags=re.I)
    bare = re.sub(rf"</?({main_text.BOUNDS})\b[^>]*>", "\x1d", bare, flags=re.I)
    bare = re.sub(r"<[^>]*>", "", bare)
    for name, sign in main_text.ENTITIES:
        bare = bare.replace(name, sign)
    clean = lambda t: " ".join(t.replace("\x1e", "").replace("\x1f", "").split())
    found = [(clean(b), len(clean("".join(re.findall("\x1e([^\x1f]*)", b))))) for b in bare.split("\x1d")]
    found = [(t, len(t.split(" ")), n / len(t)) for t, n in found if t]
    out = []
    for i, (t, words, density) in enumerate(found):
        _, before, of = found[i - 1] if i else ("", 0, 0.0)
        after = found[i + 1][1] if i + 1 < len(found) else 0
        if density <= 0.333333 and ((words > 16 or after > 15 or before > 4) if of <= 0.555556 else (words > 40 or after > 17)):
            out.append(t)
    return "\n".join(out) or None


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html", main_text.main_text(F.col("html")).alias("t")).collect()
    assert all(r["t"] == main_text_plainly(r["html"]) for r in pages)
    shown = [r for r in pages if r["t"]]
    assert len(shown) > len(pages) / 2
    for r in shown:
        nav = re.search(r"(?is)<nav\b.*?</nav>", r["html"])
        links = re.findall(r">([^<>]+)</a>", nav[0]) if nav else []
        assert not links or " ".join(links) not in r["t"].split("\n")
    odd = [(1, None), (2, ""), (3, "<nav><a href='/'>Home</a></nav><footer>Imprint, terms</footer>"), (4, "<p>" + "word " * 30 + "<a href=x>more</a></p><ul>" + "<li><a href=x>link text here</a></li>" * 20 + "</ul>"), (5, "<!-- x --><script>var a = '<p>';</script>")]
    got = dict(map(tuple, spark.createDataFrame(odd, "page_id int, html string").select("page_id", main_text.main_text(F.col("html"))).collect()))
    assert got == {1: None, 2: None, 3: None, 4: " ".join(["word"] * 30) + " more", 5: None}
