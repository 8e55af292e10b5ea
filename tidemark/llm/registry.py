"""The queries of the training-data operators, at production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fingerprint, lexical_search, line_dedup, lm_scoring, merkle, metric_search, mixing, multi_index, ngram_join, pii, quality, sentencepiece, toxicity
from tidemark.llm.common import documents

_WORD = r"[^\x20\x09-\x0D]+"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_lm_scoring(spark, d):
    return lm_scoring.score_documents(spark, documents(spark, d))


def op2_ngram_join(spark, d):
    return ngram_join.link_documents(spark, documents(spark, d), 3, 90, 100)


def op3_toxicity(spark, d):
    return toxicity.score_toxicity(spark, documents(spark, d), _labels(spark, d))


def op4_fingerprints(spark, d):
    return fingerprint.fingerprint_documents(spark, documents(spark, d))


def op5_quality(spark, d):
    return quality.score_quality(spark, documents(spark, d), _labels(spark, d))


def op6_top_k(spark, d):
    return metric_search.top_k(spark, spark.read.parquet(f"{d}/embeddings.parquet"), 50, 5)


def op7_sentencepiece(spark, d):
    return sentencepiece.encode_documents(spark, documents(spark, d))


def op8_personal_data(spark, d):
    return pii.find_personal_data(spark, documents(spark, d))


def op9_mixing(spark, d):
    return mixing.mix_documents(documents(spark, d))


def op10_line_dedup(spark, d):
    return line_dedup.dedup_lines(documents(spark, d)).select("doc_id", "text", F.col("n_lines"), F.col("n_removed"))


def op11_near_dedup(spark, d):
    return multi_index.near_duplicates(spark, spark.read.parquet(f"{d}/embeddings.parquet"))


def op12_lexical_search(spark, d):
    return lexical_search.search(spark, documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"), 10)


def op13_merkle_manifest(spark, d):
    return merkle.manifest(documents(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_lm_scoring, op2_ngram_join, op3_toxicity, op4_fingerprints, op5_quality, op6_top_k, op7_sentencepiece, op8_personal_data, op9_mixing, op10_line_dedup, op11_near_dedup, op12_lexical_search, op13_merkle_manifest]
    return {f.__name__: f for f in own}


_OP2 = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS t FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(t[i:i + 2], ' ') AS g
    FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 1, 2))) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
rep AS (SELECT min(doc_id) AS doc_id, k, any_value(n) AS n, count(*) AS copies FROM n GROUP BY k),
rs AS (SELECT s.* FROM s JOIN rep USING (doc_id)),
e AS (
    SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM rs p JOIN rs q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2) x
    JOIN rep m ON m.doc_id = x.a JOIN rep o ON o.doc_id = x.b WHERE 100 * x.c >= 90 * (m.n + o.n - x.c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM rep UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root.component_id, d.doc_id) AS component_id, coalesce(rep.copies, 1) AS n_copies
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN rep ON rep.k = n.k LEFT JOIN root ON root.a = rep.doc_id
"""

_OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_OP10 = rf"""
WITH l AS (
    SELECT doc_id, coalesce(source, chr(0)) AS site, p.pos, p.line FROM (
        SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'pos': i, 'line': x}})) AS p FROM documents)),
c AS (
    SELECT line, min(doc_id) AS first_doc FROM l WHERE len(regexp_extract_all(line, '{_WORD}')) >= {line_dedup.MIN_WORDS}
    GROUP BY line HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}),
k AS (SELECT l.doc_id, l.pos, l.line, c.line IS NOT NULL AND l.doc_id <> c.first_doc AS cut FROM l LEFT JOIN c ON c.line = l.line)
SELECT d.doc_id, coalesce(t.text, CASE WHEN d.text IS NULL THEN NULL ELSE '' END) AS text, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut) AS text, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed FROM k GROUP BY doc_id) t
ON t.doc_id = d.doc_id
"""


_OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(root.component_id, vec_id) AS component_id, coalesce(root.component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN root ON root.a = vec_id
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"unnest(regexp_extract_all(translate(text, {_LOWER}), '{lexical_search.TERM}')) AS t"
_OP12 = f"""
WITH term AS (SELECT doc_id, {_TERMS} FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY doc_id, t),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // total) AS m FROM n, c),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, c),
q AS (SELECT item_id, {_TERMS} FROM benchmark),
qt AS (SELECT item_id, t, count(*) AS times FROM q GROUP BY item_id, t),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM qt JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def _leaf(text: str = "text") -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, of: str) -> str:
    return f"""
{name}(g, l, i, n, h) AS (
    {of}
    UNION ALL
    SELECT g, l + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, l, i // 16, n),
{name}_beside AS (
    SELECT a.g, a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l_side, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r_side
    FROM {name} a JOIN {name} b ON a.g = b.g AND a.l = b.l AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.g, a.l, a.i)"""


_OP13 = f"""
WITH RECURSIVE bits(b, n, c) AS (
    SELECT b, 0, b FROM range(256) r(b) UNION ALL SELECT b, n + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE n < 8),
crc(id, s, c) AS (
    SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 4294967295::BIGINT FROM documents
    UNION ALL SELECT id, s[2:], xor(bits.c, crc.c // 256) FROM crc JOIN bits ON n = 8 AND b = xor(crc.c % 256, ascii(s)) WHERE s <> ''),
d AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, {_leaf()} AS leaf,
        CASE WHEN xor(c, 4294967295) % 5 = 0 THEN {_leaf(f"translate(text, {_LOWER})")} ELSE {_leaf()} END AS shown
    FROM documents JOIN crc ON s = '' AND id = doc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),{_tree("src", "SELECT g, 0::BIGINT, i, n, leaf FROM p")},
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM src WHERE n = 1),{_tree("top", "SELECT '', 0::BIGINT, i, n, h FROM sub")},
walk(doc_id, g, stage, l, i, h, sibs) AS (
    SELECT doc_id, g, 0, 0::BIGINT, i, shown, '' FROM p
    UNION ALL
    SELECT doc_id, w.g, CASE WHEN b.g IS NULL THEN 1 ELSE stage END, CASE WHEN b.g IS NULL THEN 0 ELSE w.l + 1 END, CASE WHEN b.g IS NULL THEN sub.i ELSE w.i // 16 END,
        CASE WHEN b.g IS NULL THEN w.h ELSE sha256(l_side || w.h || r_side) END, CASE WHEN b.g IS NULL THEN sibs ELSE sibs || l_side || r_side END
    FROM walk w LEFT JOIN (SELECT 0 AS s, * FROM src_beside UNION ALL SELECT 1, * FROM top_beside) b ON b.s = w.stage AND b.l = w.l AND b.i = w.i AND b.g = CASE WHEN w.stage = 0 THEN w.g ELSE '' END
    JOIN sub ON sub.g = w.g WHERE w.stage = 0 OR b.g IS NOT NULL),
ends AS (SELECT doc_id, h, sibs FROM walk WHERE stage = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC) = 1)
SELECT p.doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(sibs) AS proof_sha256, ends.h AS folded_root, ends.h = top.h AS verified
FROM p JOIN sub ON sub.g = p.g JOIN top ON top.n = 1 JOIN ends ON ends.doc_id = p.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": _OP2, "op6_top_k": _OP6, "op10_line_dedup": _OP10, "op11_near_dedup": _OP11, "op12_lexical_search": _OP12, "op13_merkle_manifest": _OP13}
