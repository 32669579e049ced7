"""The registered queries of this subpackage: thin layers over the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_quality, op2_decontaminate, op3_neardup, op4_packing, op5_lm, op6_pii, op7_urls, op8_warc, op9_neighbours, op10_extract
from .common import table


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = op1_quality.train(docs, table(spark, sf_dir, "labels"))
    return op1_quality.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op2_decontaminate.digest(op2_decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)


def op5_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the benchmark's texts, the background all documents."""
    return op5_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pii.digest(op6_pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = op8_warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return op9_neighbours.search(base, base.where(F.col("vec_id") % 50 == 0))


def op10_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6 what SQL can say: the base kinds."""
    return op6_pii_spans(spark, sf_dir).drop("spans")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7 what SQL can say: all but the method's verdict."""
    return op7_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_fm,
        op2_decontamination,
        op3_minhash_forest,
        op4_best_fit_packing,
        op5_lm_cross_entropy,
        op6_pii_spans,
        op7_url_filter,
        op8_warc_zip,
        op9_block_neighbours,
        op10_template_extract,
        pipeline,
        pii_base_spans,
        url_rules,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
#: kind, pattern, and what a match must be.
_PII = (
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "TRUE"),
    ("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE coalesce(nullif(ltrim(x, '0'), '')::INT, 0) END)) <= 255"),
    (
        "card",
        "[0-9]([ -]?[0-9])+",
        f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0",
    ),
    ("phone", "\\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
)


def _pii_sql() -> str:
    parts = []
    for k, (kind, pattern, valid) in enumerate(_PII):
        parts.append(f"""SELECT doc_id, {k} k, '{kind}' kind, s, s + length(m) e FROM (
SELECT doc_id, ms[i] m, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT s
FROM (SELECT doc_id, ms, string_split_regex(text, '{pattern}') gaps, unnest(range(1, len(ms) + 1)) i FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') ms FROM documents WHERE text IS NOT NULL))) WHERE {valid}""")
    counts = ", ".join(f"count(*) FILTER (k = {k}) n_{kind}" for k, (kind, *_) in enumerate(_PII))
    return f"""WITH p AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) l FROM p GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT n_{kind}" for kind, *_ in _PII)}, sha256(coalesce(l, '')) base_sha256 FROM documents LEFT JOIN g USING (doc_id)"""


ORACLE: dict[str, str] = {
    "pii_base_spans": _pii_sql(),
    "url_rules": """
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages)
SELECT page_id, host, path,
CASE WHEN r = 1 THEN 'example.net/en/' WHEN r = 2 THEN 'example.com/de/' WHEN r = 3 THEN 'org/fr/' WHEN r = 4 THEN 'net/' END AS rule,
CASE WHEN r IN (1, 3) THEN 'allow' WHEN r IN (2, 4) THEN 'block' END AS ruled
FROM (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 1 WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 2
WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 3 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 4 END r FROM u)""",
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
i AS (SELECT item_id, {_WORDS} w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') g
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) s FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) s, unnest(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x:x + n - 1], ' '))) g
      FROM d JOIN k ON len(w) >= n),
m AS (SELECT DISTINCT doc_id, s, n, item_id FROM p JOIN g USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT pos) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) pos FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) items FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op3_minhash_forest": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
e AS (SELECT a.doc_id a, b.doc_id b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
      HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT n_shingles, c.component_id, d.doc_id = c.component_id kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) component_id FROM r GROUP BY 1) c USING (doc_id)""",
    "op8_warc_zip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT payload_bytes, sha256(coalesce(html, '')) payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) first FROM p GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END refers_to
FROM p JOIN f USING (payload_digest)""",
    "op9_block_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(x, lambda a: a * a)), lambda a, b: a + b)) m FROM v WHERE x IS NOT NULL),
s AS (SELECT q.vec_id query_id, b.vec_id,
             list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.x, b.x), lambda t: t[1] * t[2])), lambda a, b: a + b) / (q.m * b.m) score
      FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0 AND q.m > 0 AND b.m > 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5""",
}
