"""One query per operator, over whole tables, with the parameters used in production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, importance, jaccard, licences, mixing, ranking, rules, secrets, substrings, tokens, urls, variants
from .common import table

SQL: dict[str, str] = {}


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_features", "log_weight", "kept")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "n_matches", F.array_join("items", ",").alias("items"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan_licences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.RULES, keep=["page_id"])


_RULES = ", ".join(f"('{v}', '{h}', '{p}', {len(h.split('.'))})" for v, h, p in urls.RULES)
SQL["op5_url_filter"] = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, host, path, labels) AS (VALUES {_RULES}),
m AS (SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY s.page_id ORDER BY r.labels DESC NULLS LAST, length(r.path) DESC) AS k
      FROM s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op6_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, list_aggregate(w[i:i + 34], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT a.doc_id, string_agg(a.x, ' ' ORDER BY a.p) AS t, count(*) AS n
         FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p WHERE g.p IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


SQL["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i + 3], 'string_agg', ' '))
                                   WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT x AS root, x AS node FROM e UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       CAST(coalesce((SELECT min(r.node) FROM r WHERE r.root = d.doc_id), d.doc_id) AS BIGINT) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nearly even weights and one and a half times the tokens of the table: small sources are repeated, large ones are not
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), entropy_share=0.9999, budget_ratio=1.5)
    return out.select("doc_id", "source", "n_tokens", "weight", "passes", "slot")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"),
                      secrets.digest(F.col("spans")).alias("spans"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL["op11_ranked_search"] = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
             '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
             '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM benchmark),
s AS (SELECT count(*) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) GROUP BY 1, 2, 3),
v AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_all) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
c AS (SELECT p.doc_id, p.t, v.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_all) // l_all)))) AS x
      FROM p JOIN v USING (t), s),
z AS (SELECT item_id, doc_id, CAST(sum(x) AS BIGINT) AS score FROM i JOIN c USING (t) GROUP BY 1, 2 HAVING sum(x) > 0),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM z)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


SQL["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
               '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT lang, source, r, t, count(*) AS c FROM (SELECT lang, source, r, unnest(w) AS t FROM d) GROUP BY ALL),
k AS (SELECT lang, t FROM o GROUP BY lang, t HAVING count(*) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, t, sum(c) AS c FROM o JOIN k USING (lang, t) GROUP BY ALL),
ng AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.t, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(ng.n, 0) + v.v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN ng USING (lang, source) LEFT JOIN c USING (lang, source, t)),
q AS (SELECT lang, t, 1 + (1000000000 * (sum(c) + 1)) // (sum(sum(c)) OVER (PARTITION BY lang) + any_value(v)) AS q
      FROM c JOIN v USING (lang) GROUP BY lang, t),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
       FROM f a JOIN f b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
      UNION ALL
      SELECT f.lang, f.source, 'term', f.t, CAST((p - q) * (p - q) // q AS BIGINT) FROM f JOIN q USING (lang, t) WHERE c > 0 AND p > q),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= 200
"""


def op13_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = variants.near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", variants.hex_print(F.col("fp")).alias("fingerprint"), "component_id")
