"""Queries over clusters, tags, report sections and text assembly."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import batches, clusters, sections, tagging
from ..operators.filters import at
from .registry import joined, query
from .scalars import SIMHASH_CTE
from .views import (COMPETITOR_TERMS, COMPETITORS, DEVELOPER_TERMS, DEVELOPERS, ITEMS, REGION_TERMS, REGIONS, SOURCES, TAG_TEXT,
                    competitors, developers, items, mentions_sql, names_sql, regions, sources)

# --- clusters ----------------------------------------------------------------------------------------

PAIRS_SQL = f"""{SIMHASH_CTE},
distinct_hashes AS (SELECT DISTINCT simhash64 AS h FROM simhashes WHERE simhash64 IS NOT NULL),
pairs AS (SELECT a.h AS hash_a, b.h AS hash_b, bit_count(xor(a.h, b.h)) AS distance FROM distinct_hashes a JOIN distinct_hashes b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 3)"""
MEMBERS_SQL = f"""{PAIRS_SQL}, {ITEMS},
edges AS (SELECT hash_a AS a, hash_b AS b FROM pairs UNION ALL SELECT hash_b, hash_a FROM pairs),
reach AS (SELECT h AS node, h AS root FROM distinct_hashes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
comps AS (SELECT node, min(root) AS component FROM reach GROUP BY 1),
placed AS (SELECT i.*, c.component, first_value(item_id) OVER (PARTITION BY component ORDER BY published_at, item_id) AS primary_id, count(*) OVER (PARTITION BY component) AS size
  FROM items i JOIN simhashes s ON s.doc_id = i.item_id JOIN comps c ON c.node = s.simhash64),
members AS (SELECT * FROM placed WHERE size > 1)"""


def hashed(t):
    return clusters.with_simhash(items(t))


@query("near_dup_pairs", f"WITH {PAIRS_SQL} SELECT hash_a, hash_b, distance FROM pairs")
def _(t):
    return clusters.near_dup_pairs(hashed(t))


@query("copy_links", f"""
WITH {SIMHASH_CTE} SELECT simhash64, min_id AS first_id, doc_id AS copy_id FROM (
  SELECT *, min(doc_id) OVER (PARTITION BY simhash64) AS min_id FROM simhashes WHERE simhash64 IS NOT NULL) WHERE doc_id <> min_id""")
def _(t):
    return clusters.copy_links(hashed(t))


@query("connected_components", f"WITH RECURSIVE {MEMBERS_SQL} SELECT node, component FROM comps WHERE node IN (SELECT a FROM edges)")
def _(t):
    return clusters.connected_components(clusters.near_dup_pairs(hashed(t)), "hash_a", "hash_b")


@query("build_clusters", f"""
WITH RECURSIVE {MEMBERS_SQL} SELECT primary_id, string_agg(item_id, '|' ORDER BY published_at, item_id) AS related, count(*) AS n FROM members WHERE item_id <> primary_id GROUP BY 1""")
def _(t):
    c = clusters.build_clusters(hashed(t), since=at(dt.datetime(2023, 12, 1)))
    # parts of one cluster continue each other
    parts = c.select("primary_id", "part_no", joined(F.col("related_item_ids")).alias("ids"), F.size("related_item_ids").alias("n"))
    return parts.groupBy("primary_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("part_no", "ids")))["ids"], "|").alias("related"), F.sum("n").alias("n"))


@query("cluster_members", f"WITH RECURSIVE {MEMBERS_SQL} SELECT primary_id, item_id, size FROM members")
def _(t):
    return clusters.cluster_members(hashed(t)).select("primary_id", "item_id", "size")


def small_parts(t):
    """The cluster table in parts of five related items, so that most large clusters have several."""
    return clusters.build_clusters(hashed(t), part_size=5).withColumn(
        "created_at", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("primary_id") * 7919, F.lit(100000))))


CLUSTER_TABLE = f"""RECURSIVE {MEMBERS_SQL},
cluster_rows AS (SELECT primary_id, item_id, row_number() OVER (PARTITION BY primary_id ORDER BY item_id <> primary_id, published_at, item_id) - 1 AS position, title, url, published_at FROM members),
cluster_heads AS (SELECT primary_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(primary_id * 7919 % 100000) AS created_at FROM members WHERE item_id = primary_id)"""


@query("clusters_in_report", f"""
WITH {CLUSTER_TABLE}, kept AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, primary_id) AS cluster_no FROM cluster_heads
  WHERE primary_id IN (SELECT item_id FROM items WHERE title ILIKE '%e%') ORDER BY created_at DESC, primary_id LIMIT 20)
SELECT primary_id, cluster_no, (SELECT count(*) FROM cluster_rows r WHERE r.primary_id = kept.primary_id AND position > 0) AS related FROM kept""")
def _(t):
    report = items(t).where(F.ilike("title", F.lit("%e%")))
    found = clusters.clusters_in_report(small_parts(t), report, limit=20)
    return found.groupBy("primary_id", "cluster_no").agg(F.sum(F.size("related_item_ids")).alias("related"))


@query("cluster_lookup", f"WITH {CLUSTER_TABLE} SELECT primary_id, position, item_id, title, url FROM cluster_rows")
def _(t):
    return clusters.cluster_lookup(small_parts(t), items(t)).select("primary_id", "position", "item_id", "title", "url")


@query("cluster_lines", f"""
WITH {CLUSTER_TABLE} SELECT primary_id, position, CASE WHEN position = 0 THEN '  Главная: [' ELSE '  Похожая: [' END
  || strftime(published_at, '%Y-%m-%d %H:%M') || '] [' || title || '](' || url || ')' AS line FROM cluster_rows
UNION ALL SELECT primary_id, -1, '### Кластер ' || primary_id || ', порог simhash: 3' FROM cluster_heads""")
def _(t):
    return batches.cluster_lines(clusters.cluster_lookup(small_parts(t), items(t)))


# --- tags --------------------------------------------------------------------------------------------

@query("tag_entities", f"""
WITH {ITEMS}, {COMPETITOR_TERMS}, {mentions_sql('found', 'competitor_terms', 'content_text')}
SELECT item_id, coalesce(string_agg(entity_id, '|' ORDER BY entity_id), '') AS mentions FROM items LEFT JOIN found USING (item_id) GROUP BY 1""")
def _(t):
    return tagging.tag_entities(items(t), competitors(t), F.col("content_text")).select("item_id", joined(F.col("mentions")).alias("mentions"))



@query("confirm_mentions", f"""
WITH {ITEMS}, {COMPETITOR_TERMS}, {mentions_sql('found', 'competitor_terms', "title || ' ' || content_text || ' ' || snippet")}
SELECT item_id, coalesce(string_agg(entity_id, '|' ORDER BY entity_id DESC) FILTER (WHERE entity_id IN (5, 3, 1, 9)), '') AS mentions
FROM items LEFT JOIN found USING (item_id) GROUP BY 1""")
def _(t):
    stored = items(t).withColumn("mentions", F.array(*[F.lit(x) for x in ("5", "3", "1", "9")]))
    return tagging.confirm_mentions(stored, competitors(t)).select("item_id", joined(F.col("mentions")).alias("mentions"))


@query("mention_names", f"""
WITH {ITEMS}, {names_sql('competitors', COMPETITORS)}
SELECT item_id, coalesce(string_agg(name, '|' ORDER BY pos), '') AS names FROM (
  SELECT item_id, unnest([item_id % 7, item_id % 3 + 1]) AS entity_id, unnest([0, 1]) AS pos FROM items) LEFT JOIN competitors USING (entity_id) GROUP BY 1""")
def _(t):
    i = items(t).withColumn("mentions", F.array((F.col("item_id") % 7).cast("int"), (F.col("item_id") % 3 + 1).cast("int")))
    return tagging.mention_names(i, competitors(t)).select("item_id", joined(F.col("mention_names")).alias("names"))


WORD = "a-z0-9а-яё"


def _geo_hit(text: str) -> str:
    return (f"CASE WHEN length(term) <= 3 THEN contains(' ' || regexp_replace({text}, '[^{WORD}]', ' ', 'g') || ' ', ' ' || term || ' ') "
            f"ELSE contains({text}, term) OR regexp_matches({text}, '(^|[^{WORD}])' || substr(term, 1, length(term) - 1)) END")


def scores_sql(title: str, body: str) -> str:
    s = "(least(length(term), 16) / 16.0::DOUBLE)"
    return f"""{ITEMS}, {SOURCES}, {REGION_TERMS},
texts AS (SELECT item_id, region_tags, {TAG_TEXT.format(title)} AS tl, {TAG_TEXT.format(body)} AS bl FROM items JOIN sources USING (source_id)),
raw_scores AS (
  SELECT item_id, any_value(region_tags) AS region_tags, CAST(entity_id AS VARCHAR) AS region_id,
    sum(CASE WHEN {_geo_hit('tl')} THEN 4 + 2 * {s} ELSE 0 END + CASE WHEN {_geo_hit('substr(bl, 1, 300)')} THEN 1.2 + {s} WHEN {_geo_hit('bl')} THEN 0.45 + 0.35 * {s} ELSE 0 END) AS score
  FROM texts, region_terms WHERE is_active AND length(term) >= 2 AND term <> 'город' GROUP BY item_id, entity_id),
scores AS (SELECT item_id, region_id, round(score + CASE WHEN len(region_tags) = 1 AND region_tags[1] = region_id THEN 3 ELSE 0 END, 6) AS score FROM raw_scores WHERE score > 0)"""


@query("score_regions", f"WITH {scores_sql('title', 'content_text')} SELECT item_id, region_id, score FROM scores")
def _(t):
    i = sections.with_source(items(t), sources(t))
    s = tagging.score_regions(i, regions(t), F.col("title"), F.col("content_text"))
    return s.select("item_id", F.inline("scores")).select("item_id", "region_id", "score")


PICK_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, region_id) AS rk, max(score) OVER (PARTITION BY item_id) AS top FROM scores),
picked AS (SELECT item_id, string_agg(region_id, '|' ORDER BY rk) AS ids FROM ranked WHERE top >= 1 AND (rk = 1 OR (rk = 2 AND {n} > 1 AND score >= round(top * 0.88, 6))) GROUP BY 1)"""


@query("pick_regions", f"""
WITH {scores_sql('title', 'content_text')}, {PICK_SQL.format(n=2)}
SELECT item_id, coalesce(ids, array_to_string(region_tags, '|')) AS region_ids FROM texts LEFT JOIN picked USING (item_id)""")
def _(t):
    i = sections.with_source(items(t), sources(t))
    return tagging.resolve_regions(i, regions(t), max_regions=2).select("item_id", joined(F.col("region_ids")).alias("region_ids"))


# --- sections ----------------------------------------------------------------------------------------

def linked_items(t):
    """Items with their source, primary entities and confirmed mentions."""
    i = tagging.tag_entities(items(t), competitors(t), tagging.item_text(), "competitor_mentions")
    i = tagging.tag_entities(i, developers(t), tagging.item_text(), "developer_mentions")
    null = F.lit(None).cast("string")
    own = F.when(F.col("item_id") % 10 == 0, F.lit("2")).otherwise(null)
    j = sections.with_source(i.withColumns({"competitor_id": own, "developer_id": null}), sources(t))
    j = j.withColumns({f"source_{k}_id": F.col(f"source_{k}_id").cast("string") for k in ("competitor", "developer")})
    return sections.primary_entity(j)


ITEM_TEXT = "title || ' ' || content_text || ' ' || snippet"
LINKED = f"""{ITEMS}, {SOURCES}, {COMPETITOR_TERMS}, {DEVELOPER_TERMS}, {names_sql('competitors', COMPETITORS)}, {names_sql('developers', DEVELOPERS)},
{mentions_sql('c_found', 'competitor_terms', ITEM_TEXT)}, {mentions_sql('d_found', 'developer_terms', ITEM_TEXT)},
linked AS (SELECT i.*, coalesce(CASE WHEN item_id % 10 = 0 THEN 2 END, competitor_id) AS pc, developer_id AS pd,
  coalesce(nullif(name, ''), nullif(base_url, ''), nullif(feed_url, ''), '@' || tg_channel_username) AS label, s.region_tags FROM items i LEFT JOIN sources s USING (source_id)),
by_competitor AS (SELECT name AS section_name, entity_id, item_id FROM (SELECT item_id, pc AS entity_id FROM linked WHERE pc IS NOT NULL
  UNION ALL SELECT item_id, f.entity_id FROM linked JOIN c_found f USING (item_id) WHERE pc IS NULL) JOIN competitors USING (entity_id)),
by_developer AS (SELECT name AS section_name, entity_id, item_id FROM (SELECT item_id, pd AS entity_id FROM linked WHERE pd IS NOT NULL
  UNION ALL SELECT item_id, f.entity_id FROM linked JOIN d_found f USING (item_id) WHERE pd IS NULL) JOIN developers USING (entity_id))"""


def _names(df, id_type="string"):
    return df.withColumn("entity_id", F.col("entity_id").cast(id_type))


@query("with_source", f"WITH {LINKED} SELECT item_id, label AS source_label, array_to_string(region_tags, '|') AS regions FROM linked")
def _(t):
    return sections.with_source(items(t), sources(t)).select("item_id", "source_label", joined(F.col("source_region_ids")).alias("regions"))


@query("primary_entity", f"WITH {LINKED} SELECT item_id, CAST(pc AS VARCHAR) AS competitor, CAST(pd AS VARCHAR) AS developer FROM linked")
def _(t):
    return linked_items(t).select("item_id", F.col("primary_competitor_id").alias("competitor"), F.col("primary_developer_id").alias("developer"))


@query("group_by_entity", f"""
WITH {LINKED} SELECT 'competitor' AS kind, section_name, item_id FROM by_competitor UNION ALL SELECT 'developer', section_name, item_id FROM by_developer""")
def _(t):
    j = linked_items(t)
    a = sections.group_by_entity(j, _names(competitors(t)), "competitor").select(F.lit("competitor").alias("kind"), "section_name", "item_id")
    b = sections.group_by_entity(j, _names(developers(t)), "developer").select(F.lit("developer").alias("kind"), "section_name", "item_id")
    return a.unionByName(b)


@query("entity_roster", f"""
WITH {SOURCES}, {names_sql('competitors', COMPETITORS)} SELECT entity_id, name FROM competitors WHERE is_active AND entity_id <> 4
  AND entity_id IN (SELECT competitor_id FROM sources WHERE enabled)""")
def _(t):
    return sections.entity_roster(competitors(t), sources(t), "competitor", disabled=[4])


@query("with_empty_groups", f"""
WITH {LINKED}, roster AS (SELECT n_name AS name FROM nation UNION SELECT name FROM competitors)
SELECT coalesce(section_name, name) AS section_name, coalesce(n, 0) AS items FROM roster FULL JOIN (SELECT section_name, count(*) AS n FROM by_competitor GROUP BY 1) ON section_name = name""")
def _(t):
    g = sections.group_by_entity(linked_items(t), _names(competitors(t)), "competitor")
    roster = t.nation.select(F.col("n_name").alias("name")).unionByName(competitors(t).select("name"))
    return sections.with_empty_groups(g, roster)


@query("drop_disabled", f"""
WITH {LINKED} SELECT section_name, count(*) AS items FROM by_competitor WHERE entity_id NOT IN (1) AND section_name NOT IN ('Mentre') GROUP BY 1""")
def _(t):
    g = sections.group_by_entity(linked_items(t), _names(competitors(t)), "competitor")
    disabled = t.spark.createDataFrame([("1",), ("Mentre",)], "id string")
    return sections.drop_disabled(g, disabled).groupBy("section_name").agg(F.count(F.lit(1)).alias("items"))


@query("group_by_region", f"""
WITH {scores_sql("title", "content_text || ' ' || snippet")}, {PICK_SQL.format(n=1)}, {names_sql('regions', REGIONS)},
chosen AS (SELECT item_id, CASE WHEN ids IS NOT NULL THEN [ids] ELSE region_tags END AS ids FROM texts LEFT JOIN picked USING (item_id)),
flat AS (SELECT item_id, unnest(CASE WHEN len(ids) = 0 THEN [NULL] ELSE ids END) AS region_id FROM chosen)
SELECT CASE WHEN region_id IS NULL THEN 'Без региона' ELSE coalesce(r.name, region_id) END AS section_name, item_id
FROM flat LEFT JOIN regions r ON r.is_active AND CAST(r.entity_id AS VARCHAR) = region_id WHERE coalesce(region_id, '') <> '4'""")
def _(t):
    i = tagging.effective_regions(sections.with_source(items(t), sources(t)), regions(t))
    return sections.group_by_region(i, regions(t), disabled=["4"]).select("section_name", "item_id")


@query("group_by_channel", f"WITH {LINKED} SELECT coalesce(label, 'Без источника') AS section_name, item_id FROM linked")
def _(t):
    return sections.group_by_channel(sections.with_source(items(t), sources(t))).select("section_name", "item_id")


@query("general_items", f"""
WITH {LINKED} SELECT item_id FROM linked WHERE pc IS NULL AND pd IS NULL AND item_id NOT IN (SELECT item_id FROM c_found) AND item_id NOT IN (SELECT item_id FROM d_found)""")
def _(t):
    return sections.general_items(linked_items(t)).select("item_id")


THEMES = [("Alpha", ["reation", "Eauon"]), ("Beta", ["the "]), ("Gamma", ["und", "que"]), ("Rest", [])]


@query("assign_theme", f"""
WITH {ITEMS} SELECT item_id, CASE WHEN contains(h, 'reation') OR contains(h, 'eauon') THEN 'Alpha' WHEN contains(h, 'the') THEN 'Beta'
  WHEN contains(h, 'und') OR contains(h, 'que') THEN 'Gamma' ELSE 'Rest' END AS theme FROM (SELECT item_id, lower(title || ' ' || snippet) AS h FROM items)""")
def _(t):
    return sections.assign_theme(items(t), THEMES).select("item_id", "theme")


REPORT_SQL = f"""
WITH {LINKED}, placed AS (
  SELECT 'competitor' AS section_kind, section_name, item_id FROM by_competitor UNION ALL SELECT 'developer', section_name, item_id FROM by_developer
  UNION ALL SELECT 'channel', coalesce(label, 'Без источника'), item_id FROM linked
  UNION ALL SELECT 'general', '', item_id FROM linked WHERE pc IS NULL AND pd IS NULL AND item_id NOT IN (SELECT item_id FROM c_found) AND item_id NOT IN (SELECT item_id FROM d_found)
  UNION ALL SELECT 'theme', CASE WHEN contains(h, 'reation') OR contains(h, 'eauon') THEN 'Alpha' WHEN contains(h, 'the') THEN 'Beta'
    WHEN contains(h, 'und') OR contains(h, 'que') THEN 'Gamma' ELSE 'Rest' END, item_id FROM (SELECT item_id, lower(title || ' ' || snippet) AS h FROM items)
  UNION ALL SELECT 'region', section_name, item_id FROM (
    WITH {scores_sql("title", "content_text || ' ' || snippet")}, {PICK_SQL.format(n=1)}, {names_sql('regions', REGIONS)},
    chosen AS (SELECT item_id, CASE WHEN ids IS NOT NULL THEN [ids] ELSE region_tags END AS ids FROM texts LEFT JOIN picked USING (item_id)),
    flat AS (SELECT item_id, unnest(CASE WHEN len(ids) = 0 THEN [NULL] ELSE ids END) AS region_id FROM chosen)
    SELECT CASE WHEN region_id IS NULL THEN 'Без региона' ELSE coalesce(r.name, region_id) END AS section_name, item_id
    FROM flat LEFT JOIN regions r ON r.is_active AND CAST(r.entity_id AS VARCHAR) = region_id)),
numbered AS (SELECT section_kind, section_name, item_id, row_number() OVER (PARTITION BY section_kind, section_name ORDER BY published_at DESC, item_id) AS rank
  FROM placed JOIN items USING (item_id))
SELECT * FROM numbered"""


def report_rows(t, per_section=None):
    j = tagging.effective_regions(sections.assign_theme(linked_items(t), THEMES), regions(t))
    return sections.report_rows(j, _names(competitors(t)), _names(developers(t)), regions(t), per_section)


@query("report_rows", REPORT_SQL)
def _(t):
    """The report as one table."""
    return report_rows(t)


@query("report_rows_capped", REPORT_SQL + " WHERE rank <= 5")
def _(t):
    return report_rows(t, per_section=5)


@query("sync_entity_links", f"""
WITH {ITEMS}, {SOURCES}, x AS (SELECT item_id, source_id, CASE WHEN item_id % 2 = 0 THEN 4 END AS c0, CASE WHEN item_id % 3 = 0 THEN 1 END AS d0, competitor_id AS c, developer_id AS d,
  competitor_id IS NOT NULL OR developer_id IS NOT NULL AS hit FROM items LEFT JOIN sources USING (source_id))
SELECT count_if(hit) AS checked, count_if(hit AND coalesce(c0, c) IS DISTINCT FROM c0) AS updated_competitor, count_if(hit AND coalesce(d0, d) IS DISTINCT FROM d0) AS updated_developer,
  count(DISTINCT CASE WHEN hit THEN source_id END) AS sources_touched FROM x""")
def _(t):
    i = items(t).withColumns({"competitor_id": F.when(F.col("item_id") % 2 == 0, 4), "developer_id": F.when(F.col("item_id") % 3 == 0, 1)})
    return sections.sync_stats(sections.sync_entity_links(i, sources(t)))


@query("sync_entity_links_overwrite", f"""
WITH {ITEMS}, {SOURCES}, x AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 4 END AS c0, competitor_id AS c, competitor_id IS NOT NULL OR developer_id IS NOT NULL AS hit FROM items LEFT JOIN sources USING (source_id))
SELECT item_id, CASE WHEN hit THEN c ELSE c0 END AS competitor_id, hit AND c IS DISTINCT FROM c0 AS changed FROM x""")
def _(t):
    i = items(t).withColumns({"competitor_id": F.when(F.col("item_id") % 2 == 0, 4), "developer_id": F.lit(None).cast("int")})
    s = sections.sync_entity_links(i, sources(t), overwrite=True)
    return s.select("item_id", "competitor_id", F.col("changed_competitor").alias("changed"))


# --- text assembly -----------------------------------------------------------------------------------

LINE_SQL = """'- ' || {prefix}strftime(published_at, '%Y-%m-%d') || ' | [' || trim(title) || '](' || url || ')' ||
  CASE WHEN snippet <> '' THEN chr(10) || '  ' || substr(snippet, 1, {n}) || CASE WHEN length(snippet) > {n} THEN '…' ELSE '' END ELSE '' END"""


@query("news_lines", f"""
WITH {LINKED}, named AS (SELECT item_id, string_agg(name, ', ' ORDER BY entity_id) AS names FROM c_found JOIN competitors USING (entity_id) GROUP BY 1)
SELECT item_id, {LINE_SQL.format(n=200, prefix="coalesce('[' || coalesce(c.name, names) || '] ', '') || ")} AS line
FROM linked l LEFT JOIN competitors c ON c.entity_id = pc LEFT JOIN named USING (item_id)""")
def _(t):
    j = tagging.mention_names(linked_items(t), _names(competitors(t)), "competitor_mentions", "mentioned")
    own = _names(competitors(t)).select(F.col("entity_id").alias("primary_competitor_id"), F.col("name").alias("own_name"))
    from ..scale import attach
    j = attach(j, own, ["primary_competitor_id"]).withColumn("entity_label", batches.entity_label(F.col("own_name"), F.col("mentioned")))
    return batches.news_lines(j, 200).select("item_id", "line")


@query("char_batches", f"""
WITH RECURSIVE {ITEMS}, lined AS (SELECT source_id, item_id, length({LINE_SQL.format(n=320, prefix='')}) + 1 AS w,
  row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, item_id) AS pos FROM items),
walk AS (SELECT source_id, item_id, pos, w AS chars, 0 AS batch_no FROM lined WHERE pos = 1
  UNION ALL SELECT l.source_id, l.item_id, l.pos, CASE WHEN k.chars + l.w > 2000 - 280 + 1 THEN l.w ELSE k.chars + l.w END, k.batch_no + CASE WHEN k.chars + l.w > 2000 - 280 + 1 THEN 1 ELSE 0 END
  FROM walk k JOIN lined l ON l.source_id = k.source_id AND l.pos = k.pos + 1)
SELECT source_id, item_id, batch_no FROM walk""")
def _(t):
    lines = batches.news_lines(items(t), 320)
    return batches.char_batches(lines, "source_id", ["published_at", "item_id"], F.char_length("line"), max_chars=2000).select(
        "source_id", "item_id", "batch_no")


@query("batch_texts", f"""
WITH RECURSIVE {ITEMS}, full_lines AS (SELECT lang, item_id, {LINE_SQL.format(n=320, prefix='')} AS line, row_number() OVER (PARTITION BY lang ORDER BY published_at, item_id) AS pos FROM items),
lined AS (SELECT lang, line, pos, length(line) + 1 AS w FROM full_lines),
walk AS (SELECT lang, line, pos, w AS chars, 0 AS batch_no FROM lined WHERE pos = 1
  UNION ALL SELECT l.lang, l.line, l.pos, CASE WHEN k.chars + l.w > 5000 - 420 + 1 THEN l.w ELSE k.chars + l.w END, k.batch_no + CASE WHEN k.chars + l.w > 5000 - 420 + 1 THEN 1 ELSE 0 END
  FROM walk k JOIN lined l ON l.lang = k.lang AND l.pos = k.pos + 1)
SELECT lang, batch_no, count(*) AS items, string_agg(line, chr(10) ORDER BY pos) AS text FROM walk GROUP BY 1, 2""")
def _(t):
    lines = batches.news_lines(items(t), 320)
    placed = batches.char_batches(lines, "lang", ["published_at", "item_id"], F.char_length("line"), 5000, batches.POSTS_RESERVE, newest_first=False)
    return batches.batch_texts(placed, "lang", ["published_at", "item_id"], newest_first=False)


def _budget_sql(max_chars: int) -> str:
    opts = [(s, n) for s in (400, 200, 0) for n in (800, 500, 350, 200, 120, 80)]
    values = ", ".join(f"({i}, {s}, {n})" for i, (s, n) in enumerate(opts))
    return f"""WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY published_at DESC, item_id) AS rk, count(*) OVER (PARTITION BY lang) AS total FROM items),
opts(o, s, n) AS (VALUES {values}, (18, 0, 60)),
texts AS (SELECT lang, o, s, any_value(total) AS total, count(*) AS shown,
  CASE WHEN any_value(total) > count(*) THEN 'Всего новостей в разделе: ' || any_value(total) || '. Ниже ' || count(*) || ' самых свежих (остальные опущены по лимиту контекста ИИ).' || chr(10) || chr(10) ELSE '' END
  || string_agg('- ' || strftime(published_at, '%Y-%m-%d') || ' | [' || trim(title) || '](' || url || ')' || CASE WHEN s > 0 AND snippet <> '' THEN chr(10) || '  ' || substr(snippet, 1, s)
     || CASE WHEN length(snippet) > s THEN '…' ELSE '' END ELSE '' END, chr(10) ORDER BY rk) AS text
  FROM r JOIN opts ON rk <= n GROUP BY lang, o, s)
SELECT lang, total, shown, s AS snippet_chars, length(text) > {max_chars} AS truncated,
  CASE WHEN length(text) > {max_chars} THEN substr(text, 1, {max_chars} - 40) || chr(10) || chr(10) || '[... обрезано по лимиту контекста ...]' ELSE text END AS text
FROM texts WHERE o = 18 OR length(text) <= {max_chars} QUALIFY row_number() OVER (PARTITION BY lang ORDER BY o) = 1"""


@query("budget_select", _budget_sql(72000))
def _(t):
    return batches.budget_select(items(t), "lang")


@query("budget_select_tight", _budget_sql(9000))
def _(t):
    return batches.budget_select(items(t), "lang", max_chars=9000)
