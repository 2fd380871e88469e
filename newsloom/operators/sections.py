"""Report sections: items by entity, region, channel and theme, as long tables (group, item_id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..scale import attach, ranked, top_n
from ..session import stage

# Labels of the groups without a region or a source.
NO_REGION = "Без региона"
NO_SOURCE = "Без источника"

# Default themes of the general section, first match wins, the last one takes the rest.
DEFAULT_THEMES = [
    ("Ипотека и ставка", ["ипотек", "ипотеч", "ключев", "ставк", "цб", "центробанк", "рефинанс"]),
    ("Ввод жилья и строительство", ["ввод", "введен", "росстат", "жиль", "строитель", "млн м", "млн кв"]),
    ("Законодательство и регулирование", ["закон", "госдум", "минстрой", "регулир", "норматив", "постановлен"]),
    ("Рынок и цены", ["цен", "стоимост", "продаж", "спрос", "предложен", "рынок", "новостро", "девелоп"]),
    ("Госпрограммы и субсидии", ["семейн", "льгот", "субсид", "господдерж", "dom.rf", "дом.рф", "госпрограмм"]),
    ("Прочее", []),
]
OTHER_THEME = "Прочее"


def nonblank(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def source_label(with_id: bool = True) -> Column:
    """Name, else base url, else feed url, else @channel, else (optionally) the id."""
    channel = F.concat(F.lit("@"), F.nullif(F.col("tg_channel_username"), F.lit("")))
    parts = [F.col("name"), F.col("base_url"), F.col("feed_url"), channel]
    return nonblank(*parts, *([F.col("source_id").cast("string")] if with_id else []))


def with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Left join of items to the label, entity ids and regions of their source."""
    dim = sources.select(
        "source_id", source_label().alias("source_label"),
        F.col("competitor_id").alias("source_competitor_id"), F.col("developer_id").alias("source_developer_id"),
        F.col("region_tags").alias("source_region_ids"))
    return attach(items, dim, ["source_id"])


def primary_entity(joined: DataFrame) -> DataFrame:
    """Add primary_competitor_id / primary_developer_id: the item's own id, else its source's."""
    return joined.withColumns({
        f"primary_{k}_id": F.coalesce(f"{k}_id", f"source_{k}_id") for k in ("competitor", "developer")})


def group_by_entity(joined: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """(section_name, entity_id, item_id): the primary entity's group, else one row per confirmed mention.

    ``joined`` carries ``primary_<kind>_id`` and confirmed ``<kind>_mentions``. Entities of equal name form
    one group; an unknown id names its own group.
    """
    primary = F.col(f"primary_{kind}_id")
    ids = F.when(primary.isNotNull(), F.array(primary)).otherwise(F.col(f"{kind}_mentions"))
    rows = joined.select("item_id", F.explode(F.array_distinct(ids)).alias("entity_id"))
    names = entities.select("entity_id", "name")
    return attach(rows, names, ["entity_id"]).select(
        F.coalesce(F.nullif("name", F.lit("")), F.col("entity_id").cast("string")).alias("section_name"),
        "entity_id", "item_id")


def entity_roster(entities: DataFrame, sources: DataFrame, kind: str, disabled: Sequence = ()) -> DataFrame:
    """(entity_id, name) of active entities with an enabled source: groups a report shows even when empty."""
    live = sources.where("enabled").select(F.col(f"{kind}_id").alias("entity_id"))
    out = entities.where("is_active").join(live, "entity_id", "left_semi").select("entity_id", "name")
    return out.where(~F.col("entity_id").isin(list(disabled))) if disabled else out


def with_empty_groups(groups: DataFrame, roster: DataFrame) -> DataFrame:
    """(section_name, items): counts per group, with zero rows for roster names that have no item."""
    counts = groups.groupBy("section_name").agg(F.count(F.lit(1)).alias("items"))
    return roster.select(F.col("name").alias("section_name")).distinct().join(counts, "section_name", "full").select(
        "section_name", F.coalesce("items", F.lit(0)).alias("items"))


def drop_disabled(groups: DataFrame, disabled: DataFrame, unassigned: str | None = None,
                  include_unassigned: bool = True) -> DataFrame:
    """Groups that are not disabled by id or by name; the unassigned group follows its own flag."""
    out = groups.join(disabled.select(F.col("id").cast("string").alias("_d")),
                      F.col("entity_id").cast("string").eqNullSafe(F.col("_d")), "left_anti")
    named = disabled.select(F.col("id").cast("string").alias("_n"))
    if unassigned is None:
        return out.join(named, F.col("section_name") == F.col("_n"), "left_anti")
    out = out.join(named, (F.col("section_name") == F.col("_n")) & (F.col("section_name") != unassigned), "left_anti")
    return out if include_unassigned else out.where(F.col("section_name") != unassigned)


def group_by_region(resolved: DataFrame, regions: DataFrame, disabled: Sequence = (),
                    include_unassigned: bool = True) -> DataFrame:
    """(section_name, region_id, item_id) from items with region_ids; items without one get their own label."""
    rows = resolved.select("item_id", F.explode_outer("region_ids").alias("region_id"))
    names = regions.where("is_active").select(F.col("region_id").cast("string").alias("region_id"), "name")
    rows = attach(rows, names, ["region_id"])
    if disabled:
        rows = rows.where(F.col("region_id").isNull() | ~F.col("region_id").isin([str(d) for d in disabled]))
    if not include_unassigned:
        rows = rows.where(F.col("region_id").isNotNull())
    label = F.when(F.col("region_id").isNull(), F.lit(NO_REGION)).otherwise(F.coalesce("name", "region_id"))
    return rows.select(label.alias("section_name"), "region_id", "item_id")


def group_by_channel(joined: DataFrame) -> DataFrame:
    """(section_name, item_id) by source label."""
    return joined.select(F.coalesce("source_label", F.lit(NO_SOURCE)).alias("section_name"), "item_id")


def general_items(joined: DataFrame) -> DataFrame:
    """Items that belong to no competitor and no developer."""
    def free(kind: str) -> Column:
        return F.col(f"primary_{kind}_id").isNull() & (F.coalesce(F.size(f"{kind}_mentions"), F.lit(0)) == 0)

    return joined.where(free("competitor") & free("developer"))


def assign_theme(items: DataFrame, themes: Sequence[tuple[str, Sequence[str]]] | None = None) -> DataFrame:
    """Add ``theme``: the first theme with a keyword in title or snippet, else the last one without keywords."""
    chosen = [(t.strip(), [w for w in dict.fromkeys(x.strip().lower() for x in words) if w])
              for t, words in (themes or DEFAULT_THEMES) if t.strip()]
    if all(words for _, words in chosen):
        chosen.append((OTHER_THEME, []))
    rest = [t for t, words in chosen if not words][-1]
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))

    def pick(h: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for title, words in chosen:
            if words:
                out = out.when(contains_any(h, words), F.lit(title))
        return out.otherwise(F.lit(rest))

    return items.withColumn("theme", F.transform(F.array(hay), pick)[0])


def report_rows(joined: DataFrame, competitors: DataFrame, developers: DataFrame, regions: DataFrame,
                per_section: int | None = None) -> DataFrame:
    """The whole report as one long table (section_kind, section_name, item_id, rank), newest items first.

    ``joined`` carries what the single groupings need: primary ids and confirmed mentions of both kinds, region_ids, source_label and
    theme. Every item is read once and sent to all its sections; kinds are competitor, developer, region, channel, theme and
    general (items of no competitor and no developer). With ``per_section`` each section keeps its newest items.
    """
    none = F.expr("cast(array() as array<struct<section_kind:string,entity_id:string>>)")

    def keys(kind: str, ids: Column) -> Column:
        found = F.transform(F.array_distinct(ids), lambda x: F.struct(F.lit(kind).alias("section_kind"), x.cast("string").alias("entity_id")))
        return F.coalesce(found, none)

    def entity(kind: str) -> Column:
        primary = F.col(f"primary_{kind}_id").cast("string")
        return F.when(primary.isNotNull(), F.array(primary)).otherwise(F.transform(f"{kind}_mentions", lambda x: x.cast("string")))

    somewhere = F.coalesce(F.size("region_ids"), F.lit(0)) > 0
    lone = [F.coalesce(F.size(entity(k)), F.lit(0)) <= 0 for k in ("competitor", "developer")]
    sections = F.concat(
        keys("competitor", entity("competitor")), keys("developer", entity("developer")),
        keys("region", F.when(somewhere, F.col("region_ids")).otherwise(F.array(F.lit(None).cast("string")))),
        keys("channel", F.array(F.coalesce("source_label", F.lit(NO_SOURCE)))), keys("theme", F.array("theme")),
        F.when(lone[0] & lone[1], keys("general", F.array(F.lit("")))).otherwise(none))
    rows = joined.select("item_id", "published_at", F.explode(sections).alias("k")).select("item_id", "published_at", "k.*")
    names = None
    for kind, dim, key in (("competitor", competitors, "entity_id"), ("developer", developers, "entity_id"), ("region", regions.where("is_active"), "region_id")):
        part = dim.select(F.lit(kind).alias("section_kind"), F.col(key).cast("string").alias("entity_id"), "name")
        names = part if names is None else names.unionByName(part)
    rows = attach(rows, names, ["section_kind", "entity_id"])
    label = F.when((F.col("section_kind") == "region") & F.col("entity_id").isNull(), F.lit(NO_REGION)).otherwise(
        F.coalesce(F.nullif("name", F.lit("")), "entity_id"))
    rows = rows.select("section_kind", label.alias("section_name"), "item_id",
                       F.coalesce(-F.unix_micros("published_at"), F.lit(2 ** 62)).alias("_age"))
    group = ["section_kind", "section_name"]
    if per_section is None:
        # the ranges of the order are sampled before they are written: staged, so that the items are tagged once
        return ranked(stage(rows, "sections"), group, ["_age", "item_id"]).drop("_age")
    return top_n(rows, group, [F.col("_age"), F.col("item_id")], per_section).drop("_age")


def referenced_ids(joined: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    """Distinct entity ids a report refers to: primary, mentioned, and those of the items' sources."""
    own = joined.select(F.col(f"primary_{kind}_id").alias("entity_id"))
    told = joined.select(F.explode(f"{kind}_mentions").alias("entity_id"))
    used = sources.join(joined.select("source_id").distinct(), "source_id", "left_semi").select(
        F.col(f"{kind}_id").alias("entity_id"))
    return own.unionByName(told).unionByName(used).where("entity_id is not null").distinct()


def sync_entity_links(items: DataFrame, sources: DataFrame, overwrite: bool = False) -> DataFrame:
    """Items with competitor_id / developer_id taken over from their source, and what changed.

    Only items of sources with at least one link are touched. Without ``overwrite`` only NULLs are filled;
    with it the source's value always wins, clearing included. Adds changed_competitor / changed_developer /
    checked.
    """
    dim = sources.where("competitor_id is not null or developer_id is not null").select(
        "source_id", F.col("competitor_id").alias("_competitor"), F.col("developer_id").alias("_developer"),
        F.lit(True).alias("_linked"))
    out = attach(items, dim, ["source_id"])
    checked = F.coalesce("_linked", F.lit(False))
    new = {}
    for kind in ("competitor", "developer"):
        own, src = F.col(f"{kind}_id"), F.col(f"_{kind}")
        value = src if overwrite else F.coalesce(own, src)
        new[kind] = F.when(checked, value).otherwise(own)
    out = out.withColumns({f"new_{k}": v for k, v in new.items()} | {"checked": checked})
    out = out.withColumns({f"changed_{k}": ~F.col(f"new_{k}").eqNullSafe(F.col(f"{k}_id")) for k in new})
    return out.withColumns({f"{k}_id": F.col(f"new_{k}") for k in new}).drop(
        "_competitor", "_developer", "_linked", "new_competitor", "new_developer")


def sync_stats(synced: DataFrame) -> DataFrame:
    return synced.agg(
        F.count_if("checked").alias("checked"), F.count_if("changed_competitor").alias("updated_competitor"),
        F.count_if("changed_developer").alias("updated_developer"),
        F.count_distinct(F.when(F.col("checked"), F.col("source_id"))).alias("sources_touched"))
