"""Golden cases of tagging, tables, health, posts, payloads and pages."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import health, payloads, posts, sections, tagging
from newsloom.session import new_path
from newsloom.sources import articles, feeds, tables

NOW = dt.datetime(2024, 1, 31, 12)


def regions(spark, *rows):
    return spark.createDataFrame([(i, name, [], terms, [], True) for i, (name, terms) in enumerate(rows, 1)],
                                 "region_id int, name string, federal_subjects array<string>, keywords array<string>, "
                                 "geographic_aliases array<string>, is_active boolean")


def item(spark, title, body, source):
    return spark.createDataFrame([(1, title, body, source)], "item_id int, title string, content_text string, source_region_ids array<string>")


def test_inflected_title_beats_body(spark):
    r = regions(spark, ("Волга", ["Самара", "Самарская область"]), ("Восток", ["Владивосток", "Приморский край"]))
    i = item(spark, "Самаре не грозит дефицит", "В красной зоне Крым и Владивосток. В Самаре срок 2,9 года.", ["1"])
    scored = tagging.score_regions(i, r, F.col("title"), F.col("content_text"))
    scores = {s.region_id: s.score for s in scored.first().scores}
    assert scores["1"] > scores["2"]
    assert tagging.pick_regions(scored).first().region_ids == ["1"]


def test_generic_words_name_no_region(spark):
    r = regions(spark, ("ДНР", ["Донецк", "ДНР", "Донецкая Народная Республика", "Республика"]), ("ЛНР", ["Луганск", "ЛНР"]))
    i = item(spark, "Минстрой ЛНР меняет участки в Луганске", "Программа в новых регионах республики продолжается.", [])
    assert tagging.resolve_regions(i, r).first().region_ids == ["2"]


def test_region_fallbacks(spark):
    r = regions(spark, ("A", ["Самара"]), ("B", ["Казань"]))
    assert tagging.resolve_regions(item(spark, "Самаре", "Сравнение с Казанью.", ["1"]), r).first().region_ids == ["1"]
    assert tagging.resolve_regions(item(spark, "ничего", "пусто", ["1", "2"]), r).first().region_ids == ["1", "2"]
    both = tagging.resolve_regions(item(spark, "Самара Казань", "", []), r, max_regions=2).first().region_ids
    assert both == ["1", "2"]
    assert tagging.resolve_regions(item(spark, "Самара Казань", "", []), r).first().region_ids == ["1"]


def test_short_terms_stand_alone(spark):
    e = spark.createDataFrame([(1, "ПИК", [], [], True), (2, "c++", [], ["a-b"], True), (3, "Самолет", None, None, True), (4, "пик", [], [], False)],
                              "entity_id int, name string, aliases array<string>, tags array<string>, is_active boolean")
    for body, want in [("пикник", []), ("это пик!", ["1"]), ("дом.пик-парк", ["1"]), ("x c++ y", ["2"]), ("a-b", ["2"]), ("xa-b", []),
                       ("https://пик.ru/samolet самолетов", ["3"])]:
        assert tagging.tag_entities(item(spark, "", body, []), e, F.col("content_text")).first().mentions == want, body


def test_sliced_dictionaries_agree(spark, monkeypatch):
    e = spark.createDataFrame([(i, f"term{i}x", [], [], True) for i in range(40)],
                              "entity_id int, name string, aliases array<string>, tags array<string>, is_active boolean")
    i = item(spark, "", "term3x term17x term39x", [])
    whole = tagging.tag_entities(i, e, F.col("content_text")).first().mentions
    monkeypatch.setattr(tagging, "SLICE_CHARS", 50)
    assert tagging.tag_entities(i, e, F.col("content_text")).first().mentions == whole == ["17", "3", "39"]


def test_term_by_term_and_one_scan_agree(spark, monkeypatch):
    rnd = random.Random(3)
    syllables = ["ка", "зань", "мо", "сква", "ab", "c1", "x", "пик", "ё", "-", "области"]
    term = lambda n: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, n)))
    names = [[term(4) for _ in range(3)] for _ in range(60)]
    r = regions(spark, *[(f"R{i}", t) for i, t in enumerate(names)])
    e = spark.createDataFrame([(i, t[0], t[1:], [], True) for i, t in enumerate(names)], "entity_id int, name string, aliases array<string>, tags array<string>, is_active boolean")
    texts = [(" ".join(term(4) for _ in range(6)), " ".join(term(5) for _ in range(120))) for _ in range(40)] + [("", ""), (None, None)]
    df = spark.createDataFrame([(i, a, b, []) for i, (a, b) in enumerate(texts)], "item_id int, title string, content_text string, source_region_ids array<string>")

    def run():
        tagged = tagging.score_regions(tagging.tag_entities(df, e, F.col("content_text")), r, F.col("title"), F.col("content_text"))
        return {x.item_id: (x.mentions, sorted(map(tuple, x.scores))) for x in tagged.collect()}

    monkeypatch.setattr(tagging, "SCAN_TERMS", 0)
    scanned = run()
    monkeypatch.setattr(tagging, "SCAN_TERMS", 10_000)
    assert run() == scanned


def test_rate_tables(spark):
    text = """
    Период действия ставки | Значение
    16 февраля 2026 г. | 16,00
    22 декабря 2025 г. - 15 февраля 2026 г. | 15,50
    24 июля 2022 г. - 17 декабря 2023 г. | 7,50
    """
    docs = spark.createDataFrame([(1, text), (2, "10 января 2025 г.\t16.00"), (3, " ".join(text.replace("|", " ").split()[4:]))], "doc_id int, text string")
    got = {}
    for r in tables.date_value_table(docs).collect():
        got.setdefault(r.doc_id, {})[r.period] = r.value
    assert sorted(got[1].values()) == [7.5, 15.5, 16.0] and "22 декабря 2025 г. - 15 февраля 2026 г." in got[1]
    assert list(got[2].values()) == [16.0]
    assert len(got[3]) >= 3


def cells(spark, *named):
    rows = [(tid, doc, r, c, x) for tid, doc, table in named for r, row in enumerate(table) for c, x in enumerate(row)]
    return spark.createDataFrame(rows, "table_id string, doc_id string, row int, col int, text string")


def test_cell_tables(spark):
    rate = [["Период", "Значение", "Ссылка"], ["16 февраля 2026 г.", "16,00", ""], ["22 декабря 2025 г. - 15 февраля 2026 г.", "15,50", ""], ["24 июля 2022 г.", "7,50", ""]]
    matrix = [["№", "Наименование показателя", "2024", "", "2025"], ["1", "Ввод", "41,6 (+55,1%)", "7,49 (-0,19 п.п.)", ""], ["", "— МКД", "5", "—", ""], ["2", "Пусто", "", "", ""], ["", "— ИЖС", "6", "", ""]]
    got = tables.classify_table(cells(spark, ("t1", "d1", rate), ("t2", "d2", matrix), ("t3", "d3", [["only"]]))).collect()
    t1 = [(r.indicator_name, r.value, r.unit) for r in sorted(got, key=lambda r: r.row) if r.table_id == "t1"]
    assert t1 == [("Ключевая ставка", 16.0, "%"), ("Ключевая ставка", 15.5, "%"), ("Ключевая ставка", 7.5, "%")]
    t2 = {(r.indicator_name, r.period): (r.value, r.change_pct) for r in got if r.table_id == "t2"}
    assert t2 == {("Ввод", "2024"): (41.6, 55.1), ("Ввод", "2025"): (7.49, -0.19), ("Ввод — МКД", "2024"): (5.0, None), ("Ввод — ИЖС", "2024"): (6.0, None)}


def sources(spark, *rows):
    base = dict(enabled=True, name="s", base_url=None, feed_url=None, tg_channel_username=None, fetch_frequency_min=60,
                consecutive_failures=0, last_fetch_at=None, last_success_at=None, backoff_until=None)
    full = [{"source_id": f"s{i}", **base, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.values()) for r in full],
                                 "source_id string, enabled boolean, name string, base_url string, feed_url string, tg_channel_username string, "
                                 "fetch_frequency_min int, consecutive_failures int, last_fetch_at timestamp, last_success_at timestamp, backoff_until timestamp")


def ago(**kw):
    return NOW - dt.timedelta(**kw)


def test_alerts(spark):
    s = sources(spark,
                dict(consecutive_failures=4, last_fetch_at=ago(hours=5), last_success_at=ago(hours=10), backoff_until=ago(hours=-7)),
                dict(), dict(consecutive_failures=1, last_success_at=ago(minutes=20)), dict(enabled=False, consecutive_failures=9),
                dict(last_success_at=ago(minutes=180), backoff_until=ago(minutes=-360)), dict(last_success_at=ago(minutes=360)), dict(last_success_at=ago(minutes=179)))
    got = {(r.source_id, r.code.removeprefix("SOURCE_"), r.severity) for r in health.source_alerts(s, NOW).collect()}
    assert got == {("s0", "CONSECUTIVE_FAILURES_HIGH", "critical"), ("s0", "BACKOFF_ACTIVE", "critical"), ("s0", "STALE_SUCCESS", "critical"),
                   ("s1", "NEVER_RUN", "warning"), ("s2", "CONSECUTIVE_FAILURES", "warning"),
                   ("s4", "BACKOFF_ACTIVE", "critical"), ("s4", "STALE_SUCCESS", "warning"), ("s5", "STALE_SUCCESS", "critical")}


def test_post_groups(spark):
    rows = [(1, "Введено 5 млн кв. м жилья", []), (2, "Сдан многоквартирный дом", []), (3, "О погоде", []), (4, "текст", ["многоквартирных"]), (5, "ставка ЦБ", [])]
    p = spark.createDataFrame(rows, "post_id int, text string, matched_keywords array<string>")
    assert {r.post_id: r.group_title for r in posts.assign_post_group(p).collect()} == {1: "Ввод жилья", 2: "Ввод МКД", 4: "Ввод МКД"}
    mine = posts.assign_post_group(p, [("Ставки", ["ставка цб"]), ("Дома", ["многоквартирного"])])
    assert {r.post_id: r.group_title for r in mine.collect()} == {2: "Дома", 4: "Дома", 5: "Ставки"}


def test_albums(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("c", 1, 10, " ", t0, "a.jpg"), ("c", 2, 10, "first", t0, None), ("c", 3, 10, "last", t0, "b.jpg"), ("c", 4, None, "solo", t0, None), ("c", 5, 0, "zero", t0, None)]
    m = spark.createDataFrame(rows, "channel string, message_id int, grouped_id int, text string, published_at timestamp, image_path string")
    got = {r.message_id: (r.messages, r.text, r.images) for r in posts.merge_albums(m).collect()}
    assert got == {1: (3, "last", 2), 4: (1, "solo", 0), 5: (1, "zero", 0)}
    assert [(r.message_id, r.image_no, r.image_path) for r in posts.album_images(m).orderBy("image_no").collect()] == [(1, 1, "a.jpg"), (1, 2, "b.jpg")]


def test_section_payloads(spark):
    good = {"headline": "\U0001F680 H", "bullets": ["plain ✦", {"text": "obj", "citations": [{"label": "", "url": "http://x"}]}, {"text": " "}],
            "subsections": [{"title": "", "paragraphs": ["", "p"], "bullets": []}, {"title": " ", "paragraphs": [], "bullets": []}, "junk"], "extra": 1}
    body = json.dumps(good, ensure_ascii=False)
    raws = [body, f"```json\n{body}\n```", f"Ответ:\n{body} — всё", "[1]", "{bad", "", None, '{"lead": "L"}']
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = {r.i: r.section for r in payloads.parse_sections(df, "raw").collect()}
    for i in (0, 1, 2):
        assert got[i].headline == "H" and [b.text for b in got[i].bullets] == ["plain", "obj"]
        assert [(s.title, s.paragraphs) for s in got[i].subsections] == [("", ["p"])]
    assert all(got[i] is None for i in (3, 4, 5, 6)) and got[7].lead == "L"
    text = payloads.sections_to_text(payloads.parse_sections(df, "raw")).where("i = 0").first().text
    assert text == "H\n\n- plain\n\n- obj [источник](http://x)\n\np"


def test_merge_of_parts(spark):
    parts = [{"lead": "L1", "paragraphs": ["p", "q"], "bullets": ["Same", "b1"]}, {"headline": "H2", "paragraphs": ["q", "r"], "bullets": ["same", "b2"], "closing": "C2",
             "subsections": [{"title": "S", "paragraphs": [], "bullets": ["deep", "b1"]}]}]
    rows = [("g", i, json.dumps(p)) for i, p in enumerate(parts)] + [("one", 0, json.dumps(parts[1]))]
    df = payloads.parse_sections(spark.createDataFrame(rows, "g string, part_no int, raw string"), "raw")
    heads = {r.g: (r.headline, r.lead, r.closing) for r in payloads.section_heads(df, ["g"]).collect()}
    assert heads == {"g": ("Общие новости", "L1", "C2"), "one": ("H2", None, "C2")}

    def texts(rows, g, kind):
        mine = [r for r in rows.collect() if (r.g, r.kind) == (g, kind)]
        return [r.text for r in sorted(mine, key=lambda r: (r.sub_no >= 0, r.part_no, r.sub_no, r.pos))]

    merged = payloads.merge_sections(df, ["g"])
    assert texts(merged, "g", "paragraph") == ["p", "q", "r"] and texts(merged, "g", "bullet") == ["Same", "b1", "b2"]
    assert texts(merged, "one", "bullet") == ["same", "b2", "deep", "b1"]
    assert texts(payloads.merge_sections(df, ["g"], drafts=True), "g", "bullet") == ["Same", "b1", "b2", "deep"]
    timed = payloads.merge_time_parts(df.withColumn("label", F.concat(F.lit("part "), "part_no")), ["g"]).where("g = 'g'")
    assert {(r.sub_title, r.text) for r in timed.collect() if r.kind == "bullet"} == {
        ("part 0", "Same"), ("part 0", "b1"), ("S", "deep"), ("S", "b1"), ("part 1", "same"), ("part 1", "b2")}


def test_analytical_sections(spark):
    def sec(lead, title, n):
        return json.dumps({"lead": "x" * lead, "subsections": [{"title": title, "paragraphs": ["y" * 120, "z" * 80], "bullets": ["b"] * n}]})
    rows = [(0, sec(180, "T", 6)), (1, sec(179, "T", 6)), (2, sec(180, "T", 5)), (3, sec(180, "2024-01-01 — 2024-01-05", 6)), (4, '{"lead": "a"}')]
    df = payloads.parse_sections(spark.createDataFrame(rows, "i int, raw string"), "raw")
    assert {r.i for r in payloads.section_quality(df).where("is_analytical").collect()} == {0}


def test_articles(spark):
    page = """<html><head><title>Site</title></head><body><nav><a href="/n">Menu</a></nav><article class="post main"><h1 data-t="T attr">Head <b>line</b></h1>
      <time datetime="2024-01-02T03:04:05Z">x</time><div id="text"><p>One<p>Two<script>bad()</script><span class="ad">Ad</span></div></article></body></html>"""
    df = spark.createDataFrame([(1, "https://a.b/c", page)], "page_id int, url string, html string")
    spec = {"detail": {"title": {"css": "article.post h1", "attr": "data-t"}, "date": {"css": "time[datetime]", "attr": "datetime"}, "body": {"css": "#text"}},
            "cleanup": {"remove_css": [".ad"]}, "min_fulltext_length": 3}
    r = articles.extract_articles(df, spec).first()
    assert (r.title, r.body_text, str(r.published_at)) == ("T attr", "One Two", "2024-01-02 03:04:05")
    short = articles.extract_articles(df, {"detail": {"body": {"css": "#none"}}}).first()
    assert short.title == "Site" and "One" in short.body_text and "Menu" not in short.body_text


def test_feeds(spark):
    rss = """<?xml version="1.0"?><rss><channel><item><title>A</title><link> https://a/1 </link><description>&lt;p&gt;x &amp;amp; y&lt;/p&gt;</description>
      <pubDate>Tue, 02 Jan 2024 03:04 +0300</pubDate></item><item><guid>urn:2</guid><description>plain</description></item><item><title>none</title></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link rel="self" href="https://a/self"/><link href="https://a/3"/><content type="html">&lt;b&gt;c&lt;/b&gt;</content>
      <published>2024-01-02T00:00:00Z</published></entry></feed>"""
    p = spark.createDataFrame([("s", "f1", rss), ("s", "f2", atom)], "source_id string, url string, body string").withColumn("fetched_at", F.lit(NOW))
    got = {r.url: (r.content_text, str(r.published_at)) for r in feeds.rss_items(p).collect()}
    assert got == {"https://a/1": ("x & y", "2024-01-02 00:04:00"), "urn:2": ("plain", "None"), "https://a/3": ("c", "2024-01-02 00:00:00")}


def test_sitemaps(spark):
    def maps(*children):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"
    bodies = {"r": maps("a", "b", "r"), "a": maps("c", "b"), "b": "<s:urlset xmlns:s='x'><s:url><s:loc>u1</s:loc><s:lastmod>2024-01-01</s:lastmod></s:url><s:url><s:loc/></s:url></s:urlset>",
              "c": "<urlset><url><loc>u2</loc></url><url><loc>skip</loc></url></urlset>", "h": "<html></html>", "x": "<urlset><url>"}
    p = spark.createDataFrame([("s", k, v) for k, v in bodies.items()], "source_id string, url string, body string").withColumn("fetched_at", F.lit(NOW))
    seen = feeds.expand_sitemap_index(p.where("url = 'r'").select("source_id", "url"), p)
    assert {r.url: r.seq for r in seen.collect()} == {"r": 0, "a": 1, "b": 2, "c": 3}
    assert {r.url for r in feeds.expand_sitemap_index(p.where("url = 'r'").select("source_id", "url"), p, max_sitemaps=2).collect()} == {"r", "a"}
    visited = p.join(seen.select("url", "seq"), "url")
    assert [r["loc"] for r in feeds.sitemap_urls(visited, exclude="^skip").orderBy("seq", "position").collect()] == ["u1", "u2"]
    assert [(r["loc"], r.left_out) for r in feeds.sitemap_urls(visited, max_urls=1).collect()] == [("u1", 2)]
    assert {r.url for r in feeds.sitemap_errors(p).collect()} == {"x"}


def test_disabled_groups(spark):
    g = spark.createDataFrame([("A", "1", 1), ("B", "2", 2), ("Без региона", None, 3)], "section_name string, entity_id string, item_id int")
    off = spark.createDataFrame([("1",), ("Без региона",)], "id string")
    left = sections.drop_disabled(g, off, unassigned=sections.NO_REGION)
    assert {r.item_id for r in left.collect()} == {2, 3}
    assert {r.item_id for r in sections.drop_disabled(g, off, sections.NO_REGION, False).collect()} == {2}


def test_feed_forms(spark):
    rss = "<rss><channel><item><title>R & D</title><link>https://a/1</link><description>s</description></item></channel></rss>"
    prefixed = ('<?xml version="1.0"?><atom:feed xmlns:atom="x"><atom:entry><atom:title>T</atom:title><atom:link href="https://a/2"/>'
                '<atom:content type="xhtml"><div xmlns="y"><p>one <b>two</b></p></div></atom:content></atom:entry></atom:feed>')
    rdf = ('<rdf:RDF xmlns:rdf="r"><item><title>D</title><link>https://a/3</link><dc:date>2024-01-02T00:00:00Z</dc:date>'
           '<content:encoded>&lt;p&gt;full&lt;/p&gt;</content:encoded></item></rdf:RDF>')
    bad = {"b1": "<rss><channel><item>", "b2": "no xml", "b3": None, "b4": "<html><body>x</body></html>"}
    rows = [("s", "f1", rss), ("s", "f2", prefixed), ("s", "f3", rdf), *[("s", k, v) for k, v in bad.items()]]
    p = spark.createDataFrame(rows, "source_id string, url string, body string").withColumn("fetched_at", F.lit(NOW))
    got = {r.url: (r.title, r.content_text, str(r.published_at)) for r in feeds.rss_items(p).collect()}
    assert got == {"https://a/1": ("R & D", "s", "None"), "https://a/2": ("T", "one two", "None"), "https://a/3": ("D", "full", "2024-01-02 00:00:00")}
    assert {r.url for r in feeds.feed_errors(p).collect()} == set(bad)


def test_feeds_with_namespaces_entities_and_broken_items(spark):
    head = '<?xml version="1.0" encoding="windows-1251"?><rss xmlns:media="http://search.yahoo.com/mrss/" xmlns:a="http://www.w3.org/2005/Atom" xml:base="https://x/"><channel>'
    bodies = {
        "media": head + "<item><media:title>other</media:title><title>t</title><media:group><media:title>deep</media:title></media:group><link>https://a/1</link></item>"
                 "<item><media:title>only</media:title><link>https://a/2</link></item></channel></rss>",
        "atom": head + '<item><title>t</title><a:link rel="self" href="z"/><link>https://a/3</link></item><item><a:link href="/4"/><guid isPermaLink="false">g</guid></item></channel></rss>',
        "entity": head + "<item><title>a&nbsp;b &copy; &unknown; &#8211; x&y</title><link>https://a/5?p=1&q=2</link></item></channel></rss>",
        "cdata": head + "<item><title><![CDATA[<x:y> & more]]></title><link>https://a/6</link><description><![CDATA[a:b &amp; <b>c</b>]]></description></item></channel></rss>",
        "broken": head + "<item><title>g1</title><link>https://a/7</link></item><item><title>x <b></title><link>https://bad</link></item>"
                  "<item><title>open <![CDATA[</title></item><item><title>g2</title><link>https://a/8</link></item><item><title>no end<link>u</link></item>",
        "source": '<feed xmlns="http://www.w3.org/2005/Atom"><entry><source><title>of</title><id>s</id></source><title type="html">own</title><link rel="enclosure" href="e"/><id>https://a/9</id>'
                  '<content type="xhtml"><div>1 &lt; 2 <p>two<br/></p></div></content></entry></feed>',
        "nested": head + "<item><title>lost</title><link>l</link><item><title>kept</title><link>https://a/10</link></item></channel></rss>",
    }
    p = spark.createDataFrame([("s", k, v) for k, v in bodies.items()], "source_id string, url string, body string").withColumn("fetched_at", F.lit(NOW))
    got = {r.url: (r.title, r.content_text) for r in feeds.rss_items(p).collect()}
    assert got == {
        "https://a/1": ("t", None), "https://a/2": ("only", None), "https://a/3": ("t", None), "https://x/4": (None, None),
        "https://a/5?p=1&q=2": ("a\u00a0b © &unknown; – x&y", None), "https://a/6": ("<x:y> & more", "a:b & c"),
        "https://a/7": ("g1", None), "https://a/8": ("g2", None), "https://a/9": ("own", "1 < 2 two"), "https://a/10": ("kept", None)}
    lost = {r.url: (r.reason, r.broken_items) for r in feeds.feed_errors(p).collect()}
    assert lost == {"broken": ("mismatched tag", 3), "nested": ("mismatched tag", 1)}


def test_articles_with_odd_markup(spark):
    deep = "<body>" + "<div>" * 5000 + "deep text</div>"
    page = "<ul class=a><li>one<li>two<ul><li>inner</ul></ul><div class=b><section><p>far</p></section><p>near</p></div>"
    df = spark.createDataFrame([(1, "u", deep), (2, "u", page), (3, "u", None), (4, "u", "<![x <p")], "page_id int, url string, html string")
    template = {"detail": {"title": {"css": "div.b > p"}, "body": {"css": "body"}}, "min_fulltext_length": 1}
    got = {r.page_id: r for r in articles.extract_articles(df, template).collect()}
    assert len(got) == 4 and got[1].error is None and "deep text" in got[1].body_text and got[2].title == "near"
    tree = articles.Tree()
    tree.feed(page)
    assert [n.text() for n in articles.select(tree.root, "ul.a > li")] == ["one", "two inner"]
    assert [n.text() for n in articles.select(tree.root, "div p")] == ["far", "near"]
    for css in ("a:hover", "> p", "p >"):
        with pytest.raises(ValueError):
            articles.extract_articles(df, {"detail": {"title": {"css": css}}})


def test_equal_period_headers_keep_the_last(spark):
    grid = [["Name", "2023", "2023", "2024"], ["a", "1", "2", "3"], ["b", "4", "", "5"]]
    cells = spark.createDataFrame([("t", i, j, x) for i, row in enumerate(grid) for j, x in enumerate(row)], "table_id string, row int, col int, text string")
    got = {(r.indicator_name, r.period): r.value for r in tables.unpivot_matrix(cells).collect()}
    assert got == {("a", "2023"): 2.0, ("a", "2024"): 3.0, ("b", "2023"): 4.0, ("b", "2024"): 5.0}


def test_clusters_in_several_parts(spark):
    from newsloom.operators import batches, clusters
    t = NOW
    table = spark.createDataFrame([(1, 0, [2, 3], t), (1, 1, [4], t), (9, 0, [8], t)], "primary_id int, part_no int, related_item_ids array<int>, created_at timestamp")
    items = spark.createDataFrame([(i, f"t{i}", f"u{i}", t) for i in (1, 2, 3, 4, 8, 9)], "item_id int, title string, url string, published_at timestamp")
    rows = clusters.cluster_lookup(table, items)
    assert sorted((r.primary_id, r.position, r.item_id) for r in rows.collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4), (9, 0, 9), (9, 1, 8)]
    assert batches.cluster_lines(rows).where("position = -1").count() == 2
    first = clusters.clusters_in_report(table, items, limit=1).collect()
    assert sorted((r.primary_id, r.part_no, r.cluster_no) for r in first) == [(1, 0, 1), (1, 1, 1)]


def test_facts_that_share_keys_in_a_chain(spark):
    cite = lambda *urls: [{"url": u, "title": None} for u in urls]
    kind = spark.sql(f"select cast(array() as array<{payloads.CITATION}>) c").schema["c"].dataType
    names = [f.name for f in kind.elementType.fields]
    row = lambda i: (1, i, f"fact number {i} about something", [tuple(c.get(n) for n in names) for c in cite(f"u{i}", f"u{i + 1}")])
    ddl = f"report_id int, fact_no int, text string, citations {kind.simpleString()}"
    drafts = spark.createDataFrame([row(i) for i in range(1000)], ddl)
    told = spark.createDataFrame([], ddl).drop("fact_no")
    assert sorted(r.fact_no for r in payloads.missing_facts(drafts, told).collect()) == list(range(0, 1000, 2))
    few = drafts.where("fact_no < 10")
    assert sorted(r.fact_no for r in payloads.missing_facts(few, told, group_rows=5).collect()) == list(range(0, 10, 2))


def test_upsert_keeps_other_columns(spark):
    from newsloom.operators import sinks
    path = new_path(spark, "wide")
    rows = spark.createDataFrame([("A", 1, 1.0, "m", "note"), ("B", 1, 2.0, "m", "other")], "k string, v int, value double, month string, note string")
    sinks.upsert_table(spark, path, rows, ["k"], "v", "month")
    sinks.upsert_table(spark, path, spark.createDataFrame([("A", 2, 9.0, "m"), ("C", 1, 3.0, "m")], "k string, v int, value double, month string"), ["k"], "v", "month")
    assert sorted((r.k, r.value, r.note) for r in spark.read.parquet(path).collect()) == [("A", 9.0, "note"), ("B", 2.0, "other"), ("C", 3.0, None)]
    with pytest.raises(ValueError):
        sinks.upsert_table(spark, path, rows.withColumn("extra", F.lit(1)), ["k"], "v", "month")


def test_entries_of_all_connectors(spark):
    from newsloom.operators import ingest
    from newsloom.sources import entries
    from newsloom.sources import posts as channels
    bot = spark.createDataFrame([("s1", "c", '[{"id": 1, "text": "hello", "timestamp": 1704067200000}]', NOW)], "source_id string, channel_id string, body string, fetched_at timestamp")
    wall = spark.createDataFrame([("s2", '{"response": {"items": [{"id": 5, "owner_id": 7, "text": "wall"}]}}', NOW)], "source_id string, body string, fetched_at timestamp")
    pages = spark.createDataFrame([("s3", "https://a/1", "<body>" + "word " * 60 + "</body>", NOW)], "source_id string, url string, html string, fetched_at timestamp")
    read = articles.extract_articles(pages.withColumn("page_id", F.lit(1)), {"detail": {"body": {"css": "body"}}})
    found = [entries.entries(channels.bot_messages(bot)), entries.entries(channels.wall_posts(wall)),
             entries.entries(read, source_id=F.lit("s3"), content_text="body_text")]
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    assert rows.columns == list(entries.ENTRY)
    assert {(r.source_id, r.url, r.fetched_at is not None) for r in rows.collect()} == {
        ("s1", "max://c/1", True), ("s2", "https://vk.com/wall7_5", True), ("s3", "https://a/1", False)}
    # a source that isn't registered is judged by the global words; the summary counts for rules and regions
    sources = spark.createDataFrame([], "source_id string, include_keywords array<string>, exclude_keywords array<string>, match_whole_words boolean, "
                                        "competitor_id int, developer_id int, region_tags array<string>")
    entity = spark.createDataFrame([], "entity_id int, name string, aliases array<string>, tags array<string>, is_active boolean")
    told = spark.createDataFrame([("x", "https://a/2", "t", "Самара wanted", "", NOW, NOW), ("x", "https://a/3", "t", "other", "", NOW, NOW)],
                                 "source_id string, url string, title string, summary string, content_text string, published_at timestamp, fetched_at timestamp")
    got = ingest.enrich_items(told, sources, {"global_include_keywords": ["wanted"]}, entity, entity, regions(spark, ("A", ["Самара"])), F.lit(NOW)).collect()
    assert [(r.url, r.region_ids, r.content_text) for r in got] == [("https://a/2", ["1"], "")]


def test_text_index_reads_only_files_with_all_trigrams(spark):
    from newsloom.operators.textindex import TextIndex, literal_runs
    from newsloom.session import new_path

    assert literal_runs(r"%ab\%c_d%%e\\") == ["ab%c", "d", "e\\"]
    words = ["alpha", "beta", "Gamma", "ДЕЛЬТА", "100% sure", "under_score", "ab"]
    rows = [(i, f"{words[i // 20]} number {i}", None if i % 3 else "Other") for i in range(140)]
    path = new_path(spark, "texts")
    spark.createDataFrame(rows, "id int, title string, body string").repartitionByRange(7, "id").write.parquet(path)
    index = TextIndex(spark, path, new_path(spark, "trigrams"), ["title", "body"])
    index.build()
    whole = spark.read.parquet(path)
    for pattern in ("%gamma%", "%дельта number 6_", "100\\% s%", "%under\\_score%", "%a_pha%1%", "other", "%ab%", "%nothing here%", "%", "%nu%ber 13_"):
        plain = whole.where(F.ilike("title", F.lit(pattern)) | F.coalesce(F.ilike("body", F.lit(pattern)), F.lit(False)))
        assert sorted(r.id for r in index.search(pattern).collect()) == sorted(r.id for r in plain.collect()), pattern
    assert len(index.files("%gamma%")) == 1 and len(index.files("%nothing here%")) == 0 and len(index.files("%ab%")) == 7
    spark.createDataFrame([(999, "late gamma", None)], "id int, title string, body string").coalesce(1).write.mode("append").parquet(path)
    assert {r.id for r in index.search("%late gamma%").collect()} == {999}  # not indexed yet: read
    index.build()
    assert len(index.files("%gamma%")) == 2 and {r.id for r in index.search("%late gamma%").collect()} == {999}
