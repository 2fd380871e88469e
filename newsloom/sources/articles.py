"""Article extraction with per-template CSS selectors, one Arrow batch of pages at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_iso_ts

# Elements without content, elements whose text is not shown, elements whose text is no markup, blocks compared by the fallback,
# and the shortest body a template may deliver.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}
RAW = {"script", "style"}
BLOCKS = {"article", "main", "section", "div", "td", "body"}
# Open elements that a start tag closes, and elements such a search doesn't leave.
IMPLIED = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BARRIERS = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "body"}
MIN_BODY = 200

STEP = re.compile(r"([\w*-]+)?((?:[.#][\w-]+|\[[^\]]+\])*)")
FILTERS = re.compile(r"([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """All elements below in document order; a stack, as markup may be nested deeper than calls can be."""
        todo = self.children[::-1]
        while todo:
            child = todo.pop()
            if isinstance(child, Node):
                yield child
                todo += child.children[::-1]

    def texts(self):
        todo = self.children[::-1]
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                yield child
            elif child.tag not in HIDDEN:
                todo += child.children[::-1]

    def text(self):
        return " ".join(" ".join(self.texts()).split())

    def html(self):
        """The element and all below as markup; a stack of nodes, texts and end tags still to write."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                out.append(f"</{node[0]}>")
            elif isinstance(node, str):
                out.append(escape(node, quote=False))
            else:
                attrs = "".join(f" {k}" if v is None else f' {k}="{escape(v)}"' for k, v in node.attrs.items())
                if node.tag in VOID:
                    out.append(f"<{node.tag}{attrs}/>")
                    continue
                out.append(f"<{node.tag}{attrs}>")
                todo.append((node.tag,))
                if node.tag in RAW:
                    out += [c for c in node.children if isinstance(c, str)]
                else:
                    todo += node.children[::-1]
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = IMPLIED.get(tag, ())
        node = self.at
        while closes and node.parent is not None and node.tag not in closes and node.tag not in BARRIERS:
            node = node.parent
        if node.tag in closes:
            self.at = node.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _step_fits(node: Node, step: tuple) -> bool:
    tag, filters, _ = step
    if tag not in (None, "*") and node.tag != tag:
        return False
    for kind, name, attr, op, value in filters:
        if kind == "#" and node.attrs.get("id") != name:
            return False
        if kind == "." and name not in (node.attrs.get("class") or "").split():
            return False
        if attr:
            have = node.attrs.get(attr)
            tests = {"": have is not None, "=": have == value, "^=": (have or "").startswith(value),
                     "$=": (have or "").endswith(value), "*=": value in (have or ""), "~=": value in (have or "").split()}
            if not tests[op or ""]:
                return False
    return True


@lru_cache(maxsize=10_000)
def _compile(css: str) -> list[list[tuple]]:
    """Selector lists of descendant and child (>) steps made of tag, .class, #id and [attribute]."""
    out = []
    for one in css.split(","):
        steps, child = [], False
        for word in re.findall(r">|(?:\[[^\]]*\]|[^\s>])+", one):
            if word == ">":
                child = True
                continue
            step = STEP.fullmatch(word)
            if step is None:
                raise ValueError(f"unsupported selector: {css}")
            steps.append((step.group(1), FILTERS.findall(step.group(2)), child))
            child = False
        if not steps or child or steps[0][2]:
            raise ValueError(f"unsupported selector: {css}")
        out.append(steps)
    return out


def _fits(node: Node, steps: list[tuple]) -> bool:
    if not _step_fits(node, steps[-1]):
        return False
    # (element, step it fits): the steps before it must fit above
    if len(steps) == 1:
        return True
    seen, todo = set(), [(node, len(steps) - 1)]
    while todo:
        at, left = todo.pop()
        up = at.parent
        while up is not None and up.parent is not None:
            if _step_fits(up, steps[left - 1]):
                if left == 1:
                    return True
                if (up, left - 1) not in seen:
                    seen.add((up, left - 1))
                    todo.append((up, left - 1))
            if steps[left][2]:
                break
            up = up.parent
    return False


def select(root: Node, css: str | None) -> list[Node]:
    if not css:
        return []
    alternatives = _compile(css)
    return [n for n in root.walk() if any(_fits(n, steps) for steps in alternatives)]


def _value(root: Node, spec: dict | None) -> str | None:
    spec = spec or {}
    for node in select(root, spec.get("css"))[:1]:
        own = (node.attrs.get(spec["attr"]) or "").strip() if spec.get("attr") else ""
        return own or node.text() or None
    return None


def densest_block(root: Node) -> Node | None:
    """Fallback body: the block whose text, less the text inside links and nested blocks' chrome, is longest."""
    best, best_score = None, 0
    for node in root.walk():
        if node.tag in BLOCKS:
            text = sum(len(" ".join(c.text().split())) for c in node.children if isinstance(c, Node) and c.tag not in BLOCKS)
            linked = sum(len(a.text()) for c in node.children if isinstance(c, Node) and c.tag not in BLOCKS
                         for a in [c, *c.walk()] if a.tag == "a")
            if text - 2 * linked > best_score:
                best, best_score = node, text - 2 * linked
    return best


def extract(html: str, template: dict) -> tuple:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    root, detail = tree.root, template.get("detail") or {}
    page_title = next((n.text() for n in root.walk() if n.tag == "title"), None)
    for css in (template.get("cleanup") or {}).get("remove_css") or []:
        for node in select(root, css):
            if node.parent is not None and node in node.parent.children:
                node.parent.children.remove(node)
    title, date, author = (_value(root, detail.get(k)) for k in ("title", "date", "author"))
    body = next(iter(select(root, (detail.get("body") or {}).get("css"))), None)
    if body is None or len(body.text()) < int(template.get("min_fulltext_length") or MIN_BODY):
        body = densest_block(root) or body
        title = title or page_title or None
    text = body.text() if body else ""
    return title, date, author, text or None, body.html() if text else None


def extract_or_error(html: str, template: dict) -> tuple:
    """``extract`` and an error text: one page that can't be read must not fail its task."""
    try:
        return *extract(html, template), None
    except (RecursionError, AssertionError, LookupError, TypeError, ValueError) as e:
        return None, None, None, None, None, f"{type(e).__name__}: {e}"


SCHEMA = "title string, published_at_raw string, author string, body_text string, body_html string, error string"


def _selectors(template: dict) -> list[str]:
    found = [*((template.get("cleanup") or {}).get("remove_css") or [])]
    return found + [d["css"] for d in (template.get("detail") or {}).values() if isinstance(d, dict) and d.get("css")]


def extract_articles(pages: DataFrame, template: dict, page_id: str = "page_id", url: str = "url",
                     html: str = "html") -> DataFrame:
    """(page_id, url, title, published_at_raw, published_at, author, body_text, body_html, error) of each page.

    Selectors cover tag, .class, #id, [attribute], descendants and children; others are refused before the job starts. A body that is missing or shorter than
    ``min_fulltext_length`` is replaced by the densest text block of the page.
    """
    spec = json.dumps(template)
    for css in _selectors(template):
        _compile(css)
    id_type, url_type = dict(pages.dtypes)[page_id], dict(pages.dtypes)[url]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = json.loads(spec)
        for pdf in batches:
            rows = [extract_or_error(h, rules) for h in pdf[html]]
            found = pd.DataFrame(rows, columns=["title", "published_at_raw", "author", "body_text", "body_html", "error"], dtype=object)
            yield pd.concat([pdf[[page_id, url]].reset_index(drop=True), found], axis=1)

    out = pages.select(page_id, url, html).mapInPandas(run, f"{page_id} {id_type}, {url} {url_type}, {SCHEMA}")
    return out.withColumn("published_at", parse_iso_ts(F.col("published_at_raw")))


LINKS = "kind string, position int, href string"


def _list_links(html: str | None, item_css: str | None, next_css: str | None) -> list[tuple]:
    """('item', position, href) of the picked anchors and ('next', 0, href) of the first next-page anchor of a list page."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    found = [("item", i, n.attrs["href"]) for i, n in enumerate(select(tree.root, item_css or "a")) if n.attrs.get("href")]
    following = select(tree.root, next_css)[:1]
    return found + [("next", 0, n.attrs["href"]) for n in following if n.attrs.get("href")]


def crawl_lists(sources: DataFrame, pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source_id, page_no, page_url, position, url, canonical_url): the item links of the list pages of every source, each once.

    Sources have source_id, base_url, item_links_css, next_page_css and max_pages (null: all anchors, no next page, one page). From the
    base page on, the frontier of all sources moves one list page at a time: it is joined with the table of fetched pages, the
    selectors pick item and next links, and a next page is visited if its source has pages left and has not been there, by canonical url.
    List pages missing from ``pages`` end their source's walk. Of links that share a canonical url the first in page order stays.
    """
    from ..functions.urls import absolute_url, canonicalize_url
    from ..scale import keep_first
    from ..session import stage

    for r in sources.select(F.explode(F.array("item_links_css", "next_page_css")).alias("css")).where("css <> ''").distinct().toLocalIterator():
        _compile(r.css)
    rules = sources.select("source_id", "item_links_css", "next_page_css", F.coalesce("max_pages", F.lit(1)).alias("max_pages"))
    kind = dict(sources.dtypes)["source_id"]
    spark = sources.sparkSession

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(a, b, c, *link) for a, b, c, text, item, following in zip(*[pdf[x] for x in ("source_id", "page_no", "page_url", "_html", "item_links_css", "next_page_css")])
                    for link in _list_links(text, item, following)]
            yield pd.DataFrame(rows, columns=["source_id", "page_no", "page_url", "kind", "position", "href"])

    texts = pages.select(F.col(url).alias("page_url"), F.col(html).alias("_html"))
    frontier = stage(keep_first(sources.where("base_url <> ''").select("source_id", F.lit(0).alias("page_no"), F.col("base_url").alias("page_url")),
                                ["source_id"], ["page_url"]).withColumn("visited", canonicalize_url(F.col("page_url"))), "frontier")
    seen, found, no = frontier, None, 0
    while not frontier.isEmpty():
        # pages first: a url fetched twice is read once
        at = keep_first(texts.join(frontier.select("page_url").distinct(), "page_url", "left_semi"), ["page_url"], ["_html"])
        read = frontier.drop("visited").join(at, "page_url").join(rules, "source_id")
        links = stage(read.mapInPandas(pick, f"source_id {kind}, page_no int, page_url string, {LINKS}").withColumn(
            "url", absolute_url(F.col("page_url"), F.col("href"))).drop("href").where("url is not null"), "links")
        items = links.where("kind = 'item'").drop("kind")
        found = items if found is None else found.unionByName(items)
        no += 1
        following = links.where("kind = 'next'").join(rules.where(F.col("max_pages") > no).select("source_id"), "source_id", "left_semi").select(
            "source_id", F.lit(no).alias("page_no"), F.col("url").alias("page_url"), canonicalize_url(F.col("url")).alias("visited"))
        frontier = stage(following.join(seen.select("source_id", "visited"), ["source_id", "visited"], "left_anti").select(
            "source_id", "page_no", "page_url", "visited"), "frontier")
        seen = seen.unionByName(frontier)
    if found is None:
        return spark.createDataFrame([], f"source_id {kind}, page_no int, page_url string, position int, url string, canonical_url string")
    named = found.withColumn("canonical_url", canonicalize_url(F.col("url")))
    return keep_first(named, ["source_id", "canonical_url"], ["page_no", "position"]).select(
        "source_id", "page_no", "page_url", "position", "url", "canonical_url")


def selected_links(pages: DataFrame, css: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, page_url, position, href) of the anchors a selector picks on each page."""
    id_type = dict(pages.dtypes)[page_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pid, link, text in zip(pdf[page_id], pdf[url], pdf[html]):
                tree = Tree()
                tree.feed(text or "")
                tree.close()
                rows += [(pid, link, i, n.attrs["href"]) for i, n in enumerate(select(tree.root, css)) if n.attrs.get("href")]
            yield pd.DataFrame(rows, columns=[page_id, "page_url", "position", "href"])

    return pages.select(page_id, url, html).mapInPandas(run, f"{page_id} {id_type}, page_url string, position int, href string")
