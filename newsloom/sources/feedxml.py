"""The entries of one feed body, pulled out of an XML event stream.

Names are resolved by namespace, and by their usual prefix where a feed does not declare one. HTML entities, bare ampersands and control characters
are repaired outside of CDATA sections. When the XML breaks, the entry it breaks in is lost and reading goes on at the next one.
"""

from __future__ import annotations

import html.entities
import re
from urllib.parse import urljoin
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

# Namespaces of feed elements.
NAMESPACES = {
    "http://purl.org/rss/1.0/": "core", "http://my.netscape.com/rdf/simple/0.9/": "core", "http://backend.userland.com/rss2": "core",
    "http://www.w3.org/2005/Atom": "atom", "http://purl.org/atom/ns#": "atom",
    "http://purl.org/rss/1.0/modules/content/": "content", "http://purl.org/dc/elements/1.1/": "dc", "http://purl.org/dc/terms/": "dcterms",
    "http://search.yahoo.com/mrss/": "media", "http://search.yahoo.com/mrss": "media",
    "http://www.itunes.com/dtds/podcast-1.0.dtd": "itunes", "http://www.w3.org/1999/xhtml": "xhtml",
}
PREFIXES = {"atom", "content", "dc", "dcterms", "media", "itunes", "xhtml"}
#: (namespace, element) → what it is; of several elements for one field the first of FALLBACKS counts
FIELDS = {
    ("core", "title"): "title", ("dc", "title"): "title_dc", ("media", "title"): "title_media",
    ("core", "link"): "link", ("core", "guid"): "guid", ("core", "id"): "id", ("atom", "id"): "id",
    ("core", "description"): "summary", ("core", "summary"): "summary", ("atom", "summary"): "summary", ("itunes", "summary"): "summary_itunes",
    ("media", "description"): "summary_media", ("dc", "description"): "summary_dc",
    ("content", "encoded"): "content", ("core", "content"): "content", ("atom", "content"): "content", ("xhtml", "body"): "content",
    ("core", "pubdate"): "published", ("core", "published"): "published", ("atom", "published"): "published", ("core", "issued"): "published",
    ("dc", "date"): "published_dc", ("dcterms", "issued"): "published_dc", ("dcterms", "created"): "published_dc",
    ("core", "updated"): "updated", ("atom", "updated"): "updated", ("core", "modified"): "updated", ("dcterms", "modified"): "updated",
}
FALLBACKS = {"title": ("title", "title_dc", "title_media"), "summary": ("summary", "summary_itunes", "summary_media", "summary_dc"), "content": ("content",),
             "published": ("published", "published_dc"), "updated": ("updated",)}
RICH = {"summary", "content"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ROOTS = {"feed", "rss", "rdf"}
ENTRY = re.compile(rb"<(?:[A-Za-z_][\w.\-]*:)?(?:item|entry)(?=[\s>/])")
ODD = re.compile(rb"<!\[CDATA\[.*?\]\]>|<!--.*?-->|&(#\d+;|#[xX][0-9a-fA-F]+;|[A-Za-z][\w.\-]*;)?", re.S)
CONTROL = bytes(c for c in range(32) if c not in (9, 10, 13))


def _repaired(match: re.Match) -> bytes:
    whole, entity = match.group(), match.group(1)
    if whole[:1] == b"<":
        return whole
    if entity is None:
        return b"&amp;"
    name = entity[:-1].decode("ascii", "replace")
    if name.startswith("#") or name in ("amp", "lt", "gt", "quot", "apos"):
        return whole
    known = html.entities.html5.get(name + ";")
    return "".join(f"&#{ord(c)};" for c in known).encode() if known else b"&amp;" + entity


def repaired(body: bytes) -> bytes:
    """Well-formed wherever only entities, ampersands or control characters are to blame."""
    body = body.translate(None, CONTROL).replace(b"\xef\xbf\xbe", b"").replace(b"\xef\xbf\xbf", b"")
    return body if b"&" not in body or b"<!ENTITY" in body else ODD.sub(_repaired, body)


class NoFeed(Exception):
    pass


class FeedReader:
    """``entries`` (None for each one that broke) and ``error`` of one body."""

    def __init__(self, body: bytes | None):
        self.entries: list[dict | None] = []
        self.error: str | None = None
        self.root: str | None = None
        self.root_uri, self.around = "", {}
        data = repaired((body or b"").lstrip())
        at, prologue = 0, b""
        while True:
            self._begin(at - len(prologue))
            try:
                if prologue:
                    self.parser.Parse(prologue, False)
                self.parser.Parse(memoryview(data)[at:], True)
                break
            except NoFeed:
                self.error = "no feed"
                break
            except expat.ExpatError as e:
                self.error = self.error or expat.errors.messages[e.code]
                reached = max(self.parser.ErrorByteIndex + self.offset, at + 1)
                if self.entry is not None:
                    self.entries.append(None)
                    reached = self.entry_at + 1
                following = ENTRY.search(data, reached) if self.root else None
                if following is None:
                    break
                at = following.start()
                names = "".join(f" {'xmlns:' + k if k else 'xmlns'}={quoteattr(v)}" for k, v in self.around.items() if k != "xml:base")
                prologue = f"<{self.root}{names}>".encode()

    def _begin(self, offset: int) -> None:
        self.parser = p = expat.ParserCreate("utf-8")
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text
        self.offset, self.scopes, self.depth = offset, [dict(self.around)], 0
        self.entry = self.field = None
        self.entry_at = self.entry_depth = self.field_depth = 0

    def _kind(self, prefix: str, scope: dict) -> str:
        uri = scope.get(prefix, "")
        if (uri == self.root_uri and (uri or not prefix)) or not (uri or prefix):
            return "core"
        return NAMESPACES.get(uri) or (prefix if prefix in PREFIXES else "other")

    def _start(self, name: str, attrs: dict) -> None:
        self.depth += 1
        scope = self.scopes[-1]
        own = {k[6:]: v for k, v in attrs.items() if k == "xmlns" or k.startswith("xmlns:")}
        if "xml:base" in attrs:
            own["xml:base"] = urljoin(scope.get("xml:base", ""), attrs["xml:base"])
        self.scopes.append({**scope, **own} if own else scope)
        scope = self.scopes[-1]
        prefix, _, local = name.rpartition(":")
        if self.root is None:
            if local.lower() not in ROOTS:
                raise NoFeed
            self.root, self.root_uri, self.around = name, scope.get(prefix, ""), scope
            return
        if self.field is not None:
            if self.rich:
                kept = "".join(f" {k}={quoteattr(v)}" for k, v in attrs.items() if not k.startswith("xmlns"))
                self.parts.append(f"<{local}{kept}>")
            return
        kind, local = self._kind(prefix, scope), local.lower()
        if local in ("item", "entry") and kind in ("core", "atom"):
            if self.entry is None:
                self.around = self.scopes[-2]
            else:  # the one before has no end
                self.entries.append(None)
            self.entry, self.entry_depth, self.entry_at = {"links": []}, self.depth, self.parser.CurrentByteIndex + self.offset
        elif self.entry is not None and (self.depth == self.entry_depth + 1 or kind == "media"):
            href = attrs.get("href")
            if local == "link" and kind in ("core", "atom") and href is not None:
                self.entry["links"].append((attrs.get("rel") or "alternate", urljoin(scope.get("xml:base", ""), href.strip())))
                return
            field = FIELDS.get((kind, local))
            if field == "guid" and attrs.get("isPermaLink") == "false":
                field = "id"  # names the entry, but is no address
            if field and field not in self.entry:
                self.field, self.field_depth, self.parts = field, self.depth, []
                self.rich, self.escaped = field.split("_")[0] in RICH, attrs.get("type") == "xhtml" or kind == "xhtml"

    def _text(self, data: str) -> None:
        if self.field is not None:
            self.parts.append(escape(data) if self.escaped else data)

    def _end(self, name: str) -> None:
        self.scopes.pop()
        if self.field is not None:
            if self.depth == self.field_depth:
                self.entry[self.field] = "".join(self.parts)
                self.field = None
            elif self.rich and (local := name.rpartition(":")[2]) not in VOID:
                self.parts.append(f"</{local}>")
        elif self.entry is not None and self.depth == self.entry_depth:
            self.entries.append(self.entry)
            self.entry = None
        self.depth -= 1


def entry_url(entry: dict) -> str | None:
    """Address of an entry: its link, an alternate link, what identifies it, any other link."""
    alternate = [h for r, h in entry["links"] if r == "alternate"]
    found = [entry.get("link"), *alternate, entry.get("guid"), entry.get("id"), *[h for _, h in entry["links"]]]
    return next((u.strip() for u in found if u and u.strip()), None)


def entry_value(entry: dict, field: str) -> str | None:
    """The first filled element of a field; an empty one if none is filled."""
    values = [entry[k] for k in FALLBACKS[field] if k in entry]
    return next((v for v in values if v.strip()), values[0] if values else None)
