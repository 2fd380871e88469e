"""URL columns, split by the RFC 3986 appendix B pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The RFC pattern with a scheme that must start with a letter, and the schemes
# whose URLs carry an authority part.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?:(//)([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
AUTHORITY_SCHEMES = ["ftp", "http", "https", "file", "sftp", "ws", "wss"]


def _part(u: Column, i: int) -> Column:
    return F.regexp_extract(u, PARTS, i)


def _decode(c: Column) -> Column:
    # a percent sign that starts no escape is kept as it is
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    # form encoding, except that the tilde stays and the asterisk is escaped
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _cleaned(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"[\t\r\n]", "")


def canonicalize_url(c: Column) -> Column:
    """Lower scheme and host, drop the fragment and utm_* parameters, re-encode the rest in order."""
    u = _cleaned(c)
    scheme = F.lower(F.when(_part(u, 1) == "", F.lit("http")).otherwise(_part(u, 1)))
    netloc = F.lower(_part(u, 3))
    path = _part(u, 4)
    pairs = F.transform(
        F.filter(F.split(_part(u, 5), "&", -1), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(p, r"(?s)^[^=]*=?(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.startswith(F.lower(p["k"]), F.lit("utm_")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    rooted = F.when((path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    has_authority = (netloc != "") | (scheme.isin(AUTHORITY_SCHEMES) & ~F.startswith(path, F.lit("//")))
    return F.concat(
        scheme, F.lit(":"),
        F.when(has_authority, F.concat(F.lit("//"), netloc, rooted)).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def host_key(c: Column) -> Column:
    """Lower-case host name without user info and port, or ``unknown``."""
    netloc = F.lower(_part(_cleaned(c), 3))
    host = F.regexp_extract(netloc, r"^(?:.*@)?(?:\[([^\]]*)\]|([^:\[\]]*))(?::.*)?$", 1)
    name = F.regexp_extract(netloc, r"^(?:.*@)?(?:\[([^\]]*)\]|([^:\[\]]*))(?::.*)?$", 2)
    found = F.concat(host, name)
    return F.when(found != "", found).otherwise(F.lit("unknown"))


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base`` (RFC 3986 section 5.2, dot segments removed)."""
    b, h = _cleaned(base), F.trim(href)
    scheme, root = _part(b, 1), F.concat(_part(b, 1), F.lit("://"), _part(b, 3))
    base_path, base_query = _part(b, 4), F.regexp_extract(b, r"^[^?#]*(\?[^#]*)", 1)
    own_scheme = _part(h, 1) != ""
    directory = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_extract(base_path, r"^(.*/)", 1))
    tail = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    path = _part(h, 4)
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(directory, path))
    return (F.when(h == "", b)
            .when(own_scheme, h)
            .when(_part(h, 2) == "//", F.concat(scheme, F.lit(":"), h))
            .when((path == "") & F.startswith(h, F.lit("?")), F.concat(root, base_path, tail))
            .when(path == "", F.concat(root, base_path, base_query, tail))
            .otherwise(F.concat(root, _without_dots(joined), tail)))


def _without_dots(path: Column) -> Column:
    ends_in_dots = path.rlike(r"/\.{1,2}$")
    parts = F.split(path, "/", -1)
    segments = F.slice(parts, 2, F.size(parts))
    walked = F.aggregate(
        segments, F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    resolved = F.concat(F.lit("/"), F.array_join(walked, "/"),
                        F.when(ends_in_dots & (F.size(walked) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), resolved).otherwise(path)
