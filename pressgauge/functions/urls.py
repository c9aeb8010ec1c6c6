"""URL keys as native column expressions (no Python on the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that name a referrer or a campaign.
TRACKING_KEYS = (
    "fbclid", "gclid", "yclid", "msclkid", "from", "source", "ref", "share", "share_source",
    "amp", "at_medium", "at_campaign", "_gl",
)
TRACKING_PREFIX = "utm_"

#: RFC 3986, appendix B: scheme, authority, path, query.
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def strip(c: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.regexp_replace(c, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def is_tracking_key(key: Column) -> Column:
    low = F.lower(key)
    return low.isin(*TRACKING_KEYS) | low.startswith(TRACKING_PREFIX)


def _encode(c: Column) -> Column:
    # Java's form encoder keeps '*' and escapes '~'; the key format has it the other way round.
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decode(c: Column) -> Column:
    # A stray '%' is literal text, so only well-formed escapes may reach the decoder.
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonicalize(url: Column) -> Column:
    """Stable key of an article URL; NULL for an unusable port, the trimmed input when there is no host.

    https is forced, one leading ``www.`` and userinfo go, the scheme's own port goes (443 where there is no port of its
    own), a trailing ``/`` goes unless it is the root (of a path of several slashes all go), tracking parameters go, the rest is sorted by (key, value), the fragment goes.
    """
    u = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    part = lambda i: F.regexp_extract(u, _SPLIT, i)
    scheme = F.lower(part(1))
    hostport = F.regexp_replace(part(2), r"^.*@", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(hostport, r"^\[?([^\]]*?)\]?(?::[^:\]]*)?$", 1)), r"^www\.", "")
    port = F.regexp_extract(hostport, r":([^:\]]*)$", 1)
    number = port.try_cast("int")
    usable = (port == "") | (port.rlike("^[0-9]+$") & number.between(0, 65535))
    keep_port = (port != "") & (number != F.when(scheme == "http", 80).otherwise(443))
    path = F.when(part(3).isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(part(3), "/+$", ""))
    pairs = F.transform(
        F.filter(F.split(part(4), "&"), lambda s: s != ""),
        lambda s: F.struct(
            _decode(F.regexp_extract(s, r"^([^=]*)", 1)).alias("k"), _decode(F.regexp_extract(s, r"^[^=]*=([\s\S]*)$", 1)).alias("v")
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_tracking_key(p["k"])))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    netloc = F.when(keep_port, F.concat(host, F.lit(":"), number.cast("string"))).otherwise(host)
    full = F.concat(F.lit("https://"), netloc, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host == "", strip(url)).when(usable, full)


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; ``..`` at the root stays at the root, and a last dot segment leaves a slash."""
    parts = F.split(path, "/", -1)
    empty = F.expr("cast(array() as array<string>)")
    walked = F.aggregate(
        parts, empty,
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, s)),
    )
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    return F.when(F.concat(F.lit("/"), path, F.lit("/")).contains("/./") | F.concat(F.lit("/"), path, F.lit("/")).contains("/../"), F.array_join(F.concat(walked, last), "/")).otherwise(path)


def resolve(base: str, href: Column) -> Column:
    """Absolute URL of ``href`` on a page at ``base``: absolute, scheme-relative, rooted, query and plain relative forms.

    Outer blanks go; dot segments of rooted and relative paths are resolved.
    """
    from urllib.parse import urlsplit

    b = urlsplit(base)
    root, folder = f"{b.scheme}://{b.netloc}", b.path.rpartition("/")[0] + "/"
    ref = strip(href)
    path, rest = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*([\s\S]*)$", 1)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.lit(f"{b.scheme}:"), ref))
        .when(ref.startswith("/"), F.concat(F.lit(root), _without_dots(path), rest))
        .when(ref.startswith("?"), F.concat(F.lit(root + b.path), ref))
        .when(ref.startswith("#") | (ref == ""), F.concat(F.lit(base.partition("#")[0]), ref))
        .otherwise(F.concat(F.lit(root), _without_dots(F.concat(F.lit(folder if folder.startswith("/") else "/" + folder), path)), rest))
    )


def cache_path(outlet: Column, url_canonical: Column, seen_at: Column) -> Column:
    """Key of a stored page; the day is that of ``seen_at``, which a backfill never moves."""
    return F.concat(outlet, F.lit("/"), F.date_format(seen_at, "yyyy-MM-dd"), F.lit("/"), F.sha2(url_canonical, 256), F.lit(".html.gz"))
