"""URL canonicalisation and ids taken from URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellmatch.functions.text import let, regex_first

# Query parameters that only track the visitor (with the utm_ prefix).
TRACKING_PARAMS = ["utm", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid"]


def resolve_url(c: Column, base: str) -> Column:
    """Absolute URL of a link found under ``base`` (scheme and host only)."""
    root = base.rstrip("/")
    scheme = root.split(":", 1)[0]
    return let(F.trim(c), lambda t: _resolved(t, root, scheme))


def _resolved(t: Column, root: str, scheme: str) -> Column:
    return (
        F.when(F.length(t) == 0, F.lit(None).cast("string"))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), t)
        .when(t.startswith("//"), F.concat(F.lit(scheme + ":"), t))
        .when(t.startswith("/"), F.concat(F.lit(root), t))
        .otherwise(F.concat(F.lit(root + "/"), t))
    )


def url_host(c: Column) -> Column:
    return F.lower(regex_first(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def url_path(c: Column) -> Column:
    return regex_first(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(/[^?#]*)")


def _port(c: Column) -> Column:
    return regex_first(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#:]+(:\d+)")


def _query(c: Column) -> Column:
    return regex_first(c, r"^[^?#]*\?([^#]*)")


def canonical_url(c: Column, force_https: bool = True, strip_query: bool = False) -> Column:
    """Lower-case host, no fragment, no tracking parameters, no trailing slash; http(s) only."""
    return let(c, lambda u: _canonical(u, force_https, strip_query))


def _canonical(u: Column, force_https: bool, strip_query: bool) -> Column:
    scheme = F.lower(regex_first(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://"))
    path = F.regexp_replace(F.coalesce(url_path(u), F.lit("")), "/+$", "")
    name = lambda p: F.lower(F.get(F.split(p, "="), F.lit(0)))
    kept = F.filter(
        F.split(_query(u), "&"),
        lambda p: ~name(p).startswith("utm_") & ~name(p).isin(TRACKING_PARAMS) & (F.length(p) > 0),
    )
    query = F.lit("") if strip_query else F.array_join(kept, "&")
    out = F.concat(
        F.lit("https") if force_https else scheme,
        F.lit("://"),
        url_host(u),
        F.coalesce(_port(u), F.lit("")),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(scheme.isin("http", "https"), out)


def same_origin(c: Column, base: str) -> Column:
    """Host equals the host of ``base`` (scheme is forced to https beforehand)."""
    host = base.split("://", 1)[-1].split("/", 1)[0].lower()
    return url_host(c) == F.lit(host)


def is_http_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(False))


def looks_like_url(c: Column) -> Column:
    """Absolute URL check of the quality gate: any scheme, and a host for http(s)."""
    other = c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~c.rlike(r"(?i)^https?:")
    return F.coalesce(is_http_url(c) | other, F.lit(False))


def is_rent_search_url(c: Column) -> Column:
    """Path speaks of flats to rent and not of buying."""
    path = F.lower(F.coalesce(url_path(c), F.lit("")))
    return ~path.contains("kaufen") & path.rlike("mieten|wohnung|wohnungen")


# External ids by URL shape, name → ordered patterns, group 1 is the id.
ID_PATTERNS = {
    "expose": [r"(?iu)/expose/([^/?#]+)/?(?:[?#].*)?$", r"/immobilien/[^/?#]*-([A-Za-z0-9]+)/?(?:[?#].*)?$"],
    "detail": [r"(?iu)/immobilien/detail/([^/?#]+)"],
    "immodetail": [r"/immodetail/(\d+)(?:[/?#]|$)"],
    "numeric_html": [r"\.([0-9]+)\.html(?:[?#].*)?$", r"/([0-9]+)\.html(?:[?#].*)?$"],
}


def external_id(c: Column, shape: str) -> Column:
    """Id inside a detail URL; the numeric-html shape falls back to the last path segment."""
    return let(c, lambda u: _external_id(u, shape))


def _external_id(u: Column, shape: str) -> Column:
    found = [regex_first(u, p) for p in ID_PATTERNS[shape]]
    if shape == "numeric_html":
        segments = F.filter(F.split(F.coalesce(url_path(u), F.lit("")), "/"), lambda s: s != "")
        found.append(F.regexp_replace(F.try_element_at(segments, F.lit(-1)), r"(?i)\.html$", ""))
    picked = F.coalesce(*found)
    if shape in ("expose", "detail"):
        return let(picked, lambda p: F.trim(F.coalesce(F.try_url_decode(p), p)))
    return picked


def image_key(c: Column) -> Column:
    """Two URLs with the same 'id' parameter, else the same path, are one image."""
    return F.coalesce(regex_first(c, r"[?&]id=([^&#]*)"), url_path(c), c)


def distinct_by(urls: Column, key) -> Column:
    """Order-preserving distinct of an array by a derived key."""
    keys = F.transform(urls, key)
    return F.filter(urls, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def image_list(gallery: Column, thumbs: Column, meta: Column, base: str, path_prefix: str | None = None) -> Column:
    """Gallery before thumbnails before the meta image; resolved, filtered, deduplicated."""
    none = F.array().cast("array<string>")
    g, t = F.coalesce(gallery, none), F.coalesce(thumbs, none)
    picked = F.when(F.size(g) > 0, g).when(F.size(t) > 0, t).otherwise(F.filter(F.array(meta), lambda x: x.isNotNull()))
    urls = F.transform(picked, lambda u: resolve_url(u, base))
    ok = lambda u: is_http_url(u) & ~F.coalesce(u.rlike("(?iu)obj_img_placeholder|objnoimg"), F.lit(False))
    if path_prefix:
        kept = F.filter(urls, lambda u: ok(u) & F.coalesce(url_path(u).startswith(path_prefix), F.lit(False)))
    else:
        kept = F.filter(urls, ok)
    return distinct_by(kept, image_key)
