"""URL algebra as native column functions: five normalisers, domains, filters, classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3986 parts: scheme, netloc, path, query, fragment.  Agrees with urlsplit.
RFC3986 = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

# Exclude patterns, extensions, priority patterns and classes of links.
EXCLUDE_PATTERNS = "/login /logout /signin /signout .pdf .doc .docx .xls .xlsx .zip .tar .gz .rar .jpg .jpeg .png .gif .svg javascript: mailto: tel:".split()
EXCLUDED_EXTENSIONS = (
    ".pdf .doc .docx .xls .xlsx .ppt .pptx .zip .rar .tar .gz .7z .jpg .jpeg .png .gif .bmp .svg .ico .webp"
    " .mp3 .mp4 .avi .mov .wmv .flv .wav .exe .msi .dmg .apk .deb .rpm"
).split()
EXCLUDE_PATTERNS_V2 = "/login /logout /signin /signup /search /cart /checkout .pdf .jpg .png .gif .zip /calendar /map /sitemap # javascript: mailto: tel:".split()
EXCLUDE_PATTERNS_V1 = "/login /logout /search .pdf .jpg .png .gif /calendar /map".split()
PRIORITY_PATTERNS_V2 = "/admission /apply /international /program /degree /graduate /undergraduate /research /faculty /about".split()
LINK_KEYWORDS_V2 = "admission apply international program graduate".split()
LINK_CLASSES_V2 = {
    "admission": "/admission /apply /application /enroll",
    "academic": "/program /course /academic /degree /major",
    "research": "/research /publication /paper /lab",
    "faculty": "/faculty /people /staff /professor",
    "international": "/international /global /abroad",
    "financial": "/financial /tuition /scholarship /aid",
    "news": "/news /blog /article /press",
    "event": "/event /conference /seminar",
    "about": "/about /history /mission",
}
LINK_CLASSES_V1 = {
    "research": "/research /publication /paper",
    "people": "/faculty /people /staff",
    "academic": "/program /course /academic",
    "news": "/news /blog /article",
    "event": "/event /conference",
}
TYPE_BONUS = {"admission": 3.0, "international": 2.5, "financial": 2.0, "academic": 1.5, "research": 1.0, "faculty": 0.5, "news": -0.5, "navigation": -1.0, "general": 0.0}


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, RFC3986, group)


def netloc(url: Column) -> Column:
    return part(url, 2)


def host(url: Column) -> Column:
    """Lowercased netloc with the port kept."""
    return F.lower(netloc(url))


def bare_host(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def host_without_www(url: Column) -> Column:
    """Host with every ``www.`` taken out."""
    return F.replace(host(url), F.lit("www."), F.lit(""))


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(part(url, 3), ";[^/]*$", "")


def normalize(url: Column, base: Column | None = None) -> Column:
    """Canonical form: absolute, no fragment, lower scheme and host, no default port, no
    trailing slashes but the root's, query kept as it is."""
    u = resolve(url, base) if base is not None else F.regexp_replace(url, "^//", "https://")
    # Each part is one chain of replacements, so the url is read three times, not dozens.
    prefix = F.lower(F.regexp_extract(u, "^((?:[^:/?#]+:)?(?://[^/?#]*)?)", 1))
    prefix = F.regexp_replace(F.regexp_replace(prefix, "^([^:/?#]+:)$", "$1//"), "^(http://.*):80$|^(https://.*):443$", "$1$2")
    p = F.regexp_replace(path(u), "/+$", "")
    return F.concat(prefix, F.coalesce(F.nullif(p, F.lit("")), F.lit("/")), F.regexp_extract(u, r"^[^?#]*(\?[^#]+)", 1))


def normalize_utils(url: Column) -> Column:
    """Trimmed, without fragment; null unless scheme and netloc are there."""
    u = F.regexp_replace(url, r"^\s+|\s+$", "")
    # Taking a fragment off writes the url anew, with its scheme in lower case.
    scheme = part(u, 1)
    u = F.when(F.contains(u, F.lit("#")), F.concat(F.lower(scheme), F.substring(F.regexp_replace(u, "#.*$", ""), F.length(scheme) + 1, F.length(u)))).otherwise(u)
    return F.when((part(u, 1) != "") & (netloc(u) != ""), u)


def normalize_v2(url: Column) -> Column:
    """Cut at the first ``#``, trailing slashes of the whole taken off."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def seed_key(url: Column) -> Column:
    """Host without any ``www.`` and path without trailing slashes, lowercased; scheme and query ignored."""
    return F.lower(F.concat(F.replace(netloc(url), F.lit("www."), F.lit("")), F.regexp_replace(path(url), "/+$", "")))


def link_key_v2(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\?.*$", ""), "#.*$", "")


def url_hash(url: Column) -> Column:
    return F.md5(normalize(url))


def same_domain_tail(a: Column, b: Column) -> Column:
    """Last two labels agree."""
    tail = lambda u: F.regexp_extract(host(u), r"([^.]*\.)?[^.]*$", 0)
    return tail(a) == tail(b)


def same_domain_exact(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def same_domain_v2(a: Column, b: Column) -> Column:
    """Equal or a dot-suffix of each other, without any ``www.``."""
    x, y = host_without_www(a), host_without_www(b)
    return (x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x))


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a reference (RFC 3986); ``without_dots`` takes dot segments out."""
    scheme, loc, dir_ = part(base, 1), netloc(base), F.regexp_replace(part(base, 3), "[^/]*$", "")
    root = F.concat(scheme, F.lit("://"), loc)
    whole = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(href == "", whole)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(whole, r"\?.*$", ""), href))
        .when(href.startswith("#"), F.concat(whole, href))
        .otherwise(F.concat(root, F.when(dir_ == "", F.lit("/")).otherwise(dir_), href))
    )


def without_dots(url: Column) -> Column:
    """An absolute url with the dot segments of its path taken out, as a fold over segments."""
    p = part(url, 3)
    segments = F.split(F.regexp_replace(p, "^/", ""), "/")
    up = lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda x, s: F.when(s == "..", up(x)).when(s == ".", x).otherwise(F.concat(x, F.array(s))))
    tail = F.when(p.rlike(r"(?:^|/)\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    path = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return F.when(p.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(F.regexp_extract(url, "^((?:[^:/?#]+:)?(?://[^/?#]*)?)", 1), path, rest)).otherwise(url)


def is_internal(link: Column, base: Column) -> Column:
    """The page's netloc is a substring of the link's; an empty one is in any."""
    return F.contains(netloc(link), netloc(base))


def is_internal_v2(link: Column, base: Column) -> Column:
    x, y = host_without_www(link), host_without_www(base)
    return (y != "") & ((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)))


def any_in(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a | F.contains(text, F.lit(p)), patterns, F.lit(False))


def first_in(text: Column, patterns: list[str]) -> Column:
    """The first of ``patterns``, in list order, that is a substring; null if none is."""
    out = None
    for p in patterns:
        hit = F.contains(text, F.lit(p))
        out = F.when(hit, F.lit(p)) if out is None else out.when(hit, F.lit(p))
    return out if out is not None else F.lit(None).cast("string")


def classify(url: Column, classes: dict[str, str] = LINK_CLASSES_V2) -> Column:
    """First class, in order, one of whose patterns is in the lowercased url; else general."""
    low, out = F.lower(url), None
    for name, patterns in classes.items():
        hit = any_in(low, patterns.split())
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise("general")


def to_filename(url: Column, max_length: int = 100) -> Column:
    """Scheme off, unsafe characters to ``_``; longer names end in a hash of the url."""
    name = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r'[<>:"/\\|?*]', "_")
    return F.when(F.length(name) > max_length, F.concat(F.substring(name, 1, max_length - 9), F.lit("_"), F.substring(F.md5(url), 1, 8))).otherwise(name)


def link_priority_v2(url: Column, text: Column) -> Column:
    low, t = F.lower(url), F.lower(F.coalesce(text, F.lit("")))
    score = F.when(any_in(low, PRIORITY_PATTERNS_V2), 10).otherwise(0) + F.when(F.length(F.coalesce(text, F.lit(""))) > 10, 3).otherwise(0)
    for kw in LINK_KEYWORDS_V2:
        score = score + F.when(F.contains(low, F.lit(kw)) | F.contains(t, F.lit(kw)), 2).otherwise(0)
    return score
