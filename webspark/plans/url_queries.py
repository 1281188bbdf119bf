"""Queries over urls: normal forms, domains, filters, classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import dedup, links
from .registry import query

RX = U.RFC3986
#: Patterns and hosts that occur in crawled data, so that every branch is taken.
PATTERNS = ["/jobs", "/contact", "page-", "/login"]
EXTENSIONS = [".html", ".php", "1", "2"]
ALLOWED = ["-lab", "-museum", "-post", "-press", "-college", ".test"]


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


def part(u: str, i: int) -> str:
    return f"regexp_extract({u}, '{RX}', {i})"


def sql_norm(u: str) -> str:
    """The canonical form in SQL."""
    u = f"(CASE WHEN {u} LIKE '//%' THEN 'https:' || {u} ELSE {u} END)"
    scheme, loc = f"lower({part(u, 1)})", f"lower({part(u, 2)})"
    loc = f"(CASE WHEN {scheme}='http' THEN regexp_replace({loc}, ':80$', '') WHEN {scheme}='https' THEN regexp_replace({loc}, ':443$', '') ELSE {loc} END)"
    path = f"regexp_replace({part(u, 3)}, ';[^/]*$', '')"
    path = f"(CASE WHEN {path}='/' THEN '/' WHEN regexp_replace({path}, '/+$', '')='' THEN '/' ELSE regexp_replace({path}, '/+$', '') END)"
    return (
        f"(CASE WHEN {scheme}<>'' THEN {scheme} || ':' ELSE '' END || CASE WHEN {loc}<>'' OR {scheme}<>'' THEN '//' || {loc} ELSE '' END || {path}"
        f" || CASE WHEN {part(u, 4)}<>'' THEN '?' || {part(u, 4)} ELSE '' END)"
    )


def host(u: str) -> str:
    return f"lower({part(u, 2)})"


def any_in(text: str, patterns) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in patterns) + ")"


def sql_class(u: str, classes) -> str:
    return "CASE " + " ".join(f"WHEN {any_in(f'lower({u})', p.split())} THEN '{c}'" for c, p in classes.items()) + " ELSE 'general' END"


_URLS = "(SELECT DISTINCT url FROM extracted_links WHERE url IS NOT NULL UNION SELECT DISTINCT final_url FROM fetch_results WHERE final_url IS NOT NULL)"


def _urls(extracted_links, fetch_results):
    return extracted_links.select("url").unionAll(fetch_results.select(F.col("final_url").alias("url"))).where("url is not null").distinct()


@query("extracted_links", "fetch_results", sql=f"SELECT url, {sql_norm('url')} AS norm, md5({sql_norm('url')}) AS url_hash FROM {_URLS}")
def url_normalize(extracted_links, fetch_results):
    """Canonical urls and their hashes."""
    return _urls(extracted_links, fetch_results).select("url", U.normalize(F.col("url")).alias("norm"), U.url_hash(F.col("url")).alias("url_hash"))


_STRIPPED = "regexp_replace(url, '^\\s+|\\s+$', '', 'g')"
_TRIM = f"(CASE WHEN contains({_STRIPPED}, '#') THEN lower({part(_STRIPPED, 1)}) || substr(regexp_replace({_STRIPPED}, '#.*$', ''), length({part(_STRIPPED, 1)}) + 1) ELSE {_STRIPPED} END)"


@query(
    "extracted_links",
    "fetch_results",
    sql=f"""SELECT url, CASE WHEN {part(_TRIM, 1)}<>'' AND {part(_TRIM, 2)}<>'' THEN {_TRIM} END AS utils_form,
    regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS v2_form,
    lower(replace({part('url', 2)}, 'www.', '') || regexp_replace(regexp_replace({part('url', 3)}, ';[^/]*$', ''), '/+$', '')) AS seed_key,
    regexp_replace(regexp_replace(regexp_replace(url, '/+$', ''), '\\?.*$', ''), '#.*$', '') AS link_key FROM {_URLS}""",
)
def url_variants(extracted_links, fetch_results):
    """The four other normal forms."""
    u = F.col("url")
    return _urls(extracted_links, fetch_results).select(
        "url", U.normalize_utils(u).alias("utils_form"), U.normalize_v2(u).alias("v2_form"), U.seed_key(u).alias("seed_key"), U.link_key_v2(u).alias("link_key")
    )


@query(
    "fetch_results",
    sql=f"""SELECT {host('final_url')} AS host, regexp_replace({host('final_url')}, '^www\\.', '') AS bare_host, replace({host('final_url')}, 'www.', '') AS v2_host,
    count(*) AS n_pages, count(DISTINCT final_url) AS n_urls FROM fetch_results WHERE final_url IS NOT NULL GROUP BY 1, 2, 3""",
)
def url_domain_counts(fetch_results):
    """Pages and different urls by domain, in the forms a domain has."""
    u = F.col("final_url")
    hosts = fetch_results.where("final_url is not null").select(U.host(u).alias("host"), "final_url")
    by_url = hosts.groupBy("host", "final_url").agg(F.count("*").alias("n"))
    counts = by_url.groupBy("host").agg(F.sum("n").alias("n_pages"), F.count("*").alias("n_urls"))
    return counts.select("host", F.regexp_replace("host", r"^www\.", "").alias("bare_host"), F.replace("host", F.lit("www."), F.lit("")).alias("v2_host"), "n_pages", "n_urls")


def _v2(u):
    return f"replace({host(u)}, 'www.', '')"


@query(
    "fetch_results",
    "extracted_links",
    sql=f"""SELECT DISTINCT l.url AS link, f.final_url AS page,
    regexp_extract({host('l.url')}, '([^.]*\\.)?[^.]*$', 0) = regexp_extract({host('f.final_url')}, '([^.]*\\.)?[^.]*$', 0) AS same_tail,
    {host('l.url')} = {host('f.final_url')} AS same_exact,
    ({_v2('l.url')} = {_v2('f.final_url')} OR {_v2('l.url')} LIKE '%.' || {_v2('f.final_url')} OR {_v2('f.final_url')} LIKE '%.' || {_v2('l.url')}) AS same_v2,
    contains({part('l.url', 2)}, {part('f.final_url', 2)}) AS internal,
    {_v2('f.final_url')} <> '' AND ({_v2('l.url')} = {_v2('f.final_url')} OR {_v2('l.url')} LIKE '%.' || {_v2('f.final_url')} OR {_v2('f.final_url')} LIKE '%.' || {_v2('l.url')}) AS internal_v2
    FROM extracted_links l JOIN fetch_results f USING (fetch_id) WHERE l.url IS NOT NULL AND f.final_url IS NOT NULL""",
)
def same_site_links(fetch_results, extracted_links):
    """Whether each link stays on its page's site, by the five definitions."""
    a, b = F.col("link"), F.col("page")
    rows = extracted_links.select("fetch_id", F.col("url").alias("link")).join(fetch_results.select("fetch_id", F.col("final_url").alias("page")), "fetch_id")
    rows = rows.where("link is not null and page is not null").select("link", "page").distinct()
    return rows.select(
        "link",
        "page",
        U.same_domain_tail(a, b).alias("same_tail"),
        U.same_domain_exact(a, b).alias("same_exact"),
        U.same_domain_v2(a, b).alias("same_v2"),
        U.is_internal(a, b).alias("internal"),
        U.is_internal_v2(a, b).alias("internal_v2"),
    )


_NAME = "regexp_replace(regexp_replace(url, '^https?://', ''), '[<>:\"/\\\\|?*]', '_', 'g')"


@query(
    "extracted_links",
    sql=f"""SELECT DISTINCT url, CASE WHEN length({_NAME}) > 60 THEN substr({_NAME}, 1, 51) || '_' || substr(md5(url), 1, 8) ELSE {_NAME} END AS filename FROM extracted_links WHERE url IS NOT NULL""",
)
def url_filename(extracted_links):
    """File names of urls."""
    return extracted_links.where("url is not null").select("url").distinct().select("url", U.to_filename(F.col("url"), 60).alias("filename"))


@query(
    "extracted_links",
    sql=f"""SELECT url, {sql_class('url', U.LINK_CLASSES_V2)} AS class_v2, {sql_class('url', U.LINK_CLASSES_V1)} AS class_v1, count(*) AS n_links
    FROM extracted_links WHERE url IS NOT NULL GROUP BY url""",
)
def link_classify(extracted_links):
    """Classes of link targets, both rule sets."""
    u = F.col("url")
    n = extracted_links.where("url is not null").groupBy("url").agg(F.count("*").alias("n_links"))
    return n.select("url", U.classify(u).alias("class_v2"), U.classify(u, U.LINK_CLASSES_V1).alias("class_v1"), "n_links")


def sql_reason(u: str, allowed, patterns, extensions) -> str:
    low = f"lower({part(u, 3)})"
    return (
        f"CASE WHEN coalesce({u}, '')='' THEN 'empty' WHEN lower({part(u, 1)}) NOT IN ('http', 'https') THEN 'scheme'"
        + (f" WHEN NOT {any_in(host(u), allowed)} THEN 'domain'" if allowed else "")
        + "".join(f" WHEN contains({u}, '{p}') THEN 'pattern:{p}'" for p in patterns)
        + "".join(f" WHEN {low} LIKE '%{e}' THEN 'extension:{e}'" for e in extensions)
        + " ELSE 'allowed' END"
    )


@query("queue_items", sql=f"SELECT DISTINCT url, {sql_reason('url', ALLOWED, PATTERNS, EXTENSIONS)} AS reason, {sql_reason('url', [], U.EXCLUDE_PATTERNS, U.EXCLUDED_EXTENSIONS)} AS default_reason FROM queue_items")
def url_filter_reason(queue_items):
    """Why urls are not admitted, first failure first."""
    u = F.col("url")
    return queue_items.select("url").distinct().select("url", links.filter_reason(u, ALLOWED, PATTERNS, EXTENSIONS).alias("reason"), links.filter_reason(u, []).alias("default_reason"))


@query("queue_items", sql=f"SELECT {sql_reason('url', ALLOWED, PATTERNS, EXTENSIONS)} AS reason, count(*) AS n FROM queue_items GROUP BY 1")
def url_filter_summary(queue_items):
    """Rows by filter reason."""
    return queue_items.groupBy(links.filter_reason(F.col("url"), ALLOWED, PATTERNS, EXTENSIONS).alias("reason")).agg(F.count("*").alias("n"))


_BARE = f"regexp_replace({host('url')}, '^www\\.', '')"


@query(
    "queue_items",
    sql=f"""SELECT DISTINCT url, {part('url', 1)} IN ('http', 'https') AND {_BARE} <> '' AND NOT {any_in('lower(url)', PATTERNS)}
    AND ({' OR '.join(f"contains({_BARE}, '{a}') OR contains('{a}', {_BARE})" for a in ALLOWED)}) AS fetchable,
    {part('url', 1)} IN ('http', 'https') AND {part('url', 2)} <> '' AND NOT {any_in('lower(url)', U.EXCLUDE_PATTERNS_V2[:-4])} AS valid_v2,
    {part('url', 1)} IN ('http', 'https') AND {part('url', 2)} <> '' AND NOT {any_in('lower(url)', U.EXCLUDE_PATTERNS_V1)} AS valid_v1 FROM queue_items WHERE url IS NOT NULL""",
)
def url_gates(queue_items):
    """Gates of the fetchers and of the two older link filters."""
    u = F.col("url")
    return queue_items.where("url is not null").select("url").distinct().select(
        "url",
        links.fetch_gate(u, ALLOWED, PATTERNS).alias("fetchable"),
        links.valid_link(u, U.EXCLUDE_PATTERNS_V2[:-4]).alias("valid_v2"),
        links.valid_link(u, U.EXCLUDE_PATTERNS_V1).alias("valid_v1"),
    )


@query(
    "queue_items",
    "fetch_results",
    sql=f"""SELECT DISTINCT url FROM queue_items q WHERE url IS NOT NULL AND {any_in(_BARE, ALLOWED)} AND NOT {any_in('lower(url)', PATTERNS)}
    AND NOT EXISTS (SELECT 1 FROM fetch_results f WHERE md5({sql_norm('f.final_url')}) = md5({sql_norm('q.url')}))""",
)
def visit_filter(queue_items, fetch_results):
    """Urls still to visit: allowed, no pattern, not fetched yet (anti-join on the hash)."""
    u = F.col("url")
    ok = queue_items.where("url is not null").select("url").distinct().where(U.any_in(U.bare_host(u), ALLOWED) & ~U.any_in(F.lower(u), PATTERNS))
    done = fetch_results.where("final_url is not null").select(U.url_hash(F.col("final_url")).alias("url_hash"))
    return dedup.not_in(ok.withColumn("url_hash", U.url_hash(u)), done, "url_hash").select("url")


@query(
    "seed_urls",
    sql=f"""WITH r AS (SELECT DISTINCT url FROM seed_urls WHERE url IS NOT NULL), h AS (SELECT * FROM (VALUES ('a/b'), ('/c'), ('?q=1'), ('#f'), ('//x.test/y'), ('https://z.test/'), ('')) v(href))
    SELECT url, href, CASE WHEN href='' THEN regexp_replace(url, '#.*$', '') WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
    WHEN href LIKE '//%' THEN {part('url', 1)} || ':' || href WHEN href LIKE '/%' THEN {part('url', 1)} || '://' || {part('url', 2)} || href
    WHEN href LIKE '?%' THEN regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') || href WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href
    ELSE {part('url', 1)} || '://' || {part('url', 2)} || CASE WHEN regexp_replace({part('url', 3)}, '[^/]*$', '')='' THEN '/' ELSE regexp_replace({part('url', 3)}, '[^/]*$', '') END || href END AS resolved
    FROM r, h""",
)
def url_resolve(seed_urls):
    """Absolute forms of the kinds of references."""
    hrefs = F.array(*(F.lit(h) for h in ("a/b", "/c", "?q=1", "#f", "//x.test/y", "https://z.test/", "")))
    rows = seed_urls.where("url is not null").select("url").distinct().select("url", F.explode(hrefs).alias("href"))
    return rows.select("url", "href", U.resolve(F.col("href"), F.col("url")).alias("resolved"))


#: References with dot segments and what they come to (RFC 3986, 5.4), as fixed values.
DOTS = [
    ("http://a/b/c/d;p?q", "./g", "http://a/b/c/g"), ("http://a/b/c/d;p?q", "g/", "http://a/b/c/g/"), ("http://a/b/c/d;p?q", ".", "http://a/b/c/"), ("http://a/b/c/d;p?q", "./", "http://a/b/c/"),
    ("http://a/b/c/d;p?q", "..", "http://a/b/"), ("http://a/b/c/d;p?q", "../", "http://a/b/"), ("http://a/b/c/d;p?q", "../g", "http://a/b/g"), ("http://a/b/c/d;p?q", "../..", "http://a/"),
    ("http://a/b/c/d;p?q", "../../g", "http://a/g"), ("http://a/b/c/d;p?q", "../../../g", "http://a/g"), ("http://a/b/c/d;p?q", "/./g", "http://a/g"), ("http://a/b/c/d;p?q", "/../g", "http://a/g"),
    ("http://a/b/c/d;p?q", "g.", "http://a/b/c/g."), ("http://a/b/c/d;p?q", "..g", "http://a/b/c/..g"), ("http://a/b/c/d;p?q", "./../g", "http://a/b/g"), ("http://a/b/c/d;p?q", "g/./h", "http://a/b/c/g/h"),
    ("http://a/b/c/d;p?q", "g/../h", "http://a/b/c/h"), ("http://a/b/c/d;p?q", "g?y/./x", "http://a/b/c/g?y/./x"), ("http://a/b/c/d;p?q", "g#s/../x", "http://a/b/c/g#s/../x"), ("http://a/b/c/d;p?q", "?y", "http://a/b/c/d;p?y"),
]


@query("seed_urls", sql="SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{h}', '{u}')" for b, h, u in DOTS) + ") v(base, href, url)")
def resolve_dots(seed_urls):
    """References with dot segments made absolute, against the standard's examples."""
    rows = seed_urls.sparkSession.createDataFrame([(b, h) for b, h, _ in DOTS], "base string, href string")
    return rows.select("base", "href", U.without_dots(U.resolve(F.col("href"), F.col("base"))).alias("url"))
