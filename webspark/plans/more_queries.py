"""Queries over older rule sets, stages and model steps that have deterministic answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from ..functions import values as V
from ..operators import dedup, links, score
from ..operators.rank import top_per
from .crawl_queries import KEYWORDS, sql_hits
from .registry import query
from .text_queries import _TITLE, collapse, first_of, page_text_sql, words
from .url_queries import PATTERNS, any_in, host, part, sql_class


@query(
    "fetch_results",
    sql=f"""WITH p AS (SELECT fetch_id, {_TITLE} AS title, {page_text_sql('html')} AS text, coalesce({first_of('(?is)<meta[^>]*name=["' + chr(39) + ']description["' + chr(39) + '][^>]*content=["' + chr(39) + ']([^"' + chr(39) + ']*)')}, '') AS description, html FROM fetch_results)
    SELECT fetch_id, title, description, CAST(len({words('text')}) AS INT) AS word_count, substr(md5(coalesce(html, '')), 1, 16) AS html_hash, substr(sha256(text), 1, 16) AS content_hash, length(text) > 5000 AS text_truncated,
    coalesce(html, '') <> '' AS success, CASE WHEN coalesce(html, '') = '' THEN 'empty html' ELSE '' END AS error FROM p""",
)
def page_content(fetch_results):
    """Extracted content of each page as one record; a page without html is a failure."""
    h = F.col("html")
    p = fetch_results.select("fetch_id", H.title(h).alias("title"), H.text(h).alias("text"), H.description(h).alias("description"), F.substring(F.md5(F.coalesce(h, F.lit(""))), 1, 16).alias("html_hash"), (F.coalesce(h, F.lit("")) != "").alias("success"))
    return p.select(
        "fetch_id", "title", "description", T.word_count(F.col("text")).alias("word_count"), "html_hash", T.short_hash(F.col("text")).alias("content_hash"),
        (F.length("text") > 5000).alias("text_truncated"), "success", F.when(F.col("success"), "").otherwise("empty html").alias("error"),
    )


@query(
    "queue_items",
    sql=f"""WITH q AS (SELECT DISTINCT url FROM queue_items WHERE url IS NOT NULL), k AS (SELECT url, regexp_replace(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '#.*$', '') AS norm FROM q),
    v AS (SELECT * FROM k WHERE {part('norm', 1)} <> '' AND {part('norm', 2)} <> ''), d AS (SELECT norm, min(url) AS url FROM v GROUP BY norm)
    SELECT norm, url FROM d WHERE NOT {any_in('norm', PATTERNS)} AND {any_in(host('norm'), ['.example'])}""",
)
def url_list_filter(queue_items):
    """List filter: normal form, once each, then allowed hosts and patterns."""
    k = queue_items.where("url is not null").select("url").distinct().withColumn("norm", U.normalize_utils(F.col("url"))).where("norm is not null")
    d = k.groupBy("norm").agg(F.min("url").alias("url"))
    return d.where(~U.any_in(F.col("norm"), PATTERNS) & U.any_in(U.host(F.col("norm")), [".example"])).select("norm", "url")


@query(
    "extracted_links",
    sql=f"""WITH d AS (SELECT DISTINCT fetch_id, link_no, url, text FROM extracted_links WHERE url IS NOT NULL AND {part('url', 1)} IN ('http', 'https') AND {part('url', 2)} <> '' AND NOT {any_in('lower(url)', U.EXCLUDE_PATTERNS_V1)}),
    f AS (SELECT *, row_number() OVER (PARTITION BY fetch_id, url ORDER BY link_no, text NULLS FIRST) AS k FROM d)
    SELECT fetch_id, link_no, url, {sql_class('url', U.LINK_CLASSES_V1)} AS type FROM f WHERE k = 1""",
)
def links_v1(extracted_links):
    """Links by the oldest rules: valid, first of equal urls, typed."""
    ok = extracted_links.where(F.col("url").isNotNull() & links.valid_link(F.col("url"), U.EXCLUDE_PATTERNS_V1)).select("fetch_id", "link_no", "url", "text").distinct()
    return dedup.first_by(ok, ["fetch_id", "url"], "link_no", "text").select("fetch_id", "link_no", "url", U.classify(F.col("url"), U.LINK_CLASSES_V1).alias("type"))


_QT = "lower(substr(coalesce(title, ''), 1, 100) || ' ' || substr(coalesce(text, ''), 1, 300))"


@query(
    "documents",
    sql=f"""SELECT doc_id, round({sql_hits(_QT)} / {float(len(KEYWORDS))}, 6) AS confidence, list_filter({'[' + ', '.join("'" + k + "'" for k in KEYWORDS) + ']'}, lambda k: contains({_QT}, k)) AS matched_keywords,
    CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE coalesce(text, '') END AS summary, 'fallback' AS model_used FROM documents""",
)
def quick_match(documents):
    """Match of title and beginning with the keywords, with the keywords found."""
    t = F.lower(F.concat_ws(" ", F.substring(F.coalesce("title", F.lit("")), 1, 100), F.substring(F.coalesce("text", F.lit("")), 1, 300)))
    rows = documents.select("doc_id", t.alias("t"), F.coalesce(T.truncate(F.col("text"), 200), F.lit("")).alias("summary"))
    found = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.col("t"), k))
    return rows.select("doc_id", F.round(score.keyword_relevance(F.col("t"), KEYWORDS), 6).alias("confidence"), found.alias("matched_keywords"), "summary", F.lit("fallback").alias("model_used"))


@query(
    "queue_items",
    "fetch_results",
    sql="""WITH d AS (SELECT DISTINCT final_url AS url FROM fetch_results WHERE final_url IS NOT NULL), q AS (SELECT q.url, d.url IS NOT NULL AS done FROM queue_items q LEFT JOIN d ON q.url = d.url)
    SELECT count(*) AS total, count(*) FILTER (WHERE done) AS processed, round(coalesce(count(*) FILTER (WHERE done) * 100.0 / nullif(count(*), 0), 0), 1) AS progress FROM q""",
)
def queue_progress(queue_items, fetch_results):
    """Share of queued rows that are fetched."""
    d = fetch_results.where("final_url is not null").select(F.col("final_url").alias("url")).distinct().withColumn("done", F.lit(1))
    q = queue_items.select("url").join(d, "url", "left").agg(F.count("*").alias("total"), F.coalesce(F.sum("done"), F.lit(0)).cast("bigint").alias("processed"))
    return q.select("total", "processed", V.percent(F.col("processed"), F.col("total")).alias("progress"))


@query("extracted_links", sql=f"SELECT {host('url')} AS host, count(*) AS n_links, count(DISTINCT fetch_id) AS n_pages FROM extracted_links WHERE url IS NOT NULL GROUP BY 1")
def link_hosts(extracted_links):
    """Links and linking pages by host; the hot target is combined map-side."""
    by = extracted_links.where("url is not null").groupBy(U.host(F.col("url")).alias("host"), "fetch_id").agg(F.count("*").alias("n"))
    return by.groupBy("host").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_pages"))


@query("extracted_links", sql="SELECT url, first_text, n FROM (SELECT url, count(*) AS n, min(text) FILTER (WHERE text <> '') AS first_text FROM extracted_links WHERE url IS NOT NULL GROUP BY url) ORDER BY n DESC, url LIMIT 20")
def top_link_targets(extracted_links):
    """The twenty most linked urls."""
    by = extracted_links.where("url is not null").groupBy("url").agg(F.count("*").alias("n"), F.min(F.when(F.col("text") != "", F.col("text"))).alias("first_text"))
    return by.orderBy(F.desc("n"), "url").limit(20).select("url", "first_text", "n")


@query(
    "analysis_results",
    "fetch_results",
    sql="""WITH a AS (SELECT fetch_id, max_by(analysis_id, (analysed_at, analysis_id)) AS analysis_id FROM analysis_results WHERE analysed_at IS NOT NULL GROUP BY fetch_id)
    SELECT f.fetch_id, f.url, a.analysis_id, CASE WHEN a.analysis_id IS NOT NULL THEN 'analyzed' WHEN coalesce(f.html, '') <> '' THEN 'raw' ELSE 'failed' END AS stage FROM fetch_results f LEFT JOIN a USING (fetch_id)""",
)
def stage_latest(analysis_results, fetch_results):
    """Latest stage of each record, with its last analysis."""
    a = analysis_results.where("analysed_at is not null").groupBy("fetch_id").agg(F.max_by("analysis_id", F.struct("analysed_at", "analysis_id")).alias("analysis_id"))
    f = fetch_results.select("fetch_id", "url", (F.coalesce("html", F.lit("")) != "").alias("has_html"))
    return f.join(a, "fetch_id", "left").select("fetch_id", "url", "analysis_id", F.when(F.col("analysis_id").isNotNull(), "analyzed").when(F.col("has_html"), "raw").otherwise("failed").alias("stage"))


@query("fetch_results", "analysis_results", sql="SELECT 'raw' AS stage, count(*) AS n, count(DISTINCT url) AS n_urls FROM fetch_results WHERE coalesce(html, '') <> '' UNION ALL SELECT 'analyzed', count(*), count(DISTINCT url) FROM analysis_results WHERE success")
def stage_counts(fetch_results, analysis_results):
    """Rows and urls of each stage."""
    rows = fetch_results.where(F.coalesce("html", F.lit("")) != "").select(F.lit("raw").alias("stage"), "url").unionByName(analysis_results.where("success").select(F.lit("analyzed").alias("stage"), "url"))
    by = rows.groupBy("stage", "url").agg(F.count("*").alias("n"))
    return by.groupBy("stage").agg(F.sum("n").alias("n"), F.count("url").alias("n_urls"))


@query("lineitem", "orders", sql="SELECT o_orderkey, o_totalprice, n_lines FROM (SELECT o.o_orderkey, o.o_totalprice, count(*) AS n_lines FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2) ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def generic_topk(lineitem, orders):
    """Top-k behind a join, on neutral tables: the large side is counted before it is joined."""
    n = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return orders.join(n, orders.o_orderkey == n.l_orderkey).select("o_orderkey", "o_totalprice", "n_lines").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("customer", "orders", sql="SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def generic_antijoin(customer, orders):
    """Anti-join on neutral tables."""
    return customer.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    "analysis_results",
    "extracted_links",
    sql="""WITH p AS (SELECT fetch_id, unnest(prioritized_urls).url AS url, unnest(range(len(prioritized_urls))) AS pos FROM analysis_results),
    r0 AS (SELECT fetch_id, url, min(pos) AS pos FROM p WHERE coalesce(url, '') <> '' GROUP BY fetch_id, url),
    r AS (SELECT fetch_id, url, row_number() OVER (PARTITION BY fetch_id ORDER BY pos, url) AS k FROM r0),
    l AS (SELECT DISTINCT fetch_id, url FROM extracted_links WHERE url IS NOT NULL AND fetch_id IN (SELECT fetch_id FROM analysis_results)),
    x AS (SELECT l.fetch_id, l.url, row_number() OVER (PARTITION BY l.fetch_id ORDER BY md5('7' || l.url), l.url) AS k FROM l LEFT JOIN r0 ON r0.fetch_id = l.fetch_id AND r0.url = l.url WHERE r0.url IS NULL)
    SELECT fetch_id, url, 'recommended' AS link_type, CAST(k AS INT) AS k FROM r WHERE k <= 5 UNION ALL SELECT fetch_id, url, 'exploration', CAST(k AS INT) FROM x WHERE k <= 5""",
)
def enqueue_v2(analysis_results, extracted_links):
    """Five recommended links of each page and five others, chosen by a seeded hash."""
    p = analysis_results.select("fetch_id", F.posexplode("prioritized_urls").alias("pos", "p")).select("fetch_id", "pos", F.col("p.url").alias("url")).where("coalesce(url, '') <> ''")
    r = p.groupBy("fetch_id", "url").agg(F.min("pos").alias("pos"))
    li = dedup.only_in(extracted_links.where("url is not null").select("fetch_id", "url").distinct(), analysis_results, "fetch_id")
    x = li.join(r.select("fetch_id", "url"), ["fetch_id", "url"], "left_anti")
    best = top_per(r, ["fetch_id"], 5, "pos", "url", rank="k").select("fetch_id", "url", F.lit("recommended").alias("link_type"), "k")
    other = top_per(x, ["fetch_id"], 5, F.md5(F.concat(F.lit("7"), "url")), "url", rank="k").select("fetch_id", "url", F.lit("exploration").alias("link_type"), "k")
    return best.unionByName(other)


@query(
    "analysis_results",
    sql="""WITH a AS (SELECT analysis_id, coalesce(json_extract_string(extracted_data, '$.topic'), 'other') AS category, CASE WHEN isnan(relevance_score) THEN NULL ELSE relevance_score END AS score, summary, key_findings FROM analysis_results WHERE success),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC NULLS LAST, analysis_id) AS k FROM a)
    SELECT r.category, r.analysis_id, CAST(k AS INT) AS k, substr(coalesce(summary, ''), 1, 200) AS summary, key_findings[1:5] AS points, n, mean_score
    FROM r JOIN (SELECT category, count(*) AS n, round(avg(score), 6) AS mean_score FROM a GROUP BY category) g USING (category) WHERE k <= 5""",
)
def category_overview(analysis_results):
    """Best five pages of each category with shortened summaries, and the category's figures."""
    a = analysis_results.where("success").select(
        "analysis_id",
        F.coalesce(F.get_json_object("extracted_data", "$.topic"), F.lit("other")).alias("category"),
        F.when(~F.isnan("relevance_score"), F.col("relevance_score")).alias("score"),
        F.substring(F.coalesce("summary", F.lit("")), 1, 200).alias("summary"),
        F.slice("key_findings", 1, 5).alias("points"),
    )
    figures = a.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
    best = top_per(a, ["category"], 5, F.desc_nulls_last("score"), "analysis_id", rank="k")
    return best.join(figures, "category").select("category", "analysis_id", "k", "summary", "points", "n", "mean_score")


@query(
    "analysis_results",
    sql="""SELECT analysis_id, '<div class="card"><h3>' || replace(replace(replace(coalesce(url, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h3><p>' ||
    replace(replace(replace(substr(coalesce(summary, ''), 1, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p></div>' AS card FROM analysis_results WHERE success""",
)
def html_cards(analysis_results):
    """HTML cards of pages, texts escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return analysis_results.where("success").select(
        "analysis_id",
        F.concat(F.lit('<div class="card"><h3>'), safe(F.coalesce("url", F.lit(""))), F.lit("</h3><p>"), safe(F.substring(F.coalesce("summary", F.lit("")), 1, 200)), F.lit("</p></div>")).alias("card"),
    )
