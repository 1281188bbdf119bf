"""Queries over links, the frontier, seeds, scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions import values as V
from ..operators import dedup, frontier, links, score
from ..operators.rank import numbered, rank_score, source_order, top_per, SOURCE_ORDER
from ..sources.tables import fetched, hybrid
from .registry import query
from .url_queries import ALLOWED, EXTENSIONS, PATTERNS, _BARE, any_in, host, part, sql_class, sql_norm, sql_reason

#: Intents the queries below are asked with.
KEYWORDS = ["admission", "research", "library", "scholarship", "招生", "seminar"]


def sql_hits(t: str, keywords=KEYWORDS) -> str:
    return "(" + " + ".join(f"CAST(contains({t}, '{k.lower()}') AS INT)" for k in keywords) + ")"


# -- Sources ----------------------------------------------------------------------------------


@query("fetch_results", sql="SELECT fetch_id, url, final_url, engine, CAST(length(coalesce(html, '')) AS INT) AS content_length, length(coalesce(html, '')) >= 100 AS success FROM fetch_results")
def fetch_projection(fetch_results):
    """Fetch records with success derived from their content."""
    return fetched(fetch_results)


@query(
    "fetch_results",
    sql=f"""WITH p AS (SELECT fetch_id, regexp_replace({host("coalesce(url, '')")}, '^www\\.', '') AS host, NOT coalesce(success, false) OR length(coalesce(html, '')) < 500 AS bad FROM fetch_results)
    SELECT fetch_id, host, CASE WHEN bad THEN 'fallback' WHEN host IN (SELECT host FROM p WHERE bad) THEN 'browser' ELSE 'http' END AS route FROM p""",
)
def hybrid_fallback(fetch_results):
    """Engine that serves each page; hosts that once needed the browser keep it."""
    return hybrid(fetch_results)


# -- Seeds ------------------------------------------------------------------------------------

_ORD = "CASE source " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in SOURCE_ORDER.items()) + " ELSE 99 END"
_SEEDKEY = f"lower(replace({part('url', 2)}, 'www.', '') || regexp_replace(regexp_replace({part('url', 3)}, ';[^/]*$', ''), '/+$', ''))"


@query(
    "seed_urls",
    sql=f"""WITH d AS (SELECT DISTINCT url, title, source, seed_rank, relevance_score, {_SEEDKEY} AS seed_key FROM seed_urls WHERE url IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY seed_key ORDER BY seed_rank NULLS FIRST, source NULLS FIRST, url NULLS FIRST, title NULLS FIRST, relevance_score NULLS FIRST) AS r FROM d)
    SELECT seed_key, url, source, seed_rank, row_number() OVER (ORDER BY {_ORD}, relevance_score DESC NULLS LAST, seed_rank NULLS FIRST, seed_key) AS seed_no FROM k WHERE r = 1""",
)
def seed_dedup_sort(seed_urls):
    """Seeds once by key, in order of source, relevance and rank."""
    rows = seed_urls.where("url is not null").select("url", "title", "source", "seed_rank", "relevance_score").distinct().withColumn("seed_key", U.seed_key(F.col("url")))
    one = dedup.first_by(rows, ["seed_key"], "seed_rank", "source", "url", "title", "relevance_score")
    # Parts are the sources and hundredths of relevance (from high to low, nulls last), so few.
    score = F.col("relevance_score")
    hundredth = F.when(score.isNull(), 1_000_000).when(F.isnan(score), -1_000_000).otherwise(-F.least(F.greatest(F.floor(score * 100), F.lit(-1000)), F.lit(100_000))).cast("bigint")
    parts = [source_order(F.coalesce("source", F.lit(""))), hundredth]
    out = numbered(one, parts, [F.desc_nulls_last("relevance_score"), F.col("seed_rank"), F.col("seed_key")], "seed_no")
    return out.select("seed_key", "url", "source", "seed_rank", "seed_no")


@query("seed_urls", sql="SELECT DISTINCT url, source, seed_rank, round(1 - (seed_rank - 1) * CAST(0.08 AS DOUBLE), 6) AS api_score, round(1 - (seed_rank - 1) * CAST(0.1 AS DOUBLE), 6) AS lite_score, round(0.8 - seed_rank * CAST(0.05 AS DOUBLE), 6) AS fallback_score, CASE WHEN source = 'original' OR seed_rank <= 3 THEN 1 ELSE 2 END AS priority FROM seed_urls WHERE url IS NOT NULL")
def rank_to_score(seed_urls):
    """Scores of ranks, and priorities of seeds."""
    r = F.col("seed_rank")
    return seed_urls.where("url is not null").select(
        "url",
        "source",
        "seed_rank",
        F.round(rank_score(r, 0.08), 6).alias("api_score"),
        F.round(rank_score(r, 0.1), 6).alias("lite_score"),
        F.round(F.lit(0.8) - r * F.lit(0.05), 6).alias("fallback_score"),
        F.when((F.col("source") == "original") | (r <= 3), 1).otherwise(2).alias("priority"),
    ).distinct()


_STOP = "[" + ", ".join(f"'{w}'" for w in score.STOPWORDS) + "]"
_KW = f"""(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT list_contains({_STOP}, w) AND length(w) > 1)[1:5] || regexp_extract_all(text, '"([^"]+)"', 1)[1:2])"""
_CAT = "'general'"
_BEST = "0"
for _name, _kws in score.CATEGORY_KEYWORDS.items():
    _n = sql_hits("lower(text)", _kws.split())
    _CAT = f"CASE WHEN {_n} > ({_BEST}) THEN '{_name}' ELSE {_CAT} END"
    _BEST = f"greatest({_BEST}, {_n})"


@query(
    "documents",
    sql=f"""WITH i AS (SELECT doc_id, text, CASE WHEN len({_KW}) < 2 THEN [text] ELSE {_KW} END AS keywords FROM documents WHERE category = 'intent' AND text IS NOT NULL),
    q AS (SELECT *, array_to_string(list_transform(keywords, lambda k: CASE WHEN contains(k, ' ') THEN '"' || k || '"' ELSE k END), ' OR ') AS j FROM i)
    SELECT doc_id, keywords, CASE WHEN len(keywords) > 1 THEN '(' || j || ')' ELSE j END || ' site:example.test' AS full_query, {_CAT} AS category FROM q""",
)
def search_keywords(documents):
    """Search keywords, search strings and categories of wishes."""
    t = F.col("text")
    rows = documents.where("category = 'intent' and text is not null").select("doc_id", score.search_keywords(t).alias("keywords"), score.guess_category(t).alias("category"))
    return rows.select("doc_id", "keywords", score.full_query(F.col("keywords"), F.lit("example.test")).alias("full_query"), "category")


# -- Scores -----------------------------------------------------------------------------------


@query(
    "documents",
    sql=f"""WITH s AS (SELECT doc_id, {sql_hits("lower(coalesce(title, '') || ' ' || coalesce(text, ''))")} / {float(len(KEYWORDS))} AS confidence, substr(text, 1, 200) AS head FROM documents)
    SELECT doc_id, round(confidence, 6) AS confidence, CASE WHEN confidence < 0.2 THEN 'low relevance' ELSE head END AS summary, confidence >= 0.2 AS analysed, 0.5 >= 0.2 AS default_analysed FROM s""",
)
def relevance_gate(documents):
    """Keyword relevance of texts and the gate behind it; refused texts get no analysis."""
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    s = documents.select("doc_id", score.keyword_relevance(t, KEYWORDS).alias("confidence"), F.substring("text", 1, 200).alias("head"))
    return s.select(
        "doc_id",
        F.round("confidence", 6).alias("confidence"),
        F.when(F.col("confidence") < 0.2, "low relevance").otherwise(F.col("head")).alias("summary"),
        (F.col("confidence") >= 0.2).alias("analysed"),
        (score.keyword_relevance(F.lit(""), []) >= 0.2).alias("default_analysed"),
    )


_LT = "lower(coalesce(text, '') || ' ' || url)"


@query(
    "extracted_links",
    sql=f"""WITH d AS (SELECT DISTINCT fetch_id, link_no, url, text, is_internal FROM extracted_links WHERE is_internal AND url IS NOT NULL),
    s AS (SELECT fetch_id, link_no, url, CASE WHEN {sql_hits(_LT)} >= 2 THEN 1 ELSE 2 END AS priority FROM d WHERE {sql_hits(_LT)} >= 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY fetch_id ORDER BY priority, link_no, url) AS rank FROM s) SELECT fetch_id, CAST(rank AS INT) AS rank, url, priority FROM r WHERE rank <= 10""",
)
def link_keyword_topk(extracted_links):
    """The ten best internal links of each page for the keywords (flagship query)."""
    rows = extracted_links.where("is_internal and url is not null").select("fetch_id", "link_no", "url", "text").distinct()
    n = score.keyword_matches(F.concat_ws(" ", F.coalesce("text", F.lit("")), "url"), KEYWORDS)
    rows = rows.withColumn("n", n).where("n >= 1").withColumn("priority", F.when(F.col("n") >= 2, 1).otherwise(2))
    return top_per(rows, ["fetch_id"], 10, "priority", "link_no", "url").select("fetch_id", "rank", "url", "priority")


_PRI = (
    f"(CASE WHEN {any_in('lower(url)', U.PRIORITY_PATTERNS_V2)} THEN 10 ELSE 0 END + CASE WHEN length(coalesce(text, '')) > 10 THEN 3 ELSE 0 END + "
    + " + ".join(f"CASE WHEN contains(lower(url), '{k}') OR contains(lower(coalesce(text, '')), '{k}') THEN 2 ELSE 0 END" for k in U.LINK_KEYWORDS_V2)
    + ")"
)
_VALID = f"{part('url', 1)} IN ('http', 'https') AND {part('url', 2)} <> '' AND NOT {any_in('lower(url)', U.EXCLUDE_PATTERNS_V2[:-4])}"
_LKEY = "regexp_replace(regexp_replace(regexp_replace(url, '/+$', ''), '\\?.*$', ''), '#.*$', '')"


@query(
    "extracted_links",
    sql=f"""WITH d AS (SELECT DISTINCT fetch_id, link_no, url, substr(text, 1, 200) AS text, is_internal FROM extracted_links WHERE {_VALID}),
    p AS (SELECT *, {_LKEY} AS k, {sql_class('url', U.LINK_CLASSES_V2)} AS type, {_PRI} AS priority FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY fetch_id, k ORDER BY priority DESC, link_no, url) AS n FROM p) SELECT fetch_id, link_no, url, text, is_internal, type, priority FROM r WHERE n = 1""",
)
def link_priority_v2(extracted_links):
    """Links typed, with priorities, once a key."""
    return links.extract_v2(extracted_links.select("fetch_id", "link_no", "url", "text", "is_internal").distinct())


_BONUS = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in U.TYPE_BONUS.items()) + " ELSE 0.0 END"


@query(
    "queue_items",
    sql=f"""WITH q AS (SELECT DISTINCT url, depth, priority, {sql_class('url', U.LINK_CLASSES_V2)} AS type FROM queue_items WHERE url IS NOT NULL),
    s AS (SELECT *, -(5 + priority * 2 + {_BONUS} - depth * 0.1) AS score FROM q) SELECT url, depth, priority, type, round(CAST(score AS DOUBLE), 6) AS score, round(-CAST(score AS DOUBLE), 6) AS shown FROM s""",
)
def frontier_priority_v2(queue_items):
    """Float priorities of the frontier, and as shown by peeking."""
    q = queue_items.where("url is not null").select("url", "depth", "priority").distinct().withColumn("type", U.classify(F.col("url")))
    s = q.withColumn("score", frontier.score(F.lit(5.0), F.col("priority").cast("double"), F.col("type"), F.col("depth").cast("double")))
    return s.select("url", "depth", "priority", "type", F.round("score", 6).alias("score"), F.round(-F.col("score"), 6).alias("shown"))


# -- Frontier ---------------------------------------------------------------------------------

_Q = "SELECT DISTINCT priority, depth, queued_at, url, parent_url FROM queue_items"


@query("queue_items", sql=f"WITH q AS ({_Q}) SELECT * FROM q WHERE url IS NOT NULL ORDER BY priority NULLS FIRST, depth NULLS FIRST, queued_at NULLS FIRST, url, parent_url NULLS FIRST LIMIT 50")
def frontier_order(queue_items):
    """Next fifty items: a top-k, kept per partition before the last step."""
    q = queue_items.select("priority", "depth", "queued_at", "url", "parent_url").distinct().where("url is not null")
    return frontier.pop(q, 50, "queued_at", "url", "parent_url")


_N = sql_norm("coalesce(url, '')")


@query(
    "queue_items",
    "seed_urls",
    sql=f"""WITH q AS (SELECT DISTINCT priority, depth, queued_at, url FROM queue_items), n AS (SELECT *, {_N} AS norm, md5({_N}) AS url_hash FROM q),
    p AS (SELECT *, CASE WHEN coalesce(url, '')='' OR {part('norm', 2)}='' THEN 'invalid' WHEN depth > 3 THEN 'depth' WHEN {sql_reason('norm', ALLOWED, U.EXCLUDE_PATTERNS, U.EXCLUDED_EXTENSIONS)} <> 'allowed' THEN 'filtered' END AS pre,
      url_hash IN (SELECT md5({sql_norm('url')}) FROM seed_urls WHERE url IS NOT NULL) AS known FROM n),
    r AS (SELECT *, CASE WHEN pre IS NULL THEN row_number() OVER (PARTITION BY url_hash, pre IS NULL ORDER BY queued_at NULLS FIRST, priority NULLS FIRST, depth NULLS FIRST, url) END AS k FROM p)
    SELECT url, depth, priority, queued_at, url_hash, CASE WHEN pre IS NOT NULL THEN pre WHEN known OR k > 1 THEN 'duplicate' ELSE 'added' END AS status FROM r""",
)
def frontier_insert_status(queue_items, seed_urls):
    """What becomes of each row on insertion, in the order of the checks."""
    q = queue_items.select("priority", "depth", "queued_at", "url").distinct()
    seen = seed_urls.where("url is not null").select(U.url_hash(F.col("url")).alias("url_hash"))
    out = frontier.insert_status(q, ["queued_at", "priority", "depth", "url"], 3, ALLOWED, seen)
    return out.select("url", "depth", "priority", "queued_at", "url_hash", "status")


@query(
    "queue_items",
    sql="""SELECT 'priority' AS what, priority AS value, count(*) AS n FROM queue_items GROUP BY priority UNION ALL SELECT 'depth', depth, count(*) FROM queue_items GROUP BY depth
    UNION ALL SELECT 'total', NULL, count(*) FROM queue_items UNION ALL SELECT 'clamped', CASE WHEN priority <= 1 THEN 1 WHEN priority = 2 THEN 2 ELSE 3 END, count(*) FROM queue_items GROUP BY 2""",
)
def frontier_counts(queue_items):
    """Rows by priority, by depth and by clamped priority, in one pass."""
    q = queue_items.select("priority", "depth", V.clamp_priority_int(F.col("priority")).alias("clamped"))
    sets = q.groupingSets([["priority"], ["depth"], ["clamped"], []], "priority", "depth", "clamped").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    what = F.when(F.col("g") == 3, "priority").when(F.col("g") == 5, "depth").when(F.col("g") == 6, "clamped").otherwise("total")
    return sets.select(what.alias("what"), F.coalesce("priority", "depth", "clamped").alias("value"), "n")


@query(
    "extracted_links",
    "fetch_results",
    sql=f"""WITH RECURSIVE pages AS (SELECT fetch_id, {sql_norm('final_url')} AS src FROM fetch_results WHERE final_url IS NOT NULL),
    edges AS (SELECT DISTINCT p.src, {sql_norm('l.url')} AS dst FROM extracted_links l JOIN pages p USING (fetch_id) WHERE l.url IS NOT NULL),
    seeds AS (SELECT min(src) AS url FROM pages GROUP BY {host('src')}),
    b(url, depth) AS (SELECT url, 0 FROM seeds UNION SELECT e.dst, b.depth + 1 FROM b JOIN edges e ON e.src = b.url WHERE b.depth < 2)
    SELECT url, min(depth) AS depth, min(depth) AS round FROM b GROUP BY url""",
)
def bfs_levels(extracted_links, fetch_results):
    """Levels of a breadth-first crawl along stored links, from one page of each site."""
    pages = fetch_results.where("final_url is not null").select("fetch_id", U.normalize(F.col("final_url")).alias("src"))
    edges = extracted_links.where("url is not null").select("fetch_id", U.normalize(F.col("url")).alias("dst")).join(pages, "fetch_id").select("src", "dst").distinct()
    seeds = pages.groupBy(U.host(F.col("src")).alias("h")).agg(F.min("src").alias("url")).select("url")
    return frontier.crawl(seeds, edges, 2)


# -- Joins and stages -------------------------------------------------------------------------


@query(
    "fetch_results",
    "analysis_results",
    sql="SELECT f.fetch_id, f.url FROM fetch_results f WHERE NOT EXISTS (SELECT 1 FROM analysis_results a WHERE a.fetch_id = f.fetch_id)",
)
def stage_unprocessed(fetch_results, analysis_results):
    """Records of a stage that the next stage lacks."""
    return dedup.not_in(fetch_results.select("fetch_id", "url"), analysis_results, "fetch_id")


@query("fetch_results", "analysis_results", sql="SELECT f.fetch_id, f.url FROM fetch_results f WHERE f.fetch_id IN (SELECT fetch_id FROM analysis_results)")
def stage_processed(fetch_results, analysis_results):
    """Records of a stage that the next stage has."""
    return dedup.only_in(fetch_results.select("fetch_id", "url"), analysis_results, "fetch_id")


@query(
    "extracted_links",
    "seed_urls",
    sql="""WITH s AS (SELECT url, max_by(relevance_score, (seed_rank, source, relevance_score)) AS score FROM seed_urls WHERE url IS NOT NULL AND relevance_score IS NOT NULL AND seed_rank IS NOT NULL AND source IS NOT NULL GROUP BY url),
    l AS (SELECT DISTINCT url FROM extracted_links WHERE url IS NOT NULL) SELECT l.url, coalesce(s.score, 1.0) AS score FROM l LEFT JOIN s USING (url)""",
)
def score_join_default(extracted_links, seed_urls):
    """Links with their scores, 1 by default; the last score of a url holds."""
    s = seed_urls.where("url is not null and relevance_score is not null and seed_rank is not null and source is not null")
    s = s.groupBy("url").agg(F.max_by("relevance_score", F.struct("seed_rank", "source", "relevance_score")).alias("score"))
    return extracted_links.where("url is not null").select("url").distinct().join(s, "url", "left").select("url", F.coalesce("score", F.lit(1.0)).alias("score"))


@query(
    "fetch_results",
    "analysis_results",
    sql="""WITH f AS (SELECT fetch_id, substr(md5(coalesce(url, '')), 1, 8) || '.html' AS filename FROM fetch_results WHERE html IS NOT NULL),
    a AS (SELECT analysis_id, fetch_id, 'a_' || analysis_id AS own FROM analysis_results) SELECT a.analysis_id, a.fetch_id, coalesce(f.filename, a.own) AS filename FROM a LEFT JOIN f USING (fetch_id)""",
)
def filename_inherit(fetch_results, analysis_results):
    """Names that later stages take over from the first one."""
    f = fetch_results.where("html is not null").select("fetch_id", F.concat(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 8), F.lit(".html")).alias("filename"))
    a = analysis_results.select("analysis_id", "fetch_id", F.concat(F.lit("a_"), F.col("analysis_id").cast("string")).alias("own"))
    return a.join(f, "fetch_id", "left").select("analysis_id", "fetch_id", F.coalesce("filename", "own").alias("filename"))


@query(
    "documents",
    sql="""WITH p AS (SELECT doc_id, md5('small' || 'sum up' || coalesce(text, '')) AS cache_key FROM documents), c AS (SELECT cache_key, min(doc_id) AS answered_by FROM p WHERE doc_id % 3 = 0 GROUP BY cache_key)
    SELECT p.doc_id, p.cache_key, c.answered_by, c.answered_by IS NOT NULL AS hit FROM p LEFT JOIN c USING (cache_key)""",
)
def llm_cache_join(documents):
    """Prompts answered from the cache by their key; only misses would be asked."""
    p = documents.select("doc_id", F.md5(F.concat(F.lit("small"), F.lit("sum up"), F.coalesce("text", F.lit("")))).alias("cache_key"))
    c = p.where("doc_id % 3 = 0").groupBy("cache_key").agg(F.min("doc_id").alias("answered_by"))
    return p.join(c, "cache_key", "left").select("doc_id", "cache_key", "answered_by", F.col("answered_by").isNotNull().alias("hit"))


@query("queue_items", "seed_urls", sql=f"SELECT url, min(origin) AS origin FROM (SELECT url, 'seed' AS origin FROM seed_urls UNION ALL SELECT url, 'queue' FROM queue_items) WHERE url IS NOT NULL GROUP BY url")
def union_seeds(queue_items, seed_urls):
    """Seeds and queued urls together, once each."""
    both = seed_urls.select("url", F.lit("seed").alias("origin")).unionByName(queue_items.select("url", F.lit("queue").alias("origin")))
    return both.where("url is not null").groupBy("url").agg(F.min("origin").alias("origin"))


@query(
    "analysis_results",
    "extracted_links",
    sql="""WITH l AS (SELECT DISTINCT fetch_id, url FROM extracted_links WHERE is_internal AND url IS NOT NULL), r AS (SELECT DISTINCT fetch_id, unnest(prioritized_urls).url AS url FROM analysis_results)
    SELECT l.fetch_id, l.url FROM l WHERE l.fetch_id IN (SELECT fetch_id FROM analysis_results) AND NOT EXISTS (SELECT 1 FROM r WHERE r.fetch_id = l.fetch_id AND r.url = l.url)""",
)
def links_not_recommended(analysis_results, extracted_links):
    """Internal links of analysed pages that were not recommended."""
    li = extracted_links.where("is_internal and url is not null").select("fetch_id", "url").distinct()
    r = analysis_results.select("fetch_id", F.explode("prioritized_urls").alias("p")).select("fetch_id", F.col("p.url").alias("url"))
    return dedup.only_in(li, analysis_results, "fetch_id").join(r, ["fetch_id", "url"], "left_anti")
