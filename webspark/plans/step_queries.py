"""Queries over model steps without an answer, report parts, states of the frontier and names.

Where a model gives no usable answer its step has a fixed fallback; the queries below are those
fallbacks, so every pipeline runs without a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from ..functions import values as V
from ..operators import dedup
from ..operators.rank import top_per
from .registry import query
from .text_queries import W, _namer, first_of, page_text_sql
from .url_queries import PATTERNS, any_in, host, part, sql_class

# -- Answers of models ------------------------------------------------------------------------

_WHOLE = "CASE WHEN json_valid(text) THEN text WHEN json_valid(regexp_extract(text, '(?s)\\{.*\\}')) THEN regexp_extract(text, '(?s)\\{.*\\}') END"


def json_whole_or_braces(t: Column) -> Column:
    """The whole text if it parses, else its widest braces if they do, else null."""
    return F.coalesce(V.valid_json(t), V.valid_json(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))))


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, {_WHOLE} AS js FROM documents WHERE category = 'llm_json' AND text IS NOT NULL)
    SELECT doc_id, js, js IS NULL AS unreadable, coalesce(json_extract_string(js, '$.category'), 'general_info') AS category, coalesce(TRY_CAST(json_extract_string(js, '$.relevance_score') AS DOUBLE), 0.5) AS confidence,
    coalesce(json_extract_string(js, '$.should_extract') = 'true', false) AS should_extract FROM d""",
)
def page_class_v1(documents):
    """Page class by the oldest rules: the answer's, or general_info at 0.5 without extraction."""
    d = documents.where("category = 'llm_json' and text is not null").select("doc_id", json_whole_or_braces(F.col("text")).alias("js"))
    return d.select(
        "doc_id",
        "js",
        F.col("js").isNull().alias("unreadable"),
        F.coalesce(F.get_json_object("js", "$.category"), F.lit("general_info")).alias("category"),
        F.coalesce(F.get_json_object("js", "$.relevance_score").try_cast("double"), F.lit(0.5)).alias("confidence"),
        F.coalesce(F.get_json_object("js", "$.should_extract") == "true", F.lit(False)).alias("should_extract"),
    )


_KWOBJ = "'(?s)\\{[^{}]*\"keywords\"[^{}]*\\}'"
_LINE = "trim(line, '- •*\"''[]')"


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, text, nullif(regexp_extract(text, {_KWOBJ}), '') AS obj FROM documents WHERE category IN ('llm_json', 'intent') AND text IS NOT NULL),
    c AS (SELECT doc_id, text, obj IS NOT NULL AND NOT json_valid(obj) OR obj IS NULL AND NOT json_valid(text) AS broken, CASE WHEN json_valid(obj) THEN obj WHEN obj IS NULL AND json_valid(text) THEN text END AS js FROM d)
    SELECT doc_id, CASE WHEN broken THEN (list_filter(list_transform(string_split(text, chr(10)), lambda line: {_LINE}), lambda x: x <> '' AND length(x) < 50))[1:5]
    ELSE coalesce(list_filter(list_transform(CAST(json_extract(js, '$.keywords') AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> ''), []) END AS keywords FROM c""",
)
def keywords_answer(documents):
    """Keywords in a model's answer: of a flat object, of the whole, else five short lines."""
    t = F.col("text")
    obj = F.nullif(F.regexp_extract(t, r'(?s)\{[^{}]*"keywords"[^{}]*\}', 0), F.lit(""))
    d = documents.where("category in ('llm_json', 'intent') and text is not null").select("doc_id", "text", obj.alias("obj"))
    js = F.coalesce(V.valid_json(F.col("obj")), F.when(F.col("obj").isNull(), V.valid_json(t)))
    lines = F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit("- •*\"'[]")))
    short = F.slice(F.filter(lines, lambda x: (x != "") & (F.length(x) < 50)), 1, 5)
    listed = F.from_json(F.get_json_object(js, "$.keywords"), "array<string>")
    named = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return d.select("doc_id", F.when(js.isNull(), short).otherwise(named).alias("keywords"))


@query(
    "documents",
    sql="""SELECT doc_id, 'other' AS page_class, CAST(0.5 AS DOUBLE) AS confidence, true AS should_extract, true AS relevant, substr(coalesce(text, ''), 1, 300) AS summary, CAST(0.5 AS DOUBLE) AS relevance_score, true AS analysis_failed,
    'no answer' AS error FROM documents""",
)
def rule_classes(documents):
    """What stands for a model's class, relevance and analysis of a page when it gives none."""
    half = F.lit(0.5)
    return documents.select(
        "doc_id",
        F.lit("other").alias("page_class"),
        half.alias("confidence"),
        F.lit(True).alias("should_extract"),
        F.lit(True).alias("relevant"),
        F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("summary"),
        half.alias("relevance_score"),
        F.lit(True).alias("analysis_failed"),
        F.lit("no answer").alias("error"),
    )


@query(
    "extracted_links",
    sql=f"""WITH d AS (SELECT DISTINCT fetch_id, link_no, url FROM extracted_links WHERE url IS NOT NULL), t AS (SELECT *, {sql_class('url', U.LINK_CLASSES_V1)} AS type FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY fetch_id ORDER BY link_no, url) AS k FROM t),
    a AS (SELECT *, row_number() OVER (PARTITION BY fetch_id ORDER BY link_no, url) AS k FROM t WHERE type IN ('academic', 'research'))
    SELECT fetch_id, 'first' AS rule, CAST(k AS INT) AS k, url FROM r WHERE k <= 3 UNION ALL SELECT fetch_id, 'typed', CAST(k AS INT), url FROM a WHERE k <= 10 UNION ALL SELECT fetch_id, 'unreadable', CAST(k AS INT), url FROM r WHERE k <= 10""",
)
def recommend_fallback(extracted_links):
    """Links recommended without a model: the first three of a page, ten of the wanted types,
    or the first ten where the answer could not be read."""
    d = extracted_links.where("url is not null").select("fetch_id", "link_no", "url").distinct().withColumn("type", U.classify(F.col("url"), U.LINK_CLASSES_V1))
    ten = top_per(d, ["fetch_id"], 10, "link_no", "url", rank="k")
    pick = lambda rows, rule: rows.select("fetch_id", F.lit(rule).alias("rule"), "k", "url")
    typed = top_per(d.where(F.col("type").isin("academic", "research")), ["fetch_id"], 10, "link_no", "url", rank="k")
    return pick(ten.where("k <= 3"), "first").unionByName(pick(typed, "typed")).unionByName(pick(ten, "unreadable"))


@query("analysis_results", sql="SELECT count(*) AS n_infos, '共收集' || count(*) || '条信息' AS overview, 0 AS n_sections FROM (SELECT analysis_id FROM analysis_results WHERE success LIMIT 10)")
def synthesis_fallback(analysis_results):
    """Overview of at most ten pieces of information, without a model."""
    n = analysis_results.where("success").limit(10).agg(F.count("*").alias("n_infos"))
    return n.select("n_infos", F.concat(F.lit("共收集"), F.col("n_infos"), F.lit("条信息")).alias("overview"), F.lit(0).alias("n_sections"))


@query(
    "analysis_results",
    sql="SELECT analysis_id, CASE WHEN analysis_time > 0 AND isfinite(analysis_time) THEN round(length(coalesce(raw_response, summary, '')) / analysis_time, 4) ELSE 0.0 END AS chars_per_second FROM analysis_results",
)
def answer_speed(analysis_results):
    """Output a second of each call; 0 without a time."""
    t = F.col("analysis_time")
    return analysis_results.select(
        "analysis_id", F.when((t > 0) & ~F.isnan(t) & (t != float("inf")), F.round(F.length(F.coalesce("raw_response", "summary", F.lit(""))) / t, 4)).otherwise(0.0).alias("chars_per_second")
    )


# -- Gates, links and providers ----------------------------------------------------------------

#: The search engines tried after the primary one, in order.
FALLBACK = ("duckduckgo_api", "bing", "duckduckgo", "google")
#: What the anonymous sources of the test data stand for.
ENGINES = {"alpha": "google", "beta": "bing", "gamma": "duckduckgo"}


def first_provider(rows: DataFrame, engine: Column, primary: str) -> DataFrame:
    """Rows of the first engine of the chain that gave any: the primary one, then the others."""
    order = F.when(engine == primary, 0)
    for i, s in enumerate(e for e in FALLBACK if e != primary):
        order = order.when(engine == s, i + 1)
    rows = rows.withColumn("ord", order).where("ord is not null")
    return rows.join(F.broadcast(rows.agg(F.min("ord").alias("ord"))), "ord", "left_semi").drop("ord")  # one row, whatever the data


@query(
    "seed_urls",
    sql="""WITH o AS (SELECT *, CASE source WHEN 'alpha' THEN 4 WHEN 'beta' THEN 2 WHEN 'gamma' THEN 3 END AS ord FROM seed_urls WHERE url IS NOT NULL),
    k AS (SELECT * FROM o WHERE ord IS NOT NULL) SELECT url, title, source, seed_rank FROM k WHERE ord = (SELECT min(ord) FROM k)""",
)
def provider_fallback(seed_urls):
    """Results where the primary engine gave nothing: those of the first of the others that did."""
    engine = F.lit(None).cast("string")
    for source, name in ENGINES.items():
        engine = F.when(F.col("source") == source, name).otherwise(engine)
    return first_provider(seed_urls.where("url is not null"), engine, "duckduckgo_lite").select("url", "title", "source", "seed_rank")


_PRIOR = "('academic', 'research', 'people')"


@query(
    "extracted_links",
    sql=f"""WITH d AS (SELECT {host('url')} AS host, url, min(link_no) AS link_no FROM extracted_links WHERE url IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, {sql_class('url', U.LINK_CLASSES_V1)} AS type FROM d),
    r AS (SELECT *, count(*) OVER (PARTITION BY host) AS n, row_number() OVER (PARTITION BY host, type IN {_PRIOR} ORDER BY link_no, url) AS k FROM t)
    SELECT host, link_no, url, type FROM r WHERE n <= 50 OR type IN {_PRIOR} OR k <= 20""",
)
def link_prefilter(extracted_links):
    """Prefilter of link lists of more than fifty: all of the priority types and the first twenty others."""
    t = extracted_links.where("url is not null").groupBy(U.host(F.col("url")).alias("host"), "url").agg(F.min("link_no").alias("link_no"))
    t = t.withColumn("type", U.classify(F.col("url"), U.LINK_CLASSES_V1)).withColumn("prior", F.col("type").isin("academic", "research", "people"))
    # Lists are counted, not held: a list is kept whole, or its first rows by a top-k.
    long = t.groupBy("host").agg(F.count("*").alias("n")).where("n > 50").select("host")
    whole = t.join(long, "host", "left_anti")
    rest = t.join(long, "host", "left_semi")
    first = top_per(rest.where(~F.col("prior")), ["host"], 20, "link_no", "url", rank="k").drop("k")
    return whole.unionByName(rest.where("prior")).unionByName(first).select("host", "link_no", "url", "type")


#: Categories whose pages the oldest rules extract, and the kinds of facts reports show.
EXTRACT_CATEGORIES = ("academic_program", "research", "faculty")
FACT_TYPES = ("deadline", "requirement", "date")


@query(
    "analysis_results",
    sql=f"""WITH a AS (SELECT analysis_id, success, CASE WHEN isnan(relevance_score) THEN NULL ELSE relevance_score END AS c, extracted_data, json_extract_string(extracted_data, '$.topic') AS topic FROM analysis_results),
    k AS (SELECT *, CASE WHEN topic LIKE '%research%' THEN 'research' WHEN topic IS NULL THEN 'other' ELSE 'academic_program' END AS category FROM a)
    SELECT analysis_id, category, coalesce(c, 0.5) AS confidence, coalesce(c, 0.5) < 0.6 OR extracted_data IS NOT NULL AS analyse_v2, coalesce(c, 0.5) >= 0.6 AND category IN ('academic_program', 'research', 'faculty') AS extract_v1,
    coalesce(c, 0) > 0.7 AS highly_relevant, list_filter(json_keys(extracted_data), lambda x: x IN ('deadline', 'requirement', 'date', 'places')) AS facts FROM k""",
)
def analysis_gates(analysis_results):
    """Gates in front of the costly steps; refused rows are split off before a provider sees them."""
    c = F.when(~F.isnan("relevance_score"), F.col("relevance_score"))
    topic = F.get_json_object("extracted_data", "$.topic")
    category = F.when(F.contains(topic, F.lit("research")), "research").when(topic.isNull(), "other").otherwise("academic_program")
    a = analysis_results.select("analysis_id", category.alias("category"), F.coalesce(c, F.lit(0.5)).alias("confidence"), F.coalesce(c, F.lit(0.0)).alias("c"), "extracted_data")
    return a.select(
        "analysis_id",
        "category",
        "confidence",
        ((F.col("confidence") < 0.6) | F.col("extracted_data").isNotNull()).alias("analyse_v2"),
        ((F.col("confidence") >= 0.6) & F.col("category").isin(*EXTRACT_CATEGORIES)).alias("extract_v1"),
        (F.col("c") > 0.7).alias("highly_relevant"),
        F.filter(F.json_object_keys("extracted_data"), lambda x: x.isin(*FACT_TYPES, "places")).alias("facts"),
    )


def mutated(patterns: list[str], domains: list[str], more_patterns=(), more_domains=()) -> tuple[list[str], list[str]]:
    """Filter lists with patterns and (lowercased) domains added once each."""
    return list(dict.fromkeys([*patterns, *more_patterns])), list(dict.fromkeys([*domains, *(d.lower() for d in more_domains)]))


_MORE, _DOMAINS = mutated(PATTERNS, [".example"], ["/news"], [".TEST", ".example"])


@query(
    "queue_items",
    sql=f"WITH q AS (SELECT DISTINCT url FROM queue_items WHERE url IS NOT NULL) SELECT {any_in('url', _MORE)} AS excluded, {any_in(host('url'), _DOMAINS)} AS allowed, count(*) AS n FROM q GROUP BY 1, 2",
)
def mutated_filters(queue_items):
    """Urls by the filters after patterns and domains were added."""
    u = F.col("url")
    q = queue_items.where("url is not null").select("url").distinct()
    return q.groupBy(U.any_in(u, _MORE).alias("excluded"), U.any_in(U.host(u), _DOMAINS).alias("allowed")).agg(F.count("*").alias("n"))


# -- Fetches and extraction ---------------------------------------------------------------------


@query(
    "fetch_results",
    sql="""SELECT fetch_id, CASE WHEN success AND coalesce(html, '') <> '' THEN md5(html) END AS html_md5, CASE WHEN success AND coalesce(html, '') <> '' THEN 0 ELSE 3 END AS retries,
    CASE WHEN engine IN ('hybrid', 'selenium', 'requests') THEN engine WHEN engine IS NULL THEN 'hybrid' ELSE 'requests' END AS engine FROM fetch_results""",
)
def fetch_v1(fetch_results):
    """Html or null of each fetch, retries used, and the engine the factory would make:
    hybrid where none is named, plain requests for unknown names."""
    ok = F.coalesce(F.col("success"), F.lit(False)) & (F.coalesce("html", F.lit("")) != "")
    e = F.col("engine")
    return fetch_results.select(
        "fetch_id",
        F.when(ok, F.md5("html")).alias("html_md5"),
        F.when(ok, 0).otherwise(3).alias("retries"),
        F.when(e.isin("hybrid", "selenium", "requests"), e).when(e.isNull(), "hybrid").otherwise("requests").alias("engine"),
    )


@query(
    "fetch_results",
    sql=f"""WITH p AS (SELECT fetch_id, nullif({page_text_sql('html')}, '') AS text FROM fetch_results) SELECT fetch_id, text IS NULL AS no_text, coalesce(CAST(ceil(length(text) / 1000.0) AS INT), 0) AS n_chunks, substr(sha256(text), 1, 16) AS content_hash FROM p""",
)
def extract_v1(fetch_results):
    """Extraction by the oldest rules: null where there is no text, else its number of chunks and hash."""
    p = fetch_results.select("fetch_id", F.nullif(H.text(F.col("html")), F.lit("")).alias("text"))
    return p.select("fetch_id", F.col("text").isNull().alias("no_text"), F.coalesce(F.ceil(F.length("text") / 1000.0).cast("int"), F.lit(0)).alias("n_chunks"), F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"))


@query(
    "analysis_results",
    sql="""SELECT analysis_id, to_json(struct_pack(analysis_id := analysis_id, url := url, findings := key_findings, ok := success, at := strftime(analysed_at, '%Y-%m-%d %H:%M:%S'))) AS js FROM analysis_results""",
)
def serialised(analysis_results):
    """Nested values of a record as one JSON text, nulls kept, times as text."""
    s = F.struct("analysis_id", "url", F.col("key_findings").alias("findings"), F.col("success").alias("ok"), F.date_format("analysed_at", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return analysis_results.select("analysis_id", F.to_json(s, {"ignoreNullFields": "false"}).alias("js"))


# -- Names ---------------------------------------------------------------------------------------

_SEG = f"regexp_replace(regexp_extract(regexp_replace({part('url', 3)}, '^/+|/+$', '', 'g'), '[^/]*$'), '\\.[^.]*$', '')"
_SEGNAME = f"CASE WHEN {_SEG} <> '' THEN {_SEG} ELSE split_part(replace({part('url', 2)}, 'www.', ''), '.', 1) END"


def segment_name(url: Column) -> Column:
    """Name from the last segment of the path without its extension, else the first label of
    the host without ``www.``."""
    last = F.regexp_replace(F.regexp_extract(F.regexp_replace(U.part(url, 3), "^/+|/+$", ""), "[^/]*$", 0), r"\.[^.]*$", "")
    return F.when(last != "", last).otherwise(F.split_part(F.replace(U.netloc(url), F.lit("www."), F.lit("")), F.lit("."), F.lit(1)))


@query("extracted_links", sql=f"SELECT DISTINCT url, {_namer(_SEGNAME)} AS name FROM extracted_links WHERE url IS NOT NULL")
def segment_filenames(extracted_links):
    """Names of files from the last segment of a url."""
    return extracted_links.where("url is not null").select("url").distinct().select("url", T.sanitize_namer(segment_name(F.col("url"))).alias("name"))


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, url, title, CASE WHEN category = 'summary' THEN nullif(lang, '') END AS answer FROM documents WHERE title IS NOT NULL)
    SELECT doc_id, {_namer("coalesce(answer, title)")} || '_' || substr(md5(coalesce(url, '')), 1, 8) AS name, answer IS NOT NULL AS by_model FROM d""",
)
def name_dispatch(documents):
    """A model's name where there is one, else the rule's, with a hash in any case."""
    answer = F.when(F.col("category") == "summary", F.nullif("lang", F.lit("")))
    d = documents.where("title is not null").select("doc_id", F.coalesce("url", F.lit("")).alias("u"), "title", answer.alias("answer"))
    return d.select("doc_id", F.concat(T.sanitize_namer(F.coalesce("answer", "title")), F.lit("_"), F.substring(F.md5("u"), 1, 8)).alias("name"), F.col("answer").isNotNull().alias("by_model"))


# -- Frontier -------------------------------------------------------------------------------------


@query(
    "seed_urls",
    sql="""WITH d AS (SELECT DISTINCT url, source, seed_rank FROM seed_urls WHERE url IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY source = 'original' DESC NULLS LAST, seed_rank NULLS LAST, url, source NULLS FIRST) - 1 AS i FROM d)
    SELECT url, source, seed_rank, CASE WHEN source = 'original' OR i < 3 THEN 1 ELSE 2 END AS priority FROM r""",
)
def seed_priority(seed_urls):
    """Priorities of seeds: original ones and the first three are high, the others medium."""
    d = seed_urls.where("url is not null").select("url", "source", "seed_rank").distinct()
    order = (F.coalesce(F.col("source") == "original", F.lit(False)).desc(), F.asc_nulls_last("seed_rank"), F.asc("url"), F.asc_nulls_first("source"))
    first = d.orderBy(*order).limit(3).withColumn("first", F.lit(True))  # three rows
    same = F.broadcast(first.select(F.col("url").alias("u"), F.col("source").alias("s"), F.col("seed_rank").alias("r"), "first"))
    both = d.join(same, (F.col("url") == F.col("u")) & F.col("source").eqNullSafe(F.col("s")) & F.col("seed_rank").eqNullSafe(F.col("r")), "left")
    return both.select("url", "source", "seed_rank", F.when((F.coalesce("source", F.lit("")) == "original") | F.col("first"), 1).otherwise(2).alias("priority"))


_V2N = "regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')"


@query(
    "queue_items",
    "fetch_results",
    sql=f"""WITH seen AS (SELECT DISTINCT {_V2N.replace('url', 'final_url')} AS norm FROM fetch_results WHERE final_url IS NOT NULL),
    q AS (SELECT {_V2N} AS norm, {host('url')} AS host, depth, queued_at, row_number() OVER () AS id FROM queue_items WHERE url IS NOT NULL AND queued_at IS NOT NULL AND depth IS NOT NULL),
    f AS (SELECT norm, min((queued_at, depth)) AS first FROM q WHERE depth <= 2 GROUP BY norm),
    m AS (SELECT q.*, s.norm IS NOT NULL AS known, f.first FROM q LEFT JOIN seen s USING (norm) LEFT JOIN f USING (norm)),
    r AS (SELECT *, CASE WHEN known THEN 'duplicate' WHEN first IS NOT NULL AND (queued_at, depth) > first THEN 'duplicate' WHEN depth > 2 THEN 'depth' ELSE 'first' END AS s,
    row_number() OVER (PARTITION BY norm, queued_at, depth, known ORDER BY id) AS k FROM m)
    SELECT host, count(*) FILTER (WHERE s = 'first' AND k = 1) AS added, count(*) FILTER (WHERE s = 'duplicate' OR s = 'first' AND k > 1) AS duplicates, count(*) FILTER (WHERE s = 'depth') AS too_deep FROM r GROUP BY host""",
)
def frontier_insert_v2(queue_items, fetch_results):
    """Insertion by the second set of rules, by host: known urls are duplicates before their
    depth is looked at, and a url too deep is not remembered.

    The first admitted row of a url is an aggregate, not a rank, so a url that holds a tenth of
    all rows is combined map-side; equal rows are counted before they meet it.
    """
    seen = fetch_results.where("final_url is not null").select(U.normalize_v2(F.col("final_url")).alias("norm")).distinct().withColumn("known", F.lit(True))
    q = queue_items.where("url is not null and queued_at is not null and depth is not null").groupBy(U.normalize_v2(F.col("url")).alias("norm"), U.host(F.col("url")).alias("host"), "queued_at", "depth").agg(F.count("*").alias("n"))
    first = q.where("depth <= 2").groupBy("norm").agg(F.min(F.struct("queued_at", "depth", "host")).alias("first"))
    m = q.join(seen, "norm", "left").join(first, "norm", "left")
    at = F.struct("queued_at", "depth", "host")
    status = F.when(F.col("known"), "duplicate").when(F.col("first").isNotNull() & (at > F.col("first")), "duplicate").when(F.col("depth") > 2, "depth").otherwise("first")
    m = m.select("host", "n", status.alias("s"))
    one = F.when(F.col("s") == "first", 1).otherwise(0)
    return m.groupBy("host").agg(
        F.sum(one).cast("bigint").alias("added"), F.sum(F.when(F.col("s") == "depth", 0).otherwise(F.col("n") - one)).alias("duplicates"), F.sum(F.when(F.col("s") == "depth", F.col("n")).otherwise(0)).alias("too_deep")
    )


@query(
    "analysis_results",
    "queue_items",
    sql=f"""WITH p AS (SELECT analysis_id, url AS parent_url, unnest(prioritized_urls) AS p, unnest(range(len(prioritized_urls))) AS pos FROM analysis_results WHERE url IS NOT NULL),
    d AS (SELECT analysis_id, parent_url, pos, p.url AS url, greatest(1, least(3, coalesce(p.priority, 2))) AS priority, row_number() OVER (PARTITION BY analysis_id, p.url ORDER BY pos) AS k FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY priority, pos) AS rank FROM d WHERE k = 1 AND coalesce(url, '') <> ''),
    q AS (SELECT url AS parent_url, min(depth) AS depth FROM queue_items WHERE url IS NOT NULL GROUP BY url)
    SELECT analysis_id, CAST(rank AS INT) AS rank, r.parent_url, CASE WHEN regexp_matches(r.url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN r.url WHEN r.url LIKE '//%' THEN {part('r.parent_url', 1)} || ':' || r.url
    WHEN r.url LIKE '/%' THEN {part('r.parent_url', 1)} || '://' || {part('r.parent_url', 2)} || r.url ELSE 'relative' END AS url, priority, CAST(coalesce(q.depth, 0) + 1 AS INT) AS depth FROM r LEFT JOIN q USING (parent_url) WHERE rank <= 10""",
)
def enqueue_discovered(analysis_results, queue_items):
    """Recommended urls for the frontier: absolute, first of equal ones, priorities clamped, ten
    a page, one level below their page."""
    p = analysis_results.where("url is not null").select("analysis_id", F.col("url").alias("parent_url"), F.posexplode("prioritized_urls").alias("pos", "p"))
    p = p.select("analysis_id", "parent_url", "pos", F.col("p.url").alias("url"), F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce("p.priority", F.lit(2)))).alias("priority"))
    p = top_per(dedup.first_by(p.where("url is not null and url <> ''"), ["analysis_id", "url"], "pos"), ["analysis_id"], 10, "priority", "pos")
    depth = queue_items.where("url is not null").groupBy(F.col("url").alias("parent_url")).agg(F.min("depth").alias("depth"))
    u = F.col("url")
    whole = F.when(u.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|/)"), U.resolve(u, F.col("parent_url"))).otherwise(F.lit("relative"))
    return p.join(depth, "parent_url", "left").select("analysis_id", "rank", "parent_url", whole.alias("url"), "priority", (F.coalesce("depth", F.lit(0)) + 1).cast("int").alias("depth"))


@query(
    "fetch_results",
    sql="""SELECT url, count(*) AS attempts, count(*) FILTER (WHERE NOT coalesce(success, false)) AS failures, count(*) - 1 AS retries, CASE WHEN bool_or(coalesce(success, false)) THEN 'processed' ELSE 'failed' END AS state,
    min(error) FILTER (WHERE NOT coalesce(success, false) AND error <> '') AS error FROM fetch_results WHERE url IS NOT NULL GROUP BY url""",
)
def url_states(fetch_results):
    """State of each url: processed if any attempt was, with attempts, failures and retries."""
    ok = F.coalesce("success", F.lit(False))
    return fetch_results.where("url is not null").groupBy("url").agg(
        F.count("*").alias("attempts"),
        F.sum((~ok).cast("bigint")).alias("failures"),
        (F.count("*") - 1).alias("retries"),
        F.when(F.max(ok), "processed").otherwise("failed").alias("state"),
        F.min(F.when(~ok & (F.col("error") != ""), F.col("error"))).alias("error"),
    )


@query(
    "fetch_results",
    "queue_items",
    sql="""WITH f AS (SELECT count(*) AS done, coalesce(epoch_us(max(fetched_at)) - epoch_us(min(fetched_at)), 0) / 1000000.0 AS secs FROM fetch_results), q AS (SELECT count(DISTINCT url) AS left_over FROM queue_items WHERE url IS NOT NULL)
    SELECT done, left_over, round(CASE WHEN secs > 0 THEN done / secs ELSE 0 END, 9) AS speed, CASE WHEN done > 0 AND secs > 0 THEN round(left_over / (done / secs), 3) END AS eta_seconds FROM f, q""",
)
def queue_speed(fetch_results, queue_items):
    """Pages a second so far, and the time the queue will take at that speed."""
    secs = F.coalesce(F.timestamp_diff("MICROSECOND", F.min("fetched_at"), F.max("fetched_at")), F.lit(0)) / 1e6
    f = fetch_results.agg(F.count("*").alias("done"), secs.alias("secs"))
    q = queue_items.where("url is not null").select("url").distinct().agg(F.count("*").alias("left_over"))
    speed = F.when(F.col("secs") > 0, F.col("done") / F.col("secs")).otherwise(0.0)
    return f.crossJoin(q).select(  # one row each
        "done", "left_over", F.round(speed, 9).alias("speed"), F.when((F.col("done") > 0) & (F.col("secs") > 0), F.round(F.col("left_over") / speed, 3)).alias("eta_seconds")
    )


# -- Reports -----------------------------------------------------------------------------------------


@query(
    "analysis_results",
    "fetch_results",
    sql=f"""SELECT a.analysis_id, f.fetch_id, f.final_url, a.relevance_score, length(f.html) AS html_chars FROM analysis_results a JOIN fetch_results f USING (fetch_id) WHERE a.success AND coalesce(f.html, '') <> ''""",
)
def index_payload(analysis_results, fetch_results):
    """Index of analyses with the stored pages; entries without a page are dropped."""
    f = fetch_results.where("coalesce(html, '') <> ''").select("fetch_id", "final_url", F.length("html").alias("html_chars"))
    return analysis_results.where("success").select("analysis_id", "fetch_id", "relevance_score").join(f, "fetch_id").select("analysis_id", "fetch_id", "final_url", "relevance_score", "html_chars")


def flatten(df: DataFrame, keys: list[str], js: Column, depth: int = 6) -> DataFrame:
    """Leaves of a JSON object as rows ``(keys..., key, value)`` with dotted keys; lists are
    values.  Objects nested deeper than ``depth`` stay values."""
    rows = df.select(*keys, F.explode(F.from_json(js, "map<string,string>")).alias("key", "value"))
    out = None
    for level in range(depth):
        nested = F.coalesce(F.col("value").startswith("{"), F.lit(False)) if level + 1 < depth else F.lit(False)
        leaves = rows.where(~nested)
        out = leaves if out is None else out.unionAll(leaves)
        rows = rows.where(nested).select(*keys, F.col("key").alias("above"), F.explode(F.from_json("value", "map<string,string>")).alias("k", "value")).select(*keys, F.concat_ws(".", "above", "k").alias("key"), "value")
    return out


@query(
    "analysis_results",
    "events",
    sql="""WITH e AS (SELECT 'event' AS kind, event_id AS id, '{"props": ' || props || ', "at": {"type": "' || event_type || '"}}' AS js FROM events UNION ALL SELECT 'analysis', analysis_id, extracted_data FROM analysis_results WHERE extracted_data IS NOT NULL)
    SELECT kind, id, substr(fullkey, 3) AS key, CASE WHEN type = 'VARCHAR' THEN json_extract_string(js, fullkey) ELSE CAST(value AS VARCHAR) END AS value FROM (SELECT e.kind, e.id, e.js, t.fullkey, t.type, t.value, t.atom FROM e, json_tree(e.js) t) WHERE type NOT IN ('OBJECT')""",
)
def json_flatten(analysis_results, events):
    """Nested values of JSON columns as dotted keys, whatever keys there are."""
    e = events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.concat(F.lit('{"props": '), "props", F.lit(', "at": {"type": "'), "event_type", F.lit('"}}')).alias("js"))
    a = analysis_results.where("extracted_data is not null").select(F.lit("analysis").alias("kind"), F.col("analysis_id").alias("id"), F.col("extracted_data").alias("js"))
    return flatten(e.unionAll(a), ["kind", "id"], F.col("js"))


@query(
    "analysis_results",
    sql="""WITH v AS (SELECT unnest(json_keys(extracted_data)) AS key, extracted_data FROM analysis_results WHERE success AND extracted_data IS NOT NULL), w AS (SELECT key, json_extract_string(extracted_data, '$."' || key || '"') AS v FROM v),
    u AS (SELECT key, list_sort(list_distinct(list(v) FILTER (WHERE coalesce(v, '') NOT IN ('', '0', 'false'))))[1:10] AS shown, count(DISTINCT v) FILTER (WHERE coalesce(v, '') NOT IN ('', '0', 'false')) AS n_unique FROM w GROUP BY key)
    SELECT key, n_values, n_unique, shown FROM u JOIN (SELECT key, count(*) AS n_values FROM w GROUP BY key) USING (key)""",
)
def data_rollup(analysis_results):
    """Extracted values by key over successful pages: all counted, ten unique ones shown."""
    v = analysis_results.where("success and extracted_data is not null").select(F.explode(F.from_json("extracted_data", "map<string,string>")).alias("key", "v"))
    by = v.groupBy("key", "v").agg(F.count("*").alias("n"))
    good = by.where("coalesce(v, '') not in ('', '0', 'false')")
    shown = top_per(good, ["key"], 10, "v", rank="r").groupBy("key").agg(F.array_sort(F.collect_list("v")).alias("shown"))
    total = by.groupBy("key").agg(F.sum("n").alias("n_values"), F.sum(F.when(~F.coalesce("v", F.lit("")).isin("", "0", "false"), 1).otherwise(0)).cast("bigint").alias("n_unique"))
    return total.join(shown, "key", "left").select("key", "n_values", "n_unique", F.coalesce("shown", F.array().cast("array<string>")).alias("shown"))


_FINDINGS = """WITH a AS (SELECT analysis_id, url, key_findings, summary, json_extract_string(extracted_data, '$.topic') AS topic, CASE WHEN isnan(relevance_score) THEN 0 ELSE coalesce(relevance_score, 0) END AS score FROM analysis_results WHERE success),
    k AS (SELECT topic, count(*) AS n, min(analysis_id) AS first FROM a WHERE topic IS NOT NULL GROUP BY topic ORDER BY n DESC, first, topic LIMIT 5),
    b AS (SELECT 1 AS part, CAST(0 AS BIGINT) AS page, CAST(0 AS BIGINT) AS pos, '最常见的主题包括: ' || string_agg(topic, ', ' ORDER BY n DESC, first, topic) AS finding FROM k HAVING count(*) > 0
    UNION ALL SELECT 2, analysis_id, pos, '事实: ' || substr(f, 1, 80) || ' (来源: ' || substr(coalesce(url, 'Unknown'), 1, 30) || ')' FROM (SELECT analysis_id, url, unnest(key_findings) AS f, unnest(range(len(key_findings))) AS pos FROM a) WHERE trim(coalesce(f, '')) <> ''
    UNION ALL SELECT 3, analysis_id, 0, substr(summary, 1, 100) || '...' FROM a WHERE score > 0.7 AND coalesce(summary, '') <> '')"""


@query("analysis_results", sql=f"{_FINDINGS} SELECT part, page, pos, finding FROM b ORDER BY part, page, pos LIMIT 15")
def key_findings(analysis_results):
    """Key findings in order: the commonest topics in one sentence, facts with their page, then
    summaries of the most relevant pages; fifteen at most."""
    a = analysis_results.where("success").withColumn("topic", F.get_json_object("extracted_data", "$.topic"))
    k = a.where("topic is not null").groupBy("topic").agg(F.count("*").alias("n"), F.min("analysis_id").alias("first")).orderBy(F.desc("n"), "first", "topic").limit(5)
    named = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "topic")))
    zero = F.lit(0).cast("bigint")
    one = k.agg(named.alias("x")).where(F.size("x") > 0).select(F.lit(1).alias("part"), zero.alias("page"), zero.alias("pos"), F.concat(F.lit("最常见的主题包括: "), F.array_join(F.col("x.topic"), ", ")).alias("finding"))
    f = a.select("analysis_id", "url", F.posexplode("key_findings").alias("pos", "f")).where("trim(coalesce(f, '')) <> ''")
    two = f.select(F.lit(2).alias("part"), F.col("analysis_id").alias("page"), F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("事实: "), F.substring("f", 1, 80), F.lit(" (来源: "), F.substring(F.coalesce("url", F.lit("Unknown")), 1, 30), F.lit(")")).alias("finding"))
    s = a.where("relevance_score > 0.7 and not isnan(relevance_score) and coalesce(summary, '') <> ''")
    three = s.select(F.lit(3).alias("part"), F.col("analysis_id").alias("page"), zero.alias("pos"), F.concat(F.substring("summary", 1, 100), F.lit("...")).alias("finding"))
    return one.unionAll(two).unionAll(three).orderBy("part", "page", "pos").limit(15)


@query(
    "analysis_results",
    sql="""WITH f AS (SELECT analysis_id, unnest(key_findings) AS finding, unnest(range(len(key_findings))) AS pos FROM analysis_results WHERE success), r AS (SELECT *, row_number() OVER (ORDER BY analysis_id, pos) AS no FROM f), n AS (SELECT count(*) AS n FROM f)
    SELECT no, finding FROM r WHERE no <= 20 UNION ALL SELECT 21, '*... and ' || (n - 20) || ' more findings*' FROM n WHERE n > 20""",
)
def all_findings(analysis_results):
    """All findings in page order: the first twenty and how many there are besides."""
    f = analysis_results.where("success").select("analysis_id", F.posexplode("key_findings").alias("pos", "finding"))
    first = f.orderBy("analysis_id", "pos").limit(20)
    ranked = first.agg(F.array_sort(F.collect_list(F.struct("analysis_id", "pos", "finding"))).alias("x")).select(F.posexplode("x").alias("i", "x")).select((F.col("i") + 1).cast("bigint").alias("no"), F.col("x.finding").alias("finding"))
    rest = f.agg(F.count("*").alias("n")).where("n > 20").select(F.lit(21).cast("bigint").alias("no"), F.concat(F.lit("*... and "), F.col("n") - 20, F.lit(" more findings*")).alias("finding"))
    return ranked.unionAll(rest)


@query(
    "analysis_results",
    sql="""SELECT analysis_id, coalesce(url, '') AS url, '' AS title, CASE WHEN relevance_score IS NULL OR isnan(relevance_score) THEN 0.0 ELSE relevance_score END AS relevance_score, coalesce(key_findings, []) AS key_findings, coalesce(extracted_data, '{}') AS extracted_data,
    coalesce(summary, '') AS summary, coalesce(len(prioritized_urls), 0) AS n_urls, CAST(0 AS DOUBLE) AS fetch_time, CASE WHEN analysis_time IS NULL OR isnan(analysis_time) THEN 0.0 ELSE analysis_time END AS analysis_time, coalesce(success, true) AS success, error FROM analysis_results""",
)
def page_report_rows(analysis_results):
    """Rows of a page report, with the default of every field that is missing."""
    number = lambda c: F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(F.col(c)).alias(c)
    return analysis_results.select(
        "analysis_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.lit("").alias("title"),
        number("relevance_score"),
        F.coalesce("key_findings", F.array().cast("array<string>")).alias("key_findings"),
        F.coalesce("extracted_data", F.lit("{}")).alias("extracted_data"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.when(F.col("prioritized_urls").isNull(), 0).otherwise(F.size("prioritized_urls")).cast("bigint").alias("n_urls"),
        F.lit(0.0).alias("fetch_time"),
        number("analysis_time"),
        F.coalesce("success", F.lit(True)).alias("success"),
        "error",
    )


@query(
    "analysis_results",
    "fetch_results",
    sql="""SELECT a.analysis_id, a.url, coalesce(json_extract_string(a.extracted_data, '$.topic'), 'other') AS category, strftime(a.analysed_at, '%Y-%m-%dT%H:%M:%S') AS timestamp, a.relevance_score, f.status_code, f.content_type
    FROM analysis_results a LEFT JOIN fetch_results f USING (fetch_id) WHERE a.success""",
)
def export_summary(analysis_results, fetch_results):
    """Pages of an export with their metadata merged in (the task's figures are stage_counts)."""
    a = analysis_results.where("success").select("analysis_id", "fetch_id", "url", F.coalesce(F.get_json_object("extracted_data", "$.topic"), F.lit("other")).alias("category"), F.date_format("analysed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "relevance_score")
    return a.join(fetch_results.select("fetch_id", "status_code", "content_type"), "fetch_id", "left").drop("fetch_id")


@query(
    "analysis_results",
    "fetch_results",
    sql=f"""{_FINDINGS}, c AS (SELECT coalesce(topic, 'other') AS category, count(*) AS n FROM a GROUP BY 1), g AS (SELECT finding, row_number() OVER (ORDER BY part, page, pos) AS no FROM b), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, analysis_id) AS no FROM a)
    SELECT 1 AS section, CAST(1 AS BIGINT) AS no, '| 原始页面 | ' || (SELECT count(*) FROM fetch_results WHERE coalesce(html, '') <> '') || ' |' AS line UNION ALL SELECT 1, 2, '| 已分析 | ' || (SELECT count(*) FROM a) || ' |'
    UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, category), '- **' || category || '**: ' || n || ' 页' FROM c
    UNION ALL SELECT 3, no, no || '. ' || finding FROM g WHERE no <= 10 UNION ALL SELECT 4, no, '### [' || substr(coalesce(url, ''), 1, 50) || '](' || coalesce(url, '') || ') ' || printf('%.2f', score) FROM t WHERE no <= 10""",
)
def summary_report(analysis_results, fetch_results):
    """Lines of the overview report by section: figures, categories, findings, best pages."""
    numbered = lambda x: x.select(F.posexplode("x").alias("i", "x")).select((F.col("i") + 1).cast("bigint").alias("no"), "x")  # noqa: E731  at most ten rows, or the categories
    a = analysis_results.where("success").select(
        "analysis_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.get_json_object("extracted_data", "$.topic"), F.lit("other")).alias("category"), F.when(~F.isnan("relevance_score"), F.col("relevance_score")).otherwise(0.0).alias("s")
    ).withColumn("s", F.coalesce("s", F.lit(0.0)))
    line = lambda section, no, text: (F.lit(section).alias("section"), no.alias("no"), text.alias("line"))
    no1, no2 = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
    raw = fetch_results.where(F.coalesce("html", F.lit("")) != "").agg(F.count("*").alias("n")).select(*line(1, no1, F.concat(F.lit("| 原始页面 | "), "n", F.lit(" |"))))
    done = a.agg(F.count("*").alias("n")).select(*line(1, no2, F.concat(F.lit("| 已分析 | "), "n", F.lit(" |"))))
    c = a.groupBy("category").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "category"))).alias("x"))
    cats = numbered(c).select(*line(2, F.col("no"), F.concat(F.lit("- **"), F.col("x.category"), F.lit("**: "), -F.col("x.m"), F.lit(" 页"))))
    found = key_findings(analysis_results).orderBy("part", "page", "pos").limit(10).agg(F.array_sort(F.collect_list(F.struct("part", "page", "pos", "finding"))).alias("x"))
    facts = numbered(found).select(*line(3, F.col("no"), F.concat(F.col("no"), F.lit(". "), F.col("x.finding"))))
    best = a.orderBy(F.desc("s"), "analysis_id").limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("m"), "analysis_id", "url"))).alias("x"))
    top = numbered(best).select(*line(4, F.col("no"), F.concat(F.lit("### ["), F.substring(F.col("x.url"), 1, 50), F.lit("]("), F.col("x.url"), F.lit(") "), F.format_string("%.2f", -F.col("x.m")))))
    return raw.unionAll(done).unionAll(cats).unionAll(facts).unionAll(top)


# -- Names and metadata besides ---------------------------------------------------------------------

_CLEAN = f"regexp_replace(substr(regexp_replace(regexp_replace(coalesce(answer, ''), '[^{W}-]', '_', 'g'), '_+', '_', 'g'), 1, 30), '^_+|_+$', '', 'g')"


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, category, title, CASE WHEN doc_id % 3 <> 0 THEN substr(text, 1, 60) END AS answer FROM documents), n AS (SELECT doc_id, category, title, {_CLEAN} AS n FROM d)
    SELECT doc_id, CASE WHEN n <> '' THEN n ELSE concat_ws('_', category, substr(md5(coalesce(title, '')), 1, 8)) END AS name FROM n""",
)
def llm_filenames(documents):
    """Names made of a model's answers (here the beginnings of two texts of three); category and
    a hash of the title where there is no answer."""
    answer = F.when(F.col("doc_id") % 3 != 0, F.substring("text", 1, 60))
    return documents.select("doc_id", T.llm_name(answer, F.col("category"), F.col("title")).alias("name"))


@query(
    "seed_urls",
    sql="""WITH d AS (SELECT DISTINCT url, coalesce(CAST(seed_rank AS VARCHAR), title) AS p FROM seed_urls WHERE url IS NOT NULL)
    SELECT url, p, greatest(1, least(3, CASE WHEN regexp_matches(p, '^[0-9]+$') THEN TRY_CAST(p AS INT) ELSE 3 END)) AS priority FROM d""",
)
def priority_strings(seed_urls):
    """Priorities given as text: digits are numbers, all else is the lowest, then between 1 and 3."""
    d = seed_urls.where("url is not null").select("url", F.coalesce(F.col("seed_rank").cast("string"), "title").alias("p")).distinct()
    return d.select("url", "p", V.clamp_priority(F.col("p")).alias("priority"))


def _meta_sql(*names: str) -> str:
    return f"coalesce({first_of('(?is)<meta[^>]*(?:name|property)=[' + chr(34) + chr(39) + ']?(?:' + '|'.join(n.replace('.', chr(92) + '.') for n in names) + ')[' + chr(34) + chr(39) + ']?[^>]*content=[' + chr(34) + chr(39) + ']([^' + chr(34) + chr(39) + ']*)')}, '')"


@query(
    "fetch_results",
    sql=f"""WITH r AS (SELECT fetch_id, html FROM fetch_results UNION ALL SELECT -1, '<head><meta name="author" content="A. Bell"><META property=og:site_name content=''The Site''><meta property="article:published_time" content="2024-05-01"></head>' FROM (SELECT 1 FROM fetch_results LIMIT 1))
    SELECT fetch_id, {_meta_sql('author')} AS author, {_meta_sql('article:published_time', 'date')} AS date, {_meta_sql('og:site_name')} AS sitename FROM r""",
)
def page_meta(fetch_results):
    """Author, date and site name of each page; one written page stands for those that have them."""
    example = """<head><meta name="author" content="A. Bell"><META property=og:site_name content='The Site'><meta property="article:published_time" content="2024-05-01"></head>"""
    rows = fetch_results.select("fetch_id", "html").unionAll(fetch_results.limit(1).select(F.lit(-1).cast("bigint"), F.lit(example)))
    h = F.col("html")
    return rows.select("fetch_id", H.meta(h, "author").alias("author"), H.meta(h, "article:published_time", "date").alias("date"), H.meta(h, "og:site_name").alias("sitename"))
