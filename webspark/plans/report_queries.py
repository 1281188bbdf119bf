"""Queries over values, aggregates, catalog and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import report
from ..operators.rank import top_per
from .registry import query
from .text_queries import words

_FENCE = "'(?s)```json\\s*(.*?)\\s*```'"
_FENCE2 = "'(?s)```(?:json)?\\s*(.*?)\\s*```'"


def _ok(t: str) -> str:
    return f"CASE WHEN json_valid({t}) THEN {t} END"


def _part(p: str) -> str:
    return f"nullif(regexp_extract(text, {p}, 1), '')"


_JSON = f"coalesce({_ok('trim(text)')}, {_ok('trim(' + _part(_FENCE) + ')')}, {_ok(_part(chr(39) + '(?s)(' + chr(92) + '{.*' + chr(92) + '})' + chr(39)))}, {_ok(_part(chr(39) + '(?s)(' + chr(92) + '[.*' + chr(92) + '])' + chr(39)))})"
_JSON2 = "coalesce(" + ", ".join(f"CASE WHEN starts_with({c}, '{{') AND json_valid({c}) THEN {c} END" for c in ("trim(text)", _part(_FENCE2), _part("'(?s)(\\{.*\\})'"))) + ")"


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, {_JSON} AS js, {_JSON2} AS obj FROM documents WHERE category = 'llm_json' AND text IS NOT NULL)
    SELECT doc_id, js, obj, coalesce(TRY_CAST(json_extract_string(obj, '$.relevance_score') AS DOUBLE), 0.5) AS relevance_score, coalesce(json_extract_string(obj, '$.summary'), '') AS summary FROM d""",
)
def json_extract(documents):
    """JSON values in model answers, and typed fields of them with defaults."""
    t = F.col("text")
    d = documents.where("category = 'llm_json' and text is not null").select("doc_id", V.json_in_text(t).alias("js"), V.json_object_in_text(t).alias("obj"))
    return d.select(
        "doc_id",
        "js",
        "obj",
        F.coalesce(F.get_json_object("obj", "$.relevance_score").try_cast("double"), F.lit(0.5)).alias("relevance_score"),
        F.coalesce(F.get_json_object("obj", "$.summary"), F.lit("")).alias("summary"),
    )


@query(
    "queue_items",
    sql="""SELECT DISTINCT url, parent_url, coalesce(context['link_type'], 'none') AS link_type, CAST(cardinality(context) AS INT) AS n_context,
    (coalesce(nullif(context['link_text'], ''), 'no text')) AS merged_text FROM queue_items WHERE url IS NOT NULL""",
)
def map_merge(queue_items):
    """Context of queued urls merged over defaults: the later value holds, empty ones do not count."""
    ctx = F.map_filter(F.coalesce("context", F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v, F.lit("")) != "")
    base = F.create_map(F.lit("link_text"), F.lit("no text"), F.lit("link_type"), F.lit("none"))
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(ctx, k))
    merged = F.map_concat(rest, ctx)
    return queue_items.where("url is not null").select(
        "url", "parent_url", F.try_element_at(merged, F.lit("link_type")).alias("link_type"),
        F.when(F.col("context").isNotNull(), F.size("context")).alias("n_context"), F.try_element_at(merged, F.lit("link_text")).alias("merged_text"),
    ).distinct()


_DUR = "CASE WHEN s < 60 THEN printf('%.1f', s) || '秒' WHEN s < 3600 THEN printf('%.1f', s / 60) || '分钟' ELSE printf('%.1f', s / 3600) || '小时' END"


@query(
    "fetch_results",
    sql=f"""WITH f AS (SELECT fetch_id, fetched_at, loaded_at, CASE WHEN isfinite(fetch_time) THEN floor(fetch_time * 1000) + 0.25 END AS s, CAST(floor((epoch_us(loaded_at) - epoch_us(fetched_at)) / 1000000.0) AS BIGINT) AS d FROM fetch_results WHERE fetched_at IS NOT NULL)
    SELECT fetch_id, {_DUR} AS fetch_duration, CASE WHEN loaded_at IS NULL THEN '进行中 / In Progress' WHEN d < 60 THEN d || '秒 / ' || d || 's' WHEN d < 3600 THEN (d // 60) || '分' || (d % 60) || '秒 / ' || (d // 60) || 'm ' || (d % 60) || 's'
    ELSE (d // 3600) || '小时' || ((d % 3600) // 60) || '分 / ' || (d // 3600) || 'h ' || ((d % 3600) // 60) || 'm' END AS run_duration, strftime(fetched_at, '%Y%m%d_%H%M%S') AS stamp FROM f""",
)
def format_duration(fetch_results):
    """Durations in the two formats, and time stamps for names."""
    s = F.when(~F.isnan("fetch_time"), F.floor(F.col("fetch_time") * 1000) + F.lit(0.25))
    return fetch_results.where("fetched_at is not null").select(
        "fetch_id", V.duration(s.cast("double")).alias("fetch_duration"), V.duration_between(F.col("fetched_at"), F.col("loaded_at")).alias("run_duration"), V.stamp(F.col("fetched_at")).alias("stamp")
    )


@query(
    "analysis_results",
    sql="""SELECT count(*) AS total_pages, count(*) FILTER (WHERE success) AS successful_pages, count(*) - count(*) FILTER (WHERE success) AS failed_pages, CAST(coalesce(sum(len(prioritized_urls)), 0) AS BIGINT) AS total_urls_found,
    CAST(count(extracted_data) AS BIGINT) AS total_data_extracted, round(coalesce(count(*) FILTER (WHERE success) * 100.0 / nullif(count(*), 0), 0), 1) AS success_rate, min(analysed_at) AS start_time, max(analysed_at) AS end_time,
    CAST(floor((epoch_us(max(analysed_at)) - epoch_us(min(analysed_at))) / 1000000.0) AS BIGINT) AS duration_seconds FROM analysis_results""",
)
def crawl_summary(analysis_results):
    """Totals of a run in one pass."""
    ok = F.sum(F.coalesce("success", F.lit(False)).cast("bigint"))
    a = analysis_results.agg(
        F.count("*").alias("total_pages"),
        F.coalesce(ok, F.lit(0)).alias("successful_pages"),
        F.coalesce(F.sum(F.when(F.col("prioritized_urls").isNotNull(), F.size("prioritized_urls"))), F.lit(0)).cast("bigint").alias("total_urls_found"),
        F.count("extracted_data").alias("total_data_extracted"),
        F.min("analysed_at").alias("start_time"),
        F.max("analysed_at").alias("end_time"),
        F.timestamp_diff("SECOND", F.min("analysed_at"), F.max("analysed_at")).alias("duration_seconds"),
    )
    return a.withColumn("failed_pages", F.col("total_pages") - F.col("successful_pages")).withColumn("success_rate", V.percent(F.col("successful_pages"), F.col("total_pages")))


@query("analysis_results", sql="SELECT analysis_id, url, relevance_score, row_number() OVER (ORDER BY coalesce(relevance_score, 0) DESC, analysis_id) AS rank FROM (SELECT analysis_id, url, CASE WHEN isnan(relevance_score) THEN 0 ELSE relevance_score END AS relevance_score FROM analysis_results WHERE success) ORDER BY rank LIMIT 100")
def pages_by_relevance(analysis_results):
    """The hundred most relevant pages: a top-k, then ranks of its rows only."""
    from pyspark.sql import Window

    rows = analysis_results.where("success").select("analysis_id", "url", F.when(F.isnan("relevance_score"), 0.0).otherwise(F.col("relevance_score")).alias("relevance_score"))
    top = rows.orderBy(F.desc(F.coalesce("relevance_score", F.lit(0.0))), "analysis_id").limit(100)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.coalesce("relevance_score", F.lit(0.0))), "analysis_id")).cast("bigint"))


@query("documents", sql="SELECT category, source, count(*) AS n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size_bytes, round(sum(octet_length(encode(text))) / 1048576.0, 2) AS size_mb FROM documents WHERE text IS NOT NULL GROUP BY GROUPING SETS ((category, source), (category), ())")
def catalog_stats(documents):
    """Files and bytes by category and source, with subtotals and the total."""
    d = documents.where("text is not null").select("category", "source", F.octet_length("text").alias("n"))
    sums = d.rollup("category", "source").agg(F.count("*").alias("n_files"), F.sum("n").cast("bigint").alias("size_bytes"))
    return sums.withColumn("size_mb", V.megabytes(F.col("size_bytes")))


@query("documents", sql="SELECT doc_id, category, collected_at FROM documents WHERE collected_at IS NOT NULL ORDER BY collected_at DESC, doc_id LIMIT 100")
def catalog_newest(documents):
    """The newest hundred entries."""
    return documents.where("collected_at is not null").select("doc_id", "category", "collected_at").orderBy(F.desc("collected_at"), "doc_id").limit(100)


@query("documents", sql="SELECT category, lower(lang) AS lang, count(*) AS n, min(collected_at) AS first_at, max(collected_at) AS last_at FROM documents GROUP BY 1, 2")
def category_counts(documents):
    """Documents by category and language."""
    return documents.groupBy("category", F.lower("lang").alias("lang")).agg(F.count("*").alias("n"), F.min("collected_at").alias("first_at"), F.max("collected_at").alias("last_at"))


@query("documents", sql="SELECT category, count(*) AS kept, min(collected_at) AS oldest FROM documents WHERE NOT (category IN ('log', 'intent') AND collected_at < TIMESTAMP '2024-03-15 00:00:00') GROUP BY category")
def retention(documents):
    """What a retention rule keeps by category (strictly older entries go)."""
    old = F.col("category").isin("log", "intent") & (F.col("collected_at") < F.lit("2024-03-15 00:00:00").cast("timestamp_ntz"))
    return documents.where(~old).groupBy("category").agg(F.count("*").alias("kept"), F.min("collected_at").alias("oldest"))


_KW = f"list_filter({words('lower(coalesce(title, ' + chr(39) * 2 + '))')}, lambda w: length(w) > 4)"


@query("documents", sql=f"SELECT keyword, count(*) AS n FROM (SELECT doc_id, unnest({_KW}) AS keyword FROM documents) GROUP BY keyword ORDER BY n DESC, min(doc_id), keyword LIMIT 5")
def keyword_top5(documents):
    """The five most frequent title words; the earlier first on ties."""
    ws = F.filter(T.words(F.lower(F.coalesce("title", F.lit("")))), lambda w: F.length(w) > 4)
    k = documents.select("doc_id", F.explode(ws).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return k.orderBy(F.desc("n"), "first", "keyword").limit(5).select("keyword", "n")


_NL = "chr(10)"
_URLS = f"""list_transform(prioritized_urls[1:10], lambda u: '- [' || CASE coalesce(u.priority, 2) WHEN 1 THEN '{report.PRIORITY_LABELS[1]}' WHEN 2 THEN '{report.PRIORITY_LABELS[2]}' WHEN 3 THEN '{report.PRIORITY_LABELS[3]}' ELSE '中 / Medium' END
    || '] ' || coalesce(u.url, '') || CASE WHEN coalesce(u.reason, '') <> '' THEN {_NL} || '  - 原因: ' || u.reason ELSE '' END)"""


@query(
    "analysis_results",
    sql=f"""SELECT analysis_id, '### ' || coalesce(url, '') || {_NL} || {_NL} || '- **相关性 / Relevance**: ' || CASE WHEN isnan(relevance_score) THEN 'NaN' ELSE printf('%.2f', coalesce(relevance_score, 0.0)) END || {_NL} || {_NL}
    || CASE WHEN coalesce(summary, '') <> '' THEN '**摘要 / Summary**:' || {_NL} || {_NL} || '> ' || summary || {_NL} || {_NL} ELSE '' END
    || CASE WHEN len(key_findings) > 0 THEN '**关键发现 / Key Findings**:' || {_NL} || {_NL} || array_to_string(list_transform(key_findings, lambda x, i: i || '. ' || coalesce(x, '')), {_NL}) || {_NL} ELSE '' END
    || CASE WHEN len(prioritized_urls) > 0 THEN '**推荐访问 / Recommended URLs**:' || {_NL} || {_NL} || array_to_string({_URLS}, {_NL}) || CASE WHEN len(prioritized_urls) > 10 THEN {_NL} || '- ... (' || (len(prioritized_urls) - 10) || ' more URLs)' ELSE '' END || {_NL} ELSE '' END AS section
    FROM analysis_results WHERE success""",
)
def report_sections(analysis_results):
    """Markdown sections of pages."""
    return report.page_section(analysis_results.where("success"))


@query(
    "extracted_links",
    sql="SELECT fetch_id, count(*) AS n_links, count(*) FILTER (WHERE is_internal) AS internal_links, count(*) FILTER (WHERE NOT is_internal) AS external_links, count(DISTINCT url) AS n_urls FROM extracted_links GROUP BY fetch_id",
)
def link_stats(extracted_links):
    """Links of each page by kind."""
    by = extracted_links.groupBy("fetch_id", "url").agg(F.count("*").alias("n"), F.sum(F.col("is_internal").cast("bigint")).alias("i"), F.sum((~F.col("is_internal")).cast("bigint")).alias("e"))
    return by.groupBy("fetch_id").agg(
        F.sum("n").alias("n_links"), F.coalesce(F.sum("i"), F.lit(0)).alias("internal_links"), F.coalesce(F.sum("e"), F.lit(0)).alias("external_links"), F.count("url").alias("n_urls")
    )


@query(
    "analysis_results",
    sql="""SELECT coalesce(model_used, 'none') AS model, count(*) AS n, count(*) FILTER (WHERE success) AS n_ok, round(avg(CASE WHEN NOT isnan(relevance_score) THEN relevance_score END), 6) AS mean_score,
    round(avg(CASE WHEN NOT isnan(analysis_time) THEN analysis_time END), 6) AS mean_time FROM analysis_results GROUP BY 1""",
)
def model_stats(analysis_results):
    """Analyses by model."""
    mean = lambda c: F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 6)
    return analysis_results.groupBy(F.coalesce("model_used", F.lit("none")).alias("model")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("success", F.lit(False)).cast("bigint")).alias("n_ok"), mean("relevance_score").alias("mean_score"), mean("analysis_time").alias("mean_time")
    )
