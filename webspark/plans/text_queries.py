"""Queries over texts and pages: cleaning, sentences, names, extraction, chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import chunk, dedup, links
from ..operators.rank import running_rank
from .registry import query

WS = T.WS
W = T.WORD[1:-1]


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(t: str) -> str:
    return strip(f"regexp_replace({t}, '{WS}+', ' ', 'g')")


def clean(t: str, extra: str = "") -> str:
    return strip(f"regexp_replace(regexp_replace(coalesce({t}, ''), '{WS}+', ' ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f{extra}]', '', 'g')")


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WS}+'), lambda w: w <> '')"


def last(t: str, char: str) -> str:
    return f"(CASE WHEN position('{char}' IN reverse({t})) > 0 THEN length({t}) - position('{char}' IN reverse({t})) ELSE -1 END)"


@query("documents", sql=f"SELECT doc_id, {clean('text')} AS cleaned, {clean('text', chr(92) + 'x{80}-' + chr(92) + 'x{9f}')} AS cleaned_v2, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS short FROM documents")
def clean_text(documents):
    """Cleaned texts, both rules, and truncated ones."""
    t = F.col("text")
    return documents.select("doc_id", T.clean(t).alias("cleaned"), T.clean(t, c1=True).alias("cleaned_v2"), T.truncate(t, 100).alias("short"))


@query("documents", sql=f"SELECT doc_id, CAST(len({words('coalesce(text, ' + chr(39) * 2 + ')')}) AS INT) AS n_words, length(coalesce(text, '')) AS n_chars FROM documents")
def word_counts(documents):
    """Words and characters of each text."""
    return documents.select("doc_id", T.word_count(F.col("text")).alias("n_words"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"))


@query(
    "documents",
    sql=f"""SELECT doc_id, CAST(pos AS INT) AS pos, sentence FROM (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM
    (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？]+'), lambda x: {clean('x')}), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL))""",
)
def sentences(documents):
    """Sentences of each text in order."""
    return documents.where("text is not null").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


_C = collapse("coalesce(text, '')")
_CUT = "substr(c, 1, 500)"
_CUT2 = "substr(t, 1, 500)"


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, {_C} AS c, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, CASE WHEN length(c) <= 500 THEN c WHEN {last(_CUT, '.')} > 250 THEN substr(c, 1, {last(_CUT, '.')} + 1) ELSE {_CUT} || '...' END AS summary,
    CASE WHEN length(t) <= 500 THEN t WHEN {last(_CUT2, '.')} > 300 THEN substr(t, 1, {last(_CUT2, '.')} + 1)
    ELSE (CASE WHEN {last(_CUT2, ' ')} > 0 THEN substr(t, 1, {last(_CUT2, ' ')}) ELSE {_CUT2} END) || '...' END AS preview FROM d""",
)
def summaries(documents):
    """Summaries and previews of at most 500 characters."""
    return documents.select("doc_id", T.summary(F.col("text")).alias("summary"), T.preview(F.col("text")).alias("preview"))


@query(
    "documents",
    sql="""WITH h AS (SELECT doc_id, md5(text) AS content_hash, sha1(text) AS sha1, sha256(text) AS sha256, substr(sha256(text), 1, 16) AS short_hash FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, content_hash, sha1, sha256, short_hash, min(doc_id) OVER (PARTITION BY content_hash) AS first_id, count(*) OVER (PARTITION BY content_hash) AS n_copies FROM h""",
)
def content_hashes(documents):
    """Hashes of each text with the first document of equal text."""
    t = F.col("text")
    d = documents.where("text is not null")
    h = d.select("doc_id", F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"), T.short_hash(t).alias("short_hash"))
    return h.join(dedup.exact_duplicates(d, "doc_id", "text"), "doc_id")


@query("documents", sql="SELECT content_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM (SELECT doc_id, md5(text) AS content_hash FROM documents WHERE text IS NOT NULL) GROUP BY content_hash")
def exact_dups(documents):
    """One row a content: its first document and the number of copies."""
    h = documents.where("text is not null").select("doc_id", F.md5("text").alias("content_hash"))
    return h.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def _us(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '_+', '_', 'g'), '^_+|_+$', '', 'g')"


_STORE = f"regexp_replace(substr({_us(f'regexp_replace(lower(title), ' + chr(39) + '[^' + W + ']' + chr(39) + ', ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, 1, 50), '_+$', '')"
_NAMER_T = "regexp_replace(lower({}), '[^a-z0-9_]', '_', 'g')"


def _namer(t: str) -> str:
    return f"regexp_replace(substr({_us(_NAMER_T.format(t))}, 1, 50), '_+$', '')"


_RT = r"regexp_replace(lower(title), '[^a-z0-9\s\x{4e00}-\x{9fff}]', '', 'g')"
_RW = rf"CASE WHEN regexp_matches({_RT}, '[\x{{4e00}}-\x{{9fff}}]') THEN regexp_extract_all({_RT}, '[a-z]+')[1:4] ELSE list_filter(regexp_split_to_array({_RT}, '\s+'), lambda w: length(w) > 2)[1:6] END"
_V2T = f"{_us(f'regexp_replace(substr(title, 1, 30), ' + chr(39) + '[^' + W + '-]' + chr(39) + ', ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}"


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, title, url, category, {_RW} AS w FROM documents WHERE title IS NOT NULL)
    SELECT doc_id, CASE WHEN {_STORE}='' THEN 'unnamed' ELSE {_STORE} END AS storage_name, {_namer('title')} AS namer_name,
    {_namer("(CASE WHEN len(w) > 0 THEN array_to_string(w, '_') ELSE 'page_' || substr(md5(title), 1, 8) END)")} AS rule_name,
    concat_ws('_', category, substr(md5(coalesce(url, '')), 1, 8), CASE WHEN {_V2T}='' THEN 'page' ELSE {_V2T} END) AS v2_name,
    concat_ws('_', {_namer('title')}, substr(md5(coalesce(url, '')), 1, 8)) AS hashed_name FROM d""",
)
def filenames(documents):
    """Names of files from titles, by each of the rules."""
    t, u = F.col("title"), F.coalesce("url", F.lit(""))
    return documents.where("title is not null").select(
        "doc_id",
        T.sanitize_storage(t).alias("storage_name"),
        T.sanitize_namer(t).alias("namer_name"),
        T.rule_name(t).alias("rule_name"),
        T.name_v2(F.col("category"), u, t).alias("v2_name"),
        F.concat_ws("_", T.sanitize_namer(t), F.substring(F.md5(u), 1, 8)).alias("hashed_name"),
    )


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, {_namer('title')} AS base FROM documents WHERE title IS NOT NULL), r AS (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) - 1 AS k FROM d)
    SELECT doc_id, CASE WHEN k = 0 THEN base ELSE base || '_' || k END AS filename FROM r""",
)
def filename_unique(documents):
    """Names made unique with a running number."""
    d = documents.where("title is not null").select("doc_id", T.sanitize_namer(F.col("title")).alias("base"))
    ranked = running_rank(d, ["base"], "doc_id", rank="k")
    return ranked.select("doc_id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", (F.col("k") - 1).cast("string"))).alias("filename"))


# -- Pages ----------------------------------------------------------------------------------


def strip_tags(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


def unescape(t: str) -> str:
    return reduce(lambda c, e: f"replace({c}, '{e[0]}', {chr(39) + e[1].replace(chr(39), chr(39) * 2) + chr(39)})", H.ENTITIES, t)


def page_text_sql(t: str) -> str:
    return collapse(unescape(f"regexp_replace(regexp_replace(coalesce({t}, ''), '{H.DROP_ALL}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"))


def first_of(p: str) -> str:
    p = p.replace("'", "''")
    return f"nullif({collapse(unescape(strip_tags(f'regexp_extract(coalesce(html, ' + chr(39) * 2 + f'), {chr(39)}{p}{chr(39)}, 1)')))}, '')"


_TITLE = f"coalesce({first_of('(?is)<title[^>]*>(.*?)</title')}, {first_of('(?is)<h1[^>]*>(.*?)</h1')}, '')"
_LANG = """lower(regexp_extract(coalesce(html, ''), '(?is)<html[^>]*\\blang\\s*=\\s*["'']?([A-Za-z-]+)', 1))"""


@query("fetch_results", sql=f"SELECT fetch_id, {_TITLE} AS title, {_LANG} AS language FROM fetch_results")
def page_title(fetch_results):
    """Titles and languages of pages."""
    return fetch_results.select("fetch_id", H.title(F.col("html")).alias("title"), H.language(F.col("html")).alias("language"))


@query(
    "fetch_results",
    sql=f"""WITH p AS (SELECT fetch_id, {page_text_sql('html')} AS text FROM fetch_results) SELECT fetch_id, text, CAST(len({words('text')}) AS INT) AS word_count, length(text) >= 100 AS long_enough FROM p""",
)
def page_text(fetch_results):
    """Visible text of each page by the default extractor."""
    t = fetch_results.select("fetch_id", H.text(F.col("html")).alias("text"))
    return t.select("fetch_id", "text", T.word_count(F.col("text")).alias("word_count"), (F.length("text") >= 100).alias("long_enough"))


_ALL = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f]', 'x', 'g')"


def _phones(patterns) -> str:
    return "list_sort(list_distinct(" + " || ".join(f"regexp_extract_all({_ALL}, '{p}')" for p in patterns) + "))[1:10]"


@query(
    "documents",
    sql=f"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '{H.EMAIL}')))[1:20] AS emails, {_phones((H.PHONE_US, H.PHONE_INTL))} AS phones, {_phones((H.PHONE_US, H.PHONE_INTL, H.PHONE_12))} AS phones_wide,
    list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '{H.URL_IN_TEXT.replace("'", "''")}'))) AS urls FROM documents""",
)
def contacts(documents):
    """E-mail addresses, telephone numbers and urls in texts."""
    t = F.col("text")
    return documents.select(
        "doc_id", H.emails(t).alias("emails"), H.phones(t).alias("phones"), H.phones(t, (H.PHONE_US, H.PHONE_INTL, H.PHONE_12)).alias("phones_wide"), H.urls_in_text(t).alias("urls")
    )


_P = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g')"
_HREF = links._HREF.replace("'", "''")
_PIECES = f"list_filter(string_split_regex({_P}, '(?i)<a\\s')[2:], lambda x: contains(x, '>'))"
_END = links._ANCHOR_END
LINKS_SQL = f"""z AS (SELECT fetch_id, coalesce(final_url, url, '') AS base, {_PIECES} AS xs FROM fetch_results WHERE html IS NOT NULL),
    a AS (SELECT fetch_id, base, pos, regexp_extract(x, '(?s)^([^>]*)>', 1) AS attr, regexp_replace(regexp_replace(x, '(?s)^[^>]*>', ''), '{_END}', '') AS inner_html FROM (SELECT fetch_id, base, unnest(range(len(xs))) AS pos, unnest(xs) AS x FROM z)),
    b AS (SELECT fetch_id, base, pos, trim({unescape("(regexp_extract(attr, '" + _HREF + "', 1) || regexp_extract(attr, '" + _HREF + "', 2) || regexp_extract(attr, '" + _HREF + "', 3))")}) AS href,
      {collapse(unescape(strip_tags('inner_html')))} AS label, regexp_extract(attr, '(?is)(?:^|\\s)title\\s*=\\s*["'']([^"'']*)', 1) AS titled FROM a),
    c AS (SELECT *, CASE WHEN label <> '' THEN label ELSE titled END AS text FROM b WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)'))"""


@query("fetch_results", sql=f"WITH {LINKS_SQL} SELECT fetch_id, CAST(pos AS INT) AS pos, href, text FROM c")
def link_extract(fetch_results):
    """Every reference to a page, in document order."""
    a = links.anchors(fetch_results)
    return a.where(~links.skipped(F.col("href"))).select("fetch_id", "pos", "href", "text")


def _resolve_sql() -> str:
    from .url_queries import part

    dir_ = f"regexp_replace({part('base', 3)}, '[^/]*$', '')"
    whole = "regexp_replace(base, '#.*$', '')"
    return (
        f"CASE WHEN href='' THEN {whole} WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN {part('base', 1)} || ':' || href"
        f" WHEN href LIKE '/%' THEN {part('base', 1)} || '://' || {part('base', 2)} || href WHEN href LIKE '?%' THEN regexp_replace({whole}, '\\?.*$', '') || href"
        f" WHEN href LIKE '#%' THEN {whole} || href ELSE {part('base', 1)} || '://' || {part('base', 2)} || CASE WHEN {dir_}='' THEN '/' ELSE {dir_} END || href END"
    )


def _capped_sql() -> str:
    from .url_queries import part

    return f"""WITH {LINKS_SQL}, d AS (SELECT fetch_id, pos, {_resolve_sql()} AS url, base, text FROM c),
    e AS (SELECT *, row_number() OVER (PARTITION BY fetch_id, url ORDER BY pos) AS k FROM d),
    f AS (SELECT *, contains({part('url', 2)}, {part('base', 2)}) AS is_internal, count(*) OVER (PARTITION BY fetch_id) AS n FROM e WHERE k = 1),
    g AS (SELECT *, row_number() OVER (PARTITION BY fetch_id ORDER BY CASE WHEN n > 20 AND NOT is_internal THEN 1 ELSE 0 END, pos) AS link_no FROM f)
    SELECT fetch_id, CAST(link_no AS INT) AS link_no, url, substr(text, 1, 100) AS text, is_internal FROM g WHERE link_no <= 20"""


@query("fetch_results", sql=_capped_sql())
def link_cap_internal_first(fetch_results):
    """Links of pages as stored: absolute, once each, at most 20 with internal ones first."""
    return links.extract(fetch_results)


def _windows(end: str, size: int, overlap: int, first: str, keep: str, shown: str, short: str = "") -> str:
    """SQL of windows as a recursion over their starts; ``end`` is the end of the one at ``s``."""
    step = f"CASE WHEN e < n THEN e - {overlap} ELSE e END"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE coalesce(text, '') <> ''),
    w(doc_id, text, n, s, e) AS (SELECT doc_id, text, n, 0, {end.replace('@', '0')} FROM d WHERE {first}
    UNION ALL SELECT doc_id, text, n, s, {end.replace('@', 's')} FROM (SELECT doc_id, text, n, {step} AS s FROM w) WHERE s < n),
    c AS (SELECT doc_id, s, {shown} AS e, {strip('substr(text, s + 1, e - s)')} AS chunk FROM w), k AS (SELECT * FROM c WHERE {keep} {short})
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_id, CAST(s AS INT) AS chunk_start, CAST(e AS INT) AS chunk_end, chunk FROM k"""


_DOT = "CASE WHEN @ + 500 < n AND contains(substr(text, @ + 401, 100), '.') THEN @ + 401 + length(regexp_extract(substr(text, @ + 401, 100), '(?s)^(.*)\\.', 1)) ELSE @ + 500 END"
_SENT = rf"regexp_extract(substr(text, @ + 401, 200), '(?s)^(.*[.!?。！？]{WS}+)', 1)"
_SENT = f"CASE WHEN @ + 600 < n AND @ + 400 + length({_SENT}) > @ + 100 AND {_SENT} <> '' THEN @ + 400 + length({_SENT}) ELSE least(@ + 600, n) END"
_BACK = "substr(text, @ + 402, 200)"
_BACK = f"CASE WHEN @ + 600 < n AND regexp_matches({_BACK}, '[.!?。]') THEN @ + 402 + length(regexp_extract({_BACK}, '(?s)^(.*)[.!?。]', 1)) ELSE @ + 600 END"
_FITS = "length(cur) + length(ps[i + 1]) <= 600"


@query(
    "documents",
    sql=f"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
    r(doc_id, ps, i, cur, chunk) AS (SELECT doc_id, ps, 0, '', CAST(NULL AS VARCHAR) FROM p WHERE len(ps) > 0 UNION ALL
    SELECT doc_id, ps, i + 1, CASE WHEN cur = '' THEN ps[i + 1] WHEN {_FITS} THEN cur || chr(10) || chr(10) || ps[i + 1] ELSE CASE WHEN length(cur) > 100 THEN substr(cur, length(cur) - 99) ELSE cur END || chr(10) || chr(10) || ps[i + 1] END,
    CASE WHEN NOT {_FITS} AND length(cur) >= 50 THEN cur END FROM r WHERE i < len(ps)),
    e AS (SELECT doc_id, i, chunk FROM r WHERE chunk IS NOT NULL UNION ALL SELECT doc_id, i + 1, cur FROM r WHERE i = len(ps) AND length(cur) >= 50)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_id, chunk FROM e""",
)
def chunk_paragraph(documents):
    """Chunks of packed paragraphs."""
    out = chunk.pack_paragraphs(F.col("text"), 600, 100, 50, "\n")
    return documents.where("text is not null").select("doc_id", F.posexplode(out).alias("chunk_id", "chunk"))


@query("documents", sql=_windows(_DOT, 500, 100, "n >= 50", "length(chunk) >= 50", "least(e, n)", "") + " UNION ALL SELECT doc_id, 0, 0, CAST(n AS INT), text FROM d WHERE n < 50")
def chunk_window(documents):
    """Chunks of character windows."""
    return chunk.chunked(documents, "doc_id", "text", chunk.window_chunks, size=500, overlap=100)


@query("documents", sql=_windows(_SENT, 600, 100, "true", "chunk <> ''", "e"))
def chunk_sentence(documents):
    """Chunks of windows that end at sentences."""
    return chunk.chunked(documents, "doc_id", "text", chunk.sentence_chunks, size=600, overlap=100)


@query("documents", sql=_windows(_BACK, 600, 100, "true", "chunk <> ''", "e"))
def chunk_scan_back(documents):
    """Chunks of windows that end at the nearest sentence character."""
    return chunk.chunked(documents, "doc_id", "text", chunk.scan_back_chunks, size=600, overlap=100)
