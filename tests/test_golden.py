"""Golden values of rules, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from webspark.functions import html as H
from webspark.functions import text as T
from webspark.functions import url as U
from webspark.functions import values as V
from webspark.operators import chunk, frontier, links, score


def one(spark, value, *exprs, kind="string"):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(*[e(F.col("x")).alias(f"c{i}") for i, e in enumerate(exprs)]).first()
    return row[0] if len(exprs) == 1 else tuple(row)


URLS = [
    ("HTTPS://WWW.Example.com:443/A/B/?q=1#top", "https://www.example.com/A/B?q=1", "https://WWW.Example.com:443/A/B/?q=1", "HTTPS://WWW.Example.com:443/A/B/?q=1", "www.example.com:443/a/b", "HTTPS://WWW.Example.com:443/A/B/"),
    ("http://example.com", "http://example.com/", "http://example.com", "http://example.com", "example.com", "http://example.com"),
    ("https://example.com/a//", "https://example.com/a", "https://example.com/a//", "https://example.com/a", "example.com/a", "https://example.com/a"),
    ("https://example.com/p;x=1?y=2", "https://example.com/p?y=2", "https://example.com/p;x=1?y=2", "https://example.com/p;x=1?y=2", "example.com/p", "https://example.com/p;x=1"),
    ("https://example.com:8080/", "https://example.com:8080/", "https://example.com:8080/", "https://example.com:8080", "example.com:8080", "https://example.com:8080"),
    ("https://example.com/?a=1#f", "https://example.com/?a=1", "https://example.com/?a=1", "https://example.com/?a=1", "example.com", "https://example.com/"),
]


@pytest.mark.parametrize("row", URLS)
def test_normal_forms(spark, row):
    assert one(spark, row[0], U.normalize, U.normalize_utils, U.normalize_v2, U.seed_key, U.link_key_v2) == row[1:]


def test_normal_form_is_idempotent_and_null_safe(spark):
    for u, *_ in URLS:
        n = one(spark, u, U.normalize)
        assert one(spark, n, U.normalize) == n
    assert one(spark, None, U.normalize) is None and one(spark, "", U.normalize) == "/"


@pytest.mark.parametrize("href,want", [("c", "https://www.stanford.edu/a/c"), ("/c/", "https://www.stanford.edu/c"), ("//cdn.x.org/e", "https://cdn.x.org/e"), ("?p=2", "https://www.stanford.edu/a/b?p=2")])
def test_resolution(spark, href, want):
    assert one(spark, href, lambda h: U.normalize(h, F.lit("https://www.stanford.edu/a/b"))) == want


def test_resolution_with_dots(spark):
    assert one(spark, "../d#z", lambda h: U.normalize(U.without_dots(U.resolve(h, F.lit("https://www.stanford.edu/a/b"))))) == "https://www.stanford.edu/d"


def test_hashes(spark):
    assert one(spark, "https://www.stanford.edu/admissions/", U.url_hash) == "76f521a6f1d6771b898f10d0d7a379cd"
    assert one(spark, "Test content", F.md5, T.short_hash) == ("8bfa8e0684108f419933a5995264d150", "9d9595c5d94fb65b")


@pytest.mark.parametrize("title,want", [("Stanford Admission Requirements 2024", "stanford_admission_requirements_2024"), ("斯坦福大学研究成果", "page_0afe4913"), ("Contact Us - Stanford University", "contact_stanford_university"), ("!!!Special @#$ Characters Test!!!", "special_characters_test")])
def test_rule_names(spark, title, want):
    assert one(spark, title, T.rule_name) == want


def test_whitespace_is_unicode(spark):
    assert one(spark, " a 　b\x1c c\x07 ", T.clean) == "a b c"
    assert one(spark, "é b c", T.word_count) == 3
    assert one(spark, None, T.clean, T.word_count) == ("", 0)


def test_filter_reason_keeps_substring_rule(spark):
    assert one(spark, "https://www.target.com/", lambda u: links.filter_reason(u, [])) == "pattern:.tar"
    assert one(spark, "", lambda u: links.filter_reason(u, [])) == "empty"
    assert one(spark, "ftp://x/", lambda u: links.filter_reason(u, [])) == "scheme"


@pytest.mark.parametrize("value,want", [("2", 2), ("-1", 3), ("high", 3), ("7", 3)])
def test_clamped_priorities(spark, value, want):
    assert one(spark, value, V.clamp_priority) == want


@pytest.mark.parametrize("url,text,want", [("https://x/admissions", "Admissions", 12), ("https://x/research", "Research", 10), ("https://x/x", "Undergraduate programs", 7)])
def test_link_priorities(spark, url, text, want):
    assert one(spark, text, lambda t: U.link_priority_v2(F.lit(url), t)) == want


@pytest.mark.parametrize("base,depth,kind,ai,want", [(10.0, 0, "seed", 10.0, -30.0), (3.0, 1, "admission", 3.0, -11.9), (0.0, 2, "news", 0.0, 0.7)])
def test_frontier_scores(spark, base, depth, kind, ai, want):
    assert one(spark, kind, lambda k: frontier.score(F.lit(base), F.lit(ai), k, F.lit(float(depth)))) == pytest.approx(want)


def test_search_keywords_and_categories(spark):
    assert one(spark, "Stanford University undergraduate admission requirements", score.search_keywords) == ["stanford", "university", "undergraduate", "admission", "requirements"]
    assert one(spark, "联系 招生 admission", score.guess_category) == "admission"
    assert one(spark, "weather", score.guess_category) == "general"
    assert one(spark, "a b", lambda t: score.full_query(F.array(t, F.lit("c")), F.lit("x.org"))) == '("a b" OR c) site:x.org'


def test_contacts(spark):
    t = "Write to info@stanford.edu or call 650-723-2300."
    assert one(spark, t, H.emails) == ["info@stanford.edu"]
    assert "650-723-2300" in one(spark, t, H.phones)


def test_html_traps(spark):
    page = """<html><head><title>A &amp; B</title><script>var t="</p><a href='/no'>x</a>"</script></head><body><nav>menu</nav><!-- <a href="/hidden">h</a> --><p><b>Text <a href=/x>one</a> <a href='/y' title="why"></a><a href="javascript:z">z</a>"""
    assert one(spark, page, H.title, H.text) == ("A & B", "A & B Text one z")  # the title is text, as in the rule
    df = spark.createDataFrame([(1, "https://h.test/p", page), (2, "https://h.test/q", None), (3, None, "")], "fetch_id bigint, final_url string, html string").withColumn("url", F.col("final_url"))
    got = [(r.fetch_id, r.url, r.text) for r in links.extract(df).orderBy("fetch_id", "link_no").collect()]
    assert got == [(1, "https://h.test/x", "one"), (1, "https://h.test/y", "why")]


def test_json_in_text(spark):
    assert one(spark, 'Here:\n```json\n{"a": 1}\n```', V.json_in_text) == '{"a": 1}'
    assert one(spark, "broken {", V.json_in_text) is None
    assert one(spark, "[1, 2]", V.json_in_text, V.json_object_in_text) == ("[1, 2]", None)


@pytest.mark.parametrize("sec,want", [(5.0, "5.0秒"), (90.0, "1.5分钟"), (7200.0, "2.0小时")])
def test_durations(spark, sec, want):
    assert one(spark, sec, V.duration, kind="double") == want


def test_window_chunks():
    text = "This is sentence one. " * 250
    parts = chunk.window_chunks(text, 100, 20, 50)
    assert (len(parts), len(parts[0][2]), len(parts[-1][2])) == (83, 87, 86)
    with pytest.raises(ValueError):
        chunk.window_chunks("x", 100, 60)


@pytest.mark.parametrize("how", [chunk.window_chunks, chunk.sentence_chunks, chunk.scan_back_chunks])
def test_chunks_cover_the_text(how):
    text = "".join(f"Sentence number {i}. " for i in range(400))
    covered = set()
    for a, b, part in how(text, size=500, overlap=100):
        assert part in text[a : b + 1]
        covered.update(range(a, b))
    assert len(covered) >= len(text) - 60
    assert how("", size=500, overlap=100) == [] if how is not chunk.window_chunks else True


def test_paragraph_packing(spark):
    text = "\n\n".join("p" * n for n in (300, 300, 900, 100))
    out = one(spark, text, lambda t: chunk.pack_paragraphs(t, 700, 50, 100))
    assert [len(x) for x in out] == [602, 952, 152]
    assert one(spark, None, chunk.pack_paragraphs) == []


def test_frontier_insert_and_order(spark):
    rows = [("https://e.test/a", 1, 0, 1), ("https://e.test/a/#x", 1, 0, 2), ("https://e.test/b.pdf", 1, 0, 3), ("https://e.test/c", 2, 9, 4), (None, 1, 0, 5), ("https://e.test/d", 1, 0, 6)]
    df = spark.createDataFrame(rows, "url string, priority int, depth int, seq int")
    seen = spark.createDataFrame([("https://e.test/d",)], "url string").select(U.url_hash(F.col("url")).alias("url_hash"))
    got = {r.seq: r.status for r in frontier.insert_status(df, ["seq"], 3, seen=seen).collect()}
    assert got == {1: "added", 2: "duplicate", 3: "filtered", 4: "depth", 5: "invalid", 6: "duplicate"}


def test_crawl_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "f")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    got = {r.url: r.depth for r in frontier.crawl(seeds, edges, 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 3}
    one_by_one = frontier.crawl(seeds, edges, 3, batch=1).collect()
    assert {r.url: r.depth for r in one_by_one} == got and len({r.round for r in one_by_one}) == 5
    assert frontier.crawl(seeds, edges, 3, max_pages=2).count() == 2
    assert frontier.crawl(seeds.limit(0), edges, 3).count() == 0


def test_left_open_anchors(spark):
    html = '<p><a href=/one>one<p><a href="/two">two</a> tail <a>x</a><A HREF=\'/three\' title="named"></a><a href=/four>four <b>bold</b></div>rest<script>"<a href=/no>no</a>"</script>'
    df = spark.createDataFrame([(1, "http://s.test/", "http://s.test/", html)], "fetch_id bigint, url string, final_url string, html string")
    assert [(r.href, r.text) for r in links.anchors(df).orderBy("pos").collect()] == [("/one", "one"), ("/two", "two"), ("/three", "named"), ("/four", "four bold")]


def test_exploration_draws_from_the_best_that_are_left(spark):
    rows = [(1 + i // 40, 0, i, f"http://s.test/{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "priority int, depth int, seq int, url string")
    assert [r.seq for r in frontier.explore(df, 10, 0.0, 1).collect()] == list(range(10))
    got = [r.seq for r in frontier.explore(df, 20, 1.0, 1).collect()]
    assert got == [r.seq for r in frontier.explore(df, 20, 1.0, 1).collect()] and len(set(got)) == 20
    left = list(range(31))
    for seq in got:  # each among the eleven best at its place
        assert left.index(seq) < 11
        left.remove(seq)
