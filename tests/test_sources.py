"""Sources, store, providers, reports and streams on small fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webspark.operators import provider, report
from webspark.plans import presets
from webspark.sources import serp
from webspark.sources.store import Store, load_state, save_report, save_state
from webspark.streaming import ingest

BING = """<ol><li class="b_algo"><h2><a href="https://a.test/1">First title</a></h2><div class="b_caption"><p>First text</p></div></li>
<li class="b_algo"><h2><a href="https://www.bing.com/x">own</a></h2></li><li class="b_algo"><h2><a href="https://b.test/2">Second</a></h2><p>Second text</p></li></ol>"""
LITE = """<table><tr><td><a class="result-link" href="https://a.test/1">One</a></td></tr><tr><td><a class=result-link href="https://a.test/1">Again</a></td></tr>
<tr><td><a class=result-link href="//c.test/3">Three</a></td></tr></table>"""
GOOGLE = """<div class="g"><a href="https://a.test/1"><h3>Title</h3></a><div class="VwiC3b">Snippet</div></div><div class="g"><a href="https://maps.google.com/">x</a></div>"""
HTML = """<div class="result"><a class="result__a" href="//a.test/1">T</a><a class="result__snippet">S</a></div>"""


def test_result_pages():
    assert serp.results(BING, "bing") == [("https://a.test/1", "First title", "First text", "bing", 1, 1.0), ("https://b.test/2", "Second", "Second text", "bing", 3, 0.8)]
    assert [(r[0], r[4]) for r in serp.results(LITE, "duckduckgo_lite")] == [("https://a.test/1", 1), ("https://c.test/3", 3)]
    assert serp.results(GOOGLE, "google") == [("https://a.test/1", "Title", "Snippet", "google", 1, 1.0)]
    assert serp.results(HTML, "duckduckgo_html") == [("https://a.test/1", "T", "S", "duckduckgo_html", 1, 1.0)]
    assert serp.results('<a href="https://z.test/">A long title</a>', "bing")[0][5] == 0.8
    assert serp.results("", "bing") == []


def test_result_pages_as_table(spark):
    df = spark.createDataFrame([(1, "bing", BING), (2, "google", "please solve the CAPTCHA"), (3, "bing", None), (4, "other", BING)], "query_id bigint, engine string, html string")
    assert {(r.query_id, r.seed_rank) for r in serp.parse(df).collect()} == {(1, 1), (1, 3)}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("u1", "x", at), ("u2", "x", at), ("u3", "y", at)], "url string, html string, created_at timestamp")
    assert s.stage("raw") is None
    s.save(rows, "raw", "html")
    s.save(rows, "raw", "html")
    assert {r.url for r in s.stage("raw").collect()} == {"u1", "u3"}
    s.save(rows.where("url = 'u1'").withColumn("created_at", F.lit(datetime(2024, 2, 1))), "extracted", "html")
    assert [r.url for r in s.unprocessed("raw", "extracted").collect()] == ["u3"]
    assert s.latest("raw").count() == 2 and s.catalog().count() == 3
    s.clean("general", datetime(2024, 1, 15))
    assert [(r.url, r.stage) for r in s.catalog().collect()] == [("u1", "extracted")]
    save_state(rows, str(tmp_path), "f")
    assert load_state(spark, str(tmp_path), "f").count() == 3 and load_state(spark, str(tmp_path), "none") is None


def test_provider_sees_only_misses(spark, tmp_path):
    log = str(tmp_path / "asked")

    def make():
        def answer(prompts):
            with open(log, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return [p.upper() for p in prompts]

        return answer

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id bigint, prompt string")
    cache = df.where("id = 3").select(provider.cache_key("rules", "", F.col("prompt")).alias("cache_key"), F.lit("cached").alias("response"))
    got = {r.id: (r.answer, r.from_cache) for r in provider.ask(df, "prompt", make, cache=cache).collect()}
    assert got == {1: ("A", False), 2: ("A", False), 3: ("cached", True), 4: ("", False)}
    assert sorted(open(log).read().split("\n")) == ["", "", "a"]


def test_provider_failure(spark):
    def make():
        def answer(prompts):
            raise RuntimeError("down")

        return answer

    df = spark.createDataFrame([(1, "a")], "id bigint, prompt string")
    assert provider.ask(df, "prompt", make).first().answer_ok is False


def test_report(spark, tmp_path):
    schema = "analysis_id bigint, url string, relevance_score double, summary string, key_findings array<string>, prioritized_urls array<struct<url:string,priority:int,reason:string,link_text:string>>"
    df = spark.createDataFrame([(1, "https://a.test", 0.95, "Sum", ["f1", None], [("u", 1, "why", "t")] * 12), (2, None, None, None, None, None)], schema)
    rows = {r.analysis_id: r.section for r in report.page_section(df).collect()}
    assert "1. f1\n2. " in rows[1] and "🔴 高 / High] u\n  - 原因: why" in rows[1] and "(2 more URLs)" in rows[1]
    assert rows[2].startswith("### \n")
    files = report.write_report({"total": 2}, report.page_section(df).withColumn("rank", F.col("analysis_id")), str(tmp_path), "r")
    assert [f.rsplit(".", 1)[1] for f in files] == ["md", "json"]


def test_settings():
    s = presets.CrawlSettings.from_json('{"max_pages": 7, "unknown": 1}')
    assert s.max_pages == 7 and presets.CrawlSettings.from_json(s.to_json()) == s
    assert presets.fast().max_depth == 2 and presets.deep().max_pages == 100
    with pytest.raises(ValueError):
        presets.CrawlSettings(chunk_size=100, chunk_overlap=60)


def test_stream_drops_repeated_content(spark, tmp_path):
    schema = "fetch_id bigint, final_url string, html string, loaded_at timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(1, "https://www.a.test/x", "h", at), (2, "https://a.test/y", "h", at), (3, None, "g", at)], schema).coalesce(1).write.parquet(src)
    stream = ingest.pages(spark, src, schema)
    q = ingest.to_table(ingest.new_content(stream).drop("ts"), out, str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {r.content_hash for r in spark.read.parquet(out).collect()} and spark.read.parquet(out).count() == 2


def test_files(spark, tmp_path):
    from webspark.sources import files

    assert files.write_json({"a": [1, "é"]}, str(tmp_path / "d" / "x.json")) and not files.write_json({"a": 1}, "/proc/none/x.json")
    assert files.records(spark, str(tmp_path / "d"), "a array<string>").first().a == ["1", "é"]
    assert files.texts(spark, str(tmp_path / "d")).count() == 1
    assert files.sizes(spark, str(tmp_path / "d")).first().n_files == 1


def test_store_keeps_metadata_and_clears(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("u1", "x", "T", datetime(2024, 1, 1), ["a"]), ("u2", "y", None, datetime(2024, 1, 1), [])], "url string, text string, title string, created_at timestamp, urls array<string>")
    s.save_processed(rows.drop("urls"), "text")
    s.save_analysis(rows, "text", "urls")
    got = {r.url: (r.metadata, r.has_urls) for r in s.stage("analyzed").collect()}
    assert got == {"u1": ('{"url":"u1","title":"T"}', True), "u2": ('{"url":"u2"}', False)}
    assert s.stage("extracted").where("processed_at is not null").count() == 2
    s.export(str(tmp_path / "out"), "analyzed")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    s.clean("general", datetime(2023, 1, 1))
    assert s.catalog().count() == 4 and not (tmp_path / "store" / "pages_new").exists()
    s.clean_all()
    assert s.stage("raw") is None
    assert save_report("# x", str(tmp_path), "news", "a.md", {"task": "t"}).endswith("reports/news/a.md") and (tmp_path / "task.json").exists()


def test_provider_keeps_the_good_prompts_of_a_failing_batch(spark):
    def make():
        def answer(prompts):
            if "bad" in prompts:
                raise ValueError("no answer")
            return [p.upper() for p in prompts]

        return answer

    df = spark.createDataFrame([("good",), ("bad",), ("fine",)], "p string").coalesce(1)
    got = {r.p: (r.answer, r.answer_ok, r.answer_error) for r in provider.ask(df, "p", make).collect()}
    assert got == {"good": ("GOOD", True, None), "fine": ("FINE", True, None), "bad": (None, False, "ValueError: no answer")}
