"""Reader of pages and main bodies: untidy markup, nulls, template lines."""

from pyspark.sql import functions as F

from webspark.llm import dom, mainbody
from webspark.llm.common import site


def lines(html):
    return [dom.digits0(t.lower()) for _, t, _ in dom.parse(html).lines]


def test_lines_are_bounded_by_blocks_only():
    assert lines("<p>One <b>two</b> <a href=x>three</a><br>four</p>five\nsix") == ["one two three", "four", "five", "six"]
    assert lines("<p>a&nbsp;&amp;  b　c 12 34") == ["a & b c 0 0"]


def test_hidden_parts():
    page = '<head><title>T</title><style>.a{}</style></head><body><script>var t="<p>no</p>"</script><!-- <p>no --><noscript>Enable</noscript><p>yes<template><p>no</template>'
    assert lines(page) == ["yes"]
    assert dom.parse(page).title == "T" and dom.parse(page).noscript == ["Enable"]


def test_untidy_markup():
    assert lines("<ul><li>a<li>b</ul><p>c<p>d<table><tr><td>e<td>f") == ["a", "b", "c", "d", "e", "f"]
    assert lines('<p title="a > b">x</p><p class=c>y') == ["x", "y"]
    assert lines("<p>1 < 2 and <i>3</p>") == ["0 < 0 and 0"]
    assert lines("") == [] and lines("<!-- open <p>x") == [] and lines("<") == ["<"]


def test_words():
    assert dom.words("ab 图书 c。") == ["ab", "图", "书", "c。"] or dom.words("ab 图书 c") == ["ab", "图", "书", "c"]


def test_sites(spark):
    df = spark.createDataFrame([("HTTP://WWW.A.Test:8080/x",), ("https://a.test?q",), (None,), ("x",)], "u string")
    assert [r[0] for r in df.select(site(F.col("u"))).collect()] == ["a.test", "a.test", "", ""]


PAGE = """<html><head><title>{title} - Acme</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>
<main><h1>{title}</h1><div>By the Acme newsroom</div>{body}<p>Share this page</p><div class="more"><h3>Related</h3><p><a href="/r{n}">Other {n}</a></p></div></main>
<footer><p>&copy; 2024 Acme</p></footer></body></html>"""


def body(n):
    return f"<p>Paragraph number {n} of the article tells of subject {'abcdefghij'[n]} with enough words to be text.</p><p>A second paragraph {'klmnopqrst'[n]} goes on about it in many more words than a menu has.</p>"


def test_tree_matching_prefers_equal_text():
    a, b = (mainbody.segment(dom.parse(PAGE.format(title=t, body=body(n), n=n))) for n, t in ((1, "One"), (2, "Two")))
    same = {a.norms[j] for j in mainbody.constant_lines(mainbody.Tree(a), mainbody.Tree(b))}
    assert "share this page" in same and "by the acme newsroom" in same
    assert not any("paragraph" in t for t in same)


def test_main_body(spark):
    rows = [(i, f"https://acme.test/{i}", PAGE.format(title=f"Title {'abcdefghij'[i]}", body=body(i), n=i)) for i in range(8)]
    rows += [(100, None, None), (101, "https://acme.test/e", ""), (102, "https://acme.test/0", rows[0][2]), (103, None, "<p>alone</p>")]
    df = spark.createDataFrame(rows, "fetch_id bigint, final_url string, html string").withColumn("site", F.lit(1)).withColumn("mask", F.lit(2))
    got = {}
    for r in mainbody.main_body(df).collect():
        got.setdefault(r.fetch_id, []).append((r.pos, r.line))
    texts = {k: [t for _, t in sorted(v)] for k, v in got.items()}
    assert texts[3][0] == "title d" and len(texts[3]) == 3 and all("paragraph" in t for t in texts[3][1:])
    assert texts[102] == texts[0] and 100 not in texts and 101 not in texts and texts[103] == ["alone"]
    assert mainbody.found(df.limit(0)).count() == 0
    hashes = mainbody.found(df).where("fetch_id = 103").collect()
    import hashlib

    assert [r.line_hash for r in hashes] == [hashlib.md5(b"alone").hexdigest()[:16]]


def test_page_without_heading_or_text():
    assert mainbody.segment(dom.parse("<body><div><a href=/>Home</a> | <a href=/n>News</a></div></body>")).norms == []
    assert mainbody.segment(dom.parse("")).norms == []
