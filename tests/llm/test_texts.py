"""Operators on texts (problems 3, 8, 9, 10)."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from webspark.llm import mixing, personal, tokens, truncation


@pytest.fixture(scope="module")
def coder():
    return tokens.transducer()


def test_ids_agree_with_the_public_library(coder):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(0)
    alphabet = "abcdefghijklmnopqrstuvwxyz ABCDE  \n\t0123456789.,'’éüñ中文图书馆Привет😀​<|>"
    texts = ["", "<|endoftext|> is text", "a" * 3000, "  \n\n x", "don't We'LL"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for t in texts:
        ids = coder.encode(t)
        assert ids == enc.encode_ordinary(t)
        d = tokens.StreamDecoder(coder.text)
        assert "".join([*map(d.push, ids), d.end()]) == t


def test_transducer_equals_plain_merging(coder):
    rng = random.Random(1)
    for _ in range(500):
        word = bytes(rng.choice(b"etaoin srhld\xc3\xa9\xe4\xb8\xad-19") for _ in range(rng.randint(1, 40)))
        assert coder.encode_word(word) == coder.merge(word)


def test_encoding_of_documents(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "hello world")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encoded(df).collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] != []
    assert all(r.exact for r in tokens.round_trip(df).collect()) and tokens.encoded(df.limit(0)).count() == 0


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, "a" if i < 300 else "b" if i < 330 else "c", " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(5, 40)))) for i in range(400)]
    rows += [(1000, "a", None), (1001, None, "x"), (1002, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("block", F.lit(0))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(docs, targets, 64).collect()
    uses = {}
    for r in mix:
        uses.setdefault((r.source, r.doc_id), []).append(r.use_no)
    assert {s for s, _ in uses} == {"a", "b"} and all(len(set(u)) == len(u) for u in uses.values())
    assert all(len(u) <= (1 if s == "a" else 4) for (s, _), u in uses.items()) and max(len(u) for (s, _), u in uses.items() if s == "b") > 1
    share = {r.source: r for r in mixing.shares(docs, targets, 64).collect()}
    assert share["none"].reached_share == 0 and abs(share["a"].reached_share - 0.625) < 0.03
    assert mixing.mixture(docs, targets, 64).collect() is not None
    assert mixing.mixture(docs.limit(0), targets).count() == 0


ENDINGS = [
    ("A whole sentence.", "page_text", "whole"), ("It stops in the mid", "page_text", "cut"), ("Ends with a comma,", "summary", "cut"), (None, "page_text", "empty"), (" \n", "log", "empty"),
    ("who offers grants", "intent", "whole"), ("A.\n\n- robotics\n- optics", "page_text", "whole"), ("- One sentence here.\n- Another that sto", "findings", "cut"), ("Text. (A title in brackets)", "page_text", "cut"),
    ("Text.\n\n(A title in brackets)", "page_text", "whole"), ("See https://a.test/some-pa", "page_text", "whole"), ('{"a": ["x", "y"]}', "llm_json", "whole"), ('```json\n{"a": "x', "llm_json", "cut"),
    ('```json\n{"a": 1}\n```', "llm_json", "whole"), ("|a|b|\n|---|---|\n|1|2|", "report", "whole"), ("|a|b|\n|---|---|\n|1|", "report", "cut"), ("2024-03-04 22:29:59 | INFO | Page was fetched.", "log", "whole"),
    ("2024-03-04 22:29:59 | INFO | Page was fetched.\n2024-03-04 22:3", "log", "cut"), ("All is said. To be continued...", "page_text", "dots"), ("All is said. The long sentence that goes on and on fo...", "page_text", "cut"),
    ("图书馆举办展览。", "summary", "whole"), ("图书馆举办展", "summary", "cut"), ("He said “yes.”", "page_text", "whole"), ("Code:\n```\nx = 1\n```", "page_text", "whole"), ("Code:\n```\nx = 1", "page_text", "cut"),
]


@pytest.mark.parametrize("text,category,want", ENDINGS)
def test_endings(text, category, want):
    assert truncation.ending(text, category)[0] == want


def test_censored_fit():
    rng = np.random.RandomState(0)
    x = np.exp(rng.normal(5.0, 0.5, 20000)).astype(int)
    y = np.minimum(x, 200)
    lengths, n = np.unique(y, return_counts=True)
    mu, sd = truncation.fit_censored(lengths, n, 200.0)
    assert abs(mu - 5.0) < 0.03 and abs(sd - 0.5) < 0.03


def test_truncated_documents(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 40))) + "."
        rows.append((i, text[:120], "s", "snippet"))
    rows += [(1000 + i, "Sentence " * (i + 1) + "is whole. To be continued...", "s", "snippet") for i in range(12)] + [(2000, None, "s", None), (2001, "", None, "snippet"), (2002, "x" * 50_000 + ".", "s", "page_text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, category string").withColumn("length", F.lit("clash"))
    got = {r[0] for r in truncation.found(docs).collect()}
    assert got == {i for i, t, _, _ in rows if t and len(t) == 120 and not t.endswith(".")}
    share = {r.source: r for r in truncation.by_source(docs).collect()}
    assert share["s"].n_truncated == len(got) and share[None].n_truncated == 0
    assert truncation.found(docs.limit(0)).count() == 0


def test_length_decides_open_endings(spark):
    """Dots, list items and wishes are cut at a field limit and whole elsewhere."""
    rng = random.Random(8)
    line = lambda n, end: (" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(200)))[: n - len(end)] + end
    rows = [(i, line(rng.randint(30, 400), "."), "s", "snippet") for i in range(600)] + [(1000 + i, line(200, "."), "s", "snippet") for i in range(120)]
    ends = [(". Hall e...", "snippet"), (".\n- robotics\n- optics", "findings"), ("", "intent"), (" https://a.test/pa", "page_text")]
    for k, (end, category) in enumerate(ends):
        rows += [(2000 + k, line(200, end), "s", category), (3000 + k, line(317, end), "s", category)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, category string")
    assert {r[0] for r in truncation.found(docs).collect()} == {2000, 2001, 2002, 2003}


def test_every_length_may_be_a_limit():
    """A limit that is rarer than 50 other lengths is found."""
    pdf = pd.DataFrame({"source": "s", "length": [*range(100, 180), 900], "n": [40] * 80 + [30]})
    assert 900 in set(truncation._limits(("s",), pdf)["length"])


@pytest.fixture(scope="module")
def names():
    given = {n: "given" for n in "Grace Igor Hanna Pavel Dean Mark".split()}
    return given | {n: "family" for n in "Ashendahl Brackley Copperwick Drayholt Fennby Lindvane Marlgard Ostermann Quillwell Tarnstrom 欧阳 席".split()}


@pytest.fixture(scope="module")
def tagger(names):
    return personal.Tagger(names, *personal.train(names))


def kinds(tagger, text):
    return {text[a:b]: k for a, b, k in tagger.items([text])[0]}


def test_items(tagger):
    assert kinds(tagger, "Please contact Grace Ashendahl on +44 20 7946 0312 before noon.") == {"Grace Ashendahl": "name", "+44 20 7946 0312": "phone"}
    assert kinds(tagger, "Questions go to igor.fennby@mail.example at any time.") == {"igor.fennby@mail.example": "email"}
    assert kinds(tagger, "联系人：欧阳洛禾，电话10071304403。") == {"欧阳洛禾": "name", "10071304403": "phone"}
    got = kinds(tagger, "Dr. Drayholt moved to 12 Quarry Lane, Marrowby last spring.")
    assert set(got.values()) == {"name", "address"}
    assert "id_number" in kinds(tagger, "File of Hanna Lindvane: social security number 950-88-4289.").values()


@pytest.mark.parametrize("text", ["The Marlgard Prize is worth €4100 this year.", "Order number 2729-2643-122 was archived.", "Sensor readings: 2054-77-00 to 208.413.4, n = 8779.", "Last updated: 12 May 2024", "Follow @marrowby_campus for updates.", "", "The Dean spoke in May."])
def test_no_items(tagger, text):
    assert kinds(tagger, text) == {}


def test_held_out_accuracy(names, tagger):
    data = personal.training_set(names, copies=1, seed=77)
    paths = tagger.decode([w for w, _ in data])
    right = sum((p == y).sum() for p, (_, y) in zip(paths, data))
    assert right / sum(len(y) for _, y in data) > 0.985


def test_placeholders(tagger):
    out = personal.replace(tagger, ["Ring Grace Ashendahl first (07700 900816).", ""])
    assert out == ["Ring [NAME] first ([PHONE]).", ""]
    page = '<p class="a">Write to <a href="mailto:igor.fennby@mail.example">us</a>.</p><script>var x="a@b.example"</script>'
    assert "[EMAIL]" in personal.replace_html(tagger, [page])[0] and "igor" not in personal.replace_html(tagger, [page])[0]


def test_items_split_by_tags(tagger):
    page = "<p>Use igor.fennby<b>@</b>mail.example for A &amp; B corrections.</p><p>Ask hanna&#64;uni.test &lt;now&gt;.</p>"
    assert personal.replace_html(tagger, [page, ""]) == ["<p>Use [EMAIL]<b></b> for A &amp; B corrections.</p><p>Ask [EMAIL] &lt;now&gt;.</p>", ""]


def test_fields(spark, names):
    table = spark.createDataFrame([(k, v) for k, v in names.items()] + [(None, "given")], "name_part string, part_kind string")
    fetch = spark.createDataFrame([(1, "<p>Thanks to Hanna Ostermann for the drawings.</p>"), (2, None), (3, ""), (4, '<a href="mailto:x.y@mail.example">m</a>')], "fetch_id bigint, html string").withColumn("id", F.lit(0))
    analysis = spark.createDataFrame([(1, "Text 07700 900816 when you arrive.", ["fine", None]), (2, None, None), (3, "", [])], "analysis_id bigint, summary string, key_findings array<string>")
    got = {tuple(r) for r in personal.found(fetch, analysis, table).collect()}
    assert got == {("fetch_results", 1, "html", "name"), ("fetch_results", 4, "html", "email"), ("analysis_results", 1, "summary", "phone")}
    red = {(r.record_table, r.record_id): r for r in personal.redacted(fetch, analysis, table).collect()}
    assert red["analysis_results", 1].summary == "Text [PHONE] when you arrive." and red["fetch_results", 2].html is None and red["analysis_results", 1].key_findings == ["fine", None]
