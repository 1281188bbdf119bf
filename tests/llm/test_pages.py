"""Operators on pages (problems 1, 2, 4, 5, 6) against brute force on small fixtures."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webspark.llm import common, dom, encoding, neardup, repeats, residue, stuffing

WORDS = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]


def article(rng, n=120):
    ws = [rng.choice(WORDS) for _ in range(n)]
    return [" ".join(ws[i : i + 15]) + "." for i in range(0, n, 15)]


def html(title, paras):
    return f"<html><body><main><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras) + "</main></body></html>"


def frame(spark, rows):
    return spark.createDataFrame(rows, "fetch_id bigint, final_url string, html string").withColumn("body", F.lit("clash")).withColumn("text", F.lit("clash"))


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for k in range(12):
        base = article(rng)
        for v in range(3):
            paras = list(base)
            if v:
                paras[v] = " ".join(rng.choice(WORDS) for _ in range(15)) + "."
                rng.shuffle(paras)
            rows.append((i, f"https://s{k}{v}.test/{i}", html(f"title {WORDS[k]}", paras)))
            i += 1
    rows += [(i, "https://x.test/", rows[0][2]), (i + 1, None, None), (i + 2, None, ""), (i + 3, "https://y.test/", html("short", ["a few words."]))]
    df = frame(spark, rows)
    got = {(r[0], r[1]) for r in neardup.found(df).collect()}
    sets = {}
    for f, _, h in rows:
        ws = dom.words(" ".join(dom.digits0(t.lower()) for _, t, _ in dom.parse(h).lines)) if h else []
        if len(ws) >= 60:
            sets[f] = set(zip(ws, ws[1:], ws[2:]))
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 20
    classes = {r.fetch_id: r for r in neardup.classes(df).collect()}
    assert classes[0].class_id == classes[i].class_id == 0 and set(classes) == set(sets)
    assert neardup.found(df.limit(0)).count() == 0


def test_hard_pairs_beside_a_family_of_easy_ones(spark):
    """A family of near copies does not end the search for pairs of similarity near 0.5."""
    rng, hashes, rows = random.Random(4), neardup.WordHashes(), []
    base = [rng.choice(WORDS) for _ in range(300)]
    for _ in range(160):
        copy = list(base)
        copy[rng.randrange(300)] = rng.choice(WORDS)
        rows.append(copy)
    for _ in range(150):
        one = [rng.choice(WORDS) for _ in range(120)]
        rows += [one, one[:85] + [rng.choice(WORDS) for _ in range(30)]]
    sets = [neardup.shingles(r, neardup.SHINGLE, hashes) for r in rows]
    table = [(i, i, " ".join(r), neardup.signature(x)) for i, (r, x) in enumerate(zip(rows, sets))]
    signed = spark.createDataFrame(table, "fetch_id bigint, body bigint, text string, sig binary")
    hard = {(i, i + 1) for i in range(160, 460, 2) if len(set(sets[i]) & set(sets[i + 1])) >= 0.5 * len(set(sets[i]) | set(sets[i + 1]))}
    got = {(r.a, r.b) for r in neardup.similar_classes(signed).collect()}
    assert len(hard) > 100 and len(hard & got) >= 0.97 * len(hard)
    assert len({(a, b) for a, b in got if b < 160}) > 12_000


def test_pairs_at_the_threshold_are_met(spark):
    """Simulated signatures of pairs of similarity 0.5; equal texts let each pair that is met pass."""
    rng, table = random.Random(6), []
    for i in range(0, 4000, 2):
        x = [rng.randbytes(2) for _ in range(neardup.HASHES)]
        y = [h if rng.random() < neardup.MIN_SIMILARITY else rng.randbytes(2) for h in x]
        table += [(i + k, i + k, f"some equal text {i}", bytes(h[0] for h in z) + bytes(h[1] for h in z)) for k, z in enumerate((x, y))]
    signed = spark.createDataFrame(table, "fetch_id bigint, body bigint, text string, sig binary")
    got = sorted((r.a, r.b) for r in neardup.similar_classes(signed).collect())
    assert set(got) <= {(i, i + 1) for i in range(0, 4000, 2)} and len(got) == len(set(got)) >= neardup.TARGET * 2000


def test_bodies_that_share_phrases_are_not_written_as_candidates(spark):
    """Their pairs grow as the square of the crawl: at 1 GB they filled the disk (F1)."""
    rng, hashes = random.Random(8), neardup.WordHashes()
    phrases = [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(60)]
    texts = [" ".join(rng.sample(phrases, 26)) for _ in range(1500)]
    texts += [f"{t} another end" for t in texts[:20]]
    sets = [neardup.shingles(t.split(), neardup.SHINGLE, hashes) for t in texts]
    table = [(i, i, t, neardup.signature(x)) for i, (t, x) in enumerate(zip(texts, sets))]
    signed = spark.createDataFrame(table, "fetch_id bigint, body bigint, text string, sig binary")

    def written():
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    got = {(r.a, r.b) for r in neardup.similar_classes(signed).collect()}
    assert {(i, 1500 + i) for i in range(20)} <= got
    assert all(len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b])) for a, b in got)
    assert 10 < sum(n for k, n in written().items() if k not in before) / len(texts) < 40  # rows a body


def test_a_bucket_lists_each_of_its_pairs_once():
    rng = np.random.RandomState(2)
    sketch = rng.randint(0, 256, (60, neardup.WINDOW)).astype(np.uint8)
    sketch[20:40] = sketch[:20]  # equal to the first 20, and in their buckets
    sketch[40:] = sketch[:20]  # equal, but in others
    key = np.repeat([-5, 9], [40, 20]).astype(np.int32)
    body = np.arange(60)[::-1].copy()
    body[39] = body[19]  # one body twice is no pair
    got = [(int(a), int(b)) for x in neardup.bucket_pairs(key, body, sketch) for a, b in zip(*x)]
    assert sorted(got) == [(59 - i - 20, 59 - i) for i in range(18, -1, -1)]


def test_only_named_tables_are_released(spark):
    one, two = common.staged(spark.range(3), "one"), common.staged(spark.range(4), "two")
    common.release(one)
    assert two.count() == 4 and not any(x[2] is one for x in common._staged) and any(x[2] is two for x in common._staged)
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        one.count()


def test_signatures_estimate_similarity():
    hashes = neardup.WordHashes()
    a = neardup.shingles(WORDS[:300], 3, hashes)
    b = neardup.shingles(WORDS[:240], 3, hashes)
    x, y = neardup.signature(a), neardup.signature(b)
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs(sum(p == q for p, q in zip(x, y)) / len(x) - true) < 0.12


CASES = ["L’école ouvre à côté — très bientôt", "Das Institut prüft die Anmeldung für Gäste", "Программу обмена готовит научная библиотека", "图书馆举办古籍修复展览，欢迎参加。", "El niño comió jalapeños en São Paulo"]


@pytest.mark.parametrize("text", CASES)
def test_clean_text_is_left_alone(text):
    assert encoding.restore(f"<p>{text}</p>") == (f"<p>{text}</p>", [], False)
    assert encoding.restore(f"<p>{text.upper()}</p>")[1:] == ([], False)


@pytest.mark.parametrize("codec", ["cp1252", "cp437", "cp850", "mac_roman", "latin-1"])
@pytest.mark.parametrize("text", CASES[:2] + CASES[4:])
def test_misread_utf8_comes_back(text, codec):
    try:
        bad = text.encode().decode(codec)
    except UnicodeDecodeError:
        pytest.skip("bytes the encoding lacks")
    assert encoding.restore(f"<p>ok {bad}</p>")[0] == f"<p>ok {text}</p>"


def test_other_kinds_of_garbling():
    assert encoding.restore("<p>" + CASES[2].encode().decode("cp1251", "replace") + "</p>")[1]
    assert encoding.restore("<p>" + CASES[2].encode("cp1251").decode("latin-1") + "</p>")[0] == f"<p>{CASES[2]}</p>"
    assert encoding.restore("<p>" + CASES[2].encode("koi8_r").decode("cp1251") + "</p>")[0] == f"<p>{CASES[2]}</p>"
    assert encoding.restore("<p>" + CASES[3].encode().decode("gbk", "replace") + "</p>")[1]
    twice = CASES[4].encode().decode("cp1252").encode().decode("cp1252", "replace")
    if "�" not in twice:
        assert encoding.restore(twice)[0] == CASES[4]
    assert encoding.restore("<p>caf� d�j�</p>") == ("<p>caf� d�j�</p>", [], True)
    assert encoding.restore("caf&Atilde;&copy;")[0] == "café"


def test_garbled_records(spark):
    df = spark.createDataFrame([(1, "<p>cafÃ©</p>"), (2, "<p>café</p>"), (3, None), (4, ""), (5, "<p>cafÃ©</p>")], "fetch_id bigint, html string").withColumn("lost", F.lit(9))
    rows = {r.fetch_id: r for r in encoding.restored(df).collect()}
    assert set(rows) == {1, 5} and rows[1].html == "<p>café</p>" and not rows[1].lost
    assert encoding.found(df.limit(0)).count() == 0


def test_pages_garbled_in_references_alone(spark):
    df = spark.createDataFrame([(1, "<p>don&acirc;&euro;&trade;t</p>"), (2, "<p>S&atilde;o &amp; p&acirc;te</p>"), (3, "<p>a &amp; b</p>"), (4, "<p>a & b</p>")], "fetch_id bigint, html string")
    assert {r.fetch_id: r.html for r in encoding.restored(df).collect()} == {1: "<p>don’t</p>"}


def test_stuffed_pages(spark):
    rng = random.Random(1)
    spam = ["cheap", "best", "buy", "watches", "loans", "sale", "shoes", "bags", "online", "store"]
    phrase = lambda n: " ".join(rng.choice(spam) for _ in range(n))
    link_list = "<ul>" + "".join(f'<li><a href="/{i}">{phrase(2)}</a></li>' for i in range(25)) + "</ul>"
    explained = "<ul>" + "".join(f'<li><a href="/{i}">Report {i}</a> - explains what the survey of {WORDS[i]} found in the town last year.</li>' for i in range(10)) + "</ul>"
    attrs = "".join(f'<div><a href="/p" title="{phrase(3)}, {phrase(2)}"><img src=i></a></div>' for _ in range(15))
    prose = [" ".join(rng.choice(WORDS) for _ in range(18)) + "." for _ in range(5)]
    pages = [
        (1, html("x", prose)), (2, f"<main><h1>a</h1><p>Welcome to our shop today.</p>{link_list}</main>"), (3, f"<main><h1>a</h1>{explained}</main>"),
        (4, f"<main><h1>a</h1><p>{', '.join(phrase(2) for _ in range(30))}</p></main>"), (5, f"<main><h1>a</h1>{attrs}</main>"),
        (6, f'<main><h1>a</h1><div style="display:none">{phrase(60)}</div></main>'), (7, None), (8, ""), (9, html("tags", prose + ["Tags: a, b, c"])),
    ]
    df = frame(spark, [(i, f"https://h{i}.test/", h) for i, h in pages])
    assert {r[0] for r in stuffing.found(df).collect()} == {2, 4, 5, 6}
    links = spark.createDataFrame([(2, 1, "buy"), (2, 1, "buy"), (1, 1, "ok"), (2, 2, None)], "fetch_id bigint, link_no int, text string")
    assert stuffing.stuffed_links(df, links).count() == 2


def test_viterbi_agrees_with_brute_force():
    import itertools

    import numpy as np

    model = stuffing.train()
    seq = np.array([3, 20, 20, 7])
    best = max(itertools.product(range(4), repeat=4), key=lambda p: model[0][p[0]] + sum(model[1][a, b] for a, b in zip(p, p[1:])) + sum(model[2][s, x] for s, x in zip(p, seq)))
    paths = stuffing.viterbi([seq, np.empty(0, int)], model)
    assert tuple(paths[0]) == best and len(paths[1]) == 0


def test_repeated_lines(spark):
    rows = []
    for i in range(40):
        rows.append((i, "https://www.a.test/", f"<p>Legal note {i}</p><p>unique {WORDS[i]}</p>" + ("<p>Half line</p>" if i % 2 else "") + ("<p>Rare</p>" if i < 5 else "")))
    rows += [(100 + i, "http://B.test:80/", f"<p>other {WORDS[50 + i]}</p>") for i in range(20)] + [(200, None, "<p>x</p>"), (201, "https://a.test/", None), (202, "https://a.test/", "")]
    df = frame(spark, rows)
    got = {(r.site, r.line) for r in repeats.found(df).collect()}
    n, per = Counter(), Counter()
    for _, u, h in rows:
        if h:
            s = "" if not u else "b.test" if "B.test" in u else "a.test"
            per[s] += 1
            n.update({(s, dom.digits0(t.lower())) for _, t, _ in dom.parse(h).lines})
    assert got == {k for k, c in n.items() if c >= 6 and c >= 0.25 * per[k[0]]} == {("a.test", "legal note 0"), ("a.test", "half line")}
    clean = {r.fetch_id: (r.text, r.n_removed) for r in repeats.cleaned(df).collect()}
    assert clean[1] == (f"unique {WORDS[1]}\nrare", 2) and clean[200] == ("x", 0) and 201 not in clean


def test_residue(spark):
    rng = random.Random(2)
    full = article(rng)
    pages = [
        (1, html("Page not found", ["The page could not be found."])), (2, html("{{ page.title }}", ["{{ body }}"])), (3, html("ok", full)), (4, html("ok", full + ["A 404 says page not found."])),
        (5, html("ok", full[:2] + ["The fee is ${fee.amount} a year."] + full[2:])), (6, html("ok", full) + "<pre>{{ name }}</pre>"), (7, html("x", ["lorem ipsum dolor sit amet consectetur " * 5])),
        (8, '<body><noscript>Enable JavaScript to run this app.</noscript><div id="root"></div></body>'), (9, None), (10, ""), (11, html("Page not found", ["The page could not be found."])),
        (12, html("ok", full[:3]) .replace("<main>", "<noscript>Some features need JavaScript.</noscript><main>")), (13, html("How to", full + ["Write <code>{{ name }}</code> there."])),
    ]
    df = frame(spark, [(i, f"https://h{i}.test/", h) for i, h in pages])
    got = {r.fetch_id: r.label for r in residue.labels(df).collect()}
    assert set(got) == {1, 2, 5, 7, 8, 11} and got[2] == got[5] == "placeholder" and got[8] == "scripts"
    assert {r.fetch_id for r in residue.kept(df).collect()} == {3, 4, 6, 9, 10, 12, 13}


def test_labels_spread_over_chains(spark):
    rng = random.Random(5)
    words = [rng.choice(WORDS) for _ in range(300)]
    texts = []
    for k in range(4):  # each text differs a little from the one before
        words = words[:]
        words[40 * k] = f"new{k}"
        texts.append(" ".join(words))
    texts.append(" ".join(rng.choice(WORDS) for _ in range(300)))
    pages = spark.createDataFrame([(i, [t], [8 * 300], 0) for i, t in enumerate(texts)], "fetch_id bigint, lines array<string>, extra array<int>, notes int")
    hashed = pages.mapInPandas(residue._sketched, "fetch_id bigint, label string, text string, sketch array<bigint>, n_runs int").withColumnRenamed("fetch_id", "text_id")
    trusted = spark.createDataFrame([(0,)], "text_id bigint")
    got = {r[0] for r in residue.spread_sketches(hashed.select("text_id", "text", "sketch", "n_runs"), trusted).collect()}
    assert got == {0, 1, 2, 3}


def test_spread_finds_what_no_phrase_names(spark):
    """Without the spread of labels the second and third page are lost; the fourth is an article."""
    notice = "<p>We could not load what you asked us for on this machine today.</p>"
    pages = ["<h1>Page not found</h1>" + notice, "<h1>Nothing here</h1>" + notice, "<h1>Sorry</h1>" + notice + "<p>Try the map.</p>", "<h1>Machines</h1><p>The town bought a machine that loads carts, and it works all day.</p>" * 3]
    df = spark.createDataFrame([(i, f"http://a{i}.test/", h) for i, h in enumerate(pages)], "fetch_id bigint, final_url string, html string")
    got = {r.fetch_id: r.label for r in residue.labels(df).collect()}
    assert got == {0: "residue", 1: "near_duplicate", 2: "near_duplicate"}


@pytest.mark.parametrize("text", ["<<TERM>>", "XX/XX/XXXX", "[to be completed]", "{{ body }}", "[insert text here]", "%%page_title%%"])
def test_placeholders(text):
    assert residue._PLACEHOLDER.search(f"the {text} of may")


def test_runs_stay_inside_sentences():
    words = residue.WordHashes()
    a, b = (residue.runs(t, words) for t in ("one two three four five six.\nseven eight", "seven eight\none two three four five six."))
    assert a.tolist() == b.tolist() and len(a) == 3
    assert len(residue.runs("", words)) == 0


def edited(rng, words, share):
    """The words with runs of other words in some places, so many that about ``share`` of runs stay."""
    out = list(words)
    for _ in range(max(1, round(len(words) * (1 - share) / (1 + share) / 5))):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_recall_of_edited_copies(spark):
    """Copies of similarity 0.8 to 0.9 of trusted texts get the label, as brute force says."""
    rng = random.Random(9)
    rows, trusted, want = [], [], set()
    for k in range(200):
        base = [rng.choice(WORDS) for _ in range(rng.choice([40, 80, 200]))]
        copy = edited(rng, base, 0.85)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        trusted.append((2 * k,))
        x, y = (residue.runs(" ".join(t), residue.WordHashes()).tolist() for t in (base, copy))
        if jaccard(x, y) >= residue.MIN_SIMILARITY:
            want.add(2 * k + 1)
    texts = spark.createDataFrame(rows, "text_id bigint, text string")
    got = {r[0] for r in residue.spread_sketches(texts, spark.createDataFrame(trusted, "text_id bigint")).collect()} - {t[0] for t in trusted}
    assert got <= want and len(want) > 80 and len(got) >= 0.95 * len(want)


def test_texts_rejected_by_the_first_of_a_sketch(spark):
    """Of two labelled texts with one sketch, the one of greater id links to the third text alone."""
    rng = random.Random(12)
    base = [rng.choice(WORDS) for _ in range(60)]
    far, near = " ".join(rng.choice(WORDS) for _ in range(60)), " ".join(base)
    rows = [(1, far, [7] * 4, 56), (2, near, [7] * 4, 56), (3, near + " end", [7] * 4, 57)]
    texts = spark.createDataFrame(rows, "text_id bigint, text string, sketch array<bigint>, n_runs int")
    trusted = spark.createDataFrame([(1,), (2,)], "text_id bigint")
    assert {r[0] for r in residue.spread_sketches(texts, trusted).collect()} == {1, 2, 3}


LATIN = "lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "
OPENING = "the text of this page will be written by our office before spring term starts. "


@pytest.mark.parametrize("line,want", [
    (OPENING + LATIN * 4, True), (LATIN * 4, True), (OPENING * 4, False), ("the library was not found by visitors. " + OPENING * 4, False),
    ("please enable javascript in the settings of your browser, then load this page again to see the catalogue, the opening hours and all the other parts. " * 2, True),
    ("您访问的页面不存在，可能已经被移动、删除或者地址输入有误，请检查您输入的网址是否正确，或者返回网站首页继续浏览其他内容。", True),
])
def test_long_residue_lines(line, want):
    assert residue.is_residue(line.strip(), dom.words(line)) == want
