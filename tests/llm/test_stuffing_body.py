"""Stuffed pages without prose, the model on unseen pages, deep trees and hot sites."""

import numpy as np

from webspark.llm import dom, mainbody, stuffing


def flag(html: str) -> bool:
    body = mainbody.segment(dom.parse(html))
    use = [j for j, k in enumerate(body.kinds) if k != 3]
    x, attributes = stuffing.features(body, use)
    x = np.asarray(x, dtype=int)
    x = x[x % 2 == 0] // 2
    path = stuffing.viterbi([x % stuffing.N_SYMBOLS], stuffing.train())[0]
    size = x // stuffing.N_SYMBOLS
    other = int(size[path > 0].sum()) + attributes if len(path) else attributes
    prose = int(size[path == 0].sum()) if len(path) else 0
    return other > 0 and other >= stuffing.MIN_SHARE * (other + prose)


GOODS = ["cheap lamps", "best tents sale", "replica watches", "lamps outlet", "tents online", "free visas today", "top boots", "rugs near-me"]
MENU = "<ul id=top><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>Contact</a></ul>"


def test_stuffed_pages_of_every_kind():
    links = MENU + "<div>" + "".join(f'<p><a href="/x{i}">{GOODS[i % 8]}</a></p>' for i in range(30)) + "</div>"
    one_line = MENU + "<div><p>" + " ".join(f'<a href="/x{i}">{GOODS[i % 8]}</a>' for i in range(30)) + "</p></div>"
    titles = MENU + "<div>" + "".join(f'<div><a href="/x{i}" title="{GOODS[i % 8]}, {GOODS[(i + 3) % 8]}"><img src=i alt=></a></div>' for i in range(20)) + "</div>"
    hidden = MENU + "<div><h1>Lamps</h1><p>The shop opens at nine.</p><div style=display:none>" + " ".join(GOODS * 8) + "</div></div>"
    tags = MENU + "<div><h1>Lamps</h1><p>" + ", ".join(GOODS * 4) + "</p></div>"
    prices = MENU + "<div><h1>Lamps</h1>" + "".join(f"<div><span>{GOODS[i % 8]}</span> <span>$12.{i}</span></div>" for i in range(20)) + "</div>"
    for html in (links, one_line, titles, hidden, tags, prices):
        assert flag(html), html[:200]


def test_pages_that_are_not_stuffed():
    prose = "The council opened a new library last week, and readers may borrow up to five books for a month. "
    lorem = "<h1>Sample page</h1><p>Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.</p>"
    error = "<h1>Bad gateway</h1><p>The server met an unexpected condition. Ref 0a1f</p>"
    listed = "<h1>Reading list</h1>" + "".join(f"<p><a href=/{i}>Book {i}</a> - what the survey found in the marsh and why it matters to the town.</p>" for i in range(12))
    garbled = "<h1>Notice</h1><p>" + ("研究生院发布通知，申请者应在五月之前提交材料。" * 5).encode("gb18030").decode("latin-1") + "</p>"
    for html in ("<h1>News</h1><p>" + prose * 4 + "</p><p>tags: library, books</p>", lorem, error, listed, garbled, "<p>x</p>", MENU):
        assert not flag(html), html[:200]


def test_accuracy_on_unseen_pages():
    model = stuffing.train(stuffing.LABELLED * 5 + stuffing.composed(800, seed=1))
    right = total = 0
    for page in stuffing.composed(300, seed=77):
        states = stuffing.viterbi([np.array([stuffing.symbol(text, link) for _, link, text in page])], model)[0]
        right += sum((s == 0) == (name == "prose") for s, (name, _, _) in zip(states, page))
        total += len(page)
    assert right / total > 0.97


def test_deep_trees_are_aligned_whole():
    def page(word: str) -> mainbody.Tree:
        html = f"<h1>{word}</h1>" + "<div>" * 1500 + "<p>All rights are kept by the town.</p><p>about " + word + " only</p>"
        return mainbody.Tree(mainbody.segment(dom.parse(html)))

    a, b = page("one"), page("two")
    assert a.depth > 1500
    assert len(mainbody.constant_lines(a, b)) == 1


def test_hot_sites_by_either_plan(spark, monkeypatch):
    rows = [(i, "http://a.test/x" if i % 3 else "http://b.test/", f"<h1>Title {chr(97 + i % 26) * (1 + i // 26)}</h1><p>{'text of page %s and more words ' % (chr(97 + i % 26) * 3) * 4}.</p><div>printed by the desk</div>") for i in range(60)]
    fetch = spark.createDataFrame(rows, "fetch_id bigint, final_url string, html string")
    monkeypatch.setattr(mainbody, "PER_KEY", 7)
    few = sorted(map(tuple, mainbody.page_bodies(fetch).select("fetch_id", "lines", "kinds").collect()))
    monkeypatch.setattr(mainbody, "FEW_SITES", 0)
    many = sorted(map(tuple, mainbody.page_bodies(fetch).select("fetch_id", "lines", "kinds").collect()))
    assert few == many and len(few) == 60


def test_many_templates_by_either_plan(spark, monkeypatch):
    rows = [(i, f"http://h{i % 4}.test/", f"<h1>Title {chr(97 + i % 26) * (1 + i // 26)}</h1><p>{'text of page %s and more words ' % (chr(97 + i % 26) * 3) * 4}.</p><p>{'other text %s in many words ' % (chr(97 + i % 26) * 2) * 4}.</p><div>printed by the desk</div>") for i in range(40)]
    bodies = mainbody.page_bodies(spark.createDataFrame(rows, "fetch_id bigint, final_url string, html string")).cache()
    few = sorted((r["fetch_id"], tuple(r["lines"])) for r in mainbody.clean_bodies(bodies).collect())
    monkeypatch.setattr(mainbody, "FEW_TEMPLATES", 0)
    many = sorted((r["fetch_id"], tuple(r["lines"])) for r in mainbody.clean_bodies(bodies).collect())
    assert few == many and all("printed by the desk" not in lines for _, lines in few)
