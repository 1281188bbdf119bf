"""Texts of a page as the tagger of personal data reads them, and items of many scripts."""

import pytest

from webspark.llm import personal


@pytest.fixture(scope="module")
def tagger():
    parts = {"Anna": "given", "Zoltan": "given", "Velmann": "family", "Thornby": "family"}
    return personal.Tagger(parts, *personal.train(parts))


@pytest.mark.parametrize(
    ("text", "item", "kind"),
    [
        ("Selon Élodie Ávila, le centre ferme tôt.", "Élodie Ávila", "name"),
        ("Пишите Ивану Петрову до пятницы.", "Ивану Петрову", "name"),
        ("По словам Ольги Ивановой, не хватает подписи.", "Ольги Ивановой", "name"),
        ("张伟芳昨天提交了材料", "张伟芳", "name"),
        ("12, rue des Lilas, 75011 Paris", "12, rue des Lilas, 75011 Paris", "address"),
        ("Улица Ленина, д. 5", "Улица Ленина, д. 5", "address"),
        ("Interview with Anna Velmann, second year.", "Anna Velmann", "name"),
        ("Call 07700\n900123 now.", "07700\n900123", "phone"),
    ],
)
def test_items_of_many_scripts(tagger, text, item, kind):
    assert [(text[a:b], k) for a, b, k in tagger.items([text])[0]] == [(item, kind)]


def test_texts_that_are_no_items(tagger):
    texts = ["Campus", "本周热门", "lamps $109.77 SKU48884", "ZULETZT GEÄNDERT AM 12.12.2020", "", "   "]
    assert tagger.items(texts) == [[] for _ in texts]


def test_units_of_a_page():
    html = '<script>if(a<b && c){}</script><a href=mailto:anna.bell@uni.test?x=1>Ask</a> <b>Anna</b> Bell<p>tel 07700\n900123</p><img alt="Box 12, Ostfeld"><!-- old@uni.test -->'
    assert [t.strip() for t in personal.html_texts(html)] == ["Mail: anna.bell@uni.test", "Ask Anna Bell", "tel 07700\n900123", "Box 12, Ostfeld", "old@uni.test"]


def test_page_keeps_all_but_items(tagger):
    html = "<script>if(a<b && c){}</script><a href=mailto:anna.bell@uni.test?x=1>Ask</a><p>1 &lt; 2, write to zo<b>@</b>uni.test &amp; go</p><!-- old@uni.test -->"
    assert personal.replace_html(tagger, [html]) == [
        "<script>if(a<b && c){}</script><a href=mailto:[EMAIL]?x=1>Ask</a><p>1 &lt; 2, write to [EMAIL]<b></b> &amp; go</p><!-- [EMAIL] -->"
    ]


def test_items_at_any_place_of_a_long_text(tagger):
    filler = "the office is open and the list is long "
    for n in (10, 11, 12, 13, 24, 25, 26, 60):
        text = filler * n + "write to anna.bell@uni.test or ask Anna Velmann, who lives at 12 Heron Road, Ostfeld. " + filler * 20
        assert [k for _, _, k in tagger.items([text])[0]] == ["email", "name", "address"]


def test_comments_keep_their_markup(tagger):
    html = '<p>x</p><!-- <a href="/b">a &amp; b</a> write to anna.bell@uni.test <br> --><p title="a < b &quot;c&quot;, mail anna.bell@uni.test">y</p>'
    want = '<p>x</p><!-- <a href="/b">a &amp; b</a> write to [EMAIL] <br> --><p title="a &lt; b &quot;c&quot;, mail [EMAIL]">y</p>'
    assert personal.replace_html(tagger, [html]) == [want]
