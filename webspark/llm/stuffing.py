"""Keyword-stuffed and link-list pages (problem 4).

Each line of a page's main body becomes one symbol (links, length, end, separators,
repetition, glue words, prices); a hidden Markov model labels the lines as prose, link list,
tag list or menu, and a page is flagged if most words of its main body, hidden ones and those
in attributes included, are not prose.  The model's tables are counted from the labelled pages
below and from pages composed of labelled parts; a symbol's emission is the product of its
features', so no line is unknown to the model.

Null or empty html is never flagged; a page without words is never flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import staged
from .mainbody import Body, clean_bodies, page_bodies

STATES = ("prose", "links", "tags", "menu")
#: Flag pages with at least this share of words outside prose.
MIN_SHARE = 0.6

#: Features of a line and the number of their values.
SIZES = {"link": 2, "size": 4, "end": 2, "dense": 2, "repeat": 3, "glue": 3, "price": 2, "script": 3}
#: A line's emission: its size with glue and script, then further features given its size.
GROUPS = (("size", "glue", "script"), ("size", "end", "dense"), ("link", "size"), ("size", "repeat"), ("size", "price"))
N_SYMBOLS = int(np.prod(list(SIZES.values())))

# Words (and Chinese characters) that tie sentences together.
GLUE = frozenset(
    "the of and to in is for on with that by are be as at from was it or an this can not if who which has will their its you we your may"
    " der die das und ist ein eine zu im den von mit auf für nicht sich dem des wird werden bei oder wer als am sie"
    " el la los las de que y en un una por con para se del al es su no si lo como"
    " le les des et est une du dans pour qui que sur par au aux ce il elle son ne pas"
    " o os as da do em um uma com não na no se ao das dos sua seu"
    " и в не на с что по для из к от до это как о об при или его кто"
    " 的 了 在 是 和 与 为 将 由 等 于 并 及 可 应 以 其 请 不 个 有".split()
)
_SEP = re.compile(r"[,|·•;/#、，>»]|\s[-–]\s")
_END = re.compile(r"[.!?。！？…:：][\"'”’»)\]]*$")
_PRICE = re.compile(r"[$€£¥₽]\s?0|0\s?[$€£¥₽]|\b(?:sku|art\.?-?nr\.?) ?0")
# Characters of texts read with a wrong encoding.
_ODD = re.compile("[\u0080-\u00a6\u00a8-\u00aa\u00ac-\u00af\u00b1-\u00b6\u00b8-\u00ba\u00bc-\u00be\u00d7\u00f7\uff61-\uff9f\ue000-\uf8ff\ufffd]|[ãâðñ][\u0080-\u00bf]|[рс][\u0080-\u00bf\u0400-\u040f\u0452-\u045f]|[锛銆鐨璇鍥]")


def values(text: str, link_share: float) -> tuple[int, ...]:
    """Values of a normalised line's features, in the order of ``SIZES``."""
    ws = dom.words(text)
    n = len(ws)
    size = 0 if n <= 3 else 1 if n <= 9 else 2 if n <= 30 else 3
    end = 1 if _END.search(text) else 0
    seps = len(_SEP.findall(text))
    dense = 1 if seps >= 2 and n <= 5 * (seps + 1) else 0
    long = [w for w in ws if len(w) > 2]
    kinds = len(set(long)) / len(long) if len(long) >= 12 else 1.0
    repeat = 2 if kinds <= 0.35 else 1 if kinds <= 0.6 else 0
    glue = sum(1 for w in ws if w in GLUE)
    script = 0
    if not text.isascii():
        script = 2 if len(_ODD.findall(text)) >= max(2, 0.04 * len(text)) else 1 if len(text.encode("utf-8", "replace")) > 1.3 * len(text) else 0
    return (1 if link_share >= 0.8 else 0, size, end, dense, repeat, 0 if not glue else 1 if glue < 0.12 * n else 2, 1 if _PRICE.search(text) else 0, script)


def symbol(text: str, link_share: float) -> int:
    """The features of a normalised line as one number below ``N_SYMBOLS``."""
    out = 0
    for v, k in zip(values(text, link_share), SIZES.values()):
        out = out * k + v
    return out


# The labelled lines: pages as lists of (state, link share, line).
LABELLED: list[list[tuple[str, float, str]]] = [
    [("prose", 0, "the council opened a new library last week."), ("prose", 0, "readers may borrow up to 0 books, and students pay nothing for the first year of membership."), ("prose", 0.1, "more on this is told in the annual report.")],
    [("prose", 0, "about the programme"), ("prose", 0, "applicants send their papers before 0 may; late papers are read in autumn. the panel answers in writing."), ("prose", 0, "questions?"), ("prose", 0, "write to the office and you will get an answer within 0 days, except on holidays.")],
    [("prose", 0, "die bibliothek öffnet um 0 uhr, und neue leser brauchen nur einen ausweis."), ("prose", 0, "termine"), ("prose", 0, "am 0. mai beginnt der kurs für anfänger. wer teilnehmen will, meldet sich im büro.")],
    [("prose", 0, "图书馆将于五月开放，学生应在0日前提交申请材料。"), ("prose", 0, "研究生院发布通知"), ("prose", 0, "据介绍，课程包括三个部分，共有0个名额，欢迎报名。")],
    [("prose", 0, "la biblioteca abre a las 0 y los alumnos pueden pedir libros. el servicio es gratuito."), ("prose", 0.2, "vea el informe anual, que explica los cambios con detalle.")],
    [("prose", 0, "fees and dates"), ("prose", 0, "fees"), ("prose", 0, "0"), ("prose", 0, "dates"), ("prose", 0, "0"), ("prose", 0, "all fees are due in march. nothing is paid back after that.")],
    [("prose", 0, "reading list"), ("prose", 0.5, "history of the town - a short account of its first 0 years by a local teacher."), ("prose", 0.4, "field notes - what the survey found in the marsh, with maps and tables."), ("prose", 0.4, "atlas - maps.")],
    [("links", 1, "cheap watches"), ("links", 1, "best loans online"), ("links", 1, "replica bags sale"), ("links", 1, "discount flights"), ("links", 1, "buy essays"), ("links", 1, "free phones offer today")],
    [("links", 1, "luxury hotels"), ("links", 1, "hotel deals"), ("links", 1, "cheap hotel rooms voucher"), ("links", 1, "top chairs"), ("links", 1, "bargain chairs, sofas, lamps and rugs outlet store shop sale")],
    [("prose", 0, "welcome to our shop, where prices are low."), ("links", 1, "vintage lamps"), ("links", 1, "lamps sale"), ("links", 1, "buy lamps"), ("links", 1, "lamp code"), ("links", 1, "lamps overnight")],
    [("tags", 0, "watches, cheap watches, watches sale, replica watches, buy watches, watches store"), ("tags", 0, "loans, fast loans, loans today, best loans, loans online, free loans"), ("tags", 0, "tags: shoes, boots, bags, belts")],
    [("tags", 0, "cheap shoes buy cheap shoes best cheap shoes cheap shoes online cheap shoes sale cheap shoes store"), ("tags", 0, "best loans fast loans loans today loans loans best loans fast loans cheap loans")],
    [("tags", 0, "casino bonus casino bonus casino free casino bonus casino bonus casino free bonus"), ("tags", 0.3, "boots #sale #cheap #boots #winter #offer")],
    [("tags", 0, "cheap tents"), ("tags", 0, "tents sale"), ("tags", 0, "buy tents"), ("tags", 0, "tents price"), ("tags", 0, "best tents review"), ("tags", 0, "tents shop"), ("tags", 0, "free tents")],
    [("tags", 0, "discount gloves | gloves sale | buy gloves | gloves outlet | warm gloves"), ("tags", 0, "gloves, hats, scarves"), ("tags", 0, "hats / caps / gloves / scarves / socks")],
    [("tags", 0, "cheap rugs. best rugs. rugs sale. rugs outlet. buy rugs. rugs online. rugs store. rugs shop."), ("tags", 0, "rugs. rugs. rugs. cheap rugs. rugs. best rugs. rugs. rugs. rugs sale. rugs. rugs.")],
    [("menu", 1, "home"), ("menu", 1, "news"), ("menu", 1, "contact"), ("menu", 1, "about us")],
    [("menu", 0.9, "home | news | library | contact"), ("menu", 1, "about")],
    [("menu", 1, "startseite"), ("menu", 1, "kontakt"), ("prose", 0, "der neue kurs beginnt im mai, und alle plätze sind frei.")],
]


# Sentences and words of which further labelled pages are composed.
_SENTENCES = """
the library opens at nine and closes when the last reader leaves. | anyone who wants to join must send a letter before may. | costs fell by a third, although the number of students grew. | the committee has not yet decided which of the plans it will support.
did the new rules help? | he said that the bridge would be closed until the end of the year. | there are three ways to apply, and all of them are free. | in the second year you can choose between music, art and history.
wir haben die ergebnisse geprüft und veröffentlichen sie im herbst. | wer sich anmelden möchte, schreibt eine kurze nachricht an das büro. | die kosten sind um 0 prozent gesunken, weil weniger gedruckt wird.
el centro abre todos los días y los estudiantes pueden entrar sin pagar. | la comisión no ha decidido qué plan va a apoyar. | quien quiera participar debe enviar una carta antes de mayo.
la bibliothèque ouvre à neuf heures et ferme quand le dernier lecteur part. | les frais ont baissé de 0 pour cent, car on imprime moins. | il faut envoyer une lettre avant le mois de mai.
a biblioteca abre às nove e fecha quando sai o último leitor. | quem quiser participar deve enviar uma carta até maio. | os custos caíram porque se imprime menos.
библиотека открыта до девяти, и студенты могут работать в зале. | кто хочет участвовать, должен прислать письмо до мая. | комиссия ещё не решила, какой из планов она поддержит.
据研究生院介绍，课程目录和校园班车路线将于六月公布，共有0个名额。 | 来自柳川县的0名学员完成课程后，由图书馆统一安排住宿。 | 家住云坪县的本科新生应在0日前选修课程。 | 站点记录显示，考试时间表比去年多0项，物理系据此调整方案。
图书馆九点开门，学生可以在大厅学习。 | 申请者应在五月之前提交材料。 | 委员会还没有决定支持哪个方案，结果将在秋天公布。 | 由于印刷减少，费用下降了百分之0。
""".replace("\n", " | ")
_NOTICES = """
the server met an unexpected condition. ref 0a0f | please try again in a few minutes. | our engineers have been notified. | fees are €0 per term, and the grant pays $0 of them. | order number 0-0 was archived. | by the town newsroom | published 0 may 0 by the town desk | sign up and never miss a story. | read 0 comments | shared 0 times today | print / e-mail / share | subscribe to our weekly digest | you do not have access to this page. | warning: cannot connect to the database in /srv/app/db.inc on line 0
die seite wurde nicht gefunden. | bitte versuchen sie es später noch einmal. | la página no existe. | vuelva a intentarlo más tarde. | cette page est introuvable. | réessayez plus tard. | a página não foi encontrada. | страница не найдена, попробуйте позже. | 您访问的页面不存在。 | 请稍后再试。 | lorem ipsum dolor sit amet, consectetur adipiscing elit. | sed ut perspiciatis unde omnis iste natus error. | [insert text here] | {{ article.body }} | undefined
traceback (most recent call last): keyerror: 'name' | read in 0 minutes | 发布日期：0-0-0 | 本站编辑部整理 | 已有0人阅读本文 | 分享到朋友圈 | von der redaktion | mis à jour le 0/0/0 | lire les 0 commentaires | comparte esta página | читать 0 комментариев | hello {0}, welcome to {0} | {{ page.title }} | last updated: 0 june 0 | javascript is required | 0 internal server error | bad gateway
""".replace("\n", " | ")
_SHORT = "opening hours|how to apply|fees and dates|what is new|see also|page not found|error 0|contact|open to all|0 may 0|12 places|step 0: send the form|wie man sich bewirbt|öffnungszeiten|horario|cómo solicitar|horaires|comment postuler|расписание|как подать заявку|报名方式|开放时间|seite nicht gefunden|страница не найдена|页面不存在".split("|")
_GOODS = [
    ("cheap best buy discount replica top free fast original luxury bulk trusted slim vintage".split(), "watches loans lamps shoes boots tents rugs phones cameras visas essays sofas bags gloves heaters plumbers hotels".split(), "sale online store today price outlet deal review code bonus near-me free-shipping no-fee".split()),
    ("billige beste günstige neue echte".split(), "uhren schuhe lampen kredite taschen zelte handys".split(), "kaufen angebot online rabatt shop preis".split()),
    ("barato mejor nuevo rápido".split(), "relojes zapatos préstamos bolsos lámparas hoteles".split(), "oferta comprar precio tienda online".split()),
    ("дешёвые лучшие новые быстрые".split(), "часы кредиты сумки лампы обувь отели".split(), "купить цена скидка онлайн магазин".split()),
    ("便宜 正品 特价 热卖".split(), "手表 贷款 箱包 灯具 鞋子".split(), "批发 代购 折扣 包邮".split()),
]
_FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor magna aliqua ut enim quis nostrud aute irure in velit esse cillum. fugiat nulla, pariatur sint.".split()
_PLACES = "ashford marley denton corby elham warden kelso norton stowe tarrant".split()


def composed(n: int, seed: int = 11) -> list[list[tuple[str, float, str]]]:
    """``n`` labelled pages: prose, link lists, tag lists, product lists, stuffed blocks with a
    sentence before them, menus before articles, and lists with explanations."""
    rng = np.random.RandomState(seed)
    pick = lambda xs: xs[rng.randint(len(xs))]
    sentences = [t.strip() for t in _SENTENCES.split("|") if t.strip()]
    notices = [t.strip() for t in _NOTICES.split("|") if t.strip()]
    out = []
    for _ in range(n):
        adjectives, nouns, ends = pick(_GOODS)
        join = pick([" ", " ", " ", "-", "_"])

        def good() -> str:
            words = [pick(adjectives)] * (rng.rand() < 0.75) + [pick(nouns)] + [pick(ends)] * (rng.rand() < 0.5)
            return ("#" if join != " " and rng.rand() < 0.5 else "") + join.join(words)

        def text(a: int, b: int) -> str:
            t = " ".join(pick(sentences) for _ in range(rng.randint(a, b)))
            if rng.rand() < 0.1:  # read with a wrong encoding
                to, of = pick([("utf-8", "latin-1"), ("utf-8", "cp1251"), ("gb18030", "latin-1"), ("utf-8", "gb18030"), ("utf-8", "shift_jis")])
                t = t.encode(to, "replace").decode(of, "replace").lower()
            elif rng.rand() < 0.05:  # filler
                t = " ".join(pick(_FILLER) for _ in range(rng.randint(5, 80))) + "."
            return t

        article = [("prose", 0.0, text(1, 9)) if rng.rand() < 0.7 else ("prose", float(rng.rand() < 0.1), pick(_SHORT)) for _ in range(rng.randint(1, 14))]
        lead = [("prose", 0.0, text(1, 2))] * (rng.rand() < 0.4)
        kind = rng.randint(12)
        if kind < 3:
            page = article + ([("tags", 0.0, ", ".join(good() for _ in range(rng.randint(3, 6))))] if rng.rand() < 0.2 else [])
        elif kind == 3:
            page = [("prose", pick([0.2, 0.4, 0.5]), f"{pick(_SHORT)} - {pick(sentences)}") for _ in range(rng.randint(5, 20))]
        elif kind == 4:
            page = lead + [("links", 1.0, " ".join([good()])) for _ in range(rng.randint(8, 60))]
        elif kind == 5:
            page = lead + [("links", 0.95, " ".join(good() for _ in range(rng.randint(12, 80)))) for _ in range(rng.randint(1, 5))]
        elif kind == 6:
            sep = pick([", ", " · ", " | ", "; ", " / ", "、"])
            page = lead + [("tags", 0.0, sep.join(good() + (f" {pick(['in', 'near', 'around'])} {pick(_PLACES)}" if sep == ", " and join == " " and rng.rand() < 0.9 else "") for _ in range(rng.randint(6, 80)))) for _ in range(rng.randint(1, 6))]
        elif kind == 7:
            page = lead + [("tags", 0.0, " ".join(good() for _ in range(rng.randint(15, 150)))) for _ in range(rng.randint(1, 4))]
        elif kind == 8:
            page = lead + [("tags", pick([0.0, 0.5]), f"{good()} $0.0" + pick(["", " sku0", " 0 in stock"])) for _ in range(rng.randint(8, 50))]
        elif kind == 9:  # sentences made of the same few goods
            few = [good() for _ in range(rng.randint(3, 9))]
            run = lambda m: "".join(pick(few) + pick([" ", ", ", " and ", ". "]) for _ in range(m)).strip(" ,") + pick(["", "."])
            page = lead + [("tags", 0.0, run(rng.randint(12, 60))) for _ in range(rng.randint(1, 6))]
        elif kind == 10:  # a notice instead of a page
            page = [("prose", 0.0, " ".join(pick(notices) for _ in range(rng.randint(1, 3)))) for _ in range(rng.randint(1, 5))]
        else:
            page = [("menu", 1.0, pick(_SHORT)) for _ in range(rng.randint(3, 9))] + article
        if rng.rand() < 0.4:
            page = page[:]
            page.insert(rng.randint(len(page) + 1), ("prose", 0.0, pick(notices)))
        out.append(page)
    return out


def train(pages=None, smoothing: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log tables (start, transition, emission) counted from labelled pages.

    An emission is P(size, glue, script) times the other features' given the size; ``emit`` holds them for each symbol.
    """
    if pages is None:
        pages = LABELLED * 5 + composed(1500)
    k = len(STATES)
    start, move = np.full(k, smoothing), np.full((k, k), smoothing)
    names = list(SIZES)
    counts = [np.full((k, *(SIZES[f] for f in group)), smoothing) for group in GROUPS]
    at = [[names.index(f) for f in group] for group in GROUPS]
    for page in pages:
        before = None
        for name, link, text in page:
            s = STATES.index(name)
            vs = values(text, link)
            for c, ix in zip(counts, at):
                c[(s, *(vs[i] for i in ix))] += 1
            if before is None:
                start[s] += 1
            else:
                move[before, s] += 1
            before = s
    log = lambda t: np.log(t / t.sum(axis=-1, keepdims=True))
    emit = np.zeros((k, *SIZES.values()))
    for g, (c, ix) in enumerate(zip(counts, at)):
        given = tuple(i + 1 for i, f in enumerate(GROUPS[g]) if g == 0 or f != "size")
        p = np.log(c / c.sum(axis=given, keepdims=True))
        shape = [k] + [n if i in ix else 1 for i, n in enumerate(SIZES.values())]
        emit = emit + p.reshape(shape)  # groups keep the order of SIZES
    return log(start), log(move), emit.reshape(k, -1)


def viterbi(seqs: list[np.ndarray], model) -> list[np.ndarray]:
    """Most likely states of each sequence; sequences of like length are decoded together."""
    start, move, emit = model
    out: list[np.ndarray] = [np.empty(0, int)] * len(seqs)
    order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: len(seqs[i]))
    for at in range(0, len(order), 256):
        part = order[at : at + 256]
        t = max(len(seqs[i]) for i in part)
        x = np.zeros((len(part), t), int)
        size = np.array([len(seqs[i]) for i in part])
        for r, i in enumerate(part):
            x[r, : size[r]] = seqs[i]
        score = start + emit[:, x[:, 0]].T
        back = np.zeros((len(part), t, len(start)), np.int8)
        for j in range(1, t):
            step = score[:, :, None] + move
            back[:, j] = step.argmax(1)
            new = step.max(1) + emit[:, x[:, j]].T
            score = np.where((j < size)[:, None], new, score)
        state = score.argmax(1)
        path = np.zeros((len(part), t), int)
        for j in range(t - 1, -1, -1):
            live = j < size
            path[live, j] = state[live]
            prev = back[np.arange(len(part)), j, state]
            state = np.where(live & (j > 0), prev, state)
        for r, i in enumerate(part):
            out[i] = path[r, : size[r]]
    return out


def features(body: Body, use: list[int]) -> tuple[list[int], int]:
    """Symbol and word count of each line (count * N_SYMBOLS + symbol); words in attributes."""
    page = body.page
    out = []
    for j in use:
        node, text, link = page.lines[body.lines[j]]
        norm = body.norms[j]
        n = len(dom.words(norm))
        sym = symbol(norm, link / max(1, len(text)))
        out.append((n * N_SYMBOLS + sym) * 2 + (page.tag[node] in dom.HEADINGS))
    return out, body.attr_words


def _label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = train()
    for pdf in batches:
        seqs, sizes = [], []
        for extra in pdf["extra"]:
            x = np.asarray(extra, dtype=int)
            x = x[x % 2 == 0] // 2  # headings say nothing of a body's kind
            seqs.append(x % N_SYMBOLS)
            sizes.append(x // N_SYMBOLS)
        paths = viterbi(seqs, model)
        rows = []
        for path, size in zip(paths, sizes):
            rows.append(tuple(int(size[path == s].sum()) if len(path) else 0 for s in range(len(STATES))))
        out = pd.DataFrame(rows, columns=[f"{s}_words" for s in STATES])
        out.insert(0, "fetch_id", pdf["fetch_id"].values)
        out["attribute_words"] = pdf["notes"].values
        yield out


def labelled_pages(fetch: DataFrame) -> DataFrame:
    """Words of each record's main body by label of their lines, and those in attributes."""
    bodies = clean_bodies(staged(page_bodies(fetch, "none", features), "bodies"))
    return bodies.select("fetch_id", "extra", "notes").mapInPandas(
        _label, "fetch_id bigint, " + ", ".join(f"{s}_words int" for s in STATES) + ", attribute_words int"
    )


def stuffed(labels: DataFrame) -> DataFrame:
    other = F.col("links_words") + F.col("tags_words") + F.col("menu_words") + F.col("attribute_words")
    return labels.where((other > 0) & (other >= MIN_SHARE * (other + F.col("prose_words"))))


def found(fetch: DataFrame) -> DataFrame:
    return stuffed(labelled_pages(fetch)).select("fetch_id")


def stuffed_links(fetch: DataFrame, links: DataFrame) -> DataFrame:
    """Anchor texts of flagged pages: ``(fetch_id, link_no, text)``, whole duplicates once."""
    return links.join(found(fetch), "fetch_id", "left_semi").select("fetch_id", "link_no", "text").distinct()
