"""Personal information inside free text (problem 3).

A linear-chain conditional random field over word-shape features labels the tokens of each
text with begin and inside marks of five types.  It is trained from the small labelled table
below, whose marked items are exchanged for others of their type so that shapes, not single
words, are learned; parts of names come from a table of names.  Decoding is Viterbi in numpy,
many windows of like length at once.  Every token of every text is decoded; a text that occurs
more than once in a batch is decoded once.  A check of each item's form follows.

Placeholders are ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]``.
Null and empty texts and empty arrays have no items.  Attributes of tags and comments are read
as texts, scripts and style sheets are not.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, with_html

TYPES = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{m}-{t}" for t in TYPES for m in "BI"))
K = len(LABELS)
DIM = 1 << 15

#: Tokens a window decides on, and tokens of context on each side of them.
WINDOW, MARGIN = 100, 25
#: Any white space reads as a space; offsets stay.
_SPACES = {ord(c): " " for c in "\n\r\t\f\v\u00a0\u2007\u2009\u202f\u3000"}

_ODD_SPACE = re.compile("[\n\r\t\f\v\u00a0\u2007\u2009\u202f\u3000]")


def _even(text: str) -> str:
    return text.translate(_SPACES) if _ODD_SPACE.search(text) else text


# -- Tokens ---------------------------------------------------------------------------------

_AT = r"(?:@|\s*[\[({]\s*(?:@|at|AT)\s*[\])}]\s*|\s+(?:AT|\(at\))\s+)"
_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|DOT|\.)\s*[\])}]\s*|\s+(?:dot|DOT|punkt|punto)\s+)"
EMAIL = re.compile(
    rf"[A-Za-z0-9][A-Za-z0-9_.+%-]*(?:\s*[\[({{](?:dot|DOT)[\])}}]\s*[A-Za-z0-9_+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+|[A-Za-z0-9][A-Za-z0-9_.+%-]*\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+"
)
_PLAIN_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’-](?!s\b)[^\W\d_㐀-鿿]+)*|[A-Za-z]?\d+[A-Za-z]?(?![^\W_])|[A-Za-z\d]+|\S")
_TOKEN = re.compile(EMAIL.pattern + "|" + _PLAIN_TOKEN.pattern)
# What every address has one of; texts without it are cut by the plain expression, to the same tokens.
_AT_SIGN = re.compile(r"@|[\[({]\s*(?:at|AT)\s*[\])}]|\sAT\s|\sat\s+[A-Za-z0-9-]+\s+dot\s")


def tokens(text: str) -> re.Pattern:
    """The expression that cuts a text into tokens."""
    return _TOKEN if _AT_SIGN.search(text) else _PLAIN_TOKEN


# Titles before names, and signs of addresses.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame herr frau m mme mlle monsieur madame sr sra srta don doña señor señora senhor senhora dona dott г-н г-жа доктор профессор".split())
STREETS = frozenset("road street avenue lane drive terrace close court place square way crescent row hill gardens walk mews rd st ave ln dr blvd boulevard rue calle avenida rua straße strasse allee platz weg ulica улица проспект".split())


def shape(w: str) -> str:
    out, last = [], ""
    for c in w:
        s = "d" if c.isdigit() else "c" if "㐀" <= c <= "鿿" else "X" if c.isupper() else "x" if c.isalpha() else c
        if s != last:
            out.append(s)
            last = s
    return "".join(out)


def _h(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % DIM


def features(w: str, names: dict[str, str]) -> tuple[list[str], list[str]]:
    """Features of a token for itself, and those it gives its neighbours."""
    low = w.lower()
    sh = shape(w)
    about = ["s=" + sh]
    digits = sum(c.isdigit() for c in w)
    if digits:
        about.append(f"d={min(digits, 12)}")
    else:
        about.append("w=" + low)
    kind = names.get(w) or names.get(w.capitalize() if w.isupper() else w)
    if kind:
        about.append("n=" + kind)
    if low.rstrip(".") in TITLES:
        about.append("title")
    if low in STREETS or low.endswith(("weg", "straße", "strasse", "gasse", "allee")) and len(low) > 5:
        about.append("street")
    if EMAIL.fullmatch(w):
        about = ["email"]
    own = list(about)
    if sh.isalpha() and digits == 0 and len(w) > 3:
        own += ["e3=" + low[-3:] + sh, "e4=" + low[-4:] + sh, "b3=" + low[:3] + sh]
    if sh == "c":
        own.append("cjk")
        if low in _family_signs(names):
            about.append("n=sign")
            own.append("n=sign")
    return own, about


def _family_signs(names: dict[str, str]) -> frozenset[str]:
    """Characters of the family names written in them."""
    key = id(names)
    if key not in _signs:
        _signs[key] = frozenset(c for w, k in names.items() if k == "family" for c in w if "㐀" <= c <= "鿿") | frozenset("".join(_CJK_FAMILY).replace(" ", ""))
    return _signs[key]


_signs: dict[int, frozenset[str]] = {}


class Table:
    """Feature rows of token kinds, made when first met."""

    def __init__(self, names: dict[str, str], weights: np.ndarray | None = None) -> None:
        self.names, self.weights = names, weights
        self.ids: dict[str, int] = {}
        self.rows: list[tuple[list[int], ...]] = []
        self.scores = np.zeros((1024, 5, K), np.float32)

    def id(self, w: str) -> int:
        k = self.ids.get(w)
        if k is None:
            own, about = features(w, self.names)
            row = tuple([_h(f"{off}|{f}") for f in (own if off == 0 else about)] for off in (0, -1, 1, -2, 2))
            k = self.ids[w] = len(self.rows)
            self.rows.append(row)
            if self.weights is not None:
                if k >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                for o, hs in enumerate(row):
                    self.scores[k, o] = self.weights[hs].sum(axis=0)
        return k


# -- Labelled table -------------------------------------------------------------------------

# Items are written {N} name, {T} titled name, {E} email, {P} phone, {I} identity number,
# {A} address; {X} is a proper name that is no person, {9} a number that is none of these.
LABELLED = """
Please contact {N} on {P} before the interview. | Ring {N} first ({P}). | Ring {T} first ({P}). | For keys see {N}, {P}. | {N} answers calls on {P}.
Contact {N}, {P}. | {N} – {P} – knows the way. | {T} – {P} – knows the way. | Guardian {N} (tel. {P}), {A}. | Mobile {P}; please leave a message. | WhatsApp {P}
The porter’s phone, {P}, is off at night. | Call {P} or fax {P} for a copy. | Numbers: {P} / {P}. | Text {P} when you arrive. | {T}; {P}; {A}. | tel {P}
{N} moved to {A} last spring. | {N} moved to {A} and kept the number {P}. | Return books to {N}, {A}. | The key is kept at {A}. | Visitors park behind {A} after six.
{T} moved to {A} last spring. | {T} lives at {A}. | {T}, {A}, asks for a reply. | “We did not expect this,” said {N}, who lives at {A}. | Send forms to {A}. | The office is at {A}. | {N} lives at {A} with {N}. | Her address is {A}. | Meet us at {A} at noon.
The award went to {N} and {N} this year. | Later {N} joined the team. | Thanks to {N} for the drawings. | Interview with {N}, second year. | Photo: {N} with {N}.
My name is {N} and I study here. | {N} beat {N} in the final round. | Minutes taken by {N}, checked by {N}. | This was {N}’s third report. | {N} wrote the preface. | By {N}
{T}, {E}, room 14, marks the papers. | {T} ({E}, ext. {9}) supervises the group. | {T} supervises the group. | Ask {T} or {T}. | We thank {T} and {N}. | Signed: {N}
The secretary reads {E} twice a day. | Questions go to {E} at any time. | Use {E} for corrections. | A copy ({E}) is enough. | Mail: {E}. | Replies: {E}. | Write to {E}, not to the office.
The record still shows {I} next to {E}. | Duplicate: {I} = {E}. | File of {N}: {I}. | {N} ({I}) was admitted. | Matched on {I}. | Scan shows {I}. | Please delete {I} from the file.
The form lists {N}, {I}, as the main applicant. | Applicants must quote their number as in this example left on the page: {I}. | Holder: {N}, {I} | {I} belongs to {N}. | {T} ({I}) signed.
Laut {N} fehlt nur der Stempel. | Rückfragen an {N}, Tel. {P}. | Bitte an {E} schreiben. | {N} wohnt in {A}. | Im Formular steht {I}. | Nach Angaben von {N} fehlt ein Blatt. | Frau {N} wohnt in {A}.
Según {N}, faltan dos firmas. | Contacte con {N}, teléfono {P}. | Escriba a {E} antes del lunes. | Envíe los papeles a {A}. | La solicitud de {N} ({I}) fue admitida. | Llame a {N} al {P}.
Selon {N}, il manque une signature. | Contactez {N} au {P}. | Adressez vos questions à {E}. | Le dossier de {N}, {I}, est complet. | {N} habite {A}. | Envoyez le dossier à {A}. | Déposez les clés chez {N}, {A}.
Fale com {N} pelo {P}. | Dúvidas: {E}. | Entregue em {A}. | O cadastro de {N} mostra {I}. | Segundo {N}, faltam duas assinaturas. | Звоните {P}. | Вопросы: {E}. | В анкете указано {I}. | Пишите {N} на {E}. | По словам {N}, не хватает подписи. | Адрес: {A}.
联系人：{C}，电话{Z}。 | 材料请寄至{D}，收件人{C}。 | 申请人{C}的身份证号为{J}。 | 咨询邮箱：{E}。 | 请联系{C}老师，电话{Z}。 | 由{C}负责登记，身份证号{J}。 | 联系人：{C}，邮箱{E}。 | 收件人：{C}，地址：{D}。 | {C}老师的电话是{Z}。 | 申请人{C}已提交材料。 | 联系人：{C}，电话{Z}。 | 申请人{C}的身份证号为{J}。 | 据{C}介绍，地址为{D}。
The {X} Prize is worth €4100 this year. | The {X} Hall reading room has 36 seats. | Order number {9} was archived. | Sensor readings: {9} to {9}, n = 8779. | Course code {9} replaces {9}. | Version {9} of the portal is live.
The book (ISBN {9}) is on the list. | Follow @marrowby_campus for updates. | Lecture room 521, building 2, opens at eight. | The new greenhouse stands between {X} Road and the open practicum, 12 minutes on foot. | Reference {9}.
Staff from {X} published the thesis together with the student union. | {X} and {X} share one bulletin, which students reach by shuttle. | By 14 April the seminar must be signed. | Ask at {X} for the waiver; it’s free for doctoral candidates.
The Dean spoke in May. | Hope and faith grow in May. | Grace is given until 10 May. | Last updated: 12 May 2024 | Zuletzt geändert am 12.1.2019 | Actualizado el 14/12/2019 | Mis à jour le 10/2/2024 | 发布日期：2018-9-15 | Atualizado em 10/7/2019
Published 8 April 2024 by the {X} desk | By the {X} newsroom | Posted by the web editor of {X} | Von der Redaktion {X} | Redacción de {X} | Redação de {X} | Редакция {X} | © 2024 {X} | Sign up and never miss a story from {X}
Am 27. März verschiebt die Pressestelle in {X} den Einführungskurs. | Das Institut für Gewässerkunde in {X} prüft das Angebot. | In {X} überarbeitet das Archiv die Prüfungsordnung. | Mit {X} teilt die Zulassungsstelle das Angebot; Fachschüler zahlen 16 Euro.
El acuerdo con {X} incluye la guía y 5 plazas. | Desde julio, la biblioteca central renueva el plan. | L’accord signé à {X} comprend la bourse et 28 places. | O acordo com {X} inclui o curso e 31 vagas. | Филиал {X} получил расписание и 16 книг без доплаты.
从柳川县到屿洲的班车十一月运行，国际申请者可填写电子表格。 | 来自渡塬的55名学员完成课程后，由图书馆统一安排住宿。 | 云坪镇站点记录显示，考试时间表比去年多86项，物理系据此调整方案。 | 据研究生院介绍，课程目录将于六月评估，共有10个名额。 | 家住泓川县的本科新生应在23日前选修课程。
En {X}, la oficina de admisión revisa el plan. | ¿Cuándo revisa la biblioteca el curso? En {X}, el 8 de marzo. | À {X}, le centre de langues révise la bourse. | Em {X}, a biblioteca publica o relatório. | Entre {X} et {X}, 9 élèves suivent le cursus. | Zwischen {X} und {X} pendelt im März ein Bus.
During January, mature students can borrow up to 9 items. | Since April the archive staff has merged over 9 entries. | From May on, astronomy replaces robotics. | Last October the school of nursing replaced its clinic. | In Robotics, the workshop remains the usual route. | Applications open on 11 December and close 46 days later.
A MATRÍCULA NÃO É AUTOMÁTICA; a reitoria adia a lista. | AVISO: A INSCRIÇÃO E A SELEÇÃO terminam em 25 de abril. | UPDATED 26 SEPTEMBER 2025 BY THE {X} DESK | Programme Notes, January 2024 | Course Leaders and Students | Related Articles | Desde Julio, el Consejo renueva el plan. | Rund 10 Gäste aus {X} besuchten den Kurs.
{E} is read every morning. | The list owner is {E}. | Day line {P}, night line {P}. | The porter’s phone, {P}, is off at night. | The {X} is a registered charity, number {9}. | {X} IS A REGISTERED CHARITY, NUMBER 7148. | Emergency contact: {N} / {P} / {A}.
The tutor answers mail sent to <{E}>. | To avoid robots, write to {E} instead. | Parcels for the club arrive at {A}. | Send the signed copy to {A}. | Sensor readings: 2059-04-50 to 389.723.6, n = 1373. | Staff from {X} and the Office of Works met in {X}. | Students near {X} report that the clinic helped them. | Neither Students nor Staff need it this January.
Hasta 88 equipos de {X} presentaron el plan. | Las familias de {X} y {X} reciben el plan el 6 de julio. | Der Senat in {X} vereinfacht die Gebührenordnung. | Seit Juni veröffentlicht das Archiv den Bericht. | Quien estudie en {X} puede combinar la guía. | Wer in {X} wohnt, erhält das Verzeichnis. | В городе {X} кафедра расширяет программу. | Договор с {X} включает летний курс.
Costs fell when the senate merged the clinic and moved it to {X}. Neither Students nor Staff need it. | They moved it to {X}. Work on the plan began. | During June, part-time staff can borrow it. | Eine Ausstellung über Brücken: der Senat
Fees are €79 per term — the student union evaluates a syllabus. | Some 120 guests from {X} came on 6 August. | Incident 79811 at node {X}. | Ref 0fad0fe | Call number 4411 is on the shelf. | The {X} Building opened in 1998. | The {X} Bridge and the {X} Tower are closed.
Selon {N}, le centre ferme tôt. | D’après {N}, rien ne change. | Écrivez à {N}, {A}. | {A} | Adresse : {A}. | Domicile : {A} | Livraison au {A}. | Según {N}, nada cambia. | Pergunte a {N}. | {N} hat das Blatt geprüft.
Пишите {R} до пятницы. | По словам {R}, не хватает подписи. | Спросите {R} в бюро. | {R} проверил список. | Звоните {R}: {P}. | Дело {R}: {I}. | Адрес: {W}. | {W} | Живёт по адресу {W}. | Документы шлите на {W}. | Контакт: {R}, {P}.
{C}昨天提交了材料。 | {C}负责登记。 | {C}表示同意。 | 由{C}审核。 | 感谢{C}的帮助。 | 作者：{C} | {C}、{C}参加了比赛。 | 地址：{D} | {C}将于五月到任。
Филиал {V} получил программу. | В {V} кафедра открыла курс. | Между {V} и {V} ходит автобус. | Редакция {V} | Мы используем файлы cookie. Принять | Читайте также | Поделиться страницей | Годовой отчёт: отдел практики | Последнее обновление: 18.8.2025
本周热门 | 开学周以来，教务处评估实验室开放日，并建议中学教师自备测量工具。 | 六月以来，档案馆调整课程目录。 | 一周内提交 | 每周一开放 | 周末活动 | 国王路站 | 高年级学生 | 马上报名 | 金融学院举办讲座 | 石油工程 | 方法与成果 | 白天开放 | 温室建成 | 汪洋与江河 | 本周推荐 | 上周活动 | 两周以后 | 校园周刊 | 周边交通
WORDS: STAFF WRITERS, {X} | A RESIDÊNCIA ESTUDANTIL: O ARQUIVO | BY THE {X} NEWSROOM | ZULETZT GEÄNDERT AM 12.12.2020 | SOIL SCIENCE: SEASONAL PORTFOLIO | AVISO LEGAL | LA BECA DE MOVILIDAD: EL DEPARTAMENTO | RELATED ARTICLES | LE CENTRE DE LANGUES | Words: staff writers, {X} | #sale_lamps, #best-chairs 20, rugs deal, #top_visas, hotels quote, #affordable
The record still shows {I} next to {E}. | {N} kept the number {P}. | Numbers: {P} / {P}. | Numbers: {P} / {P}. | {N} moved to {A} and kept the number {P}. | Guardian {N} (tel. {P}), {A}. | Emergency contact: {N} / {P} / {A}. | Contacte con {N}, teléfono {P}. | Guardian {N} (tel. {P}), {A}. | Звоните {P}. | Ask {E} <now>. | Ask {E}. | Ask {E} or {N}. | {E} | See {E}, or {E} > | ({E}) | Use {E} | mail to {E} | by {E} | {X} {E} | {9} {E} | {P}, {E} | {N}, {E} | {N} {E} {P} | Contact {E} | Duplicate: {I} = {E}. | {I} = {E} | {I} = {E}; {P}
Campus | Home | News | Library | Contact | Research | Admissions | Campus life | Jobs | {X} | {X} | {X} | {X} University | Visit {X} | Home {X} | Startseite | Bibliothek | Becas | Noticias | Inicio | Actualités | Notícias | Новости | 首页 | 新闻 | 图书馆 | Related | Tags | Share
lamps no-fee ${9}.46 SKU{9} | tents near-me $109.77 SKU48884 | vintage lamps $67.46 SKU8136 | cheap desks $9.20 SKU12345 | sofas free-shipping $220.67 SKU61695 | ZULETZT GEÄNDERT AM 18.8.2025 | LAST UPDATED 12 MAY 2024 | Stand: 3.11.2021 | 16 May 2023 | 12/5/2020 | {9} | 4857 shares | Shared 4857 times today | Rated 4 of 5
Ð£Ñ‡ÐµÐ±Ð½Ð°Ñ Ð¿Ñ€Ð°ÐºÑ‚Ð¸ÐºÐ° | Ð ÐµÐ´Ð°ÐºÑ†Ð¸Ñ {X} | Ð“Ð¾Ð´ 2024 | РЅРёРµ СЌРєР·Р°РјРµРЅ | ¿¼£¬×ªÔØÇë | ±¾Ò³ÄÚÈÝ½ö | VerÃ¤nderung 24 | 2 mÃ©tiers | дёЂдёЄ
"""  # fmt: skip

# Further parts of names for the labelled table, so that names missing from the
# table of names are learned too.
_GIVEN = "Anna Peter Maria Paul Zoltan Ximena Wilhelm Will Julia Martin Elena Ivan Sofia Diego Camille Luc Ana Bruno Olga Dmitri Emma Liam Nora Felix Greta Hugo Iris Otto Petra Sven".split()
_FAMILY = "Miller Fischer Garcia Silva Dubois Martin Petrov Ivanova Schneider Lopez Costa Moreau Novak Larsson Berg Hansen Keller Weber Russo Romano Brookfield Ashworth Hartwell Lindqvist Bergstrom Thornfield".split()
_GIVEN += "Élodie Zoé Léa Jérôme José Inés Óscar Åsa Jürgen Günther João Łukasz".split()
_FAMILY += "Ávila Núñez Müller Böhm Lefèvre Château Østergård Gonçalves Łęcki Šimić Peña O’Neill".split()
_RU_GIVEN = "Иван Ивану Ивана Пётр Петра Ольга Ольги Ольге Анна Анны Анне Сергей Сергею Мария Марии Дмитрий Дмитрия Елена Елены Алексей Нина Нины".split()
_RU_FAMILY = "Петров Петрову Петрова Иванова Ивановой Сидоров Сидорову Смирнова Смирновой Кузнецов Кузнецову Орлова Орловой Волков Волкова Лебедев Лебедеву".split()
_RU_ROAD = "Ленина Садовая Мира Полевая Лесная Советская Гоголя Центральная".split()
_RU_TOWN = "Каменск Озёрск Дубна Берёзово Клин Заречье Марьино Луговое".split()
_CJK_FAMILY = "欧阳 司徒 慈 屈 覃 阎 毋 席 庞 木 王 李 张 刘 陈 杨 赵 黄 周 吴".split()
_CJK_GIVEN = "洛禾砥芽暮澄岚桐羽塘清秋以沫茜汀望舒逸墨伟芳静明思远子涵建国晓梅雨轩宇泽欣怡浩然"
_TOWN = "Holford Easton Greywick Corbank Lindale Marrow Kelburn Oakmere Westport Nantham Tarport Fallow Brindley Penstead".split()
_ROAD = "Cobbler Heron Quarry Orchard Pinfold Juniper Tannery Bramble Mill Station Church High Park Bridge".split()


def _exchange(rng: np.random.RandomState, slot: str, given: list[str], family: list[str]) -> tuple[str, str | None]:
    pick = lambda xs: xs[rng.randint(len(xs))]
    d = lambda n: "".join(str(rng.randint(10)) for _ in range(n))
    if slot in "NT":
        first, last = pick(given), pick(family)
        if slot == "T":
            title = pick(["Dr.", "Prof.", "Ms", "Mr", "Mrs", "Dr", "Prof", "Frau", "Herr", "Mme", "Sra."])
            return f"{title} {last if rng.rand() < 0.6 else first + ' ' + last}", "name"
        r = rng.rand()
        if r < 0.07:
            return f"{last}, {first}", "name"
        return (f"{first} {chr(65 + rng.randint(26))}. {last}" if r < 0.2 else f"{first[0]}. {last}" if r < 0.26 else f"{first} {last}"), "name"
    if slot == "E":
        user = pick([f"{pick(given)}.{pick(family)}", f"{pick(family)}.{pick(given)}+{pick(['grad', 'apply', 'news'])}", f"{pick(family)}{d(2)}", f"{pick(given)[0]}{pick(family)}"]).lower()
        return user + pick(["@", "@", "[@]", " [at] ", " (at) "]) + pick(["mail.example", "uni.test", "dept.example.org", "mail [dot] example", "uni (dot) test"]), "email"
    if slot == "P":
        return pick(["+44 20 7946 0" + d(3), "07700 900" + d(3), f"+1 {d(3)}.555.0{d(3)}", f"({d(3)}) 555-0{d(3)}", f"{d(3)}-555-0{d(3)}", d(3) + "5550" + d(3), d(3) + "5550" + d(3), d(10), "+49 30 23125 " + d(3), f"+33 1 99 00 {d(2)} {d(2)}", f"+86 100 {d(4)} {d(4)}", f"+7 495 {d(3)}-{d(2)}-{d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"0{d(2)}/{d(7)}"]), "phone"
    if slot == "I":
        what, number = pick([("identity card", d(18)), ("identity card", d(17) + "X"), ("SSN", f"{d(3)} {d(2)} {d(4)}"), ("social security number", f"{d(3)}-{d(2)}-{d(4)}"), ("passport no.", "X" + d(7)), ("passport", chr(65 + rng.randint(26)) + d(8)), ("tax ID", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("DNI", d(8) + "F"), ("National Insurance number", f"QQ {d(2)} {d(2)} {d(2)} A"), ("CPF", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"), ("NIE", "X" + d(7) + "L"), ("Steuer-ID", d(11)), ("СНИЛС", f"{d(3)}-{d(3)}-{d(3)} {d(2)}")])
        return what + " ‹" + number + "›", "id_number"
    if slot == "A":
        n, road, town = str(rng.randint(1, 300)), pick(_ROAD), pick(_TOWN)
        kind = pick(["Road", "Street", "Avenue", "Lane", "Drive", "Terrace", "Close"])
        return pick([f"{n} {road} {kind}, {town}", f"Flat {rng.randint(1, 30)}, {n} {road} {kind}, {town} ZZ{d(1)} {d(1)}QX", f"{n} {road} {kind}, Apt {rng.randint(1, 40)}C, {town}", f"{road}weg {n}, 00{d(3)} {town}", f"{road}straße {n}, {d(5)} {town}", f"P.O. Box {n}, {town}", f"PO Box {n}, {town}", f"{n} rue {road}, {d(5)} {town}", f"{n}, {pick(['rue', 'avenue', 'place'])} {pick(['de la', 'du', 'des', 'de'])} {road}, {d(5)} {town}", f"Calle {road} {n}, {d(5)} {town}", f"Postfach {d(4)}, {d(5)} {town}", f"Rua {road}, {n}, {town}"]), "address"
    if slot == "R":
        return (f"{pick(_RU_FAMILY)} {pick(_RU_GIVEN)}" if rng.rand() < 0.15 else f"{pick(_RU_GIVEN)} {pick(_RU_FAMILY)}"), "name"
    if slot == "W":
        return pick([f"{pick(['Улица', 'улица', 'ул.', 'Проспект', 'пр.'])} {pick(_RU_ROAD)}, {pick(['д. ', 'дом ', ''])}{rng.randint(1, 200)}{pick(['', f', кв. {rng.randint(1, 90)}'])}", f"{d(6)}, {pick(_RU_TOWN)}, ул. {pick(_RU_ROAD)}, д. {rng.randint(1, 200)}"]), "address"
    if slot == "V":
        return pick(_RU_TOWN), None
    if slot == "C":
        return pick(_CJK_FAMILY) + pick(_CJK_GIVEN) + (pick(_CJK_GIVEN) if rng.rand() < 0.8 else ""), "name"
    if slot == "Z":
        return "100" + d(8), "phone"
    if slot == "J":
        return "99" + d(15) + pick(["X", d(1)]), "id_number"
    if slot == "D":
        return f"梧桐市{pick(['翠湖', '中山', '人民', '长江'])}路{rng.randint(1, 300)}号{rng.randint(1, 12)}单元{rng.randint(100, 999)}室", "address"
    if slot == "X":
        return pick([pick(_TOWN), pick(family), pick(family)]), None
    return pick([f"{d(4)}-{d(4)}-{d(3)}", f"979-9-{d(4)}-{d(4)}-{d(1)}", f"CS-{d(3)}-{d(4)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(3)}.{d(3)}.{d(1)}", f"10.{d(1)}.{d(1)}.{d(1)}", d(3)]), None


def training_set(names: dict[str, str], copies: int = 10, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Labelled token sequences: each line of the table ``copies`` times with other items."""
    rng = np.random.RandomState(seed)
    given = sorted(w for w, k in names.items() if k == "given") + _GIVEN
    family = sorted(w for w, k in names.items() if k == "family" and not "㐀" <= w[0] <= "鿿") + _FAMILY * 3
    out = []
    for line in re.split(r"\s*\|\s*|\n", LABELLED):
        if not line.strip():
            continue
        for copy in range(copies if "{" in line else 3):
            words: list[str] = []
            labels: list[int] = []
            for part in re.split(r"(\{[A-Z9]\})", line):
                if re.fullmatch(r"\{[A-Z9]\}", part):
                    text, kind = _exchange(rng, part[1], given, family)
                    if "‹" in text:
                        lead, text = text[:-1].split("‹")
                        ws = _TOKEN.findall(lead)
                        words += ws
                        labels += [0] * len(ws)
                else:
                    text, kind = part, None
                ws = _TOKEN.findall(text)
                words += ws
                if kind is None:
                    labels += [0] * len(ws)
                else:
                    b = 1 + 2 * TYPES.index(kind)
                    labels += [b] + [b + 1] * (len(ws) - 1)
            if copy % 10 == 2:
                words = [w.upper() for w in words]
            out.append((words, labels))
    return out


# -- Conditional random field ---------------------------------------------------------------


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(names: dict[str, str], epochs: int = 45, rate: float = 0.12, l2: float = 0.0005) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and transitions, by gradient ascent on the likelihood (Adam)."""
    data = sorted(training_set(names), key=lambda x: len(x[0]))
    table = Table(names)
    batches = []
    for at in range(0, len(data), 400):
        part = data[at : at + 400]
        t = max(len(w) for w, _ in part)
        y = np.zeros((len(part), t), int)
        mask = np.zeros((len(part), t), bool)
        rows, cols, feats = [], [], []
        for r, (ws, ls) in enumerate(part):
            ids = [table.id(w) for w in ws]
            y[r, : len(ls)] = ls
            mask[r, : len(ls)] = True
            for j in range(len(ws)):
                for o, off in enumerate((0, -1, 1, -2, 2)):
                    if 0 <= j + off < len(ws):
                        fs = table.rows[ids[j + off]][o]
                        rows += [r] * len(fs)
                        cols += [j] * len(fs)
                        feats += fs
        batches.append((y, mask, np.array(rows), np.array(cols), np.array(feats)))
    w, trans = np.zeros((DIM, K)), np.zeros((K, K))
    # An inside mark follows only its own type's marks.
    bad = np.zeros((K, K), bool)
    for b in range(2, K, 2):
        bad[:, b] = True
        bad[b - 1, b] = bad[b, b] = b == 2  # an address is one token
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    step = 0
    for _ in range(epochs):
        gw, gt = np.zeros_like(w), np.zeros_like(trans)
        moves = np.where(bad, -30.0, trans)
        for y, mask, rows, cols, feats in batches:
            n, t = y.shape
            flat = rows * t + cols
            e = np.stack([np.bincount(flat, w[feats, k], n * t) for k in range(K)], axis=1).reshape(n, t, K)
            a = np.zeros((n, t, K))
            a[:, 0] = e[:, 0] + np.where(np.arange(K) % 2 == 0, np.where(np.arange(K) > 0, -30.0, 0.0), 0.0)
            for j in range(1, t):
                new = _logsumexp(a[:, j - 1, :, None] + moves, 1) + e[:, j]
                a[:, j] = np.where(mask[:, j, None], new, a[:, j - 1])
            z = _logsumexp(a[:, -1], 1)
            b = np.zeros((n, t, K))
            for j in range(t - 2, -1, -1):
                back = _logsumexp(moves[None] + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2)
                b[:, j] = np.where(mask[:, j + 1, None], back, 0.0)
                pair = np.exp(a[:, j, :, None] + moves + (e[:, j + 1] + b[:, j + 1])[:, None, :] - z[:, None, None])
                live = mask[:, j + 1]
                gt -= pair[live].sum(axis=0)
                np.add.at(gt, (y[live, j], y[live, j + 1]), 1.0)
            g = -np.exp(a + b - z[:, None, None]) * mask[:, :, None]
            r, c = np.nonzero(mask)
            g[r, c, y[r, c]] += 1
            g = g.reshape(n * t, K)
            for k in range(K):
                gw[:, k] += np.bincount(feats, g[flat, k], DIM)
        step += 1
        for p, grad, m, v in ((w, gw / len(data) - l2 * w, state[0], state[1]), (trans, gt / len(data) - l2 * trans, state[2], state[3])):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w.astype(np.float32), np.where(bad, -30.0, trans).astype(np.float32)


class Tagger:
    def __init__(self, names: dict[str, str], weights: np.ndarray, moves: np.ndarray) -> None:
        self.table = Table(names, weights)
        self.moves = moves
        self.names = names

    def windows(self, text: str) -> list[tuple[list[str], int, int, int]]:
        """All tokens of a text in windows that overlap on both sides: (tokens, number of the
        first token, first and last number the window decides on).

        The spans decided on cover the text once, and every item has ``MARGIN`` tokens of
        context.
        """
        ws = tokens(text).findall(text)
        if len(ws) <= WINDOW + 2 * MARGIN:
            return [(ws, 0, 0, len(ws))] if ws else []
        return [(ws[max(0, at - MARGIN) : at + WINDOW + MARGIN], max(0, at - MARGIN), at, at + WINDOW) for at in range(0, len(ws), WINDOW)]

    def decode(self, seqs: list[list[str]]) -> list[np.ndarray]:
        """Viterbi paths; sequences of like length go through the recursion together."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(seqs)
        known = self.table.ids
        order = sorted((i for i in range(len(seqs)) if seqs[i]), key=lambda i: len(seqs[i]))
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            if len(known) > 400_000:  # only here, where no number of a token is in use
                known.clear()
                self.table.rows.clear()
            t = len(seqs[part[-1]])
            ids = np.zeros((len(part), t), int)
            mask = np.zeros((len(part), t), bool)
            for r, i in enumerate(part):
                row = [known.get(w, -1) for w in seqs[i]]
                if -1 in row:
                    row = [self.table.id(w) for w in seqs[i]]
                ids[r, : len(row)] = row
                mask[r, : len(row)] = True
            e = self.table.scores[ids, 0]
            for o, off in ((1, -1), (2, 1), (3, -2), (4, 2)):
                s = self.table.scores[ids, o] * mask[:, :, None]
                if off < 0:
                    e[:, -off:] += s[:, :off]
                else:
                    e[:, :-off] += s[:, off:]
            score = e[:, 0] - 30.0 * ((np.arange(K) % 2 == 0) & (np.arange(K) > 0))
            back = np.zeros((len(part), t, K), np.int8)
            for j in range(1, t):
                step = score[:, :, None] + self.moves
                arg = step.argmax(1)
                back[:, j] = arg
                score = np.where(mask[:, j, None], np.take_along_axis(step, arg[:, None, :], 1)[:, 0] + e[:, j], score)
            path = np.zeros((len(part), t), int)
            state = score.argmax(1)
            rows = np.arange(len(part))
            for j in range(t - 1, -1, -1):
                path[:, j] = np.where(mask[:, j], state, 0)
                if j:
                    state = np.where(mask[:, j], back[rows, j, state], state)
            for r, i in enumerate(part):
                out[i] = path[r, : len(seqs[i])]
        return out

    def items(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Items of each text: (start, end, type), without overlaps, in order."""
        # Lines stand on many pages: each different text is decoded once.
        number: dict[str, int] = {}
        which = [number.setdefault(_even(t), len(number)) for t in texts]
        texts = list(number)
        where, wins = [], []
        for k, text in enumerate(texts):
            for win in self.windows(text):
                where.append(k)
                wins.append(win)
        paths = self.decode([win[0] for win in wins])
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        at: list[tuple[int, int]] = []
        last = -1
        for k, (_, first, start, end), path in zip(where, wins, paths):
            if not path.any():
                continue
            if k != last:
                at = [m.span() for m in tokens(texts[k]).finditer(texts[k])]
                last = k
            j = 0
            while j < len(path):
                if path[j] % 2 == 1:
                    i = j + 1
                    while i < len(path) and path[i] == path[j] + 1:
                        i += 1
                    kind = TYPES[(path[j] - 1) // 2]
                    a, b = at[first + j][0], at[first + i - 1][1]
                    if not start <= first + j < end:
                        j = i
                        continue
                    if kind == "name" and not check(texts[k][a:b], kind):
                        # A sentence may end inside: the name stands behind its stop.
                        stop = texts[k].rfind(". ", a, b)
                        if stop >= 0 and check(texts[k][stop + 2 : b], kind) and " " in texts[k][stop + 2 : b]:
                            a = stop + 2
                    if not check(texts[k][a:b], kind):
                        kind = "phone" if kind == "id_number" and check(texts[k][a:b], "phone") and texts[k][a] == "+" else ""
                    if kind:
                        found[k].append((a, b, kind))
                    j = i
                else:
                    j += 1
        out = []
        for items in found:
            keep: list[tuple[int, int, str]] = []
            for item in sorted(set(items)):
                if not keep or item[0] >= keep[-1][1]:
                    keep.append(item)
            out.append(keep)
        return [out[k] for k in which]


# Words that begin sentences before a capitalised word, never names.
_NO_NAME = frozenset(
    "a an the in on at by from for during since last after before while with and or of to en em à au de des del la le les los las el o os as am im in zwischen mit nach von seit der die das den"
    " ein eine einen un una une um uma desde hasta según selon segundo laut entre sur por para pour und et y e в на с из к по".split()
)


def check(text: str, kind: str) -> bool:
    """Whether an item has its type's form."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return EMAIL.fullmatch(text.strip(".,;:<>()")) is not None
    if kind == "phone":
        return 7 <= digits <= 15 and not re.search(r"[^\W\d_]{3}", text)
    if kind == "id_number":
        return 6 <= digits <= 20 and not re.search(r"[$=@]|[^\W\d_]{3}", text)
    if kind == "address":
        return digits >= 1 and len(text) >= 7 and re.search(r"[^\W\d_]{2}", text) is not None and not re.search(r"[$€#ÃÂÐÑ�]|\b(?:is|number|charity)\b", text, re.I)
    if re.search("[^\\w .,’'-]|[ÃÂÐ]|Р[^а-я]", text):
        return False
    if digits or len(text) < 2 or "@" in text:
        return False
    parts = re.findall(r"[^\W\d_][^\s,]*", text)
    # A single word names nobody, but for names in Chinese characters.
    if len(parts) < 2 and not re.fullmatch("[㐀-鿿]{2,4}", text):
        return False
    # A stop ends a sentence unless it stands behind a title or an initial; names are capitalised.
    if any(p.endswith(".") and len(p) > 2 and p[:-1].lower() not in TITLES for p in parts[:-1]):
        return False
    if any(p[0].islower() and p not in ("von", "van", "de", "da", "di", "del", "der", "la", "y", "e") for p in parts):
        return False
    first = re.match(r"[^\W\d_]+", text)
    return not (first and first[0].lower() in _NO_NAME)


# -- Spark ----------------------------------------------------------------------------------

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)|<[A-Za-z/!?][^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*>|<[A-Za-z/!?][^<>]*>", re.S | re.I)
_INLINE_TAG = re.compile(r"</?(?:a|b|i|u|em|strong|span|small|abbr|time|code|sub|sup)(?![\w-])", re.I)
_ATTR_VALUE = re.compile(r"=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SCHEME = re.compile(r"(mailto|tel|sms):", re.I)


class Unit:
    """A text of a page that is read as one: the runs of text between two block tags, an
    attribute's value, or a comment.  ``parts`` are (start, end, text): where the part stands
    in the page and its text with entities decoded.  ``attribute`` is None for comments, which
    are read as they are."""

    __slots__ = ("parts", "attribute", "text")

    def __init__(self, parts: list[tuple[int, int, str]], attribute: bool | None = False) -> None:
        self.parts, self.attribute = parts, attribute
        self.text = parts[0][2] if len(parts) == 1 else "".join(p[2] for p in parts)


def units(html: str) -> list[Unit]:
    """Texts of a page: its elements, with inline tags taken out, values of attributes
    (quoted or not) and comments.  Only scripts and style sheets are no text."""
    out: list[Unit] = []
    run: list[tuple[int, int, str]] = []
    at = 0

    def text(a: int, b: int) -> None:
        part = html[a:b]
        if part and (run or not part.isspace()):
            run.append((a, b, unescape(part) if "&" in part else part))

    for m in _PIECE.finditer(html):
        a, b = m.span()
        text(at, a)
        at = b
        if html.startswith("<!--", a):
            if run:
                out.append(Unit(run))
                run = []
            inner = a + 4, b - 3 if html.endswith("-->", a, b) else b
            out.append(Unit([(*inner, html[inner[0] : inner[1]])], None))
            continue
        if run and not _INLINE_TAG.match(html, a):
            out.append(Unit(run))
            run = []
        if html.find("=", a, b) >= 0 and html[a + 1 : a + 7].lower() not in ("script", "style ", "style>"):
            for v in _ATTR_VALUE.finditer(html, a, b):
                k = v.lastindex
                value = v[k]
                if len(value) > 5:
                    s, e = v.span(k)
                    scheme = _SCHEME.match(value)
                    if scheme:
                        # Until its query; the scheme says what follows.
                        s += scheme.end()
                        value = value[scheme.end() :].partition("?")[0]
                        e = s + len(value)
                        lead = "Mail: " if scheme[1].lower() == "mailto" else "Mobile "
                        out.append(Unit([(s, s, lead), (s, e, unescape(value).replace("%40", "@"))], True))
                    elif value[0] not in "/#." and not value.startswith(("http://", "https://")) or "@" in value or "%40" in value:
                        out.append(Unit([(s, e, unescape(value).replace("%40", "@"))], True))
    text(at, len(html))
    if run:
        out.append(Unit(run))
    return [u for u in out if not u.text.isspace()]


def html_texts(html: str) -> list[str]:
    """Texts of a page as they are given to the model."""
    return [u.text for u in units(html)]


#: Rows of the table of names, which is collected and broadcast with the model.
MAX_PARTS = 200_000


def model(names: DataFrame) -> tuple[dict[str, str], np.ndarray, np.ndarray]:
    """Train on the driver; the table of names is a parameter of the model, of at most
    ``MAX_PARTS`` rows (more are an error)."""
    rows = names.where("name_part is not null").select("name_part", "part_kind").distinct().limit(MAX_PARTS + 1).collect()
    if len(rows) > MAX_PARTS:
        raise ValueError(f"a table of names has at most {MAX_PARTS} rows")
    parts = {r["name_part"]: r["part_kind"] for r in sorted(rows, key=lambda r: (r["name_part"], r["part_kind"] or ""))}
    key = hash(tuple(sorted((k, str(v)) for k, v in parts.items())))
    if key not in _models:
        _models[key] = (parts, *train(parts))
    return _models[key]


_models: dict[int, tuple] = {}
_taggers: dict[int, Tagger] = {}


def _tagger(trained) -> Tagger:
    key = zlib.crc32(trained[2].tobytes())
    if key not in _taggers:
        _taggers[key] = Tagger(*trained)
    return _taggers[key]


def _rows_of(tagger: Tagger, ids, texts_of: list[list[str]]) -> list[tuple[int, str]]:
    flat = [t for ts in texts_of for t in ts]
    items = tagger.items(flat)
    rows, at = [], 0
    for i, ts in zip(ids, texts_of):
        kinds = {kind for t in items[at : at + len(ts)] for _, _, kind in t}
        at += len(ts)
        rows += [(i, kind) for kind in sorted(kinds)]
    return rows


def found(fetch: DataFrame, analysis: DataFrame, names: DataFrame) -> DataFrame:
    """Types of personal data in each field (p3_found)."""
    trained = fetch.sparkSession.sparkContext.broadcast(model(names))

    def html_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _tagger(trained.value)
        for pdf in batches:
            rows = _rows_of(tagger, pdf["id"], [html_texts(h) for h in pdf["html"]])
            yield pd.DataFrame([("fetch_results", i, "html", k) for i, k in rows], columns=columns)

    def analysis_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _tagger(trained.value)
        for pdf in batches:
            rows = [(i, "summary", k) for i, k in _rows_of(tagger, pdf["id"], [[t] if t else [] for t in pdf["summary"]])]
            lists = [[t for t in x if t] if x is not None else [] for x in pdf["key_findings"]]
            rows += [(i, "key_findings", k) for i, k in _rows_of(tagger, pdf["id"], lists)]
            yield pd.DataFrame([("analysis_results", *r) for r in rows], columns=columns)

    columns = ["record_table", "record_id", "field_name", "pii_type"]
    schema = "record_table string, record_id bigint, field_name string, pii_type string"
    pages = spread(with_html(fetch.select(F.col("fetch_id").alias("id"), "html"))).mapInPandas(html_rows, schema)
    results = spread(analysis.select(F.col("analysis_id").alias("id"), "summary", "key_findings")).mapInPandas(analysis_rows, schema)
    return pages.unionAll(results)


def replace(tagger: Tagger, texts: list[str]) -> list[str]:
    """Texts with a typed placeholder in place of each item."""
    out = []
    for text, items in zip(texts, tagger.items(texts)):
        for a, b, kind in reversed(items):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        out.append(text)
    return out


def replace_html(tagger: Tagger, pages: list[str]) -> list[str]:
    """Pages with placeholders in their texts, attributes and comments.

    An item split by inline tags becomes one placeholder, the tags stay.  Only parts that
    hold some of an item change; markup and scripts keep their very bytes.
    """
    work = [(k, u) for k, html in enumerate(pages) for u in units(html)]
    edits: list[list[tuple[int, int, str]]] = [[] for _ in pages]
    for (k, unit), items in zip(work, tagger.items([u.text for _, u in work])):
        if not items:
            continue
        parts = [p[2] for p in unit.parts]
        for start, end, kind in reversed(items):
            first, at = True, 0
            for j, (s, e, _) in enumerate(unit.parts):
                part = unit.parts[j][2]
                a, b = max(start - at, 0), min(end - at, len(part))
                at += len(part)
                if a < b and s < e:
                    parts[j] = parts[j][:a] + (f"[{kind.upper()}]" if first else "") + parts[j][b:]
                    first = False
        for (s, e, old), new in zip(unit.parts, parts):
            if old != new:
                edits[k].append((s, e, new if unit.attribute is None or "&" not in pages[k][s:e] else escape(new, quote=unit.attribute)))
    out = []
    for html, es in zip(pages, edits):
        for s, e, new in sorted(es, reverse=True):
            html = html[:s] + new + html[e:]
        out.append(html)
    return out


def redacted(fetch: DataFrame, analysis: DataFrame, names: DataFrame) -> DataFrame:
    """The three fields with placeholders: ``(record_table, record_id, html, summary,
    key_findings)``, null where the field is null or of the other table."""
    trained = fetch.sparkSession.sparkContext.broadcast(model(names))

    def html_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _tagger(trained.value)
        for pdf in batches:
            pages = replace_html(tagger, [h or "" for h in pdf["html"]])
            yield pd.DataFrame({"record_id": pdf["id"], "html": [p if h is not None else None for p, h in zip(pages, pdf["html"])]})

    def analysis_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _tagger(trained.value)
        for pdf in batches:
            new = replace(tagger, [t or "" for t in pdf["summary"]])
            summary = [n if t is not None else None for n, t in zip(new, pdf["summary"])]
            findings = [None if x is None else [n if t is not None else None for n, t in zip(replace(tagger, [t or "" for t in x]), x)] for x in pdf["key_findings"]]
            yield pd.DataFrame({"record_id": pdf["id"], "summary": summary, "key_findings": findings})

    pages = spread(fetch.select(F.col("fetch_id").alias("id"), "html")).mapInPandas(html_rows, "record_id bigint, html string")
    results = spread(analysis.select(F.col("analysis_id").alias("id"), "summary", "key_findings")).mapInPandas(
        analysis_rows, "record_id bigint, summary string, key_findings array<string>"
    )
    none = F.lit(None).cast("string")
    return pages.select(F.lit("fetch_results").alias("record_table"), "record_id", "html", none.alias("summary"), F.lit(None).cast("array<string>").alias("key_findings")).unionAll(
        results.select(F.lit("analysis_results").alias("record_table"), "record_id", none.alias("html"), "summary", "key_findings")
    )
