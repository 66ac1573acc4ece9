import html
import html.parser
import re

import pytest

from careline.llm import extract

PAGE = """<html><head><title>x</title></head><body class="has-comments"><header><a href=/>Home</a> The site of the best</header>
<div id="cookie-notice">We use cookies to make the site better for you and all of the others in the world.</div>
<div class="content"><h1>A title</h1><p>This is the text of the article and it is long enough to be recognised as such by the rules of the game.</p>
<p>Short one.</p><p>Another long paragraph with the words that are in the list of the stop words, and it goes on for a while.</p>
<div class="comments"><p>I think that this is the best article of all, and I have read it with my family at home.</p></div></div>
<div class="sidebar"><p>Related: the most read of all the articles that we have had in the last year.</p></div>
<ul><li><a href=a>Some of the links that we have for you here</a></li></ul>
<form><p>Enter the name of the one who is to be told of it by us.</p><input></form><footer>All rights &copy; the owner of this</footer></body></html>"""


def test_page_without_an_article_element():
    assert extract.main_text(PAGE).split("\n") == [
        "A title", "This is the text of the article and it is long enough to be recognised as such by the rules of the game.",
        "Short one.", "Another long paragraph with the words that are in the list of the stop words, and it goes on for a while."]


def test_article_element():
    page = ("<body><nav><a href=1>One</a></nav><div class=ad>The best of all the offers that we have had in this year are here.</div>"
            "<main><article><header><h1>T &amp; t</h1></header><p>one<p>two &lt;b&gt;&nbsp; 3<br>4<script>x('</p>')</script>"
            "<aside>The most read of all the articles that we have had</aside><style>p{}</style><!-- no --><p>zqx zqx zqx</article></main>"
            "<section id=comments><p>I have read it and it is the best of all of them, by far.</p></section><footer>f</footer>")
    assert extract.main_text(page) == "T & t\none\ntwo <b> 3 4\nzqx zqx zqx"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a &amp; b", "a & b"), ("<<<>>> < b", "<<<>>> < b"),
    ("<div class='sidebar'><p>everything that is in the page stands in the one element with a bad name</p></div>",
     "everything that is in the page stands in the one element with a bad name"),
    ("<p title='a>b'>the text</p>", "the text"), ("<p>x<!-- never closed <b>y", "x"), ("<script>never closed", ""),
    ("<div hidden>the one that is not to be seen by any of the readers of the page</div><p>seen", "seen"),
])
def test_odd_pages(page, text):
    assert extract.main_text(page) == text


LONG = "This is the text of the article and it is long enough to be recognised as such by the rules."


@pytest.mark.parametrize("name", ["button", "select", "svg", "canvas", "object", "iframe", "textarea", "math", "template", "noscript"])
def test_dropped_elements_without_end(name):
    page = f"<article><h1>T</h1><p>one</p><{name} x=1>Share<p>two</p><p>three<{name}>More</{name}> four</p><{name}>x<p>five</p></article>"
    assert extract.main_text(page) == "T\none\ntwo\nthree" + ("\n" if name in extract.BLOCKS else " ") + "four\nfive"


def test_dropped_elements():
    assert extract.main_text("<article><p>a<svg><g><svg><text>no</text></svg>label</g></svg> b<p>c<script>x<script>y</script> d") == "a b\nc d"
    assert extract.main_text("<article><p>a<button><div>Share</div></button> b<p>c<style>p{<p>}") == "a b\nc"
    assert extract.main_text("<article><p>a<svg/> b<svg><path/><p>c<svg ") == "a b\nc<svg"


@pytest.mark.parametrize("unit", ["<div>", "<div><p>", "<section><ul><li>", "<table><tr><td>", "<div class=ad>", "<button>", "<svg>", "<svg><p>",
                                  "<article>", "<p class=ad>", "</div>", "<dl><dd>", "<select><option>"])
def test_deep_pages_cost_in_proportion(unit):
    import time

    page = unit * 100_000 + f"<p>{LONG}"
    began = time.process_time()
    extract.main_text(page)
    assert time.process_time() - began < 4


class Plain(html.parser.HTMLParser):
    """Blocks by the library's parser: text of each stretch between block tags, and the elements it stands in."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.text, self.links = [], [], "", 0

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append((text, self.links, [n for n, _ in self.open], any(m for _, m in self.open)))
        self.text, self.links = "", 0

    def handle_starttag(self, name, attrs):
        if name in extract.BLOCKS:
            self.flush()
        if name == "br":
            self.text += " "
        elif name not in extract.VOID:
            marks = re.split("[^a-zA-Z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower())
            self.open.append((name, any(m in extract.MARKS for m in marks)))

    def handle_endtag(self, name):
        if name in extract.BLOCKS:
            self.flush()
        if name in [n for n, _ in self.open]:
            while self.open.pop()[0] != name:
                pass

    def handle_data(self, data):
        if not {n for n, _ in self.open} & extract.DROPPED:
            self.text += data
            self.links += len(" ".join(data.split())) if "a" in [n for n, _ in self.open] else 0


def plain_text(page):
    """The two passes over the parser's blocks of a well-formed page without nested sections, written out for one block at a time."""
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.flush()
    blocks, first = parser.blocks, []
    for text, links, names, marked in blocks:
        words = re.findall(r"[^\W\d_]+", text.lower())
        good = len(words) and sum(w in extract.STOP_WORDS for w in words) / len(words) >= extract.STOPS
        if set(names) & extract.ASIDES or marked or links > extract.LINKS * len(text) or ("header" in names and "article" not in names):
            first.append(False)
        else:
            first.append(True if len(text) >= extract.SHORT and (good or "article" in names) else None)
    plain = [i for i, f in enumerate(first) if f is None and len(blocks[i][0]) >= extract.SHORT]
    texts = sum(len(b[0]) for b, f in zip(blocks, first) if f)
    if not any("article" in b[2] for b in blocks) and sum(len(blocks[i][0]) for i in plain) > texts:
        for i in plain:
            first[i] = True
    out = []
    for i, f in enumerate(first):
        inside = "article" in blocks[i][2]
        if f is None:
            aside = (lambda j: not first[j] and (bool(set(blocks[j][2]) & extract.ASIDES) or blocks[j][3] or "header" in blocks[j][2]))
            mine = [j for j in range(len(blocks)) if first[j] is not None and ("article" in blocks[j][2]) == inside and not aside(j)]
            every = [j for j in range(len(blocks)) if first[j] is not None]
            near = mine if mine or inside else every
            if near:
                least = min(abs(j - i) for j in near)
                f = any(first[j] for j in near if abs(j - i) == least)
            else:
                f = inside or not any("article" in b[2] for b in blocks)
        out.append(f)
    if not any(out):
        return None
    return "\n".join(b[0] for b, f in zip(blocks, out) if f)


def test_equals_a_plain_second_implementation():
    import random

    rng, compared = random.Random(4), 0
    stops, names = "the of and to in a is that it for".split(), "zorvik plantu marog xeli tendra quom".split()

    def words(n, stop):
        return " ".join(rng.choice(stops if rng.random() < stop else names) for _ in range(n))

    def block():
        kind = rng.randrange(9)
        if kind == 0:
            return f"<ul>{''.join(f'<li><a href=x>{words(3, 0)}</a></li>' for _ in range(rng.randrange(1, 5)))}</ul>"
        if kind == 1:
            return f"<pre>{words(rng.randrange(1, 30), 0)}</pre>"
        if kind == 2:
            return f"<div class='{rng.choice(['sidebar', 'x-ad y', 'text', 'comments'])}'><p>{words(rng.randrange(1, 30), .4)}</p></div>"
        if kind == 3:
            return f"<{(t := rng.choice(['nav', 'footer', 'aside', 'form', 'header']))}><div>{words(9, .3)}</div></{t}>"
        if kind == 4:
            return f"<h2>{words(3, .2)}</h2><p>{words(2, 0)} <button>{words(2, 0)}</button><b>{words(4, .5)}</b></p>"
        return f"<p>{words(rng.randrange(1, 40), .5)} &amp; <a href=y>{words(rng.randrange(1, 6), 0)}</a><br>{words(4, .1)}</p>"

    for _ in range(600):
        inside = "".join(block() for _ in range(rng.randrange(1, 12)))
        page = rng.choice(["<html><body>{}</body></html>", "<div><div>{}</div></div>", "<article>{}</article>", "<nav><p>x</p></nav><article>{}</article><p>more of it</p>"]).format(inside)
        want = plain_text(page)
        if want is not None:
            compared += 1
            assert extract.main_text(page) == want, page
    assert compared > 400


def test_long_page():
    page = "<article>" + "<p>the paragraph of it</p>" * 50_000
    assert extract.main_text(page) == "\n".join(["the paragraph of it"] * 50_000)


def test_all_pages_equal_their_article(spark):
    from careline.llm.q_extract import op9_html_extract

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    found = op9_html_extract(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(pages)
    for r in found:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a")], "page_id long, url string, html string").selectExpr(
        "*", "1 AS text", "2 AS _source", "3 AS n_chars", "4 AS place")
    row = extract.with_main_text(pages).first()
    assert (row.text, row._source, row.n_chars, row.place, row.html) == ("a", 2, 3, 4, "<p>a")


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>a", None)], "page_id long, url string, html string, text string")
    assert sorted(str(tuple(r)) for r in extract.with_main_text(df).collect()) == sorted(
        str(t) for t in [(1, None, None, ""), (1, None, None, ""), (None, "u", "<p>a", "a")])
    assert extract.with_main_text(df.limit(0), keep=["page_id"]).count() == 0


TEXT = "<p>This is the text of the page and it is long enough to be recognised as such by the rules of the game, number {}.</p>"


def test_code_tables_and_names_between_paragraphs_of_a_div_page():
    code = "def fold(xs): return reduce(lambda x, y: x + y, xs, 0) # O(n) additions, O(1) memory"
    names = "Anna Berg, Boris Klein, Clara Stein, Dmitri Orlov, Elena Petrova, Farid Haddad"
    row = "<tr><td>2019</td><td>northern district, measured quantity 12.5 kg/m3, deviation 0.25 kg/m3</td></tr>"
    page = (f"<body><div class=nav><a href=1>One</a></div><div>{TEXT.format(1)}<pre>{code}</pre>{TEXT.format(2)}<p>{names}</p>"
            f"{TEXT.format(3)}<table>{row}</table>{TEXT.format(4)}</div><div class=footer>Street 1</div></body>")
    found = extract.main_text(page).split("\n")
    assert code in found and names in found and "2019" in found and len(found) == 8
    assert "northern district, measured quantity 12.5 kg/m3, deviation 0.25 kg/m3" in found


@pytest.mark.parametrize("notice", ["", "<div>We use all of the data that you give to us, and it is kept by us for a year.</div>"])
def test_div_page_in_an_unlisted_language(notice):
    text = ["Москва является крупнейшим городом страны, здесь живут миллионы жителей разных профессий.",
            "Каждый год сюда приезжают путешественники, которых привлекают музеи, театры и старинные улицы.",
            "Городские власти обещают построить новые станции метро, а также обновить старые дома центра."]
    page = (f"<body><div class=menu><a href=1>Главная</a> <a href=2>Новости</a></div><div><h1>Город</h1>"
            f"{''.join(f'<p>{t}</p>' for t in text)}</div>{notice}<ul><li><a href=3>Читайте также другие материалы нашего сайта о жизни города</a></li></ul>"
            "<div class=footer>Все права защищены законом, перепечатка материалов запрещена без разрешения</div></body>")
    found = extract.main_text(page).split("\n")
    assert found[:4] == ["Город", *text] and all("Читайте" not in t and "права" not in t for t in found)


@pytest.mark.parametrize("page, kept", [
    ("<div><p class=share>Tell it<p>{0}<p class=copyright>Owned<h2>Part</h2><p>{1}</div>", ["{0}", "Part", "{1}"]),
    ("<div><p class=share>Tell <span class=ad>it<p>{0}<ul><li class=promo>Buy<li>{1}</ul><p>{2}</div>", ["{0}", "{1}", "{2}"]),
    ("<div><p>{0}<ul><li class=promo>Buy<ul><li>Cheap</li><li>Now</li></ul>at once</li><li>{1}</ul></div>", ["{0}", "{1}"]),
    ("<div><p>{0}<dl><dt class=ad>Buy<dd>{1}<dt>{2}</dl></div>", ["{0}", "{1}", "{2}"]),
    ("<div><p>{0}<table><tr class=ad><td>Buy<tr><td class=share>Tell<td>{1}<tr><td>{2}</table></div>", ["{0}", "{1}", "{2}"]),
])
def test_implied_end_tags(page, kept):
    texts = [f"This is the text of the page and it is long enough to be seen as such by the rules of the game, {i}." for i in range(3)]
    assert extract.main_text("<body>" + page.format(*texts)).split("\n") == [k.format(*texts) for k in kept]
