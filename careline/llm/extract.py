"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. Pass one decides blocks by what they hold and
where they stand: blocks in navigation, headers, footers, sidebars, forms, adverts, notices
or comments are boilerplate, and so are blocks that are mostly links; long blocks with enough stop
words are text; other blocks inside an article element are text unless they are short. What
is left, short or sparse blocks (code, tables, lists of names), is ambiguous. If more characters stand in long
ambiguous blocks than in text, and no article element tells more, the page is taken to be in a language
without listed stop words: there long blocks are text by their length and few links alone. Pass two gives an ambiguous block the label of
the nearest decided blocks in its own container (article, section), and in the whole page if
that has none: both alike, or the nearer one; at equal distance, text. A page without any text
by these rules has its ambiguous blocks as text.

Each page is one value and is read in one pass of a tag expression; nothing is shuffled.

Defined cases: null, empty and tagless pages work (the latter are blocks of plain text); a
page without any text gives the empty text; unclosed and stray tags are tolerated, and end tags that HTML
lets a page leave out (of paragraphs, items, cells and rows) are implied; a button, picture, frame or the like without
end tag ends at the next block, so no text behind it is lost; blocks may be nested to any depth at linear cost; repeated
rows and other columns stay as they are.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from careline.llm.common import appended

#: Share of characters in links above which a block is boilerplate.
LINKS = 0.4
#: Characters of a short block and share of stop words of a block that is text, outside articles.
SHORT, STOPS = 60, 0.12

# fixed values: elements whose boundaries end a block
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li
main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr
ul""".split())
# fixed values: elements without text of the page
DROPPED = set("script style noscript template svg math canvas object iframe textarea select button".split())
# fixed values: of these, elements whose content is no markup, and elements that may hold others of their name
RAW = set("script style".split())
NESTED = set("template svg math canvas object".split())
# fixed values: elements that are never main text
ASIDES = set("head nav footer aside form dialog menu search".split())
# fixed values: elements that hold an article, and those that group blocks
ARTICLES = set("article main".split())
CONTAINERS = ARTICLES | set("section body".split())
# fixed values: elements that never have an end tag
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: start tags that end an open paragraph, and others with the open elements that they end and
# the elements beyond which they do not look
PARAGRAPH_ENDS = set("""address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul""".split())
CELLS = set("table caption td th".split())
ITEM_BOUNDS = BLOCKS - set("address div p".split())
ROW_GROUPS = set("thead tbody tfoot".split())
ENDED = {
    "li": ({"li"}, ITEM_BOUNDS), "dt": ({"dt", "dd"}, ITEM_BOUNDS), "dd": ({"dt", "dd"}, ITEM_BOUNDS),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "caption"}, {"table"}),
    **{g: (ROW_GROUPS | {"caption"}, {"table"}) for g in ROW_GROUPS}}
# fixed values: elements beyond which an end tag does not look for its start
END_BOUNDS = {"p": CELLS, "dt": CELLS | {"dl"}, "dd": CELLS | {"dl"}, "li": CELLS | set("ul ol menu dir".split()),
              "td": {"table"}, "th": {"table"}, "tr": {"table"}, **dict.fromkeys(ROW_GROUPS, {"table"})}
# fixed values: words of class and id names that mark what is not main text
MARKS = set("""ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo
promos promoted promotion banner cookie cookies consent gdpr notice notices notification notifications alert
alerts popup modal overlay newsletter subscribe subscription signup login register paywall comment comments
commentlist disqus reply replies respond discussion sidebar sidebars widget widgets related recommended recommendations
share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation navi footer masthead toolbar
topbar pagination pager copyright legal disclaimer skip""".split())
# fixed values: roles that are not main text
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
# fixed values: frequent words of some languages
STOP_WORDS = set("""
the of and to in a is that it for on was as with be by at from this are or an not have but had they which
you were all their one we can has there been if more when will would who so no her his he she
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis
le la les de des et en un une du à il est que pour dans ce qui ne sur se pas plus par je avec tout son au
sont mais comme ou nous vous elle être ses leur cette aux deux même ils été
el los las y del se con por su para como más pero sus lo una al o este sí porque esta entre cuando muy sin
sobre también me hasta hay donde quien desde todo nos durante uno ni contra ese eso
il lo gli di che è per non sono da si ha anche come più ma della dei nel alla
os uma com não em mais dos foi ao ele das tem seu sua ou ser
het een van en dat op te zijn voor met niet aan er om ook als maar dan bij
""".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"']+)|(?<![^\s"'])(hidden)(?=[\s/]|$)""", re.I)
WORD = re.compile(r"[^\W\d_]+")
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS - DROPPED, key=len, reverse=True))})(?=[\s/>])", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    aside: bool
    marked: bool  # by class, id or role
    article: bool
    place: int  # number of the container


def _attributes(rest: str) -> dict[str, str]:
    found = {}
    for m in ATTRIBUTE.finditer(rest):
        if m[3]:
            found["hidden"] = ""
        else:
            found[m[1].lower()] = m[2].strip("\"'")
    return found


def _marked(rest: str) -> tuple[bool, bool]:
    """Whether attributes say that an element is not seen, and that it is no main text."""
    if "=" not in rest and "hidden" not in rest.lower():
        return False, False
    a = _attributes(rest)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(a.get("style", "")):
        return True, True
    if a.get("role", "").lower() in ROLES:
        return False, True
    names = re.split(r"[^a-zA-Z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{a.get('class', '')} {a.get('id', '')}"))
    return False, any(n.lower() in MARKS for n in names)


class Dropped:
    """Ends of the elements of a page that are no text of it. The tags of a name are matched once."""

    def __init__(self, page: str):
        self.page, self.ends = page, {}

    def end(self, name: str, start: int, at: int) -> int:
        """The place behind the element whose start tag lies from ``start`` to ``at``. One without an end tag
        ends in front of the next tag of a block; a script or style sheet at the end of the page."""
        if name not in self.ends:
            self.ends[name] = self._matched(name)
        found = self.ends[name].get(start)
        if found is None and name in RAW:
            return len(self.page)
        if found is None:
            block = BLOCK_TAG.search(self.page, at)
            return block.start() if block else len(self.page)
        return max(found, at)

    def _matched(self, name: str) -> dict[int, int]:
        ends, waiting = {}, []
        for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", self.page, re.I):
            if m[1]:
                if waiting:
                    ends[waiting.pop()] = m.end()
            elif name in RAW and waiting:
                continue  # the text of a script that has no end tag yet
            elif not m[0].endswith("/>"):
                if name not in NESTED:
                    waiting.clear()  # one that stands in another of its name shows that the other has no end tag
                waiting.append(m.start())
        return ends


def cut(page: str) -> list[Block]:
    """Blocks of a page in page order."""
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = 0
    in_link = 0
    # open elements that matter: (name, aside, marked, article, place)
    state = [("", False, False, False, 0)]
    places = 0
    opened: dict[str, list[int]] = {}  # places in state of the open elements of each name
    dropped = Dropped(page)

    def innermost(names: set[str]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def close(first: int) -> None:
        """Close the open elements from ``first`` on."""
        for name, *_ in state[first:]:
            opened[name].pop()
        del state[first:]

    def end(names: set[str], bounds: set[str]) -> None:
        """Close the innermost open element of these names, with all in it."""
        found = innermost(names)
        if found and found >= innermost(bounds):
            close(found)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                _, aside, marked, article, place = state[-1]
                blocks.append(Block(text, min(linked, len(text)), aside, marked, article, place))
            pieces.clear()
        linked = 0

    at = 0
    while True:
        m = TAG.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            pieces.append(text)
            if in_link:
                linked += len(" ".join(html.unescape(text).split()))
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, rest = name.lower(), m["rest"]
        if m["close"]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCKS:
                flush()
                in_link = 0 if name in CONTAINERS or name in ASIDES else in_link
            end({name}, END_BOUNDS.get(name, set()))
            continue
        if name in DROPPED and not rest.endswith("/"):
            at = dropped.end(name, m.start(), at)
            if name in BLOCKS:
                flush()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name == "a":
            in_link = 1
        if name in BLOCKS:
            flush()
        if name in PARAGRAPH_ENDS:
            end({"p"}, CELLS)
        if name in ENDED:
            end(*ENDED[name])
        if name == "body":
            close(1)
        if name in VOID or rest.endswith("/"):
            continue
        _, aside, marked, article, place = state[-1]
        unseen, odd = (False, False) if name in ("body", "html") or name in ARTICLES else _marked(rest)
        if name in BLOCKS and name != "hr" or odd:
            if name in CONTAINERS:
                places += 1
                place = places
            opened.setdefault(name, []).append(len(state))
            state.append((name, aside or unseen or name in ASIDES or name == "header" and not article,
                          marked or odd, article or name in ARTICLES, place))
    flush()
    return blocks


def _decided(b: Block, names: bool) -> bool | None:
    """True for text, False for boilerplate, None for ambiguous blocks."""
    if b.aside or (names and b.marked):
        return False
    if b.linked > LINKS * len(b.text):
        return False
    if len(b.text) < SHORT:
        return None
    words = WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words)
    if b.article or stops >= STOPS * len(words) and words:
        return True
    return None


def labels(blocks: list[Block], names: bool = True) -> list[bool]:
    """The label of each block after both passes."""
    first = [_decided(b, names) for b in blocks]
    if not any(b.article for b in blocks):
        sparse = [i for i, b in enumerate(blocks) if first[i] is None and len(b.text) >= SHORT]
        if sum(len(blocks[i].text) for i in sparse) > sum(len(b.text) for b, f in zip(blocks, first) if f):
            for i in sparse:
                first[i] = True

    def nearest(i: int, step: int, inside: bool) -> tuple[int, bool] | None:
        return reach[step, inside][i]

    # nearest decided block on each side, in the container and in the page
    reach: dict = {}
    for step in (-1, 1):
        for inside in (True, False):
            found, last = [None] * len(blocks), {}
            order = range(len(blocks)) if step == -1 else range(len(blocks) - 1, -1, -1)
            for i in order:
                key = blocks[i].place if inside else 0
                got = last.get(key)
                found[i] = got if got is None else (abs(i - got[0]), got[1])
                # inside a container, asides tell nothing about the text beside them
                if first[i] is not None and not (inside and not first[i] and (blocks[i].aside or blocks[i].marked)):
                    last[key] = (i, first[i])
            reach[step, inside] = found
    out = []
    for i, b in enumerate(blocks):
        if first[i] is not None:
            out.append(first[i])
            continue
        near = [x for x in (nearest(i, -1, True), nearest(i, 1, True)) if x]
        if not near and b.article:
            out.append(True)
            continue
        near = near or [x for x in (nearest(i, -1, False), nearest(i, 1, False)) if x]
        if not near:
            out.append(b.article or not any(x.article for x in blocks))
            continue
        least = min(d for d, _ in near)
        out.append(any(good for d, good in near if d == least))
    return out


def main_text(page: str | None) -> str:
    """Text blocks of a page, joined by line ends."""
    blocks = cut(page or "")
    keep = labels(blocks)
    if not any(keep):  # nothing but ambiguous blocks
        keep = [_decided(b, True) is None for b in blocks]
    if not any(keep):  # the whole page stands in a marked element
        keep = labels(blocks, names=False)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def with_main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None,
                   name: str = "text") -> DataFrame:
    """The columns ``keep`` (by default all) with the main text, which replaces a column of that
    name."""
    return appended(pages, html_col, f"`{name}` string", lambda found: [[main_text(v) for v in found]], keep)
