"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level elements.  The first pass judges each block by what holds it (menus,
footers, adverts, forms and reader comments are told by element, role, class and id), its link density, its length and
its density of stop words: it is good, bad, or too short to tell.  In the second pass a block that is too short takes the
label of the nearest decided block; of one on each side at equal distance, the following one's for a heading and else
the better one's.  An article element (or main) is a region of its own: its blocks have no neighbours outside, the better of
both neighbours counts at any distance, and where nothing in it is decided its blocks are good.

Scale: per-row work, no shuffle; a page of any length is read once from left to right, whole.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import appended, table

#: Blocks under SHORT characters are too short to tell (in an article, those under ARTICLE_SHORT); one with more than LINKED of its characters in
#: links is a menu; outside articles a block is running text from MANY_STOPS of its words on (twice as long: from FEW_STOPS on) and isn't below FEW_STOPS.
SHORT, ARTICLE_SHORT, LINKED, MANY_STOPS, FEW_STOPS = 70, 25, 0.5, 0.2, 0.08

# Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title template iframe noembed noframes xmp svg object audio video canvas select datalist noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED = frozenset("p li dt dd td th tr thead tbody tfoot option optgroup html head body".split())  # their ends may be left out

#: What isn't the main text: elements, ARIA roles, and words of classes and ids; those of reader comments hold inside articles too.
ASIDE_ELEMENTS = frozenset("nav footer aside form menu dialog button fieldset search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion promoted popup modal overlay cookie cookies consent gdpr notice "
    "notices notification alert newsletter subscribe subscription signup login paywall menu nav navbar navigation breadcrumb breadcrumbs sidebar sidenav aside rail widget "
    "widgets footer header masthead topbar toolbar share sharing social related recommended recommendations trending pagination pager copyright legal disclaimer skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus respond replies reply".split())
#: Classes with these words tell of a page's layout or state, not of what an element holds.
STATE_WORDS = frozenset("has with without no enabled disabled".split())
#: Classes and ids that hold the main text where no article or main element does.
CONTENT_NAMES = frozenset("content article article-body article-content article-text post post-body post-content entry entry-content story story-body main main-content maincontent page-content body-content".split())
#: Parts of an article that are called like parts of a page.
ARTICLE_PARTS, ARTICLE_WORDS = frozenset("header banner legal related".split()), frozenset("article entry post story content".split())
#: Page-wide holders, whose classes may tell what else the page has ("with-sidebar", "has-comments").
PAGE_ELEMENTS = frozenset("html body main article".split())

#: Frequent words of six languages; words of any others that a corpus needs may be given instead.
STOP_WORDS = frozenset(
    (
        "the of and to in is that it for on with as was at by be this are from or an not but have which they his her you we "
        "de la le les et des en un une du que est pour dans qui sur pas au avec ce il elle par plus "
        "der die und das den von zu mit sich dem nicht ein eine ist es auf für im als auch an werden "
        "el los las y del se por con una para no su al lo como más o pero "
        "il di che è per non sono della con un una del i gli "
        "het een van op te zijn niet dat er aan voor met o a os da do em não uma com"
    ).split()
)

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s"'<>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))|(?<=\s)(hidden)(?=[\s/>])""")
_WORD = re.compile(r"[^\W\d_]+")
_KEYWORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


@dataclass
class Block:
    """text: collapsed; linked: characters in links; region: number of the article that holds it, 0 for none; aside: held by what isn't main text."""

    text: str
    linked: int
    region: int
    aside: bool
    heading: bool
    label: str = ""


def _holder(name: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """(not main text, reader comments, hidden, article) by an element's name, role, class and id."""
    aside = comment = hidden = article = False
    for key, a, b, c, bare in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = (key or bare).lower(), a or b or c
        if key in ("class", "id"):
            for token in value.split():
                words = set(_KEYWORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))  # ad-box, cookieNotice
                if words & STATE_WORDS or {"content", "sidebar"} <= words:
                    continue
                own = words & ASIDE_WORDS
                aside |= bool(own - ARTICLE_PARTS if words & ARTICLE_WORDS else own)
                comment |= bool(words & COMMENT_WORDS)
                article |= token.lower().replace("_", "-") in CONTENT_NAMES
        elif key == "role":
            aside |= value.strip().lower() in ASIDE_ROLES
            article |= value.strip().lower() in ("main", "article")
        elif key == "itemprop":
            article |= value.strip().lower() == "articlebody"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value.lower())):
            hidden = True
    if name in PAGE_ELEMENTS:
        return False, comment and name == "article", hidden, name in ("article", "main") or (article and name != "html" and name != "body")
    return aside or name in ASIDE_ELEMENTS, comment, hidden, article and not aside


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, unlabelled.

    Scripts, styles, hidden elements and markup leave nothing; an element without its end lasts until what holds it
    ends, and the first article ends the asides that were left open before it; stray ends are ignored.
    """
    out: list[Block] = []
    parts: list[str] = []
    links, in_link, heading = 0, False, False
    stack: list[tuple[str, int]] = []  # open elements with what they add to the counts below
    opened: dict[str, int] = {}
    count = {"aside": 0, "comment": 0, "hidden": 0, "article": 0}
    kinds = ("aside", "comment", "hidden", "article")
    regions, region = 0, 0

    def flush():
        nonlocal links, heading
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, min(links, len(text)), region if count["article"] else 0, count["aside"] > 0 or count["comment"] > 0, heading))
        parts.clear()
        links = 0

    def pop():
        name, bits = stack.pop()
        opened[name] -= 1
        for k, kind in enumerate(kinds):
            count[kind] -= bits >> k & 1

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at and not count["hidden"]:
            parts.append(page[at:start])
            if in_link:  # before white space at the ends is known to go
                links += len(" ".join(references.unescape(parts[-1]).split()))
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, start)
        if not m:
            parts.append("<")
            at = start + 1
            continue
        rest = _REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1 or n
        name, closing, at = m.group(1).lower(), page[start + 1] == "/", end
        if name in RAW and not closing:
            if page[end - 2 : end] == "/>" and name == "svg":
                continue
            found = _ENDS[name].search(page, end)
            at = n if not found else page.find(">", found.end()) + 1 or n
            continue
        if name == "a":
            in_link = not closing
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            in_link = in_link and not closing
            heading = name in HEADINGS and not closing
            if stack and not closing and (stack[-1][0] == "p" or stack[-1][0] == name and name in IMPLIED):
                pop()  # an end that was left out
        if name in VOID or (name in IMPLIED and not closing and not page[m.end() : end].strip("/> \n\t")):
            continue
        if closing:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        aside, comment, hidden, article = _holder(name, page[m.end() : end])
        aside = aside or (name == "header" and not count["article"])  # an article's own header belongs to it
        article = article and not comment
        if name not in BLOCKS:  # what isn't main text leaves nothing within a block
            aside, comment, hidden, article = False, False, aside or comment or hidden, False
        if name in IMPLIED and not (aside or comment or hidden):
            continue
        if name not in BLOCKS and not hidden:
            continue
        article = article and not (count["comment"] or (count["aside"] and regions))  # cards in the asides of a page with an article
        if article:
            while count["aside"]:
                pop()
            if not count["article"]:
                regions += 1
                region = regions
        stack.append((name, aside | comment << 1 | hidden << 2 | article << 3))
        opened[name] = opened.get(name, 0) + 1
        for k, on in enumerate((aside, comment, hidden, article)):
            count[kinds[k]] += on
    flush()
    return out


def label(found: list[Block], stops: frozenset[str] = STOP_WORDS, by_words: bool = True) -> None:
    """Give each block its label, good or bad, in two passes; without by_words the density of stop words decides nothing.

    Where a page has no good block by the first pass, its words are of no known language, and it is judged without them.
    """
    for b in found:
        density = b.linked / len(b.text)
        if b.aside or density > LINKED or (not b.region and ("©" in b.text or (density and len(b.text) < SHORT))):
            b.label = "bad"
        elif len(b.text) < (ARTICLE_SHORT if b.region else SHORT):
            b.label = "short"
        elif b.region or not by_words:
            b.label = "good"
        else:
            words = [w.lower() for w in _WORD.findall(b.text)]
            share = sum(w in stops for w in words) / max(1, len(words))
            b.label = "bad" if share < FEW_STOPS else "good" if share >= MANY_STOPS or len(b.text) >= 2 * SHORT else "short"
    if by_words and not any(b.label == "good" or (b.region and not b.aside) for b in found):
        return label(found, stops, False)
    for inside in (True, False):  # an article's blocks look only at blocks of the same article that no aside holds
        own = [b for b in found if bool(b.region) == inside and not (inside and b.aside)]
        marks: list[list] = [[None] * len(own), [None] * len(own)]
        for side, order in ((0, range(len(own))), (1, range(len(own) - 1, -1, -1))):
            last, gap, held = None, 0, None
            for i in order:
                if own[i].region != held:
                    last, held = None, own[i].region
                gap += 1
                if own[i].label != "short":
                    last, gap = own[i].label, 0
                marks[side][i] = None if last is None else (gap, last)
        for i, b in enumerate(own):
            if b.label == "short":
                near = [m for m in (marks[0][i], marks[1][i]) if m]
                if b.heading and marks[1][i]:
                    near = [marks[1][i]]  # a heading goes with what follows
                low = min((g for g, _ in near), default=0)
                b.label = ("good" if any(k == "good" for g, k in near if inside or g == low) else "bad") if near else ("good" if inside else "bad")


def main_text(page: str | None, stops: frozenset[str] = STOP_WORDS) -> str:
    """The good blocks, joined by line ends; a null or empty page has none."""
    found = blocks(page or "")
    label(found, stops)
    return "\n".join(b.text for b in found if b.label == "good")


def with_text(pages: DataFrame, html: str = "html", name: str = "text", stops: Iterable[str] = STOP_WORDS) -> DataFrame:
    """pages with their main text and n_chars, its length in code points.

    Null and empty pages and pages without main text have an empty one; pages of any length are read whole; equal pages
    give equal texts; columns of pages with these names are replaced; an empty table stays empty.
    """
    words = frozenset(stops)

    def compute(col: pa.Array) -> list[pa.Array]:
        texts = [main_text(p, words) for p in col.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

    return appended(pages, html, f"{name} string; n_chars long", compute, at_once=64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every page's main text and its length."""
    return with_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
