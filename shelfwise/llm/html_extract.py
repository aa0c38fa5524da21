"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides a block from the density of
stop words, its length and its link density, and from where it stands (inside a menu, footer,
form and the like nothing is main text). Stop words are listed for four languages; where they cannot tell,
on a page in none of them and in blocks of another script, length and links decide. A container whose class
or id marks boilerplate does not hide an article inside it, unless another article has fewer such containers
around it. Short blocks without links stay undecided. The second pass gives them the label of their nearest
decided neighbours.

One pass over the pages; nothing is shuffled, and a page is the most that a step holds.

Defined cases: a NULL or empty page, or one without main text, gives the empty string. Broken
markup is read as far as it goes: an unclosed comment or script hides the rest, an unclosed tag
is closed with its container, stray end tags are ignored. Repeated rows give equal results. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import ship
from shelfwise.llm.toxicity import FUNCTION_WORDS

#: Below this many characters a block without links is undecided in the first pass.
SHORT = 70
#: From this length on a block with few stop words is decided as well.
LONG = 200
#: Shares of link characters and of stop words.
MOST_LINKS, FEW_STOPS, MANY_STOPS = 0.35, 0.10, 0.18
#: Inside an article only blocks that are nearly all links, and no prose, are dropped for their links.
ARTICLE_LINKS = 0.90

GOOD, BAD, OPEN = 1, -1, 0

# Element names of HTML by their role, and words in class or id that mark boilerplate.
SKIP = frozenset("script style noscript template svg math iframe object canvas textarea select button head title audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot
th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start tag of the group ends an open element of the same group (paragraphs end at any block).
SELF_CLOSING = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
MARKED = frozenset("""ad ads adv advert adverts advertisement advertising adbox adsense banner banners sponsor sponsored sponsors promo
promos promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
sidebar sidebars side widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead
topbar toolbar share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply
tags tagcloud copyright legal disclaimer skip search hidden""".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
_NAME = re.compile(r"[a-z]+")
# Words that a mark may stand with in one name. Any other word makes the name say something else: page-with-sidebar
# has a sidebar beside it, ad-free has no adverts, related-work is a section.
PARTNERS = frozenset("posts articles stories links buttons icons list box bar block section area form widget".split())
PLACES = frozenset("""main site page left right top bottom wrap wrapper container inner outer primary secondary global item items group
panel holder""".split())
# Marks that, alone, are no boilerplate inside an article: it may have its own head, foot, notes and legal parts.
ARTICLE_OWN = frozenset("header footer side search legal tags notice notices alert hidden widget social".split())
#: Long blocks of these elements without stop words (code, lists of names, cells) are what their neighbours are.
BY_NEIGHBOURS = frozenset("pre li dd dt td th blockquote figcaption address".split())
STOP_WORDS = frozenset(w for words in FUNCTION_WORDS.values() for w in words)


@dataclass
class Block:
    text: str
    link_chars: int
    banned: bool
    article: int  # number of the article the block is in, 0 if none
    heading: bool
    marks: int = 0  # containers around it whose class or id marks boilerplate
    tag: str = ""  # element that the text stands in
    forms: tuple[int, ...] = ()  # forms around it
    label: int = OPEN


@dataclass
class _State:
    # open elements: name, banned, article, marks, forms
    stack: list[tuple[str, bool, int, int, tuple[int, ...]]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    link: list[str] = field(default_factory=list)
    in_link: int = 0
    articles: int = 0
    forms: int = 0
    article_marks: dict[int, int] = field(default_factory=dict)  # marks around each outermost article
    heading: bool = False


def _hidden(attributes: str) -> bool:
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"):
            return True
    return False


def _marked(name: str, attributes: str, in_article: bool) -> bool:
    """Whether class or id names the element as boilerplate: a mark alone, or marks with words that say what or where they are."""
    if name in ("html", "body") or name in ARTICLE:
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id"):
            for parts in map(_NAME.findall, value.strip("\"'").lower().split()):
                rest = [p for p in parts if p not in MARKED]
                if not parts or len(rest) == len(parts):
                    continue
                if in_article:
                    if PARTNERS.issuperset(rest) and not (len(parts) == 1 and parts[0] in ARTICLE_OWN) and (rest or len(set(parts)) == len(parts)):
                        return True
                elif (PARTNERS | PLACES).issuperset(rest):
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    s = _State()

    def end_block() -> None:
        if s.text:
            text = " ".join("".join(s.text).split())
            if text:
                link = len(" ".join("".join(s.link).split()))
                tag, banned, article, marks, forms = s.stack[-1] if s.stack else ("", False, 0, 0, ())
                s.blocks.append(Block(text, link, banned, article, s.heading, marks, tag, forms))
            s.text.clear()
            s.link.clear()

    def add(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        s.text.append(text)
        if s.in_link:
            s.link.append(text)

    def pop_to(depth: int) -> None:
        end_block()
        del s.stack[depth:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # end tag
            if name == "a":
                s.in_link = max(0, s.in_link - 1)
            elif name in BLOCK:
                depth = next((k for k in range(len(s.stack) - 1, -1, -1) if s.stack[k][0] == name), None)
                if depth is not None:
                    pop_to(depth)
                else:
                    end_block()
                s.heading = False
                s.in_link = 0
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW or name in SKIP:
            if not attributes.endswith("/") or name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else (size if name in RAW else at)
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            s.in_link = 1
        elif name in BLOCK:
            end_block()
            s.in_link = 0
            s.heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if s.stack and s.stack[-1][0] == "p":
                s.stack.pop()
            if name in SELF_CLOSING and s.stack and s.stack[-1][0] in SELF_CLOSING[name].split():
                s.stack.pop()
            if name in VOID:
                continue
            banned, article, marks, forms = s.stack[-1][1:] if s.stack else (False, 0, 0, ())
            if name in ARTICLE:
                s.articles += 1
                article = article or s.articles
                s.article_marks.setdefault(article, marks)
            if name == "header" and article:
                pass  # an article's own head
            elif name == "form":
                s.forms += 1
                forms += (s.forms,)
            elif name in BOILERPLATE:
                banned = True
            banned = banned or (bool(attributes) and _hidden(attributes))
            marks += bool(attributes) and _marked(name, attributes, bool(article))
            s.stack.append((name, banned, article, marks, forms))
        elif name not in VOID:
            add("")
    end_block()
    # a form around most of the page's text is the page's frame and no form to fill in
    plain = [b for b in s.blocks if not b.banned]
    size_of = {form: sum(len(b.text) - b.link_chars for b in plain if form in b.forms) for form in range(1, s.forms + 1)}
    frames = {form for form, n in size_of.items() if 2 * n > sum(len(b.text) - b.link_chars for b in plain)}
    for b in s.blocks:
        b.banned = b.banned or not frames.issuperset(b.forms)
    # of the articles with text those with the fewest marks around them are the page's own
    around = [s.article_marks[b.article] for b in s.blocks if b.article and not b.banned and b.marks == s.article_marks[b.article]]
    least = min(around, default=0)
    for b in s.blocks:
        b.banned = b.banned or b.marks > (least if b.article and s.article_marks[b.article] == least else 0)
    return s.blocks


def classify(page: list[Block]) -> None:
    """Set every block's label to ``GOOD`` or ``BAD``."""
    counts = []
    for b in page:
        words = _WORD.findall(b.text.lower())
        counts.append((sum(w in STOP_WORDS for w in words), len(words), b.text.isascii() or 2 * len(_LATIN.findall(b.text)) >= sum(map(len, words))))
    prose = [c for b, c in zip(page, counts) if not b.banned and b.link_chars <= MOST_LINKS * len(b.text) and len(b.text) >= SHORT]
    listed = sum(c[0] for c in prose) >= FEW_STOPS * sum(c[1] for c in prose)  # the page is in a language with listed stop words
    for b, (found, n, latin) in zip(page, counts):  # first pass: each block for itself
        stops = found / max(1, n)
        if b.banned:
            b.label = BAD
        elif b.article and b.link_chars > ARTICLE_LINKS * len(b.text) and (len(b.text) < SHORT or stops < FEW_STOPS):
            b.label = BAD
        elif not b.article and b.link_chars > MOST_LINKS * len(b.text):
            b.label = BAD
        elif len(b.text) < SHORT:
            b.label = BAD if b.link_chars and not b.article else OPEN
        elif stops >= MANY_STOPS or (b.article and stops >= FEW_STOPS):
            b.label = GOOD
        elif not (listed and latin):
            b.label = GOOD if len(b.text) >= LONG or not b.link_chars else OPEN
        elif len(b.text) >= LONG and stops < FEW_STOPS and not b.article and b.tag not in BY_NEIGHBOURS:
            b.label = BAD
    # second pass: undecided blocks look to both sides, inside an article no further than its ends
    decided = [b.label for b in page]
    some_good = GOOD in decided
    for k, b in enumerate(page):
        if decided[k] != OPEN:
            continue
        sides = []
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(page) and (decided[j] == OPEN or (b.article and page[j].banned)):
                j += step
            if 0 <= j < len(page) and (not b.article or page[j].article == b.article):
                sides.append((abs(j - k), decided[j]))
        labels = {label for _, label in sides}
        if b.article and GOOD not in labels:
            b.label = GOOD if not labels else BAD if len(b.text) < SHORT and not b.heading else GOOD
        elif not some_good and not b.link_chars:
            b.label = GOOD
        elif len(labels) == 1:
            b.label = labels.pop()
        elif len(labels) == 2:  # a good and a bad one: the nearer; a heading goes with what follows
            (near_before, before), (near_after, after) = sides
            b.label = after if b.heading else before if near_before < near_after else after if near_after < near_before else BAD
        else:
            b.label = BAD


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [main_text(p.as_py()) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")) \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
