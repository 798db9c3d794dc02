"""Main text of web pages by block rules in two passes.

A small scanner cuts a page into blocks with what stands around them, inside
the task that reads the page: a page is one row, so its blocks need no shuffle
and no table of their own. The first pass decides blocks by where they
stand (menus, headers, footers, asides, forms, notices, adverts, comments), by
link density, and by length and stop-word density together. Where most of the
long text of a page has few of the listed stop words, its language is none of
the listed ones, and length and link density decide alone. What is left, short
blocks and long ones with few stop words, takes the label of the nearest
decided neighbour in its region (the article, or the page around it); between
a good and a bad one at the same distance good wins. A region without any good
block has no bad neighbours but in the page around an article: an undecided
article is text, and so is an undecided page without an article and without
link-heavy blocks.

What a class, id or role names counts part by part within one name, but not in
a name that tells a state (``has-sidebar``), nor ``header`` within an article or
as an article's. ``main`` lifts such a mark from around it. If a page would have
no text, articles that stand aside only by such a name (never comments) are read.

Defined cases: a null or empty page has the empty text; broken markup is read
as far as it goes (an unclosed comment, script or tag ends with the page);
repeated rows give repeated results; an empty table gives an empty result;
other columns are not read. Nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 60
STOP_DENSITY = 0.15
LINK_DENSITY = 0.5
#: Least share of a page's long text that fits the listed languages.
FITTING = 0.25
#: Frequent function words of the languages to expect. A parameter.
STOP_WORDS = (
    "the of and to in is it that for with be on as by this was are or from at an not have which but they his her you we "
    "le la les de des du et en un une que qui dans pour pas sur avec est au ce il plus par se ne sont "
    "der die das und ist von den zu mit ein eine nicht sich auf dem des als auch im für werden oder aus bei sie er "
    "el los las y que del se por con una para es al lo como más su sus no son o"
).split()
#: Names in class, id or role that mark what is not the article. A parameter.
ASIDE_NAMES = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment comments "
    "respond reply replies disqus cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup "
    "login search contentinfo complementary dialog alert pagination pager toc toolbar skip copyright"
).split()

#: Names that mark what readers wrote: no article either, whatever the element. A parameter of the rules, as are the next two.
COMMENT_NAMES = frozenset("comment comments respond reply replies disqus".split())
#: A name with one of these tells how a wrapper looks, not what it is.
STATES = frozenset("has with without no not is js active enabled disabled open opened closed visible free".split())
#: A header named after one of these is the article's own.
OWN_HEADERS = frozenset("article post entry story".split())

# Fixed values of HTML: elements whose content is no text, elements that break lines, and those that hold others.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "select", "textarea", "head", "title", "object", "canvas", "annotation", "annotation-xml", "option", "button"}
ASIDE_TAGS = {"nav", "footer", "aside", "form", "header", "dialog", "menu", "fieldset"}
BREAKS = {"p", "div", "article", "section", "main", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "td", "th",
          "thead", "tbody", "caption", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "hr", "figure", "figcaption", "body", "html",
          "address", "details", "summary", "fieldset", "dialog", "menu"}
HOLDERS = BREAKS - {"p", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "html", "body"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "col", "area", "base", "embed", "track", "param"}

_INSIDE = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")
_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_MARKS = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")

#: Text, characters in links, how it stands aside, whether it stands in the article.
Block = tuple[str, int, int, bool]
#: Ways to stand aside: by a name only, or by an element, hidden, or among comments.
NAMED, FIRM = 1, 2


def named_aside(attributes: str, names: frozenset[str], article: bool) -> int:
    """How the names of an element put it aside."""
    found = 0
    for m in _MARKS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _PARTS.findall(name)
            if STATES.isdisjoint(parts):
                own = article or (parts and parts[0] in OWN_HEADERS)
                hits = [p for p in parts if p in names and not (p == "header" and own)]
                found = max(found, FIRM if not COMMENT_NAMES.isdisjoint(hits) else NAMED if hits else 0)
    return found


def blocks_of(page: str, names: frozenset[str]) -> Iterator[Block]:
    """Every block that has text, in page order."""
    holders: list[tuple[str, int, bool]] = []  # element, aside, article
    pieces: list[tuple[str, bool]] = []
    link = article = False
    aside = 0

    def block() -> Iterator[Block]:
        # references may be cut by inline markup, never joined by it: each piece is decoded by itself
        decoded = [(html.unescape(t), a) for t, a in pieces]
        pieces.clear()
        text = _SPACE.sub(" ", "".join(t for t, _ in decoded)).strip()
        if text:
            yield text, sum(len(_SPACE.sub(" ", t).strip()) for t, a in decoded if a), aside, article

    at, n, lower = 0, len(page), None
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            open_ = n
        if open_ > at:
            pieces.append((page[at:open_], link))
        if open_ == n:
            break
        if page.startswith("<!--", open_):
            end = page.find("-->", open_ + 4)
            at = n if end < 0 else end + 3
            continue
        named = _NAME.match(page, open_ + 1)
        if not named:
            if page[open_ + 1 : open_ + 2] in ("!", "?", "/"):
                end = page.find(">", open_)
                at = n if end < 0 else end + 1
            else:
                pieces.append(("&lt;", link))
                at = open_ + 1
            continue
        inside = _INSIDE.match(page, named.end())
        end = inside.end() if inside else page.find(">", named.end()) + 1
        at = end or n
        tag, closing, rest = named[1].lower(), page[open_ + 1] == "/", page[named.end() : at]
        if tag == "a":
            link = not closing
        elif tag == "br":
            pieces.append((" ", link))
        if tag in SILENT and not closing and not rest.rstrip(">").endswith("/"):
            lower = page.lower() if lower is None and page.isascii() else lower
            shut = (lower.find(f"</{tag}", at) if lower is not None else _find_end(page, tag, at))
            if tag == "head" and shut < 0:
                continue
            close = page.find(">", shut) if shut >= 0 else -1
            at = n if close < 0 else close + 1
            continue
        if tag in BREAKS:
            yield from block()
            link = False
        if tag in HOLDERS:
            if closing:
                where = next((i for i in range(len(holders) - 1, -1, -1) if holders[i][0] == tag), None)
                if where is not None:
                    del holders[where:]
            elif tag not in VOID:
                marked = named_aside(rest, names, article)
                if tag in ("article", "main"):
                    marked = FIRM if marked == FIRM else 0
                if tag in ASIDE_TAGS and not (tag == "header" and article) or _HIDDEN.search(rest):
                    marked = FIRM
                around = 0 if tag == "main" and aside == NAMED else aside
                holders.append((tag, max(around, marked), article or tag in ("article", "main")))
            aside, article = (holders[-1][1], holders[-1][2]) if holders else (0, False)
    yield from block()


def _find_end(page: str, tag: str, at: int) -> int:
    found = re.compile(f"</{tag}", re.I).search(page, at)
    return found.start() if found else -1


def first_labels(found: list[Block], stop_words: frozenset[str]) -> list[int | None]:
    """1 text, 0 not, None undecided, for every block of a page."""
    labels: list[int | None] = []
    long: list[int] = []
    for i, (text, link_chars, aside, _) in enumerate(found):
        labels.append(0 if aside or link_chars > LINK_DENSITY * len(text) else None)
        if labels[i] is None and len(text) >= LONG:
            long.append(i)
    fits = []
    for i in long:
        letters = _LETTERS.findall(found[i][0].lower())
        fits.append(sum(w in stop_words for w in letters) >= STOP_DENSITY * max(len(letters), 1))
    size = sum(len(found[i][0]) for i in long)
    known = sum(len(found[i][0]) for i, fit in zip(long, fits, strict=True) if fit) >= FITTING * size
    for i, fit in zip(long, fits, strict=True):
        labels[i] = 1 if fit or not known else None
    return labels


def second_labels(found: list[Block], labels: list[int | None]) -> list[int]:
    """Undecided blocks take the label of the nearest decided block of their region; two passes over the page."""
    out = list(labels)
    cored = any(b[3] and not b[2] for b in found)
    for region in (False, True):
        own = [i for i, b in enumerate(found) if b[3] == region]
        seeded = any(labels[i] == 1 for i in own)
        back: dict[int, tuple[int, int]] = {}
        ahead: dict[int, tuple[int, int]] = {}
        for order, nearest in ((own, back), (own[::-1], ahead)):
            last = None
            for i in order:
                if labels[i] is None:
                    if last is not None:
                        nearest[i] = (abs(i - last), -labels[last])  # good before bad at the same distance
                elif not found[i][2] and (labels[i] or seeded or not region):
                    last = i
        for i in own:
            if labels[i] is None:
                near = [m[i] for m in (back, ahead) if i in m]
                out[i] = -min(near)[1] if near else int(region or not cored)
    return out


def page_text(page: str, names: frozenset[str], stop_words: frozenset[str]) -> str:
    found = list(blocks_of(page, names))
    texts = _good(found, stop_words)
    if not texts:
        found = [(text, links, 0 if article and aside == NAMED else aside, article) for text, links, aside, article in found]
        texts = _good([b for b in found if b[3]], stop_words)
    return "\n\n".join(texts)


def _good(found: list[Block], stop_words: frozenset[str]) -> list[str]:
    labels = second_labels(found, first_labels(found, stop_words))
    return [b[0] for b, good in zip(found, labels, strict=True) if good]


def main_text(pages: DataFrame, names: list[str] = ASIDE_NAMES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``; a page is read where its row lies, nothing is shuffled."""
    known, stops = frozenset(names), frozenset(stop_words)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(page.as_py() or "", known, stops) for page in batch["html"]]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("long").alias("page_id"), *[F.col(c).cast("string").alias(c) for c in ("url", "html")]]
    return pages.select(*columns).mapInArrow(read, "page_id long, url string, text string, n_chars long")
