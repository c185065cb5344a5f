"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' features."""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, slices
from .tree import decide, grow

#: A tag ends at the next < at the latest, so a page of open tags is read once, not once a tag.
MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|[^<>]*>)""", re.S)
#: Elements whose content isn't text of the page, and elements that begin and end blocks.
SKIPPED = frozenset("script style noscript template iframe svg canvas textarea title select button audio video map datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Start tags that end a skipped element left open: of any kind (but templates), and of controls and drawings.
ENDS_ANY = frozenset("body main article".split())
ENDS_SOME = ENDS_ANY | frozenset("h1 h2 h3 h4 h5 h6 p section table ul ol".split())
CONTROLS = frozenset("select button datalist svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre".split())
ITEMS = frozenset("li dd dt td th tr".split())
#: Elements, and words of class, id and role, that hint at parts of a page other than its text. They are features of the tree, no verdicts.
FRAME_TAGS = frozenset("nav aside footer form dialog menu search".split())
FRAME_WORDS = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|sidebar\w*|side|widgets?|header|footer\w*|masthead|cookies?\w*|notices?|consent|gdpr|popup|modal|overlay|newsletter|subscribe\w*|signup|social|share|sharing|related|recommend\w*|toolbar|pagination|pager|copyright|legal|disclaimer|complementary|contentinfo|alert|dialog|login|search|skip|topbar|paywall|outbrain|taboola)(?=$|[\s_-])"
)
COMMENT_WORDS = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|commentlist|disqus\w*|discussion|respond|replies|reply|responses)(?=$|[\s_-])")
HINTS = re.compile(r"""(?i)\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?=[\s=>/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")
FRAME, HINT, COMMENT = 0, 1, 2
#: Elements that begin an article, the surest first; one that no mark is on or around goes first.
STARTS = ("main", "article", "h1")
#: Of a block: words and share of linked words, the same of the blocks before and after, the kind of its element (0 other, 1 prose,
#: 2 item, 3 heading), whether it stands in article or main, and for each kind of hint the part of the page that hint is about.
FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "element", "in article", "framed part", "hinted part", "commented part")
#: The value of the last three features outside such parts.
NOWHERE = 3.0


@dataclass
class Mark:
    """An open element that hints at something: what, the mark around it, whether one of them hints at comments, words and place where it began and ended."""

    kinds: tuple[int, ...]
    outer: int
    commented: bool
    words: int
    at: int
    end_words: int = -1
    end: int = -1


@dataclass
class Page:
    """texts; of each block words, linked words, element kind, in article, innermost mark; the marks; words; where the article begins (-1: nowhere), whether by an element of its own."""

    texts: list[str]
    blocks: list[tuple[int, int, int, bool, int]]
    marks: list[Mark]
    words: int
    start: int
    certain: bool


def _kinds(tag: str, attributes: str, in_article: bool) -> tuple[int, ...]:
    found = []
    if tag in FRAME_TAGS or tag == "header" and not in_article or HIDDEN.search(attributes):
        found.append(FRAME)
    if "=" in attributes:
        hints = " ".join([a or b or c for a, b, c in HINTS.findall(attributes)])
        if hints and FRAME_WORDS.search(hints):
            found.append(HINT)
        if hints and COMMENT_WORDS.search(hints):
            found.append(COMMENT)
    return tuple(found)


def parse(page: str) -> Page:
    """A page's text blocks in order (references decoded, white space joined) and what is known about each.

    A skipped element ends at its end tag, or where it can't be open any more: at the end tag of a block around it, or at
    elements that can't stand in it; without an end tag in the rest of the page it isn't skipped. Work is linear in the page.
    """
    out = Page([], [], [], 0, -1, False)
    stack: list[tuple[str, bool, int]] = []  # open block elements, whether in article or main, innermost mark
    open_: Counter[str] = Counter()
    parts: list[str] = []
    starts: dict[tuple[str, int], int] = {}  # of STARTS the first outside marked parts (0), inside (1), and inside comments (2)
    linked = link = skip = at = 0
    low = None
    skipped = ""
    inside: Counter[str] = Counter()  # blocks opened in the skipped element
    last: dict[str, int] = {}  # where the last end tag of a kind stands

    def closes(tag: str) -> bool:
        if tag not in last:
            last[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        return last[tag] >= at

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                n, (tag, main, mark) = text.count(" ") + 1, stack[-1] if stack else ("", False, -1)
                out.texts.append(text)
                out.blocks.append((n, min(n, linked), 3 if tag in HEADINGS else 1 if tag in PROSE else 2 if tag in ITEMS else 0, main, mark))
                out.words += n
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if link:
            linked += len(text.split())

    def close(i: int) -> None:
        """Closes the open elements from the i-th on."""
        for k in range(len(stack) - 1, i - 1, -1):
            tag, _, mark = stack[k]
            open_[tag] -= 1
            if mark >= 0 and (k == 0 or stack[k - 1][2] != mark):
                out.marks[mark].end_words, out.marks[mark].end = out.words, at
        del stack[i:]

    for m in MARK.finditer(page):
        if m.start() < at:
            continue
        if not skip and m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in SKIPPED:
                if skip and tag == skipped:
                    skip -= 1
                continue
            if skip:
                if tag not in BLOCKS:
                    continue
                if inside[tag] > 0:
                    inside[tag] -= 1
                    continue
                if skipped == "template" or not open_[tag]:
                    continue
                skip = 0
            if tag == "a":
                link = 0
            elif tag == "p" and (not stack or stack[-1][0] != "p"):
                flush()
            elif tag in BLOCKS:
                flush()
                if open_[tag]:
                    i = len(stack) - 1
                    while stack[i][0] != tag:
                        i -= 1
                    close(i)
                    link = 0
            continue
        if skip and skipped != "template" and tag in (ENDS_SOME if skipped in CONTROLS and not inside["foreignobject"] else ENDS_ANY):
            skip = 0
        if skip:
            if tag in RAW and not (skipped == "svg" and tag in ("title", "iframe", "textarea", "noscript")):
                end = _find(page, tag, at)
                at = len(page) if end < 0 else end
            elif tag == skipped and tag not in ("button", "select") and not m[3].endswith("/>"):
                skip += 1
            elif tag in BLOCKS and tag not in VOID or tag == "foreignobject":
                inside[tag] += 1
            continue
        if tag in SKIPPED:
            if m[3].endswith("/>") and tag not in RAW:
                continue
            if tag in RAW:  # ends at its end tag, whatever stands in it
                low = low or page.lower()
                end = low.find(f"</{tag}", at) if len(low) == len(page) else _find(page, tag, at)
                at = len(page) if end < 0 else end
                if end >= 0:
                    after = page.find(">", end)
                    at = len(page) if after < 0 else after + 1
            elif closes(tag):
                skip, skipped = 1, tag
                inside.clear()
            continue
        if tag == "a":
            link = 1
        elif tag == "br":
            say(" ")
        elif tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)  # block elements end an open paragraph
            if tag in ITEMS and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            _, main, mark = stack[-1] if stack else ("", False, -1)
            kinds = _kinds(tag, m[3], main)
            if tag in STARTS and not main:
                around = out.marks[mark] if mark >= 0 else None
                where = 2 if COMMENT in kinds or around and around.commented else 1 if around or HINT in kinds else 0
                starts.setdefault((tag, where), at)
            if kinds:
                out.marks.append(Mark(kinds, mark, COMMENT in kinds or mark >= 0 and out.marks[mark].commented, out.words, m.start()))
                mark = len(out.marks) - 1
            stack.append((tag, main or tag in ("article", "main"), mark))
            open_[tag] += 1
    if not skip and at < len(page):
        say(page[at:])
    flush()
    at = len(page)
    close(0)
    first = min(starts, key=lambda k: (k[1], STARTS.index(k[0])), default=None)
    if first:
        out.start, out.certain = starts[first], first[0] != "h1"
    return out


def _find(page: str, tag: str, at: int) -> int:
    m = re.compile(f"</{tag}", re.I).search(page, at)
    return m.start() if m else -1


def features(page: Page) -> list[tuple[float, ...]]:
    """A row of FEATURES a block; outside the page: no words, no links.

    A part's value is its share of the page's words; 1 more if the article begins in it (a wrapper of the page); -1 if an
    article or main element begins elsewhere (a part beside the text). Of nested parts the smallest value counts.
    """
    parts: list[tuple[float, float, float]] = []
    for m in page.marks:  # outer marks come first
        share, around = (m.end_words - m.words) / max(1, page.words), m.at < page.start <= m.end
        value = 1 + share if around else -1.0 if page.certain else share
        outer = parts[m.outer] if m.outer >= 0 else (NOWHERE,) * 3
        parts.append(tuple(min(outer[k], value) if k in m.kinds else outer[k] for k in range(3)))
    own = [(n, k / n) for n, k, *_ in page.blocks]
    edge = [(0, 0.0), *own, (0, 0.0)]
    return [(*own[i], *edge[i], *edge[i + 2], kind, float(main), *(parts[mark] if mark >= 0 else (NOWHERE,) * 3)) for i, (_, _, kind, main, mark) in enumerate(page.blocks)]


def labelled_pages(n: int = 240, seed: int = 11) -> list[str]:
    """The labelled table: made pages of many layouts, whose main text has words that begin with m and all else with b.

    Parts beside the text are marked by element, by class or id, or (navigation, short lines) by nothing; pages, articles and wrappers
    of the whole page may carry the same words in their classes. Words themselves are no features.
    """
    r = random.Random(seed)
    pick, chance = r.choice, lambda p: r.random() < p
    words = lambda kind, a, b: " ".join(kind + "x" * r.randint(1, 8) for _ in range(r.randint(a, b)))
    linked = lambda kind, a, b: f'<a href="#">{words(kind, a, b)}</a>'

    def part(tag: str, names: str, inner: str, bare: float = 0.0) -> str:
        how, name = r.random(), pick(names.split())
        if how < bare:
            return f"<div>{inner}</div>"
        if tag and how < 0.55:
            return f"<{tag}>{inner}</{tag}>"
        outer = pick(["div", "section", "ul" if inner.startswith("<li") else "div"])
        return f'<{outer} {pick(["class", "id"])}="{name}{pick(["", " wide", "-box", " col2"])}">{inner}</{outer}>'

    def links() -> str:
        some = [linked("b", 1, pick([1, 2, 3, 6])) for _ in range(r.randint(3, 10))]
        return "".join(f"<li>{x}</li>" for x in some) if chance(0.6) else pick([" ", " | ", ""]).join(some)

    def comments() -> str:
        each = pick(["<p>{}</p>", '<div class="comment">{}</div>', '<article class="comment"><p>{}</p></article>', "<li>{}</li>", "<article><p>{}</p></article>"])
        inner = f"<h3>{words('b', 1, 3)}</h3>" * chance(0.6) + "".join(each.format(words("b", 1, pick([5, 20, 70]))) for _ in range(r.randint(1, 14)))
        return f'<{pick(["section", "div"])} {pick(["class", "id"])}="{pick(["comments", "comment-list", "disqus_thread", "discussion", "replies", "reader-comments", "responses"])}">{inner}</div></section>'

    def before() -> list[str]:
        return [x for p, x in (
            (0.5, lambda: part("header", "site-header masthead header topbar", linked("b", 1, 3) + " " + words("b", 1, 6))), (0.8, lambda: part("nav", "nav menu navbar navigation main-menu", links(), 0.25)),
            (0.5, lambda: part("", "ad ads advert banner sponsor promo", words("b", 3, 30))), (0.3, lambda: part("", "cookie-notice notice consent gdpr alert", f"<p>{words('b', 8, 45)} {linked('b', 1, 2)}</p>")),
            (0.2, lambda: part("aside", "sidebar widget side", f"<h3>{words('b', 1, 3)}</h3><p>{words('b', 8, 45)}</p>")), (0.2, lambda: part("form", "search login", words("b", 1, 4))), (0.15, lambda: f"<div>{linked('b', 1, 3)} &gt; {linked('b', 1, 3)}</div>"),
        ) for x in [x()] if chance(p)]

    def after() -> list[str]:
        return [x for p, x in (
            (0.3, lambda: part("aside", "sidebar related recommended", "".join(f"<li>{linked('b', 3, 9)}</li>" for _ in range(r.randint(2, 7))), 0.2)), (0.25, lambda: part("form", "newsletter subscribe signup", f"<p>{words('b', 5, 25)}</p>")),
            (0.35, comments), (0.2, lambda: part("aside", "sidebar widget", f"<h3>{words('b', 1, 3)}</h3><p>{words('b', 10, 60)}</p>")), (0.25, lambda: part("", "ad promo sponsored outbrain", words("b", 3, 30))),
            (0.2, lambda: f"<div>{words('b', 1, 3)}</div>" * r.randint(1, 3)), (0.8, lambda: part("footer", "footer copyright site-footer legal", pick(["", "&copy; "]) + words("b", 1, 30) + " " + " ".join(linked("b", 1, 3) for _ in range(r.randint(0, 5))))),
        ) for x in [x()] if chance(p)]

    def text(plain: bool) -> str:
        out = [f"<h1>{words('m', 1, 14)}</h1>"] if chance(0.85) else []
        if out and chance(0.2) and not plain:
            out = [f"<header>{out[0]}<p>{words('m', 2, 8)}</p></header>"]
        for _ in range(r.randint(1, 14)):
            long = words("m", *pick([(1, 3), (3, 12), (10, 40), (10, 40), (40, 150), (40, 150)]))
            out.append(r.choices([
                lambda: f"<p>{long}</p>", lambda: f"<p>{long} {linked('m', 1, 3)} {words('m', 1, 9)}</p>", lambda: f"<h2>{words('m', 1, 9)}</h2><p>{long}</p>", lambda: f"<ul>{''.join(f'<li>{words('m', 1, 20)}</li>' for _ in range(r.randint(2, 5)))}</ul>",
                lambda: f"<blockquote>{long}</blockquote>", lambda: f"<div>{long}</div>", lambda: f"<p><b>{words('m', 1, 20)}<br><p>{long}</p>", lambda: f"<p>{linked('m', 2, 9)}</p>" if not plain else "", lambda: f"<table><tr><td>{words('m', 1, 4)}</td><td>{words('m', 1, 4)}</td></tr></table>",
                lambda: part("aside", "ad related sidebar promo share", f"<p>{words('b', 3, 40)}</p>"),
            ], [40, 8, 8, 4, 3, 6 if not plain else 3, 4, 1, 2, 4])[0]())
        return "".join(out)

    pages = []
    for _ in range(n):
        how = r.random()
        plain = how > 0.75
        main = text(plain)
        if how < 0.35:
            main = f"<article{pick(['', '', ' class=post', ' class="post comments-closed"', ' class="legal-news entry"'])}>{main}</article>"
        elif how < 0.5:
            main = f"<main{pick(['', ' id=content', ' class=with-sidebar'])}>{main}</main>"
        elif how < 0.75:
            main = f'<div class="{pick(["content", "post-content", "entry", "story", "article-body"])}">{main}</div>'
        elif chance(0.5):
            main = f"<div>{main}</div>"
        first, end = before(), after()
        if chance(0.35):
            outer = pick(["div class='page with-sidebar'", "div id=legal-news", "form id=aspnet", "div class=responses-to-war", "div class=discussion", "div class=site-header-fixed", "div class=cookie-free"])
            body = f"<{outer}>{main}</{outer.split()[0]}>" if chance(0.5) else f"<{outer}>{''.join(first)}{main}{''.join(end)}</{outer.split()[0]}>"
            first, end = ([], []) if "b" in body.split(main)[0].replace("sidebar", "") and body.startswith(f"<{outer}><") and not body.startswith(f"<{outer}>{main}") else (first, end)
        else:
            body = main
        if not body.startswith("<div class='page") and not first and not end:
            end = after()
        pages.append(f"<body{pick(['', '', ' class="single comments-open"', ' class="has-sidebar nav-fixed"'])}>{''.join(first)}{body}{''.join(end)}</body>")
    return pages


def labelled_table(n: int = 240, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the blocks of labelled_pages."""
    rows, labels = [], []
    for html in labelled_pages(n, seed):
        page = parse(html)
        for text, row in zip(page.texts, features(page), strict=True):
            rows.append(row)
            labels.append(text.lstrip("©>| ")[:1] == "m")
    return np.array(rows, float), np.array(labels, float)


@functools.lru_cache(maxsize=1)
def block_tree():
    return grow(*labelled_table(), depth=10, least=5)


def main_text(page: str | None) -> str:
    """The blocks that the tree keeps, in page order, with an empty line between."""
    if not page:
        return ""
    found, tree = parse(page), block_tree()
    return "\n\n".join([t for t, row in zip(found.texts, features(found), strict=True) if decide(tree, row)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page from its whole html: the id, url, text (empty if none), n_chars (code points).

    Null and empty html give an empty text; null or repeated ids and urls and repeated rows keep one row each; other
    columns don't matter; an empty table gives no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n"])

    source = only(pages, id_col, url_col, html_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, `{url_col}` {source.schema[1].dataType.simpleString()}, text string, n_chars long")
