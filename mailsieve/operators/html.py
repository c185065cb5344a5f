"""HTML bodies: what is quoted is taken out of the tree, the rest becomes text."""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rx import Spans, java, remove_all, strip

#: What tells HTML, forwarded blocks in raw HTML, removed elements, classes of quoted content.
SNIFF = r"<html|<body|<div|<p\s|<br"
FORWARDED = (
    r"From:\s*.*?\nSent:\s*.*?\nTo:\s*.*?\nSubject:\s*.*?\n",
    r"________________________________________\nFrom:.*?\nSent:.*?\nTo:.*?\nSubject:.*?\n",
    r"-{3,}Original Message-{3,}",
    r"Begin forwarded message:",
)
REMOVED = ("script", "style", "noscript", "iframe", "canvas", "svg")
QUOTE_CLASSES = re.compile(r"reply|forward|quote|original", re.I)
GMAIL = {"gmail_quote": ("div", "blockquote"), "gmail_attr": None, "gmail_extra": None}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


def is_html(text: Column) -> Column:
    return F.contains(text, F.lit("<")) & text.rlike(java(SNIFF, "i"))


HEADERS = (r"\nSent:", r"\nTo:", r"\nSubject:", r"\n")
BLOCKS = (Spans("From:", HEADERS, spaced=True), Spans("_" * 40 + r"\nFrom:", HEADERS), r"(?<!-)-{3,}+Original Message-{3,}", FORWARDED[3])


def without_forwarded(html: Column) -> Column:
    return remove_all(html, ("from:", "nal me", "forwarded me"), BLOCKS)


class _Texts(HTMLParser):
    """Text nodes outside removed subtrees. A removed node leaves its neighbours touching; a tag separates them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.nodes: list[str] = [""]
        self.kept: list[str] = []

    def _gone(self, tag: str, attrs) -> bool:
        if tag in REMOVED:
            return True
        names = dict(attrs).get("class") or ""
        if QUOTE_CLASSES.search(names):
            return True
        return any(n in GMAIL and (GMAIL[n] is None or tag in GMAIL[n]) for n in names.split())

    def _hidden(self) -> bool:
        return any(gone for _, gone in self.open)

    def _break(self) -> None:
        if not self._hidden():
            self.nodes.append("")

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and any(t == "p" for t, _ in self.open):
            self.handle_endtag("p")
        while self.open and self.open[-1][0] in CLOSES.get(tag, ()):
            self.handle_endtag(self.open[-1][0])
        gone = self._gone(tag, attrs)
        if tag in VOID:
            if tag != "hr" and not gone:
                self._break()
            return
        if not gone:
            self._break()
        self.open.append((tag, gone))
        if gone or self._hidden():
            return
        self.kept.append(self.get_starttag_text() or "")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        hidden = self._hidden()
        del self.open[at:]
        if not hidden:
            self.nodes.append("")
            self.kept.append(f"</{tag}>")

    def handle_data(self, data):
        if not self._hidden():
            self.nodes[-1] += data
            self.kept.append(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


def parse(html: str) -> tuple[str, str]:
    """Text and cleaned HTML: every text node stripped, empty ones dropped, one space between."""
    tree = _Texts()
    tree.feed(html)
    tree.close()
    return " ".join(x for x in (n.strip() for n in tree.nodes) if x), "".join(tree.kept)


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "html", "error")]))
def tree_text(html: pd.Series) -> pd.DataFrame:
    rows = []
    for x in html:
        try:
            rows.append((*parse(x), None) if x is not None else (None, None, None))
        except Exception as e:  # the row says what is wrong with it
            rows.append((None, None, f"Failed to clean HTML: {e}"))
    return pd.DataFrame(rows, columns=["text", "html", "error"], dtype=object)


#: An ampersand that begins no reference with its semicolon.
OPEN_REFERENCE = r"&(?!#?\w+;)"


def closed_references(html: Column) -> Column:
    """HTML in which only references with their semicolon are references; HTML itself also reads some without (`&amp` before a tag)."""
    return F.regexp_replace(html, OPEN_REFERENCE, "&amp;")


def with_tree(df: DataFrame, name: str, source: Column) -> DataFrame:
    """Adds the struct of tree_text; null for null sources.

    The source stays a column of its own, as it is used twice: Spark doesn't find a UDF whose argument has patterns inside nested lambdas.
    """
    return df.withColumn("__s", source).withColumn(name, F.when(F.col("__s").isNotNull(), tree_text("__s"))).drop("__s")


def _replaced(ref: str, c: str, node: Column) -> Column:
    return F.replace(node, F.lit(ref), F.lit(c))


def native_text(html: Column) -> Column:
    """The same text by pattern, for HTML without quote classes, whose references are among the five basic ones: stays in the JVM."""
    gone = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<(script|style|noscript|iframe|canvas|svg)\b[^>]*>.*?</\1\s*>", "")
    nodes = F.split(F.regexp_replace(gone, r"(?is)<hr\b[^>]*>", ""), r"<[^>]*>", -1)
    for ref, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        nodes = F.transform(nodes, functools.partial(_replaced, ref, c))
    return F.array_join(F.filter(F.transform(nodes, strip), lambda n: n != ""), " ")
