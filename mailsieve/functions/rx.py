"""Regular expressions with the meaning of Python's re, as Spark columns (Java's engine)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as str.split() and \s have it, for use inside and outside a character class.
WS_SET = r"\s\x1c-\x1f\x85\p{Z}"
WS = f"[{WS_SET}]"
#: The same characters one by one.
WS_SIGNS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same table. Filters on what follows from the column aren't pushed below it, where Spark would write its whole expression into the filter, once for each use."""
    return df.withColumn(name, F.when(F.rand(0) < 2, F.col(name)))


def java(pattern: str, flags: str = "") -> str:
    """The Java form of a Python pattern: Unicode classes, Python's white space, \\n as the only line end, \\Z and $ at the end.

    flags: any of i, m, s.
    """
    out, inside, i = [], False, 0
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\":
            out.append({r"\s": WS_SET if inside else WS, r"\S": f"[^{WS_SET}]", r"\Z": r"\z"}.get(two, two))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "$" and not inside and "m" not in flags:
            out.append(r"(?=\n?\z)")
            i += 1
            continue
        out.append(c)
        i += 1
    return f"(?dUu{flags})" + "".join(out)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_SIGNS))  # looks at the ends only, where a pattern goes through the whole text


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS_SET}]")


def remove(text: Column, patterns: Iterable[str], flags: str = "is") -> Column:
    """Takes out every match of each pattern, one after the other."""
    return reduce(lambda t, p: F.regexp_replace(t, java(p, flags), ""), patterns, text)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def collapse(text: Column) -> Column:
    """At most one empty line in a row."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t))


def occurrences(text: Column, literal: str) -> Column:
    """How often an ASCII string occurs, as `regexp_count` has it, without an array of what was found."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


#: What keeps words from being counted by single spaces and ends of lines: other white space, a longer run of spaces, three ends of lines.
UNEVEN = rf"{WS}(?:(?<=[^ \n])|(?<= )[ \n]|(?<=\n)(?: |\n\n))"


def words(text: Column) -> Column:
    """Runs of what is no white space, in a text that neither begins nor ends with any and isn't empty. Runs are counted as matches only where a text has uneven gaps."""
    gaps = occurrences(text, " ") + occurrences(text, "\n") - occurrences(text, "\n\n")
    return F.when(text.rlike(UNEVEN), F.regexp_count(text, F.lit(f"[^{WS_SET}]+"))).otherwise(gaps + 1)


def before(text: Column, pattern: str) -> Column:
    """The text before the first match of a Java pattern (only where there is one); counts nothing, so no code-unit offsets."""
    return F.regexp_replace(text, f"(?:{pattern})(?s:.*)\\z", "")


def up_to_last(text: Column, needle: str, body: Callable[[Column], Column]) -> Column:
    """body of the part that ends with the last `needle` (lower case, any case matches), then the rest as it is.

    For patterns that end in the needle: a text without it isn't searched, which keeps lazy gaps from going quadratic.
    """
    whole = rf"(?is)\A(.*{needle})(.*)\z"
    return let(text, lambda t: F.when(F.contains(F.lower(t), F.lit(needle)), F.concat(body(F.regexp_extract(t, whole, 1)), F.regexp_extract(t, whole, 2))).otherwise(t))


def has_any(text: Column, literals: Iterable[str | tuple[str, ...]]) -> Column:
    """Whether the text, in lower case, holds one of the literals (of a tuple: all of it). Cheap, to keep patterns off texts that can't match.

    Literals are lower-case and without i, k and s, which other letters fold to when case is ignored.
    """
    return let(F.lower(text), lambda t: reduce(or_, [reduce(and_, [F.contains(t, F.lit(x)) for x in ((g,) if isinstance(g, str) else g)]) for g in literals]))


@dataclass(frozen=True)
class Spans:
    """`start.*?anchor.*?anchor ... .*?tail`, gaps over lines, as something to remove in linear time.

    Where an anchor is missing behind many starts, lazy gaps are searched again from each start. Here the last anchors are found
    first, one after the other from the end: before the last place where all follow, every start has a match, and behind it none
    has, so nothing is searched in vain. Each gap is atomic, as its first anchor leaves most for the next ones. A match that goes on
    behind that place is the last one and is finished by itself.

    start, anchors: Python patterns. tail: behind a last gap, a pattern that ends the match like the text's end does; "" for none.
    spaced: gaps begin with white space that is taken first and left only if the anchor is in it.
    """

    start: str
    anchors: tuple[str, ...]
    tail: str = ""
    spaced: bool = False

    def steps(self) -> list[Callable[[Column], Column]]:
        """From arrays whose second item is the text to such arrays. Steps follow each other instead of standing in each other's lambdas."""
        flags = "(?dUuis)"
        plain = lambda p: java(p).removeprefix("(?dUu)")
        first = lambda a: f"(?>{WS}*+.*?{a})" if self.spaced else f"(?>.*?{a})"
        gap = lambda a: f"(?:{first(a)}|(?>{WS}*?{a}))" if self.spaced else first(a)
        start, marks, tail = plain(self.start), [plain(a) for a in self.anchors], plain(self.tail) if self.tail else ""
        # before the last place, all follow whichever first anchor is taken, and from the second on one behind the white space
        inside = start + f"(?>{gap(marks[0])})" + "".join(map(first, marks[1:])) + (first(tail) if tail else "")
        whole = start + "".join(map(gap, marks)) + (rf"(?>.*?(?:{tail}|\z))" if tail else "")

        def bound(s: Column) -> Column:
            t = s[1]
            for a in reversed(marks[1:]):
                t = F.regexp_extract(t, rf"{flags}\A(.*){a}", 1)
            return F.array(s[0], s[1], F.regexp_extract(t, rf"{flags}\A(.*{marks[0]})", 1))

        def cut(s: Column) -> Column:
            rest = F.substring(s[1], F.length(s[2]) + 1, F.length(s[1]))
            if len(marks) == 1 and not tail:
                return F.array(s[0], F.concat(F.regexp_replace(s[2], flags + inside, ""), rest))
            done, begun = F.regexp_replace(s[2], rf"{flags}{inside}|{start}.*\z", ""), F.regexp_replace(s[2], rf"{flags}{inside}|({start}.*\z)", "$1")
            return F.array(s[0], rest, done, begun)

        def finish(s: Column) -> Column:
            last = F.concat(F.substring(s[3], F.length(s[2]) + 1, F.length(s[3])), s[1])
            return F.array(s[0], F.concat(s[2], F.when(F.length(s[3]) > F.length(s[2]), F.regexp_replace(last, rf"{flags}\A{whole}", "")).otherwise(s[1])))

        return [bound, cut] if len(marks) == 1 and not tail else [bound, cut, finish]


def remove_all(text: Column, words: Iterable[str | tuple[str, ...]], patterns: Iterable[str | Spans]) -> Column:
    """Takes out every match of each pattern (cases ignored, `.` over lines), one after the other, of texts that hold one of the words as `has_any` has them; other texts stay as they are."""
    state = let(text, lambda t: F.array(t, F.when(has_any(t, words), t)))

    def plain(pattern: str) -> Callable[[Column], Column]:
        return lambda s: F.array(s[0], F.regexp_replace(s[1], java(pattern, "is"), ""))

    for p in patterns:
        for step in p.steps() if isinstance(p, Spans) else [plain(p)]:
            state = let(state, step)
    return let(state, lambda s: F.coalesce(s[1], s[0]))
