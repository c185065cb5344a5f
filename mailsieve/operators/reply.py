"""Quoted replies: visible fragments, quoted lines, attribution and header patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rx import WS, WS_SET, Spans, collapse, java, let, lines, remove_all, strip

#: Patterns of replies and forwards, in the order they apply.
PATTERNS = (
    r"On\s+.*?\d{1,2},?\s+\d{4}.*?(?:at\s+.*?)?wrote:",
    r"From:\s*[^\n]+\n\s*Sent:\s*[^\n]+\n\s*To:\s*[^\n]+\n\s*Subject:\s*[^\n]+",
    r">?\s*On\s+.*?wrote:",
    r"-{3,}\s*Original Message\s*-{3,}",
    r"_{3,}\nFrom:.*?\nDate:.*?\nTo:.*?\nSubject:.*?\n",
    r"\n\s*>\s+",
    r"Begin forwarded message:",
    r"Forwarded by.*?on.*?\n",
    r"\n-{5,}\n",
    r"\n_{5,}\n",
)
#: Lines that begin a signature, header lines, rules that get an empty line before them.
SIGNED = r"\A(?:--|__|-\w)|\ASent from my \w\s*\w\s*\w"
HEADER = r"\A\*?(?:From|Sent|To|Subject):\*? ."
RULE = r"([^\n])(?=\n ?[_-]{7})"
#: A text without these and without "wrote:" is one fragment.
SPACES = r"[\t\x0b-\r\x1c-\x1f\x85\p{Z}]*"
PARTS = rf"(?:\A|\n){SPACES}(?:>|\*?(?:From|Sent|To|Subject):|--|__|-\w|Sent from my|[_-]{{7}})"


def _joined(text: Column) -> Column:
    """The last attribution that is spread over lines, on one line: from the last "On" before the last "wrote:" to the next "wrote:"."""
    begun = F.regexp_extract(F.regexp_extract(text, r"(?s)\A(.*)wrote:", 1), rf"(?s)\A.*(On{WS}.+)\z", 1)
    head = let(begun, lambda x: F.concat(F.left(x, F.lit(4)), F.substring_index(F.concat(F.substring(x, F.lit(5), F.length(x)), F.lit("wrote:")), "wrote:", 1), F.lit("wrote:")))
    return F.when(begun != "", let(head, lambda x: F.replace(text, x, F.replace(x, F.lit("\n"), F.lit(""))))).otherwise(text)


def _kind(line: Column) -> Column:
    """Q quoted, W attribution, H other header, B blank, S beginning of a signature, N any other line."""
    wrote = line.startswith("On") & line.endswith("wrote:") & (F.length(line) > 7)
    kinds = F.when(line.startswith(">"), "Q").when(wrote, "W").when(line.rlike(java(HEADER)), "H").when(~line.rlike(f"[^{WS_SET}]"), "B")
    return kinds.when(strip(line).rlike(java(SIGNED)), "S").otherwise("N")


def visible_fragments(text: Column) -> Column:
    """The fragments of a message that aren't hidden, with an empty line between; null stays null.

    Lines join into fragments from the last to the first: quoted lines with attributions and blank lines above them, headers, and all
    others, which a signature's first line below a blank line ends. A header hides all below it; above what is visible nothing is
    hidden any more. The lines, last first, are one letter each; fragments are runs of letters, so all is found by a few passes over these.
    """
    def shown(rows: Column) -> Column:
        letters = F.array_join(F.transform(rows, _kind), "")
        cut = F.regexp_replace(F.regexp_replace(letters, "SB", "X|B"), "Q[QWB]*|[WH]+", "|$0|")  # X: the last line of a signature
        above = F.regexp_replace(cut, r"\A.*\|[WH]+\|", "")
        kept = F.regexp_extract(above, r"(?:\A|\|)(B*+[NS][BNS]*+(?:\|.*)?)\z", 1)  # from the first that isn't quoted, signed or blank
        return let(kept, lambda k: let(F.length(F.replace(k, F.lit("|"), F.lit(""))), lambda n: F.when(n > 0, together(rows, k, n)).otherwise("")))

    def together(rows: Column, kept: Column, n: Column) -> Column:
        def line(marks: Column) -> Column:
            first = lambda i: F.coalesce(F.get(marks, i + 1).startswith("|"), F.lit(True))  # noqa: E731  above it, another fragment ends
            return F.transform(F.slice(rows, F.size(rows) - n + 1, n), lambda x, i: F.concat(F.when(first(i), "\n|").otherwise("\n+"), x))

        marks = F.slice(F.split(kept, "(?<=[A-Z])", -1), F.lit(1), n)
        parts = F.split(F.array_join(F.reverse(let(marks, line)), ""), r"\n\|", -1)
        return F.array_join(F.filter(F.transform(parts, lambda x: strip(F.replace(x, F.lit("\n+"), F.lit("\n")))), lambda x: x != ""), "\n\n")

    def parsed(t: Column) -> Column:
        ruled = F.regexp_replace(F.when(F.contains(t, F.lit("wrote:")), _joined(t)).otherwise(t), RULE, "$1\n")
        return F.when(F.contains(t, F.lit("wrote:")) | t.rlike(java(PARTS)), let(F.reverse(lines(ruled)), shown)).otherwise(strip(t))

    return let(F.replace(text, F.lit("\r\n"), F.lit("\n")), parsed)


def rescue(found: Column, text: Column) -> Column:
    """Where no fragment is visible: the first line, if it is short and no attribution."""
    first = strip(F.split_part(strip(text), F.lit("\n"), F.lit(1)))
    short = let(first, lambda x: F.when((F.length(x) <= 20) & ~F.contains(x, F.lit("On ")), x).otherwise(""))
    return F.when(found == "", short).otherwise(found)


def without_quoted_lines(text: Column) -> Column:
    """Without lines that begin with > and the blank lines right after them. Each line gets a letter in front, so that two patterns do it."""
    def kind(line: Column) -> Column:
        return F.concat(F.when(line.rlike(rf"\A{WS}*>"), "q").when(line.rlike(f"[^{WS_SET}]"), "n").otherwise("b"), line, F.lit("\n"))

    def without(t: Column) -> Column:
        rest = F.regexp_replace(F.array_join(F.transform(lines(t), kind), ""), rf"(?dm)^q[^\n]*+\n[b{WS_SET}]*+", "")
        return let(F.regexp_replace(rest, r"(?dm)^[bn]", ""), lambda x: F.left(x, F.length(x) - 1))

    return let(text, lambda t: F.when(F.contains(t, F.lit(">")), without(t)).otherwise(t))


#: The patterns whose gaps may have no end, and one that begins with a run of any length.
SPANS = {
    PATTERNS[0]: Spans(r"On\s+", (r"\d{1,2},?\s+\d{4}", "wrote:")),
    PATTERNS[2]: Spans(r">?\s*On\s+", ("wrote:",)),
    PATTERNS[4]: Spans(r"(?<!_)_{3,}+\nFrom:", (r"\nDate:", r"\nTo:", r"\nSubject:", r"\n")),
    PATTERNS[7]: Spans("Forwarded by", ("on", r"\n")),
    PATTERNS[3]: r"(?<!-)-{3,}+\s*Original Message\s*-{3,}",
}
#: What a text must hold for a pattern to match, by pattern.
WORDS = ("wrote:", "from:", "nal me", ">", "forwarded me", "forwarded by", "-----", "_____")


def without_reply_headers(text: Column) -> Column:
    return strip(collapse(remove_all(text, WORDS, [SPANS.get(p, p) for p in PATTERNS])))


def remove_replies(text: Column) -> tuple[Column, Column]:
    """The text without replies and whether it changed."""
    out = without_reply_headers(without_quoted_lines(rescue(visible_fragments(text), text)))
    return out, out != text
