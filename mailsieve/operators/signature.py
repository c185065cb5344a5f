"""Signatures: a block found from the end, or separators, closings, device lines and contact patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rx import WS_SET, before, collapse, java, let, lines, strip

#: What begins a signature, in the order of the search; lines that name a device or program.
PATTERNS = (
    r"^\s*--\s*\n.*?(?:\n|$)",
    r"^\s*—\s*\n.*?(?:\n|$)",
    r"^\s*__\s*\n.*?(?:\n|$)",
    r"(?:^|\n)\s*(?:Best|Regards|Cheers|Thanks|Thank you|Sincerely|Yours truly),?\s*\n+\s*\S+",
    r"(?:^|\n)\s*(?:Warm regards|Kind regards|Best wishes),?\s*\n+\s*\S+",
    r"(?:^|\n)\s*(?:Tel|Phone|Mobile|Cell):\s*[\d\s\-+()]+\s*\n",
    r"(?:^|\n)\s*(?:Email|E-mail):\s*\S+@\S+\s*\n",
    r"(?:^|\n)\s*(?:LinkedIn|Twitter|Skype):\s*\S+\s*\n",
    r"(?:^|\n)\s*www\.\S+\s*\n",
    r"(?:^|\n)\s*(?:Ltd\.|LLC|Inc\.|Corp\.|GmbH)\s*\n",
)
DEVICE = r"\A\s*(?:Sent from my \w+|Sent from Mail for Windows|Sent from Outlook|Sent from Thunderbird|Get Outlook for \w+|Download the Outlook app)"
CLOSING = r"\A(?:Best|Regards|Cheers|Thanks|Thank you|Sincerely|Yours truly),?\s*\z"
#: What a text with a separator, a closing or a device's line holds behind some end of a line (one is put before the text).
CUTS = java(r"\n\s*(?:--|—|__|Best|Regards|Cheers|Thank|Sincerely|Yours|Sent from|Get Outlook|Download)", "i")
MOST_LINES, LONGEST_LINE = 11, 60
#: Lines of devices that end a message, lines that begin a signature, runs of short lines from the last up.
PHONE = r"\A(?:sent from my[\s,!\w]*\Z|sent from Mailbox for iPhone|sent (?:\S* )?from my BlackBerry|Enviado desde mi (?:\w+ ){0,2}BlackBerry)"
BEGINS = r"\A(?:\s*-+\s*[a-z .]*|thanks[\s,!]*|regards[\s,!]*|cheers[\s,!]*|best[ a-z]*[\s,!]*)\Z"
CANDIDATE = r"\A(c+d?(?!d)|c+|d(?!d))"
#: What stands at the beginning of some line of a text with a signature or a device's line (an end of a line is put before the text).
SOME_LINE = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029][\t \x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*+(?:-|thanks|regards|cheers|best|sent |enviado)"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def end_block(text: Column) -> Column:
    """body and found, by looking at the last lines only: of the MOST_LINES last lines that aren't blank, but for the first of all, a run of
    short ones in which a line of dashes or a closing begins the signature. A device's line and all below it go anyway. Null stays null, not found.
    """
    def without_device(t: Column) -> Column:
        rows = lines(t)
        at = F.array_min(F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(java(PHONE, "i")), i)), lambda i: i.isNotNull()))
        start = lambda i: F.length(F.array_join(F.slice(rows, 1, i), "\n")) + F.when(i > 0, 1).otherwise(0)
        body = let(strip(t), lambda x: let(at, lambda i: F.struct(F.when(i.isNull(), x).otherwise(F.left(x, start(i))).alias("body"), i.isNotNull().alias("found"))))
        return F.when(t.rlike("(?i)sent (?:\\S* )?from m|enviado desde mi"), body).otherwise(F.struct(strip(t).alias("body"), F.lit(False).alias("found")))

    def cut(rows: Column, whole: Column, found: Column) -> Column:
        full = F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(f"[^{WS_SET}]"), i)), lambda i: i.isNotNull())
        some = let(full, lambda x: F.when(F.size(x) > 1, F.slice(x, F.greatest(F.lit(2), F.size(x) - MOST_LINES + 1), F.lit(MOST_LINES))).otherwise(F.slice(x, 1, 0)))

        def kind(i: Column) -> Column:
            return let(strip(F.get(rows, i)), lambda x: F.when(F.length(x) > LONGEST_LINE, "l").when(x.startswith("-") & x.rlike("[^-]"), "d").otherwise("c"))

        def begin(last: Column) -> Column:
            many = F.length(F.regexp_extract(F.reverse(F.array_join(F.transform(last, kind), "")), CANDIDATE, 1))
            return let(many, lambda n: F.array_min(F.filter(F.transform(last, lambda i, k: F.when((k >= F.size(last) - n) & F.get(rows, i).rlike(java(BEGINS, "i")), i)), lambda i: i.isNotNull())))

        body = lambda i: F.when(i.isNull(), whole).otherwise(F.array_join(F.slice(rows, 1, i), "\n"))
        return let(let(some, begin), lambda i: F.struct(strip(body(i)).alias("body"), (found | i.isNotNull()).alias("found")))

    parted = lambda x: let(F.split(x["body"], LINE_END, -1), lambda rows: cut(rows, x["body"], x["found"]))
    searched = lambda t: F.when(F.concat(F.lit("\n"), t).rlike(f"(?iu){SOME_LINE}"), let(without_device(t), parted)).otherwise(F.struct(strip(t).alias("body"), F.lit(False).alias("found")))
    return F.when(text.isNull(), F.struct(F.lit(None).cast("string").alias("body"), F.lit(False).alias("found"))).otherwise(let(text, searched))


def without_device_lines(text: Column) -> Column:
    kept = lambda t: F.array_join(F.filter(lines(t), lambda x: ~x.rlike(java(DEVICE, "i"))), "\n")
    return let(text, lambda t: F.when(F.concat(F.lit("\n"), t).rlike(CUTS), kept(t)).otherwise(t))


def cut_at_lines(text: Column) -> Column:
    """The lines before the first separator or closing with a name below, else before the first device line."""
    def cut(rows: Column) -> Column:
        def begins(x: Column, i: Column) -> Column:
            plain, after = strip(x), strip(F.coalesce(F.get(rows, i + 1), F.lit("")))
            named = (after != "") & (F.length(after) < 60) & ~after.rlike(r"\A[a-z]")
            return plain.isin("--", "—", "__") | plain.rlike(java(CLOSING, "i")) & named

        def first(test) -> Column:
            return F.array_min(F.filter(F.transform(rows, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull()))

        at = F.coalesce(first(begins), first(lambda x, i: x.rlike(java(DEVICE, "i"))))
        return let(at, lambda n: F.array_join(F.when(n.isNull(), rows).otherwise(F.slice(rows, 1, n)), "\n"))

    return let(text, lambda t: F.when(F.concat(F.lit("\n"), t).rlike(CUTS), let(lines(t), cut)).otherwise(t))


#: How a line begins where a pattern can match: one search instead of one a pattern in most texts.
LINES = r"^\s*+(?:--|—|__|Best|Regards|Cheers|Thank|Sincerely|Yours truly|Warm|Kind|Tel:|Phone:|Mobile:|Cell:|E-?mail:|LinkedIn:|Twitter:|Skype:|www\.|Ltd\.|LLC|Inc\.|Corp\.|GmbH)"


def cut_at_pattern(text: Column) -> Column:
    """The text before the first match of the first pattern that matches anywhere."""
    def cut(t: Column) -> Column:
        out = t
        for p in reversed(PATTERNS):
            p = java(p, "im")
            out = F.when(t.rlike(p), F.regexp_replace(before(t, p), r"[\s\x1c-\x1f\x85\p{Z}]+\z", "")).otherwise(out)
        return F.when(t.rlike(java(LINES, "im")), out).otherwise(t)

    return let(text, cut)


def by_pattern(text: Column) -> tuple[Column, Column]:
    """The text without its signature, and whether it is shorter."""
    out = strip(without_device_lines(cut_at_pattern(cut_at_lines(text))))
    return strip(collapse(out)), F.length(out) < F.length(text)


def remove_signature(text: Column) -> tuple[Column, Column]:
    """A block at the end wins; only without one the patterns are tried."""
    block = end_block(text)
    out, shorter = by_pattern(text)
    return F.when(block["found"], block["body"]).otherwise(out), block["found"] | shorter
