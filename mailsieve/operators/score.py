"""Confidence in an extracted text: five factors of counts and lengths, all in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rx import is_blank, java, occurrences, strip, words

#: Indicators of noise and of quality, penalties, rewards and bounds.
NOISE = (
    r"<[^>]+>",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"https?://\S+",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"^\s*>",
    r"Forwarded by",
    r"Original Message",
    r"^\s*Sent from my",
    r"\b(CONFIDENTIAL|DISCLAIMER|NOTICE)\b",
)
QUALITY = (
    r"[.!?]\s+[A-Z]",
    r"\n\n",
    r"\b(the|a|an|is|are|was|were|have|has|had|do|does|did|will|would|could|should)\b",
    r"[?!]",
    r"\b(Hi|Hello|Hey|Dear|Good morning|Good afternoon|Good evening)\b",
    r"\b(Thanks|Thank you|Best|Regards|Cheers|Sincerely)\b",
)
SPECIAL = r"[^\w\s.,;:!?'\"-]"
#: Most characters that aren't special, which go first, as runs of them are found fast; then all others that aren't. The telephone number's form without the borders of words: cheaper to look for than what it stands before.
PLAIN = r"a-zA-Z0-9_ \t-\r.,;:!?'\"\xc0-\xd6\xd8-\xf6\xf8-\u02c1-"
OTHERS = java(SPECIAL.replace("[^", "[", 1) + "++")
NUMBER = r"\p{Nd}{3}[-.]?\p{Nd}{3}[-.]?\p{Nd}{4}"
THRESHOLD = 0.85
FACTORS = ("length", "noise", "quality", "readability", "completeness")


#: Text without any of these has no match of the pattern: signs as they are, letters in lower case and such that fold to no other letter.
GUARDS = {
    NOISE[0]: ("<",), NOISE[1]: ("@",), NOISE[2]: ("://",), NOISE[4]: (">",), NOISE[5]: ("forward",), NOISE[6]: ("nal me",), NOISE[7]: ("nt from my",), NOISE[8]: ("conf", "cla", "not"),
    QUALITY[1]: ("\n\n",), QUALITY[3]: ("?", "!"), QUALITY[4]: ("h", "dear", "good"), QUALITY[5]: ("than", "be", "reg", "ch", "nc"),
}


def counts(text: Column, patterns: tuple[str, ...], lower: Column | None = None) -> Column:
    """Matches of each pattern; searched only where the lower-case text has one of the pattern's guards."""
    def one(p: str) -> Column:
        n = F.regexp_count(text, F.lit(java(p, "im")))
        if p == NOISE[3]:
            return F.when(text.rlike(NUMBER), n).otherwise(0)
        if p in (QUALITY[1], QUALITY[3]):
            return occurrences(text, "\n\n") if p == QUALITY[1] else occurrences(text, "?") + occurrences(text, "!")
        if p not in GUARDS or lower is None:
            return n
        return F.when(reduce(or_, [F.contains(lower, F.lit(g)) for g in GUARDS[p]]), n).otherwise(0)

    return F.array(*map(one, patterns))


def found(n: Column, patterns: tuple[str, ...]) -> Column:
    """"pattern: n matches" of the patterns that match, in their order."""
    return F.array_compact(F.array(*[F.when(F.get(n, i) > 0, F.concat(F.lit(f"{p}: "), F.get(n, i).cast("string"), F.lit(" matches"))) for i, p in enumerate(patterns)]))


def _sum(n: Column, many: int, each: float, most: float) -> Column:
    total = F.lit(0.0)
    for i in range(many):  # from the left, as doubles add up
        total = total + F.least(F.get(n, i) * F.lit(each), F.lit(most))
    return total


def length_score(n: Column) -> Column:
    return F.when(n < 10, 0.1).when(n < 50, 0.6).when(n < 200, 0.9).when(n > 10_000, F.greatest(F.lit(0.5), 1.0 - (n - 10_000) / 50_000)).otherwise(1.0)


def score(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """Adds score, is_reliable, the five factors, noise_found and quality_found (names with `prefix`) for every row.

    A table that has one of these columns already is an error. Blank and null texts score 0.0 and are never reliable; their factors are null. Reliability is of the unrounded sum.
    """
    clash = {"__t", "__w", "__n", "__q", "__l", "__sum", *(f"__{k}" for k in FACTORS)} & {*df.columns}
    added = {prefix + k for k in ("score", "is_reliable", "noise_found", "quality_found", *(f"{k}_score" for k in FACTORS))} & {*df.columns}
    if clash or added:
        raise ValueError(f"the table has columns {sorted(clash | added)} already; choose a prefix or rename them")
    step = df.withColumn("__t", strip(F.coalesce(F.col(f"`{text}`"), F.lit("")))).withColumn("__w", F.lower("__t"))
    step = step.withColumns({"__n": counts(F.col("__t"), NOISE, F.col("__w")), "__q": counts(F.col("__t"), QUALITY, F.col("__w")), "__l": F.length("__t")})
    t, size = F.col("__t"), F.col("__l")
    special = F.length(F.regexp_replace(F.regexp_replace(t, f"[{PLAIN}]++", ""), OTHERS, ""))
    ends = F.right(t, F.lit(1)).rlike("[.!?]") | F.right(t, F.lit(50)).rlike("[.!?]")
    step = step.withColumns({
        "__length": length_score(size),
        "__noise": F.greatest(F.lit(0.0), 1.0 - _sum(F.col("__n"), len(NOISE), 0.05, 0.2)),
        "__quality": F.least(F.lit(1.0), 0.5 + _sum(F.col("__q"), len(QUALITY), 0.03, 0.1)),
        "__readability": F.when(special / F.greatest(size, F.lit(1)) > 0.1, 0.6).when(words(t) / F.greatest(size, F.lit(1)) < 0.1, 0.7).otherwise(1.0),
        "__completeness": F.when(~ends, 0.7).when(F.left(t, F.lit(1)).rlike("[,.;:!?]"), 0.8).otherwise(1.0),
    })
    step = step.withColumn("__sum", F.col("__length") * 0.20 + F.col("__noise") * 0.30 + F.col("__quality") * 0.20 + F.col("__readability") * 0.15 + F.col("__completeness") * 0.15)
    empty = is_blank(t)
    full = lambda c, rest=None: F.when(~empty, c).otherwise(rest) if rest is not None else F.when(~empty, c)
    out = {"score": full(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__sum"))), 3), F.lit(0.0)), "is_reliable": full(F.col("__sum") >= threshold, F.lit(False))}
    out |= {f"{k}_score": full(F.bround(f"__{k}", 3)) for k in ("length", "noise", "quality", "readability", "completeness")}
    none = F.array().cast("array<string>")
    out |= {"noise_found": full(found(F.col("__n"), NOISE), none), "quality_found": full(found(F.col("__q"), QUALITY), none)}
    return step.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(prefix + k) for k, c in out.items()])


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "High").when(confidence >= 0.6, "Medium").otherwise("Low")


def flow_label(flow: Column) -> Column:
    return F.when(F.contains(flow, F.lit("non_llm")), "Deterministic").otherwise("LLM Agent")
