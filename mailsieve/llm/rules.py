"""Quality rules as a short-circuit cascade, all in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, and only where the whole is."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """\\n-split lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, the first included.

    Windows are sorted by their 64-bit hash, so equal ones are neighbours; the places of those that have an equal
    neighbour are sorted again, and each adds the words up to the next, three at most. n log n in the words of a text.
    """
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    places = let(windows, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(x, F.get(s, k + 1))), lambda x: x["i"])))
    covered = let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.get(p, k + 1) - x)), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(words) < 3, 0).otherwise(covered).cast("long")


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts; a null text has none of anything."""
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    return {
        "counts": counts,
        "n_symbols": F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines_of(text), duplicate_lines),
    }


#: Work of one step over an array's elements, against one character read by a pattern.
STEP = 20.0


@dataclass(frozen=True)
class Rule:
    """rejects: from the text and, where they were computed before, the base columns. work: what that takes, in characters read."""

    name: str
    rejects: Callable[[Column, dict[str, Column]], Column]
    work: Callable[[Column, dict[str, Column]], Column]


def _n_words(text: Column, base: dict[str, Column]) -> Column:
    return base["n_words"] if base else F.size(words_of(text))


def _repeats(text: Column, base: dict[str, Column]) -> Column:
    if base:
        return base["n_repeat_words"] * 100 > base["n_words"] * 50
    return let(words_of(text), lambda w: repeated_words(w) * 100 > F.size(w) * 50)


def _word_length(text: Column, base: dict[str, Column]) -> Column:
    if base:
        return (base["word_chars"] < 2 * base["n_words"]) | (base["word_chars"] > 15 * base["n_words"])
    return let(words_of(text), lambda w: let(F.length(F.array_join(w, "")), lambda n: (n < 2 * F.size(w)) | (n > 15 * F.size(w))))


def _symbols(text: Column, base: dict[str, Column]) -> Column:
    n = base["n_symbols"] if base else F.regexp_count(text, F.lit(SYMBOLS))
    return n * 4 > _n_words(text, base)


def _lines(text: Column, base: dict[str, Column]) -> Column:
    return let(lines_of(text), lambda x: (base["n_dup_lines"] if base else duplicate_lines(x)) * 10 > F.size(x) * 3)


def _letters(text: Column, base: dict[str, Column]) -> Column:
    chars = base["word_chars"] if base else F.length(F.array_join(words_of(text), ""))
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]")) * 10 < chars * 6


def _split_work(text: Column) -> Column:
    return F.length(text) + STEP * F.regexp_count(text, F.lit(SPACES))


def _sort_work(text: Column) -> Column:
    return let(F.regexp_count(text, F.lit(SPACES)), lambda n: F.length(text) + STEP * n * (4 + F.log2(n + F.lit(2.0)) / 4))


def _search_work(text: Column, pattern: str) -> Column:
    return let(F.regexp_instr(text, F.lit(pattern)), lambda at: F.when(at > 0, at).otherwise(F.length(text)))


#: The first two are the base. The others: no lower-case letter beside capitals; over a symbol in four words; over 30 % of
#: lines repeat earlier ones; words of under 2 or over 15 characters on average; under 60 % letters (with their vowel signs and other marks).
RULES = (
    Rule("few_words", lambda t, b: _n_words(t, b) < 50, lambda t, b: F.lit(1.0) if b else _split_work(t)),
    Rule("repeated_words", _repeats, lambda t, b: F.lit(1.0) if b else _sort_work(t)),
    Rule("capitals", lambda t, b: t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}"), lambda t, b: _search_work(t, r"\p{Lu}") + _search_work(t, r"\p{Ll}")),
    Rule("symbols", _symbols, lambda t, b: F.lit(1.0) if b else F.length(t) + _split_work(t)),
    Rule("duplicate_lines", _lines, lambda t, b: F.length(t) + 2 * STEP * F.regexp_count(t, F.lit("\n"))),
    Rule("word_length", _word_length, lambda t, b: F.lit(1.0) if b else F.length(t) + _split_work(t)),
    Rule("few_letters", _letters, lambda t, b: F.length(t) if b else 2 * F.length(t) + _split_work(t)),
)


def measure(sample: DataFrame, rules: Sequence[Rule], text: Column, base: dict[str, Column]) -> list[tuple[Rule, float, float]]:
    """The rules in cascade order, each with its work a row and the share it rejects, both of what reaches it.

    One pass sums the work of every rule over each combination of verdicts, a few rows; then the rule with the most
    rejections for its work among what the earlier ones leave comes next. No clock: the same sample gives the same order.
    """
    verdicts = [F.coalesce(r.rejects(text, base), F.lit(False)).alias(f"v{i}") for i, r in enumerate(rules)]
    works = [r.work(text, base).cast("double").alias(f"w{i}") for i, r in enumerate(rules)]
    sums = sample.select(*verdicts, *works).groupBy(*[f"v{i}" for i in range(len(rules))]).agg(F.count("*"), *[F.sum(f"w{i}") for i in range(len(rules))])
    k = len(rules)
    rows = [tuple(r) for r in sums.collect()]  # at most 2 ** rules
    out, rest = [], list(range(k))
    while rest:
        alive = sum(r[k] for r in rows) or 1
        work = {i: max(1e-9, sum(r[k + 1 + i] for r in rows) / alive) for i in rest}
        hit = {i: sum(r[k] for r in rows if r[i]) / alive for i in rest}
        best = max(rest, key=lambda i: (hit[i] / work[i], -work[i], -i))
        out.append((rules[best], work[best], hit[best]))
        rows = [r for r in rows if not r[best]]
        rest.remove(best)
    return out


def cascade(docs: DataFrame, text_col: str, into: str, rules: Sequence[Rule] = RULES, prepare: Callable[[DataFrame], DataFrame] | None = None, base: dict[str, Column] | None = None, sample_rows: int = 2000) -> tuple[DataFrame, list[str]]:
    """Adds the column `into`, the first rule of the cascade that rejects the document (null: it stays), and gives the order.

    The order comes from `measure` on about `sample_rows` rows drawn from the whole table by a seeded draw; it changes what is
    computed, never which documents stay: CASE stops at the first rule that rejects. prepare: adds the base columns to a
    table. Null texts count as empty (too few words). All rows and other columns stay.
    """
    base = base or {}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.count()
    sample = docs.select(F.col(f"`{text_col}`"))
    sample = cut((sample.sample(fraction=sample_rows / rows, seed=7) if rows > sample_rows else sample).repartition(8))  # some thousand texts, whatever the table's partitions
    order = [r for r, _, _ in measure(prepare(sample) if prepare else sample, rules, text, base)]
    verdict = F.lit(None).cast("string")
    for r in reversed(order):
        verdict = F.when(r.rejects(text, base), r.name).otherwise(verdict)
    return (prepare(docs) if prepare else docs).withColumn(into, verdict), [r.name for r in order]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and verdict of every document: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have zero counts and fail; null or repeated ids and repeated rows keep one row each; other columns
    don't matter; an empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def prepare(df: DataFrame) -> DataFrame:
        return df.withColumns(base_columns(F.col("text"))).select(*df.columns, "counts.*", "n_symbols", "n_dup_lines")

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    judged, _ = cascade(source, "text", "rejected_by", RULES, prepare, {n: F.col(n) for n in names})
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return judged.select(F.col("id").alias(id_col), *names, failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"))


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns, whatever these are called.

    Null and empty texts are rejected (too few words); repeated rows are judged alike, each for itself; an empty table stays empty.
    """
    into = free(docs, "rejected_by")
    judged, _ = cascade(docs, text_col, into)
    return judged.where(F.col(into).isNull()).drop(into)


JUDGE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, t, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_append(w, ''), 'string_agg', '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '\p{Ll}') OR 4 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(l)
  OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * (length(t) - length(regexp_replace(t, '[\p{L}\p{M}]', '', 'g'))) < 6 * word_chars AS rejected FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f
"""
