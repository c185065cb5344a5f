"""How the sources of a language differ in their words: an audit in two passes over the texts.

Pass 1 counts exactly in how many documents of a language each term stands, and keeps the frequent ones. Pass 2 runs an
Aho-Corasick automaton of the kept terms, each between two delimiters, over the texts and counts their occurrences by
source. The counts are sparse postings (source, term); shares of pairs of sources and of a source against its language follow from them.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, scratch, slices

#: Documents of a language that a term must stand in; what is added to each count; shares are multiples of one part in SCALE, and one more.
LEAST_DOCS, ADDED, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Kept terms in one automaton (about: they are dealt by hash); counts that a task holds before it hands them on; terms of one task when sources are compared, and sources in a tile.
TERMS_AT_ONCE, HELD, CHUNK, TILE = 250_000, 600_000, 1024, 512
#: ASCII letters in lower case, everything else in ASCII as a space; bytes of other characters as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(FOLD)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / total) by long division: exact for totals below 2^63 / 32000, null for a total of 0."""
    div = lambda x, y: F.call_function("div", x, y)
    x, total = count + F.lit(ADDED), F.nullif(total, F.lit(0))
    rest = (x % total) * 32_000
    return 1 + div(x, total) * SCALE + div(rest, total) * (SCALE // 32_000) + div((rest % total) * (SCALE // 32_000), total)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    x = count + ADDED
    rest = x % total * 32_000
    return 1 + x // total * SCALE + rest // total * (SCALE // 32_000) + rest % total * (SCALE // 32_000) // total


def _in_documents(docs: DataFrame) -> DataFrame:
    """lang, term, docs: sums by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())], names=["lang", "term", "docs"])
            held.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update({*folded(text).split()})
            if sum(map(len, held.values())) >= HELD:
                yield from rows()
        yield from rows()

    return docs.select("lang", "text").mapInArrow(run, "lang string, term binary, docs long")


@functools.lru_cache(maxsize=2)
def _automata(shared) -> dict[str, ahocorasick.Automaton]:
    """An automaton a language, built once a worker for each slice of the vocabulary. Values are places in the slice."""
    out: dict[str, ahocorasick.Automaton] = {}
    for i, (lang, term) in enumerate(zip(*shared.value[:2], strict=True)):
        out.setdefault(lang, ahocorasick.Automaton()).add_word(f" {term} ", i)
    for automaton in out.values():
        automaton.make_automaton()
    return out


def _occurrences(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, id, count of the terms of one slice of the vocabulary: sums by task."""
    rows = kept.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((rows.column("lang").to_pylist(), [t.decode() for t in rows.column("term").to_pylist()], rows.column("id").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, ids = _automata(shared), shared.value[2]
        held: dict[tuple[str, str], Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([source] * len(counts), pa.string()), pa.array(ids[[*counts]]), pa.array([*counts.values()], pa.int64())], names=["lang", "source", "id", "count"])
            held.clear()

        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if lang in automata:
                    found = [i for _, i in automata[lang].iter(f" {folded(text).decode()} ")]
                    if found:
                        held.setdefault((lang, source), Counter()).update(found)
            if sum(map(len, held.values())) >= HELD:
                yield from rows()
        yield from rows()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, id long, count long")


def _differences(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, g, h (g < h), sum: by how much the sources g and h differ beyond what terms that neither has would make of it.

    Terms go in chunks, sources in tiles: a task compares two tiles in one chunk. A term that only g has counts |p - empty share of h|,
    a term of both |p - q|, each less the difference of the empty shares.
    """
    tiles = F.expr(f"transform(sequence(0, (sources - 1) div {TILE}), x -> struct(least(x, no div {TILE}) as a, greatest(x, no div {TILE}) as b))")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("terms") / CHUNK)).cast("long")
    left = postings.join(groups, ["lang", "source"]).withColumns({"chunk": F.pmod(F.xxhash64("id"), chunks), "pair": F.explode(tiles)}).select("lang", "chunk", "pair.a", "pair.b", "no", "id", "count")
    right = groups.where("terms > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).withColumn("pair", F.explode(tiles)).select("lang", "chunk", "pair.a", "pair.b", "no", "total").toDF("lang", "chunk", "a", "b", "no", "total")  # columns of its own, as both sides come from groups

    def run(key: tuple, found: pa.Table, sources: pa.Table) -> pa.Table:
        lang, _, a, b = (k.as_py() for k in key)
        order = np.argsort(sources.column("no").to_numpy(), kind="stable")
        no, total = sources.column("no").to_numpy()[order], sources.column("total").to_numpy()[order]
        empty = shares(np.zeros(len(no), np.int64), total)
        apart = np.abs(empty[:, None] - empty)
        which = np.searchsorted(no, found.column("no").to_numpy())
        p = shares(found.column("count").to_numpy(), total[which])
        out = np.zeros((len(no), len(no)), np.int64)
        order = np.lexsort((p, which))  # terms of one source against the other's empty share, by sums over the smaller and the larger ones
        at = np.searchsorted(which[order], np.arange(len(no) + 1))
        for g in range(len(no)):
            own = p[order[at[g] : at[g + 1]]]
            sums = np.concatenate([[0], np.cumsum(own)])
            below = np.searchsorted(own, empty)
            out[g] += sums[-1] - 2 * sums[below] + (2 * below - len(own)) * empty - len(own) * apart[g]
        out += out.T.copy()
        order = np.argsort(found.column("id").to_numpy(), kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(found.column("id").to_numpy()[order])) + 1):
            g, x = which[rows], p[rows]
            if len(g) > 1:
                one = np.abs(x[:, None] - empty[g])
                out[np.ix_(g, g)] += np.abs(x[:, None] - x) - one - one.T + apart[np.ix_(g, g)]
        first, second = np.nonzero(out)
        fine = (no[first] < no[second]) & (no[first] // TILE == a) & (no[second] // TILE == b)
        first, second = first[fine], second[fine]
        return pa.table({"lang": pa.array([lang] * len(first), pa.string()), "g": no[first], "h": no[second], "sum": out[first, second]})

    key = ["lang", "chunk", "a", "b"]
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "lang string, g long, h long, sum long")
    return parts.groupBy("lang", "g", "h").agg(F.sum("sum").alias("sum"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source's shares of the kept terms differ from the other sources' and from its language's.

    Terms are runs of ASCII letters (lower-cased) and characters beyond ASCII; a language keeps those in at least `least_docs` of its
    documents. A share is p = 1 + floor(10^9 (count + 5) / (N + 5 V)) for V kept terms and N occurrences of them. Part `pair` has a row
    for each other source of the language: the sum of |p - q| over all kept terms, 0 without any. Part `term` has the source's terms
    with a share above the language's by their difference, `most_terms` at most. Ranks count within source and part, largest value first, ties by item in UTF-8.
    All arithmetic is exact. Null texts, languages and sources are empty ones; repeated rows count each; groups without terms take part; other
    columns don't matter; an empty table gives no rows. Counts are summed in the tasks before they are shuffled; vocabulary, postings and
    groups are written to the shared folder. The vocabulary goes to the tasks in slices of about TERMS_AT_ONCE terms, each a pass over the texts.
    """
    spark = docs.sparkSession
    docs = only(docs, lang_col, source_col, text_col).toDF("lang", "source", "text").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    path = scratch(spark, "divergence")
    counts = _in_documents(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    counts.select("lang", "term", F.monotonically_increasing_id().alias("id")).write.parquet(f"{path}/kept")
    kept = spark.read.parquet(f"{path}/kept")
    number = math.ceil(kept.count() / TERMS_AT_ONCE)
    for i in range(number):
        part = kept.where(F.pmod(F.xxhash64("lang", "term"), F.lit(number)) == i)
        _occurrences(docs, part).groupBy("lang", "source", "id").agg(F.sum("count").alias("count")).write.mode("append").parquet(f"{path}/postings")
    postings = spark.read.schema("lang string, source string, id long, count long").parquet(f"{path}/postings") if number else spark.createDataFrame([], "lang string, source string, id long, count long")
    of_lang = Window.partitionBy("lang")
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    sums = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(terms, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["terms", "n"])
    groups = groups.withColumns({
        "no": F.row_number().over(of_lang.orderBy("source")).cast("long") - 1, "sources": F.count("*").over(of_lang),
        "total": F.col("n") + ADDED * F.col("terms"), "lang_total": F.sum("n").over(of_lang) + ADDED * F.col("terms"),
    })
    groups.write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    empty = groups.select("lang", "source", "no", "terms", share(F.lit(0).cast("long"), F.col("total")).alias("p"))
    other = empty.select("lang", F.col("source").alias("item"), F.col("no").alias("other"), F.col("p").alias("q"))
    # the result itself: a row for each two sources of a language
    pairs = empty.join(other, "lang").where("no <> other").withColumns({"g": F.least("no", "other"), "h": F.greatest("no", "other")})
    pairs = pairs.join(_differences(postings, groups), ["lang", "g", "h"], "left")
    value = F.coalesce(F.col("terms") * F.abs(F.col("p") - F.col("q")), F.lit(0)) + F.coalesce("sum", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    whole = postings.groupBy("id").agg(F.sum("count").alias("all")).join(kept.select("id", F.col("term").cast("string").alias("item")), "id")
    own = postings.join(whole, "id").join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    own = own.withColumn("value", share(F.col("count"), F.col("total")) - share(F.col("all"), F.col("lang_total"))).where("value > 0").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(own.withColumn("rank", rank).where(F.col("rank") <= most_terms))


#: Every group with every kept term, as defined.
AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, r, t, count(*) AS c FROM (SELECT lang, source, r, unnest(w) AS t FROM d) GROUP BY ALL),
k AS (SELECT lang, t FROM o GROUP BY lang, t HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(t) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
s AS (SELECT lang, source, t, CAST(sum(c) AS BIGINT) AS c FROM o GROUP BY ALL),
c AS (SELECT lang, source, t, coalesce(s.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN s USING (lang, source, t)),
n AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY ALL),
p AS (SELECT lang, source, t, c, 1 + (1000000000 * (c + 5)) // (n + 5 * v) AS p FROM c JOIN n USING (lang, source) JOIN v USING (lang)),
m AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY lang),
q AS (SELECT lang, t, 1 + (1000000000 * (c + 5)) // (n + 5 * v) AS q FROM (SELECT lang, t, CAST(sum(c) AS BIGINT) AS c FROM c GROUP BY ALL) JOIN m USING (lang) JOIN v USING (lang)),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT CAST(sum(abs(x.p - y.p)) AS BIGINT) FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT lang, source, 'term', t, p - q FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e) WHERE part = 'pair' OR rank <= 50"""
