"""Ranked lexical search by three phases over lists of postings (TPUT).

Postings are cut by term and, since a frequent term's list is as long as the table, by blocks of documents: a row of the
index is a term's list in one block. Phase 1 fetches the heads of all lists: the sums of what is seen of a document bound
the k-th best score of an item from below. Phase 2 applies one threshold to all lists of an item, that bound shared out
over its terms: a document in no list above it can't be among the best, and one seen in part is bounded by what it could still
get. Phase 3 looks up the missing scores of the candidates that remain.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, scratch, slices

#: Documents and postings of a block at most; distinct terms of the items searched at once (one item may hold more).
BLOCK_DOCS, BLOCK_POSTINGS, TERMS_AT_ONCE = 4096, 1_000_000, 100_000
HEADER = -1  # the row of a block that holds its documents instead of a list
ITEM = "item long, terms array<binary>, repeats array<int>"
#: ASCII letters in lower case, everything else in ASCII but digits as a space; bytes of other characters as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters (lower-cased), digits and characters beyond ASCII, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


@dataclass(frozen=True)
class Ranking:
    """What scores need besides the postings: items as arrays of term numbers and repeats, weights by term, the table's sums."""

    items: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    docs: int
    length: int
    floors: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def scores(self, term: int, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The share of one occurrence of the term in an item, for documents with tf of n terms."""
        if len(n) and 25 * int(n.max()) * self.docs >= 1 << 63:
            n = n.astype(object)
        m = (75 + 25 * n * self.docs // self.length).astype(np.int64)
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def _rows(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """block, term, places, tf and n of each list."""
    batches = table.to_batches() if isinstance(table, pa.Table) else [table]
    for batch in batches:
        blocks, terms = batch.column("block").to_numpy(), batch.column("term").to_numpy()
        lists = [batch.column(c) for c in ("place", "tf", "n")]
        flat = [(x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False).astype(np.int64)) for x in lists]
        for i, (block, term) in enumerate(zip(blocks.tolist(), terms.tolist(), strict=True)):
            yield block, term, *(values[at[i] : at[i + 1]] for at, values in flat)


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Lists of the vocabulary's terms in blocks of documents, places ascending, and a header for each block."""
    spark = docs.sparkSession
    shared, kind = spark.sparkContext.broadcast(vocabulary), docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, made = shared.value.get, TaskContext.get().partitionId(), 0
        lists: dict[int, list[int]] = {}
        ids, sizes, postings, id_type = [], [], 0, None

        def block() -> pa.RecordBatch:
            nonlocal made, postings
            terms, n = sorted(lists), np.array(sizes, np.int64)
            pairs = [np.array(lists[t], np.int64).reshape(-1, 2) for t in terms]
            counts = [len(p) for p in pairs]
            both = np.concatenate([*pairs, np.zeros((0, 2), np.int64)])
            at = np.concatenate([[0, 0], np.cumsum(counts)]).astype(np.int32)
            at_n = np.concatenate([[0, len(n)], len(n) + np.cumsum(counts)]).astype(np.int32)
            put = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + made] * (len(terms) + 1), pa.int64()), pa.array([HEADER, *terms], pa.int32()), put(at, both[:, 0]), put(at, both[:, 1]), put(at_n, np.concatenate([n, n[both[:, 0]]])),
                    pa.array([ids, *[[]] * len(terms)], pa.list_(id_type)), pa.array([int((n > 0).sum()), *counts], pa.int64()), pa.array([int(n.sum()), *[0] * len(terms)], pa.int64()),
                ],
                names=["block", "term", "place", "tf", "n", "ids", "docs", "length"],
            )
            made, postings = made + 1, 0
            lists.clear(), ids.clear(), sizes.clear()
            return out

        for batch in slices(batches):
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                found = Counter(map(number, words))
                found.pop(None, None)
                for term, tf in found.items():
                    lists.setdefault(term, []).extend((len(ids), tf))
                ids.append(key)
                sizes.append(len(words))
                postings += len(found)
                if len(ids) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    yield block()
        if ids:
            yield block()

    return docs.mapInArrow(run, f"block long, term int, place array<int>, tf array<int>, n array<int>, ids array<{kind}>, docs long, length long")


def _heads(index: DataFrame, ranking, k: int) -> DataFrame:
    """The k best postings of every term: each task's first, then the best of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Ranking = ranking.value
        best: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for block, term, place, tf, n in _rows(batch):
                score = own.scores(term, tf, n)
                some = np.lexsort((place, -score))[:k]
                new = score[some], np.full(len(some), block), place[some]
                if term in best:
                    new = tuple(map(np.concatenate, zip(best[term], new, strict=True)))
                    some = np.lexsort((new[2], new[1], -new[0]))[:k]
                    new = tuple(x[some] for x in new)
                best[term] = new
        if best:
            terms = np.concatenate([np.full(len(b[0]), t, np.int32) for t, b in best.items()])
            score, block, place = (np.concatenate(x) for x in zip(*best.values(), strict=True))
            for at in range(0, len(terms), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000]) for x in (terms, block, place.astype(np.int32), score)], names=["term", "block", "place", "score"])

    heads = index.where(F.col("term") != HEADER).select("block", "term", "place", "tf", "n").mapInArrow(run, "term int, block long, place int, score long")
    order = Window.partitionBy("term").orderBy(F.desc("score"), "block", "place")
    return heads.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _kth(sums: DataFrame, score: str, k: int) -> dict[int, int]:
    """Each item's k-th best score; items with fewer rows are left out. A row for each item of those searched at once."""
    order = Window.partitionBy("item").orderBy(F.desc(score))
    best = sums.select("item", score).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return {r["item"]: r["s"] for r in best.groupBy("item").agg(F.min(score).alias("s"), F.count("*").alias("n")).where(F.col("n") == k).collect()}


def _thresholded(index: DataFrame, ranking, k: int) -> DataFrame:
    """Candidates of every block: documents whose bound reaches the floor of the item and the k-th best sum of the block."""

    def run(table: pa.Table) -> pa.Table:
        own: Ranking = ranking.value
        lists = {term: (place, tf, n) for _, term, place, tf, n in _rows(table)}
        size, block = len(lists.pop(HEADER)[2]), table.column("block")[0].as_py()
        scored = {term: (place, own.scores(term, tf, n)) for term, (place, tf, n) in lists.items()}
        out: list[tuple[np.ndarray, ...]] = []
        for item, (terms, repeats) in enumerate(own.items):
            floor = int(own.floors[item])
            unseen = max(0, (floor - 1) // len(terms))  # a list gives more than this, or its entry isn't fetched
            sums, seen = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for term, times in zip(terms.tolist(), repeats.tolist(), strict=True):
                if term in scored:
                    place, score = scored[term]
                    fetched = score * times > unseen
                    sums[place[fetched]] += score[fetched] * times
                    seen[place[fetched]] += 1
            bound = sums + (len(terms) - seen) * unseen
            least = int(np.partition(sums, -k)[-k]) if size > k else 0
            found = np.flatnonzero((seen > 0) & (bound >= max(1, floor, least)))
            if len(found):
                out.append((np.full(len(found), item, np.int32), found.astype(np.int32), sums[found], bound[found]))
        item, place, sums, bound = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"block": np.full(len(item), block, np.int64), "item": item, "place": place, "sum": sums, "bound": bound})

    return index.select("block", "term", "place", "tf", "n").groupBy("block").applyInArrow(run, "block long, item int, place int, sum long, bound long")


def _looked_up(candidates: DataFrame, index: DataFrame, ranking) -> DataFrame:
    """The whole score of every candidate, each term's entry found in its list by place."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(wanted: pa.Table, table: pa.Table) -> pa.Table:
        own: Ranking = ranking.value
        lists = {term: (place, tf, n) for _, term, place, tf, n in _rows(table)} if len(wanted) else {}
        items, places = (wanted.column(c).to_numpy().astype(np.int64) for c in ("item", "place"))
        order = np.lexsort((places, items))
        items, places, scores = items[order], places[order], np.zeros(len(items), np.int64)
        for item in np.unique(items).tolist():
            a, b = np.searchsorted(items, [item, item + 1])
            for term, times in zip(*(x.tolist() for x in own.items[item]), strict=True):
                if term in lists:
                    place, tf, n = lists[term]
                    at = np.minimum(np.searchsorted(place, places[a:b]), len(place) - 1)
                    hit = place[at] == places[a:b]
                    scores[a:b][hit] += times * own.scores(term, tf[at[hit]], n[at[hit]])
        names = table.column("ids").combine_chunks()
        which = pa.array([int(i) for i in np.flatnonzero(table.column("term").to_numpy() == HEADER)], pa.int64())
        ids = names.take(which).flatten().take(pa.array(places)) if len(wanted) else pa.array([], names.type.value_type)
        block = wanted.column("block").take(pa.array(order))
        return pa.table({"item": pa.array(items.astype(np.int32)), "id": ids, "block": block, "place": pa.array(places.astype(np.int32)), "score": pa.array(scores)})

    lists = index.select("block", "term", "place", "tf", "n", "ids")
    return candidates.select("block", "item", "place").groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(run, f"item int, id {kind}, block long, place int, score long")


def _items(items: DataFrame) -> DataFrame:
    """The items with a number each, their distinct terms and repeats, in batches (column batch) of at most TERMS_AT_ONCE terms, written down."""
    spark, kind = items.sparkSession, items.schema[0].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            found = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(range(at, at + len(found)), pa.int64()), pa.array([[*f] for f in found], pa.list_(pa.binary())), pa.array([[*f.values()] for f in found], pa.list_(pa.int32()))], names=["id", "item", "terms", "repeats"]
            )
            at += len(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            numbers = []
            for n in batch.column("n").to_pylist():
                if held and held + n > TERMS_AT_ONCE:
                    number, held = number + 1, 0
                held += n
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(numbers, pa.int64())], names=[*batch.schema.names[:-1], "batch"])

    path = scratch(spark, "search-items")
    items.mapInArrow(split, f"id {kind}, {ITEM}").where(F.size("terms") > 0).write.parquet(f"{path}/split")
    rows = spark.read.parquet(f"{path}/split")
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, math.ceil(total / TERMS_AT_ONCE))
    rows.withColumn("n", F.size("terms")).repartition(parts).mapInArrow(cut, f"id {kind}, {ITEM}, batch long").write.parquet(f"{path}/batches")
    return spark.read.parquet(f"{path}/batches")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k documents of the highest score for every item: item id, rank (int, from 1), document id, score (long).

    A term's weight is w = floor(1000 * ln((2N + 2) / (2df + 1))) for N documents with a term, df of them with this one; a
    document's score is the sum over the item's terms, repeats included, of w * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L
    for a document of n terms out of L. Exact; equal scores by ascending document id (nulls last). Documents without any score aren't listed.
    Null and empty texts have no terms; such items have no rows. Each row of either table counts for itself, whatever its id: repeated
    rows are ranked side by side. Other columns don't matter. Items go in batches of at most TERMS_AT_ONCE distinct terms,
    which is what the driver and each task hold of them; every batch reads the documents once. Index and candidates are
    written to the shared folder; a task holds one block of documents.
    """
    spark = docs.sparkSession
    docs, items = only(docs, id_col, text_col), only(items, item_col, item_text)
    batches = _items(items.toDF("id", "text"))
    out = spark.createDataFrame([], f"`{item_col}` {items.schema[0].dataType.simpleString()}, rank int, `{id_col}` {docs.schema[0].dataType.simpleString()}, score long")
    for number in sorted(r["batch"] for r in batches.select("batch").distinct().collect()):
        out = out.union(_batch(docs.toDF("id", "text"), batches.where(F.col("batch") == number), k))
    return out


def _batch(docs: DataFrame, batch: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = batch.select("item", "terms", "repeats").orderBy("item").collect()
    vocabulary: dict[bytes, int] = {}
    items = [(np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]], np.int64), np.array(r["repeats"], np.int64)) for r in rows]
    path = scratch(spark, "search")
    _index(docs, vocabulary).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    found = {r["term"]: (r["docs"], r["length"]) for r in index.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).collect()}
    n, length = found.get(HEADER, (0, 0))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * found.get(t, (0, 0))[0] + 1))) for t in range(len(vocabulary))], np.int64)
    plain = Ranking(items, weights, n, length)
    share = spark.sparkContext.broadcast
    # phase 1: the k-th best sum over the heads of the lists
    wanted = spark.createDataFrame([(i, int(t), int(c)) for i, (terms, repeats) in enumerate(items) for t, c in zip(terms, repeats, strict=True)], "item int, term int, times int")
    heads = _heads(index, share(plain), k).join(F.broadcast(wanted), "term")  # bounded by TERMS_AT_ONCE
    floors = _kth(heads.groupBy("item", "block", "place").agg(F.sum(F.col("score") * F.col("times")).alias("sum")), "sum", k)
    ranking = share(Ranking(items, weights, n, length, np.array([floors.get(i, 0) for i in range(len(items))], np.int64)))
    # phase 2: what one threshold leaves, then the k-th best sum of all that was fetched
    _thresholded(index, ranking, k).write.parquet(f"{path}/candidates")
    candidates = spark.read.parquet(f"{path}/candidates")
    least = spark.createDataFrame([(i, s) for i, s in _kth(candidates, "sum", k).items()], "item int, least long")
    open_ones = candidates.join(F.broadcast(least), "item", "left").where(F.col("bound") >= F.coalesce("least", F.lit(1)))
    # phase 3
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "block", "place")
    best = _looked_up(open_ones, index, ranking).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = batch.select(F.col("id").alias("item_id"), F.col("item").alias("number"))
    numbers = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], "item int, number long")
    return best.join(F.broadcast(numbers), "item").join(names, "number").select("item_id", "rank", "id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The scores by their definition, for every document that shares a term with an item.
RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT CAST(sum(CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / (2 * c + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS c FROM p GROUP BY t), s),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(w) * s.n) // s.l) AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY i, item_id, t),
e AS (SELECT i, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM e WHERE score > 0) WHERE rank <= 20"""
