"""Approximate nearest neighbours: inverted lists of rotated vectors in column blocks, scanned with early abandonment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices

#: Rows that the driver fits on: the (upper) centres, the rotation and the share of lists to probe; every row is indexed.
SAMPLE = 16_384
#: Sampled rows a list: more lists than SAMPLE has rows for get a second level of centres, fitted in Spark on as many rows of
#: each upper list, SAMPLE at most.
ROWS_A_LIST = 32
#: Sampled rows that give a query its first bound; rows of a block; queries of a chunk; rows after which a scan tightens its bound.
BOUND_ROWS, BLOCK, CHUNK, STRIDE = 1024, 4096, 1024, 256
#: Significance of the test that abandons a candidate: larger abandons later.
EPSILON = 2.1


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec of the rows that take part: id and vector not null, not zero, all components finite, of the commonest length."""
    v, kind = F.col("vec"), vectors.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>").alias("vec")).where("id is not null and vec is not null")
    rows = rows.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (sizes["n"] if sizes else 0))


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less the squared length of each row."""
    return (centres**2).sum(1)[None] - 2 * rows @ centres.T


def k_means(rows: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = rows[random.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        at = distances(rows, centres).argmin(1)
        for i in np.unique(at):
            centres[i] = rows[at == i].mean(0)
    return centres


class Lists:
    """Centres of the lists, each under an upper centre (one level: all under one). A row goes to the nearest under its nearest upper centre."""

    def __init__(self, uppers: np.ndarray, parts: list[np.ndarray]):
        self.uppers, self.parts = uppers, parts
        self.first = np.cumsum([0, *(len(p) for p in parts)])
        self.centres = np.concatenate(parts)

    def upper_of(self, rows: np.ndarray) -> np.ndarray:
        return distances(rows, self.uppers).argmin(1)

    def of(self, rows: np.ndarray) -> np.ndarray:
        up = self.upper_of(rows)
        out = np.zeros(len(rows), np.int64)
        for u in np.unique(up):
            out[up == u] = self.first[u] + distances(rows[up == u], self.parts[u]).argmin(1)
        return out


class Index:
    """What the sample gives: the lists, a random rotation, how many lists to probe; and some of its rows for first bounds."""

    def __init__(self, rows: np.ndarray, lists: Lists, k: int, target: float, seed: int = 7):
        self.lists, self.k, self.dims = lists, k, rows.shape[1]
        self.turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.dims, self.dims)))[0]
        self.few = rows[:BOUND_ROWS]
        asked = rows[:512]
        ranks = np.argsort(np.argsort(distances(asked, lists.centres), 1, kind="stable"), 1)
        own = lists.of(rows)
        far = distances(asked, rows)
        far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        near = np.argpartition(far, min(k, len(rows) - 1) - 1, 1)[:, : min(k, len(rows) - 1)]
        needed = np.sort(np.take_along_axis(ranks, own[near], 1).ravel()) + 1
        #: The fewest lists that hold `target` of the true neighbours of sampled rows among the sample.
        self.probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if len(needed) else 1

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query a distance within which k rows other than itself lie for certain."""
        if len(self.few) <= self.k:
            return np.full(len(queries), np.inf)
        far = ((queries**2).sum(1)[:, None] + distances(queries, self.few)).clip(0)
        return np.sqrt(np.partition(far, self.k, 1)[:, self.k]) * (1 + 1e-6) + 1e-6


def scan(keys: np.ndarray, ids: np.ndarray, columns: np.ndarray, rows: np.ndarray, query_key: int, query: np.ndarray, turned: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a block within the bound: places in the block and distances.

    columns: rotated vectors as (column blocks, rows, width). After each column block the distance so far, scaled to all
    dimensions, is an estimate with a known spread: candidates whose estimate exceeds the bound by more than that spread
    allows are abandoned. What is left is measured on the original vectors in double precision. Rows come in strides; once
    k are known, the k-th is the bound of the next stride.
    """
    blocks, _, width = columns.shape
    dims, best, score = len(query), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(ids), STRIDE):
        alive = at + np.flatnonzero(keys[at : at + STRIDE] != query_key)
        so_far = np.zeros(len(alive), np.float32)
        for b in range(blocks):
            part = columns[b][alive] - turned[b * width : (b + 1) * width]
            so_far = so_far + np.einsum("ij,ij->i", part, part)
            seen = min(dims, (b + 1) * width)
            slack = 1 + EPSILON / np.sqrt(seen) if seen < dims else 1 + 1e-4
            keep = so_far <= bound * bound * seen / dims * slack * slack + 1e-6
            if not keep.all():
                alive, so_far = alive[keep], so_far[keep]
            if not len(alive):
                break
        if len(alive):
            best, score = np.concatenate([best, alive]), np.concatenate([score, np.sqrt(((rows[alive].astype(np.float64) - query) ** 2).sum(1))])
            order = np.lexsort((ids[best], score))[:k]
            best, score = best[order], score[order]
            if len(best) == k:
                bound = min(bound, float(score[-1]) * (1 + 1e-6))
    return best, score


def _lists(rows: DataFrame, sample: np.ndarray, n_lists: int, seed: int) -> Lists:
    """One level from the sample, or two: the upper centres from the sample, those below from more rows of each upper list."""
    if n_lists * ROWS_A_LIST <= SAMPLE:
        return Lists(sample.mean(0)[None], [k_means(sample, min(n_lists, len(sample)), seed=seed)])
    uppers = k_means(sample, min(len(sample), int(np.ceil(np.sqrt(n_lists)))), seed=seed)
    shared = rows.sparkSession.sparkContext.broadcast(Lists(uppers, [*uppers[:, None]]))

    @F.pandas_udf("int")
    def upper(vec: pd.Series) -> pd.Series:
        return pd.Series(shared.value.upper_of(np.stack(vec).astype(np.float64)).astype(np.int32))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.stack(pdf.sort_values(["h", "row"])["vec"]).astype(np.float64)
        centres = k_means(own, max(1, len(own) // ROWS_A_LIST), seed=seed)
        return pd.DataFrame({"upper": int(pdf["upper"].iloc[0]), "centres": [centres.tobytes()]})

    drawn = rows.withColumn("h", F.xxhash64("row")).where(F.pmod("h", F.lit(max(1, rows.count() // (n_lists * ROWS_A_LIST)))) == 0).withColumn("upper", upper("vec"))
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("upper").orderBy("h", "row"))).where(F.col("k") <= SAMPLE)
    found = {r["upper"]: np.frombuffer(r["centres"]).reshape(-1, uppers.shape[1]) for r in drawn.groupBy("upper").applyInPandas(fit, "upper int, centres binary").collect()}  # about n_lists centres
    return Lists(uppers, [found.get(u, uppers[u][None]) for u in range(len(uppers))])


def nearest(vectors: DataFrame, queries: Column | None = None, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", target: float = 0.97, width: int = 16, n_lists: int | None = None, seed: int = 7) -> DataFrame:
    """The k nearest rows (Euclidean) of each query among all other rows: query_id, rank (from 1), vec_id, score.

    queries: a condition on the column `id` (default: ids divisible by 100). Every row is indexed in one of about sqrt(rows) lists;
    lists, rotation and the number of lists to probe are fitted on bounded samples (SAMPLE, ROWS_A_LIST). Of equal vectors only
    the k + 1 smallest ids can be among any k nearest, so the others stay out of the lists. A list is dealt over blocks of about
    BLOCK rows, its queries over chunks of about CHUNK, and each block meets each chunk of its list in a task of its own.
    Vectors null, zero, of another length than most or holding null or non-finite components, and null ids, take no part. Each
    row is a candidate of its own, also where an id or a whole row repeats; a query is a row, which isn't its own neighbour;
    ties go to the smaller id; other columns don't matter; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    out_type = "query long, query_id long, vec_id long, score double"
    rows = cut(valid(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    asked = rows.where(F.col("id") % 100 == 0 if queries is None else queries)
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).select("vec").collect()], float)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, stored = sample.shape[1], np.dtype(np.float32 if isinstance(rows.schema["vec"].dataType.elementType, T.FloatType) else np.float64)
    index = Index(sample, _lists(rows, sample, n_lists or int(np.ceil(np.sqrt(n))), seed), k, target, seed)
    shared = spark.sparkContext.broadcast(index)  # the centres, about sqrt(rows), and BOUND_ROWS vectors
    size = -(-dims // width)

    equal = Window.partitionBy("vec").orderBy("id", "row")
    few = rows.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).drop("n")

    @F.pandas_udf("int")
    def list_of(vec: pd.Series) -> pd.Series:
        return pd.Series(shared.value.lists.of(np.stack(vec).astype(np.float64)).astype(np.int32))

    listed = cut(few.withColumn("list", list_of("vec")))
    counts = cut(listed.groupBy("list").agg(F.count("*").alias("n")).select("list", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    held = np.zeros(len(index.lists.centres), np.int64)
    for r in counts.collect():  # a row a list
        held[r["list"]] = r["n"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row"])
        whole = np.stack(pdf["vec"]).astype(stored)
        turned = np.zeros((len(pdf), size * width), np.float32)
        turned[:, :dims] = whole @ shared.value.turn
        columns = np.ascontiguousarray(turned.reshape(len(pdf), size, width).transpose(1, 0, 2))
        return pd.DataFrame({"list": [pdf["list"].iloc[0]], "part": [pdf["part"].iloc[0]], "keys": [pdf["row"].to_numpy(np.int64).tobytes()], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "columns": [columns.tobytes()], "rows": [whole.tobytes()]})

    dealt = listed.join(F.broadcast(counts.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    blocks = cut(dealt.groupBy("list", "part").applyInPandas(build, "list int, part int, keys binary, ids binary, columns binary, rows binary"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            keys, ids, vec = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), float)
            order, bound, turned = np.argsort(distances(vec, own.lists.centres), 1, kind="stable"), own.bounds(vec), (vec @ own.turn).astype(np.float32)
            enough = (np.cumsum(held[order], 1) < k + 1).sum(1) + 1  # lists until as many candidates as are asked for
            taken = np.minimum(np.maximum(own.probes, enough), order.shape[1])
            at = np.repeat(np.arange(len(ids)), taken)
            lists = np.concatenate([order[i, :t] for i, t in enumerate(taken)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(keys[at]), pa.array(ids[at]), pa.array([vec[i].astype(stored).tobytes() for i in at], pa.binary()), pa.array([turned[i].tobytes() for i in at], pa.binary()), pa.array(bound[at])], names=["list", "key", "query_id", "query", "turned", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            r = batch.to_pylist()[0]
            keys, ids = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["ids"], np.int64)
            columns = np.frombuffer(r["columns"], np.float32).reshape(size, len(ids), width)
            whole = np.frombuffer(r["rows"], stored).reshape(len(ids), dims)
            found = []
            for x in r["queries"]:
                turned = np.zeros(size * width, np.float32)
                turned[:dims] = np.frombuffer(x["turned"], np.float32)
                near, far = scan(keys, ids, columns, whole, x["key"], np.frombuffer(x["query"], stored).astype(np.float64), turned, x["bound"], k)
                found.append((np.full(len(near), x["key"]), np.full(len(near), x["query_id"]), ids[near], far))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query", "query_id", "vec_id", "score"])

    def search(some: DataFrame, bounded: bool) -> DataFrame:
        probes = some.select("row", "id", "vec").mapInArrow(probe, "list int, key long, query_id long, query binary, turned binary, bound double")
        probes = cut(probes if bounded else probes.withColumn("bound", F.lit(float("inf"))))
        plan = probes.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).join(counts.select("list", "parts"), "list")  # a row a list
        each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        chunks = probes.join(F.broadcast(plan), "list").withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
        chunks = chunks.groupBy("list", "parts", "chunk").agg(F.collect_list(F.struct("key", "query_id", "query", "turned", "bound")).alias("queries")).withColumn("part", each("parts")).drop("parts")
        spread = blocks.join(F.broadcast(plan.select("list", "chunks")), "list").withColumn("chunk", each("chunks")).drop("chunks")
        return cut(spread.join(chunks, ["list", "part", "chunk"]).select("keys", "ids", "columns", "rows", "queries").mapInArrow(run, out_type))

    met = search(asked, True)
    done = met.groupBy("query").count().where(F.col("count") >= min(k, int(held.sum()) - 1))
    short = cut(asked.join(done, asked["row"] == done["query"], "left_anti"))
    if not short.isEmpty():  # abandonment left a query too few: its lists again, without
        met = met.join(short.select(F.col("row").alias("query")), "query", "left_anti").unionByName(search(short, False))
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
