"""Packing documents into sequences of fixed capacity: cutting stock with column generation over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CHUNKS, LETTERS, PLAIN, Memory, Vocabulary, no_cycles, vocabulary
from .common import free, only, scratch, slices


class IdEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers, in a byte-level vocabulary.

    Chunks (white space and what follows up to the next) are encoded once while a bounded memory holds them: common
    letters by the rank merges of the same vocabulary, all other text by the tokenizers library itself.
    """

    def __init__(self, vocab: Vocabulary, limit: int = 200_000):
        if vocab.end or vocab.library.normalizer is not None:
            raise ValueError("needs a byte-level vocabulary without word ends and normaliser")
        import public_tokenizers

        value = {c: b for b, c in enumerate(LETTERS)}
        ranks = {bytes(map(value.__getitem__, s)): t for s, t in vocab.ids.items() if s not in vocab.specials}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocab, self.known = vocab, Memory(limit)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [[(s, None) if special else (s, CHUNKS.findall(s)) for s, special in self.vocab.segments(t)] for t in texts]
        known, plain = self.known, chr(PLAIN)
        for c in known.missing({c for parts in cut for _, chunks in parts if chunks for c in chunks}):
            ids = self.fast.encode_ordinary(c) if max(c) < plain else self.vocab.library.encode(c, add_special_tokens=False).ids
            known[c] = np.array(ids, "<u4").tobytes()
        get, special = known.__getitem__, self.vocab.specials
        return [b"".join([np.uint32(special[s]).astype("<u4").tobytes() if chunks is None else b"".join(map(get, chunks)) for s, chunks in parts]) for parts in cut]


_ENCODERS: dict[str, IdEncoder] = {}


def _price(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most that fits the capacity, and how many of each size; sizes ascend."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fit[c]:
            gain = worth[:k] + best[c - sizes[:k]]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], choice[c] = gain[i], i
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.003, max_columns: int = 6000) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each size) and how often each is used, so that every item is placed once.

    The linear program "fewest sequences" is solved by column generation: its duals price the sizes, the knapsack finds
    the best new pattern, and it ends when no pattern can lower the count by more than the share `gap`. Counts are
    rounded down; what then is left (less than a sequence a pattern) is packed largest first.
    """
    sizes, left = np.asarray(sizes, np.int64), np.asarray(demand, np.int64).copy()
    keep = left > 0
    sizes_, n = sizes[keep], left[keep].astype(float)
    m = len(n)
    out: list[tuple[np.ndarray, int]] = []

    def use(counts: np.ndarray, times: int) -> None:
        whole = np.zeros(len(sizes), np.int64)
        whole[keep] = counts
        left[keep] -= counts * times
        out.append((whole, times))

    if m:
        columns = np.diag(capacity // sizes_).astype(float)
        inverse = np.diag(1 / (capacity // sizes_))
        x = inverse @ n
        for _ in range(max_columns):
            worth = inverse.sum(0)
            value, counts = _price(sizes_, worth, capacity)
            if value <= 1 / (1 - gap):
                break
            step = inverse @ counts
            ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
            r = int(ratio.argmin())
            t = ratio[r]
            x = np.maximum(x - t * step, 0)
            x[r] = t
            row = inverse[r] / step[r]
            inverse -= np.outer(step, row)
            inverse[r] = row
            columns[:, r] = counts
        for k in np.argsort(-x, kind="stable"):
            counts = columns[:, k].astype(np.int64)
            have = left[keep]
            times = min(int(x[k] + 1e-7), *(int(have[i] // counts[i]) for i in np.flatnonzero(counts)), 1 << 62) if counts.any() else 0
            if times > 0:
                use(counts, times)
    order = np.argsort(-sizes_, kind="stable") if m else ()
    while left.any():
        have, room, counts = left[keep], capacity, np.zeros(m, np.int64)
        for i in order:
            if have[i] and sizes_[i] <= room:
                counts[i] = min(have[i], room // sizes_[i])
                room -= counts[i] * sizes_[i]
        use(counts, int(min(have[i] // counts[i] for i in np.flatnonzero(counts))))
    return out


def cut_documents(docs: DataFrame, vocab: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and `end_id` as pieces of `capacity` and a rest: id, start, length, ids_crc32, doc_tokens."""
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocab not in _ENCODERS:
            _ENCODERS[vocab] = IdEncoder(vocabulary(vocab))
        for batch in slices(batches):
            with no_cycles():
                found = _ENCODERS[vocab].encode([t or "" for t in batch.column(1).to_pylist()])
            row, start, length, crc, total = [], [], [], [], []
            for k, ids in enumerate(found):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    piece = ids[4 * s : 4 * (s + capacity)]
                    row.append(k)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    source = only(docs, id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocab: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", unit: int = 8, gap: float = 0.003, deal: int = 50_000) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    Returns a row for each piece: the id, start (the document's ids before it), length, ids_crc32 (of its unsigned
    32-bit little-endian ids), doc_tokens (ids with the closing id), sequence_id (from 0) and offset (gapless from 0).
    Only documents longer than a sequence are cut. The program counts in steps of `unit` tokens (it divides the capacity;
    lengths are rounded up, which pads less than a step a piece), so the driver gets a histogram of at most
    capacity / unit classes whatever the input. Ranks inside a class come from parts of about `deal` pieces, dealt by the number that each piece
    was written with, so neither a class that holds most pieces nor copies of one row are a single task. Null and empty texts are one piece of one id; null or repeated ids and repeated rows are
    documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch(spark, "pieces")
    if capacity % unit:
        raise ValueError("the unit must divide the capacity")
    number = free(docs, "piece")
    cut_documents(docs, vocab, capacity, id_col=id_col, text_col=text_col).withColumn(number, F.monotonically_increasing_id()).write.parquet(path)
    pieces = spark.read.parquet(path)
    classed = pieces.withColumn("class", F.expr(f"int((length + {unit - 1}) div {unit}) - 1"))
    demand = np.zeros(capacity // unit, np.int64)
    for r in classed.groupBy("class").agg(F.count("*").alias("n")).collect():
        demand[r["class"]] = r["n"]
    plan = cutting_stock(np.arange(1, len(demand) + 1), demand, len(demand), gap)
    base = [0, *accumulate(times for _, times in plan)]
    uses = {}  # of each class: patterns in order, their items before, items in a sequence, first sequence, first slot
    for p, (counts, times) in enumerate(plan):
        slot = 0
        for k in np.flatnonzero(counts)[::-1]:
            uses.setdefault(int(k), []).append((int(counts[k]), times, base[p], slot))
            slot += int(counts[k])
    tables = {k: (np.array([0, *accumulate(a * t for a, t, _, _ in u)]), np.array([a for a, _, _, _ in u]), np.array([b for _, _, b, _ in u]), np.array([s for _, _, _, s in u])) for k, u in uses.items()}

    salts = max(1, -(-int(demand.max(initial=0)) // deal))
    classed = classed.withColumn("part", F.pmod(F.xxhash64(number), F.lit(salts)))
    before = classed.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("class", "part", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = classed.withColumn("rank", F.row_number().over(Window.partitionBy("class", "part").orderBy(F.desc("length"), id_col, "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("sequence_id long, slot long")
    def place(kind, rank):
        sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        kind, rank = kind.to_numpy(), rank.to_numpy()
        for k in np.unique(kind):
            at = kind == k
            starts, items, first, slots = tables[int(k)]
            p = np.searchsorted(starts, rank[at], side="right") - 1
            inside = rank[at] - starts[p]
            sequence[at], slot[at] = first[p] + inside // items[p], slots[p] + inside % items[p]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    placed = ranked.withColumn("at", place("class", "rank")).select(id_col, "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.slot")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(offset, F.lit(0)).cast("long").alias("offset"))
