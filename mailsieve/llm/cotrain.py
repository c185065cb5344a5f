"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other, then score together."""

from __future__ import annotations

import pickle
import warnings
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, remove, scratch, slices

#: Hashed features of each view.
TEXT_BITS, META_BITS = 15, 10
#: Labelled rows that are fitted on: those whose ids hash smallest. Rows without label all take part in the exchange.
MAX_LABELLED = 4000
#: Bins of the histogram of confident scores; gradients are summed in units of 1 / GRAIN, so that no order of rows matters.
BINS, GRAIN = 4096, float(1 << 30)


def _slot(s: str, bits: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: every bit of the result depends on all of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


STEPS = (0.05, 0.2, 0.5)
SHAPES = ("letters", "upper", "digits", "mixed", "signs", "distinct", "top", "long", "none", "word")
_SHAPE_SLOTS = np.array([_slot(f"\0{name}{end}", TEXT_BITS) for name in SHAPES for end in (*(f">{x}" for x in STEPS), "")], np.int32)
#: Bytes of text whose words are counted at once; a longer text is counted by itself.
TEXT_BYTES = 4 << 20


def _word_table(words: pa.Array) -> np.ndarray:
    """Of each different word: slot, characters, and those in words of letters, capitals, digits, mixed signs, signs alone."""
    yes = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    ends -= ends[0]
    long = np.diff(ends)
    powers = np.cumprod(np.full(long.max(initial=0), 0x9E3779B97F4A7C15, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(ends[:-1], long)])])  # of bytes times powers by their place, modulo 2 ** 64
    slots = (_mixed(sums[ends[1:]] - sums[ends[:-1]]) >> np.uint64(64 - TEXT_BITS)).astype(np.int64)
    mixed = pc.and_(pc.invert(pc.utf8_is_alnum(words)), pc.invert(pc.utf8_is_alpha(pc.utf8_slice_codeunits(words, 0, -1))))
    signs = pc.invert(pc.match_substring_regex(words, r"[\pL\pN]"))
    n = yes(pc.utf8_length(words))
    return np.stack([slots, n, *(n * yes(x) for x in (pc.utf8_is_alpha(words), pc.utf8_is_upper(words), pc.utf8_is_digit(words), mixed, signs))], 1)


def _text_rows(texts: pa.Array) -> Rows:
    rows, size = len(texts), len(_SHAPE_SLOTS)
    split = pc.utf8_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy()
    row = np.repeat(np.arange(rows), np.diff(split.offsets.to_numpy()))
    order = pc.array_sort_indices(words).to_numpy()  # words in their own order, so that a row is the same in every batch
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    base, there = max(1, len(words)), pc.utf8_length(words).to_numpy()[at] > 0  # nothing stands before a leading space
    found, times = np.unique((row * base + rank[at])[there], return_counts=True)
    row, known = found // base, _word_table(words)[order[found % base]]
    total = lambda x: np.bincount(row, x, rows)
    n, distinct, chars, top = total(times), np.bincount(row, minlength=rows), total(times * known[:, 1]), np.zeros(rows)
    if len(row):
        top[distinct > 0] = np.maximum.reduceat(times, np.flatnonzero(np.diff(row, prepend=-1)))
    some, logs = np.maximum(1, n), 1.0 + np.log(times)
    shapes = [*(total(times * known[:, k]) / np.maximum(1, chars) for k in range(2, 7)), distinct / some, top / some, np.minimum(1.0, n / 1000), n == 0, np.minimum(2.0, np.maximum(1, chars) / some / 10)]
    extra = np.stack([x for v in shapes for x in (*(v > step for step in STEPS), v)], 1)
    ends = np.cumsum(distinct + size)
    slots, weights = np.empty(len(row) + rows * size, np.int32), np.empty(len(row) + rows * size, np.float32)
    place, last = np.arange(len(row)) + size * row, ends[:, None] - size + np.arange(size)
    slots[place], slots[last] = known[:, 0], _SHAPE_SLOTS
    weights[place], weights[last] = logs / np.sqrt(total(logs * logs))[row], extra
    return Rows(slots, weights, ends, TEXT_BITS)


def text_features(texts: pa.Array) -> Rows:
    """Slots and weights of whole texts: their words (log counts, unit length), their shapes, and how often they repeat.

    Words stand between white space. All of a batch's words are split, numbered and counted at once; a row doesn't depend on the
    others. Null counts as empty: no words.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes, found, start = pc.binary_length(texts).to_numpy(), [], 0
    while start < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[start:]), TEXT_BYTES, "right")))
        found.append(_text_rows(texts.slice(start, n)))
        start += n
    return Rows.joined(found, TEXT_BITS)


@lru_cache(1 << 16)
def meta_features(source, lang, n_chars) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of the row's metadata: source, language, coarse and fine size class, and pairs of them."""
    coarse, fine = ("?", "?") if n_chars is None else (str(int(k * np.log2(max(1, n_chars)))) for k in (1, 4))
    names = [f"s={source}", f"l={lang}", f"n={coarse}", f"m={fine}", f"s={source}|l={lang}", f"l={lang}|n={coarse}", f"l={lang}|m={fine}"]
    return np.array([_slot(x, META_BITS) for x in names], np.int32), np.ones(len(names), np.float32)


@dataclass
class Rows:
    """Sparse feature rows, one after the other."""

    slots: np.ndarray
    weights: np.ndarray
    ends: np.ndarray
    bits: int

    @classmethod
    def of(cls, pairs: list[tuple[np.ndarray, np.ndarray]], bits: int) -> Rows:
        ends = np.cumsum([len(s) for s, _ in pairs]) if pairs else np.zeros(0, np.int64)
        return cls(np.concatenate([s for s, _ in pairs] or [np.zeros(0, np.int32)]), np.concatenate([w for _, w in pairs] or [np.zeros(0, np.float32)]), ends, bits)

    @classmethod
    def joined(cls, parts: list[Rows], bits: int) -> Rows:
        if len(parts) == 1:
            return parts[0]
        sizes = [np.diff(x.ends, prepend=0) for x in parts]
        return cls(*(np.concatenate(x or [np.zeros(0, kind)]) for x, kind in (([p.slots for p in parts], np.int32), ([p.weights for p in parts], np.float32))), np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)])), bits)

    def binaries(self) -> tuple[pa.Array, pa.Array]:
        """Slots (16 bits each) and weights (32 bits each) of every row."""
        def column(values: np.ndarray) -> pa.Array:
            offsets = np.concatenate([[0], self.ends]) * values.itemsize
            return pa.Array.from_buffers(pa.large_binary(), len(self.ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())

        return column(np.ascontiguousarray(self.slots, np.int16)), column(np.ascontiguousarray(self.weights, np.float32))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row(), self.weights * w[self.slots], len(self.ends))


@dataclass
class View:
    """A logistic regression and its calibration (a slope and an intercept on its margin)."""

    bits: int
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    b: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    square: np.ndarray = field(default_factory=lambda: np.zeros(0))
    square_b: float = 1e-8

    def fit(self, x: Rows, y: np.ndarray, use: np.ndarray, rounds: int = 120, decay: float = 1e-4, rate: float = 0.5) -> None:
        """AdaGrad from zero on all rows with use > 0 (their weights)."""
        self.w, self.b = np.zeros(1 << self.bits), 0.0
        self.square, self.square_b = np.full(1 << self.bits, 1e-8), 1e-8
        row = x.row()
        live = use[row] > 0
        row, slots, weights, total = row[live], x.slots[live], x.weights[live], use.sum()
        if not total:
            return
        for _ in range(rounds):
            margin = np.bincount(row, weights * self.w[slots], len(y)) + self.b
            error = (1 / (1 + np.exp(-margin.clip(-30, 30))) - y) * use / total
            self.step(np.bincount(slots, weights * error[row], 1 << self.bits), float(error.sum()), decay, rate)

    def step(self, grad: np.ndarray, grad_b: float, decay: float = 1e-4, rate: float = 0.5) -> None:
        """One step of AdaGrad, from mean gradients."""
        grad = grad + decay * self.w
        self.square += grad * grad
        self.w -= rate * grad / np.sqrt(self.square)
        self.square_b += grad_b**2
        self.b -= rate * grad_b / np.sqrt(self.square_b)

    def calibrate(self, margin: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows that weren't fitted on, with its smoothed targets: a few Newton steps."""
        good, n = y.sum(), len(y)
        target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (n - good + 2))
        a, c = 0.0, float(np.log((good + 1) / (n - good + 1)))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * margin + c).clip(-30, 30)))
            g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
            v = p * (1 - p)
            h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, c = a - step[0], c - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = max(float(a), 0.0), float(c)  # a view that would have to be turned round says nothing

    def logit(self, margin: np.ndarray) -> np.ndarray:
        return (self.slope * margin + self.shift).clip(-12, 12)


def _rows(batch: pa.RecordBatch) -> tuple[Rows, Rows]:
    """Feature rows of both views in a batch of the columns that _features makes."""
    def one(slots: str, weights: str, kind: type, bits: int) -> Rows:
        s = batch.column(batch.schema.get_field_index(slots)).to_pylist()
        ends = np.cumsum([len(x) // np.dtype(kind).itemsize for x in s], dtype=np.int64)
        return Rows(np.frombuffer(b"".join(s), kind), np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(weights)).to_pylist()), np.float32), ends, bits)

    return one("ts", "tw", np.int16, TEXT_BITS), one("ms", "mw", np.int16, META_BITS)


def _features(rows: DataFrame, *keep: str) -> DataFrame:
    """Slots and weights of both views for rows of text, source, lang and n_chars, and the columns to keep."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, meta = text_features(batch.column(0)), Rows.of([meta_features(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)], META_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], *words.binaries(), *meta.binaries()], names=[*keep, "ts", "tw", "ms", "mw"])

    source = rows.select("text", "source", "lang", "n_chars", *keep)
    kept = "".join(f"{c} {source.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, kept + "ts binary, tw binary, ms binary, mw binary")


def _raw(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), *[_column(docs, name, kind).alias(name) for name, kind in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))])


def labelled_ids(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, y and n (the place among the ids) of at most max_labelled labelled ids, by the hash of their ids."""
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    some = ids.join(marks, "id").select("id", (F.col("y") >= 0.5).cast("double").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    return cut(some.select("id", "y", (F.row_number().over(Window.orderBy("id")) - 1).alias("n")))


def _held(n: np.ndarray) -> np.ndarray:
    """A fifth of the labelled rows, which isn't fitted on; of few rows all are both."""
    return n % 5 == 0 if len(n) >= 10 else np.ones(len(n), bool)


def _draw(tie: np.ndarray, k: int) -> np.ndarray:
    """A number from 0 to 1 of each row's hash, another one for each k."""
    h = tie.astype(np.int64).view(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _sure(margins: list[np.ndarray], views: tuple[View, View], uses: list[np.ndarray], confident: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each view and label: the other view, the label, the rows the other view may learn it for, and the bin of their score."""
    least = float(np.log(confident / (1 - confident)))
    for k, v in enumerate(views):
        logit = v.logit(margins[k])
        for label in (1, 0):
            z = logit if label else -logit
            free = np.flatnonzero((uses[1 - k] == 0) & (z >= least))
            yield 1 - k, label, free, np.minimum((z[free] - least) / (12 - least) * BINS, BINS - 1).astype(np.int64)


def _taught(data: tuple[Rows, Rows], tie: np.ndarray, past: list, confident: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Targets and uses of rows for both views after the exchanges so far (views and the last bins taken, with the share taken of each)."""
    n = len(tie)
    targets, uses = [np.zeros(n), np.zeros(n)], [np.zeros(n), np.zeros(n)]
    for r, (views, last) in enumerate(past):
        margins = [x.times(v.w) + v.b for v, x in zip(views, data, strict=True)]
        for other, label, free, bins in _sure(margins, views, uses, confident):
            least, share = last[other, label]
            taken = free[(bins > least) | (bins == least) & (_draw(tie[free], 4 * r + 2 * other + label) < share)]
            targets[other][taken], uses[other][taken] = label, 0.5
    return targets, uses


def _last_bin(counts: dict[int, int], most: int) -> tuple[int, float]:
    """The lowest bin to take so that the surest `most` rows are taken, and the share of that bin."""
    left = most
    for b in sorted(counts, reverse=True):
        if counts[b] >= left:
            return b, left / counts[b]
        left -= counts[b]
    return -1, 0.0


def _on_known(known: DataFrame, work: Callable[[tuple[Rows, Rows], np.ndarray, np.ndarray], object]):
    """work(features, labels, held-out rows) in one task on the labelled rows, whose number is bounded; what it returns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches]).sort_by("n").combine_chunks() if (batches := [*batches]) else None
        if rows is not None and rows.num_rows:
            y = rows["y"].to_numpy()
            out = work(_rows(rows.to_batches()[0]), y, np.flatnonzero(_held(rows["n"].to_numpy())))
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(out)], pa.binary())})

    found = known.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def _calibrated(views: tuple[View, View], data: tuple[Rows, Rows], y: np.ndarray, held: np.ndarray, prior: float) -> float:
    """Calibrates both views on the held-out rows; their joint accuracy there."""
    joint = -prior
    for v, x in zip(views, data, strict=True):
        margin = (x.times(v.w) + v.b)[held]
        v.calibrate(margin, y[held])
        joint = joint + v.logit(margin)
    return float(((joint > 0) == (y[held] > 0.5)).mean())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", rounds: int = 3, confident: float = 0.9, share: float = 0.1, steps: int = 12, at: str | None = None, **bounds) -> tuple[View, View, float, dict] | None:
    """Co-trained views of a table, or None if the labels have no two classes: both views, the prior logit, figures.

    Both views are first fitted in one task on the labelled rows, one a labelled id, a fifth of which is held out for
    calibration. All other rows are the pool (rows with labels beyond the bound too, without their labels). In every
    round all of the pool is scored and each view hands the other the rows it is surest of, at most `share` of the pool
    and in the proportion of the classes, as labels; a histogram of the scores tells where to stop, and hashes of the rows
    which of equal scores to take. Then AdaGrad goes on for `steps` steps over labelled and handed rows; each sums the
    gradients, of fixed width, over the partitions. The driver holds two weight vectors. Results don't depend on the order
    or partitions of rows. Features are computed once and written to `at` (default: a new path in the shared folder).
    """
    spark = docs.sparkSession
    picked = labelled_ids(docs, labels, id_col, label, **bounds)
    if at is None:
        at = scratch(spark, "cotrain-features")
    source = _raw(docs, id_col).join(F.broadcast(picked), "id", "left").withColumn("tie", F.xxhash64("id", "text", "source", "lang", "n_chars"))
    _features(source, "tie", "id", "y", "n").write.parquet(at)  # once for all passes
    rows = spark.read.parquet(at)
    names = ("ts", "tw", "ms", "mw")
    known = cut(rows.where("y is not null").groupBy("id").agg(F.min(F.struct(*names)).alias("r"), F.first("y").alias("y"), F.first("n").alias("n")).select("y", "n", "r.*"))

    def start(data: tuple[Rows, Rows], y: np.ndarray, held: np.ndarray):
        if len({*y}) < 2:
            return None
        prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        use = np.ones(len(y))
        if len(y) >= 10:
            use[held] = 0
        views = View(TEXT_BITS), View(META_BITS)
        for v, x in zip(views, data, strict=True):
            v.fit(x, y, use)
        return views, prior, {"labelled": int(use.sum()), "held_out": len(held), "accuracy": _calibrated(views, data, y, held, prior), "to_text": 0, "to_meta": 0}

    def adjust(data: tuple[Rows, Rows], y: np.ndarray, held: np.ndarray):
        return views, _calibrated(views, data, y, held, prior)

    if not (found := _on_known(known, start)):
        return None
    views, prior, figures = found
    pool = rows.where("y is null").select("tie", *names)
    size, good, past = pool.count(), 1 / (1 + np.exp(-prior)), []
    figures["pool"] = size
    for _ in range(rounds if size else 0):
        last = _surest(pool, past, views, confident, max(1, int(share * size)), good)
        past = [*past, (tuple(View(v.bits, v.w.copy(), v.b, v.slope, v.shift) for v in views), last)]
        taught_at = scratch(spark, "cotrain-taught")
        _handed(pool, known, figures["labelled"] + figures["held_out"], past, confident).write.parquet(taught_at)
        taught = spark.read.parquet(taught_at)
        sums = taught.agg(F.sum("u0"), F.sum("u1"), F.count_if(F.col("u0") == 0.5), F.count_if(F.col("u1") == 0.5)).first()
        figures["to_text"], figures["to_meta"] = sums[2], sums[3]
        for _ in range(steps):
            for k, (grad, grad_b) in enumerate(_gradients(taught, views)):
                views[k].step(grad / sums[k], grad_b / sums[k])
        remove(spark, taught_at)
        views, figures["accuracy"] = _on_known(known, adjust)
    return *views, prior, figures


def _surest(pool: DataFrame, past: list, views: tuple[View, View], confident: float, most: int, good: float) -> dict[tuple[int, int], tuple[int, float]]:
    """Of each view that learns and each label: the last bin of the scores to take and the share of it, from a histogram over the pool."""
    held = pool.sparkSession.sparkContext.broadcast((past, views))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in slices(batches):
            data, (past, views) = _rows(batch), held.value
            _, uses = _taught(data, batch.column(0).to_numpy(), past, confident)
            for other, label, _, bins in _sure([x.times(v.w) + v.b for v, x in zip(views, data, strict=True)], views, uses, confident):
                for b, n in zip(*np.unique(bins, return_counts=True), strict=True):
                    counts[other, label, int(b)] += int(n)
        columns = [*zip(*((*key, n) for key, n in counts.items()), strict=True)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["other", "label", "bin", "n"])

    found = pool.mapInArrow(run, "other long, label long, bin long, n long").groupBy("other", "label", "bin").agg(F.sum("n").alias("n")).collect()  # at most 4 * BINS rows
    held.destroy()
    parts = {1: good, 0: 1 - good}
    return {(k, y): _last_bin({r["bin"]: r["n"] for r in found if (r["other"], r["label"]) == (k, y)}, max(1, int(most * parts[y]))) for k in (0, 1) for y in (0, 1)}


def _handed(pool: DataFrame, known: DataFrame, n_known: int, past: list, confident: float) -> DataFrame:
    """Features, targets (t0, t1) and weights (u0, u1) for each view: the labelled rows that are fitted on, and the pool's rows handed so far."""
    held = pool.sparkSession.sparkContext.broadcast(past)
    names = ["ts", "tw", "ms", "mw", "t0", "t1", "u0", "u1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            targets, uses = _taught(_rows(batch), batch.column(0).to_numpy(), held.value, confident)
            marked = pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, (*targets, *uses))], names=names)
            yield marked.filter(pa.array((uses[0] > 0) | (uses[1] > 0)))

    own = known.where("n % 5 <> 0") if n_known >= 10 else known
    one = F.lit(1.0)
    return pool.mapInArrow(run, "ts binary, tw binary, ms binary, mw binary, t0 double, t1 double, u0 double, u1 double").unionByName(
        own.select("ts", "tw", "ms", "mw", F.col("y").alias("t0"), F.col("y").alias("t1"), one.alias("u0"), one.alias("u1")))


def _gradients(taught: DataFrame, views: tuple[View, View]) -> list[tuple[np.ndarray, float]]:
    """Summed gradients of each view's weights and intercept, as whole multiples of 1 / GRAIN."""
    held = taught.sparkSession.sparkContext.broadcast([(v.w, v.b) for v in views])
    widths = [1 << v.bits for v in views]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(n + 1, np.int64) for n in widths]  # the intercept's last
        for batch in slices(batches):
            for k, x in enumerate(_rows(batch)):
                (w, b), t, u = held.value[k], batch.column(4 + k).to_numpy(), batch.column(6 + k).to_numpy()
                error = (1 / (1 + np.exp(-(x.times(w) + b).clip(-30, 30))) - t) * u
                sums[k][:-1] += np.bincount(x.slots, np.rint(x.weights * error[x.row()] * GRAIN), widths[k]).astype(np.int64)
                sums[k][-1] += int(np.rint(error * GRAIN).sum())
        for k, g in enumerate(sums):
            at = np.flatnonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(g[at])], names=["k", "slot", "g"])

    found = taught.mapInArrow(run, "k long, slot long, g long").groupBy("k", "slot").agg(F.sum("g").alias("g")).toArrow()
    held.destroy()
    out = [np.zeros(n + 1) for n in widths]
    for k, g in enumerate(out):
        own = found["k"].to_numpy() == k
        g[found["slot"].to_numpy()[own]] = found["g"].to_numpy()[own] / GRAIN
    return [(g[:-1], float(g[-1])) for g in out]


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", label: str = "quality", fit_on: DataFrame | None = None, **bounds) -> DataFrame:
    """Quality of every document: the id, text_score, meta_score, score (calibrated probabilities) and keep (score >= threshold).

    The score adds the views' calibrated logits and takes away the prior that both hold. fit_on: the documents that the labels
    are joined to and the exchange runs over (default: docs); a table that was filtered before may have lost one class. Of
    the labelled rows at most MAX_LABELLED are fitted on; all others take part in the exchange, and every whole text is
    scored. Null and empty texts have a class of their own among the features; null or missing metadata count as a value;
    null ids and repeated rows keep a row each; repeated labels are averaged; without labels of two classes there is a
    warning, all scores are null and every document is kept; an empty table gives no rows.
    """
    if fit_on is None:  # what was fitted on is what is scored: its features are there
        at = scratch(docs.sparkSession, "cotrain-features")
        model = _fitted(docs, labels, id_col, label, at=at, **bounds)
        rows = _scored(docs.sparkSession.read.parquet(at), model, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
    else:
        rows = docs.select(F.col(f"`{id_col}`"), _judged(docs, _fitted(fit_on, labels, id_col, label, **bounds)).alias("view")).select(F.col(f"`{id_col}`"), "view.*")
    return rows.withColumn("keep", _kept(F.col("score"), threshold))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", label: str = "quality", fit_on: DataFrame | None = None, **bounds) -> DataFrame:
    """The documents that `score` keeps, with all their columns, whatever these are called.

    What holds for nulls, empty texts, repeated rows, missing classes and empty tables there holds here; see fit_on, too.
    """
    view = free(docs, "view")
    model = _fitted(docs if fit_on is None else fit_on, labels, id_col, label, **bounds)
    return docs.withColumn(view, _judged(docs, model)).where(_kept(F.col(f"{view}.score"), threshold)).drop(view)


def _kept(score: Column, threshold: float) -> Column:
    return F.coalesce(score >= threshold, F.lit(True))


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, label: str, **options) -> tuple[View, View, float] | None:
    model = fit(docs, labels, id_col, label, **options)
    if model is None:
        warnings.warn("the labels have no two classes among the documents: every document is kept", stacklevel=3)
    return model and (*model[:2], model[2])


def _probabilities(model: tuple[View, View, float], margins: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of the text view, the metadata view and both."""
    u, v = (view.logit(m) for view, m in zip(model, margins))
    return [1 / (1 + np.exp(-z)) for z in (u, v, u + v - model[2])]


def _scored(rows: DataFrame, model: tuple[View, View, float] | None, id_type: str) -> DataFrame:
    """id and the three scores of rows of features."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if held.value is None:
                scores = [pa.nulls(batch.num_rows, pa.float64())] * 3
            else:
                scores = [*map(pa.array, _probabilities(held.value, [x.times(v.w) + v.b for x, v in zip(_rows(batch), held.value)]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *scores], names=["id", "text_score", "meta_score", "score"])

    return rows.select("id", "ts", "tw", "ms", "mw").mapInArrow(run, f"id {id_type}, text_score double, meta_score double, score double")


def _judged(docs: DataFrame, model: tuple[View, View, float] | None) -> Column:
    """A struct of the three scores."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors of fixed size

    @F.pandas_udf("text_score double, meta_score double, score double")
    def judge(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        names, n = ("text_score", "meta_score", "score"), len(text)
        if held.value is None:
            return pd.DataFrame({c: pd.array([None] * n, "Float64") for c in names})
        meta = Rows.of([meta_features(s, x, None if pd.isna(k) else int(k)) for s, x, k in zip(source, lang, n_chars, strict=True)], META_BITS)
        margins = [x.times(v.w) + v.b for x, v in zip((text_features(pa.array(text, pa.string(), from_pandas=True)), meta), held.value)]
        return pd.DataFrame(dict(zip(names, _probabilities(held.value, margins), strict=True)))

    return judge(*(_column(docs, name, kind) for name, kind in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))))


def _column(docs: DataFrame, name: str, kind: str) -> Column:
    return F.col(f"`{name}`").cast(kind) if name in docs.columns else F.lit(None).cast(kind)
