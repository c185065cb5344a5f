"""SimHash near-duplicates: tiled exact comparison of fingerprints, skipping tiles whose population counts are too far apart."""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free, join_hot, only, slices
from .graph import components

SEED = 42
#: Most fingerprints of a tile, and tiles that a smaller input is cut into, so that all executors compare.
LARGEST_TILE, FEWEST_TILES = 65_536, 12
#: Documents and bytes of shingle sets of a block that is checked exactly in one task.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 of each k-word shingle (words between ASCII white space, A-Z lower-cased, one space between); fewer words: of all; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(line, SEED)]
    ends = [*itertools.accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends[: len(words) - k]]
    return [digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)]


def _mix(h: np.ndarray) -> np.ndarray:
    """More bits from a hash: the finaliser of a 64-bit generator."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(hashes: list[int], words: int = 1) -> np.ndarray:
    """`words` 64-bit words: each bit is 1 if set in over half of the hashes (repeats count); no hashes: zero."""
    n, out = len(hashes), np.zeros(words, np.uint64)
    h = np.array(hashes, np.uint64)
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > n).view(">u8")[0]
        h = _mix(h)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """The id, fp (array of `words` longs) of every whole text, and the columns to keep.

    distinct: each different shingle counts once, as in a Jaccard similarity of sets; otherwise repeats count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = (shingle_hashes(t, shingle) for t in batch.column(1).to_pylist())
            fps = [fingerprint([*{*h}] if distinct else h, words).view(np.int64) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64())), *batch.columns[2:]], names=["id", "fp", *keep])

    source = only(docs, id_col, text_col, *keep)
    kept = "".join(f", `{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, fp array<bigint>{kept}")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every row of a with every row of b (rows of 64-bit words)."""
    far = np.bitwise_count(a[:, 0, None] ^ b[None, :, 0])
    if a.shape[1] > 3:
        far = far.astype(np.uint16)
    for k in range(1, a.shape[1]):
        far += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return far


def block_counts(fps: np.ndarray, blocks: int) -> np.ndarray:
    """Population counts of `blocks` equal parts of each row's bits."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8)).reshape(len(fps), blocks, -1).sum(2, dtype=np.int64)


def near_counts(blocks: int, size: int, radius: int) -> list[tuple[int, ...]]:
    """The differences of population counts that can stand within the radius, one of each pair of opposites."""
    step = range(-min(radius, size), min(radius, size) + 1)
    return [d for d in itertools.product(step, repeat=blocks) if sum(map(abs, d)) <= radius and d >= (0,) * blocks]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links within the radius between rows of a and b (None: within a) that join what isn't joined yet.

    Rows are numbered through a, then b. Every link left out runs inside one group of those returned.
    """
    own = b is None
    b = a if own else b
    shift = 0 if own else len(a)
    group = np.arange(len(a) if own else len(a) + len(b))
    found = []
    for start in range(0, len(b), 4096):  # blocks of a size that stays in a core's cache
        part = b[start : start + 4096]
        for at in range(0, min(len(a), start + len(part)) if own else len(a), 64):
            near = distances(a[at : at + 64], part) <= radius
            if own and at + 64 > start:
                near &= np.arange(start, start + len(part))[None, :] > np.arange(at, at + len(near))[:, None]
            for i in np.flatnonzero(near.any(1)):
                hits = shift + start + np.flatnonzero(near[i])
                new = hits[group[hits] != group[at + i]]
                if len(new):
                    groups, first = np.unique(group[new], return_index=True)
                    found += [(int(at + i), int(new[f])) for f in first]
                    group[np.isin(group, groups)] = group[at + i]
    return found


def tile_pairs(fps: DataFrame, radius: int, words: int, blocks: int, tile: int | None = None) -> DataFrame:
    """Tiles of at most about `tile` fingerprints side by side, where their population counts allow links within the radius.

    fps: node (a long, distinct) and fp (array of `words` longs). A cell holds fingerprints with the same population count
    in each of `blocks` equal parts (one block: neighbouring counts share a cell while it is smaller than a tile); the
    counts of two fingerprints within the radius differ by that much at most in sum, so other cells never meet. Larger
    cells are dealt over several tiles. What the driver gets is a count for each cell, whose number the width fixes.
    Returns c1, p1, c2, p2 and sides: one (a tile with itself) or two of struct(side, nodes, w0, w1, ...).
    """
    size = words * 64 // blocks
    base = size + 1

    @F.pandas_udf("long")
    def code(fp: pd.Series) -> pd.Series:
        return pd.Series(block_counts(np.stack(fp), blocks) @ base ** np.arange(blocks, dtype=np.int64))

    keyed = cut(fps.select("node", "fp", code("fp").alias("code")))
    counts = {r["code"]: r["count"] for r in keyed.groupBy("code").count().collect()}  # at most base ** blocks
    n = sum(counts.values())
    most = tile or min(LARGEST_TILE, max(2048, -(-n // FEWEST_TILES)))
    if blocks == 1:
        cells, spans = {}, []  # of each count its cell; of each cell the first and last count, and fingerprints
        for c in sorted(counts):
            if not spans or spans[-1][2] + counts[c] > most:
                spans.append([c, c, 0])
            spans[-1][1] = c
            spans[-1][2] += counts[c]
            cells[c] = len(spans) - 1
        held = [k for _, _, k in spans]
        met = [(i, j) for i in range(len(spans)) for j in range(i, len(spans)) if spans[j][0] - spans[i][1] <= radius]
    else:
        cells = {c: i for i, c in enumerate(sorted(counts))}
        held = [counts[c] for c in sorted(counts)]
        steps, met = near_counts(blocks, size, radius), []
        for c, i in cells.items():
            digits = [c // base**k % base for k in range(blocks)]
            for d in steps:
                if all(0 <= x + y < base for x, y in zip(digits, d, strict=True)):
                    j = cells.get(sum((x + y) * base**k for k, (x, y) in enumerate(zip(digits, d, strict=True))))
                    if j is not None:
                        met.append((i, j))
    parts = [-(-k // most) for k in held]
    meets: dict[int, list[tuple[int, int, int]]] = {}  # of each cell: c1, c2, side
    for i, j in met:
        meets.setdefault(i, []).append((i, j, 0))
        if i != j:
            meets.setdefault(j, []).append((i, j, 1))
    pairs = sum(parts[i] * parts[j] if i != j else parts[i] * (parts[i] + 1) // 2 for i, j in met)
    work = sum(held[i] * held[j] for i, j in met) * words

    def meetings(cell: int, part: int) -> list[tuple[int, int, int, int, int]]:
        out = []
        for i, j, side in meets.get(cell, ()):
            if i == j:
                out += [(i, part, j, p, 0) for p in range(part, parts[i])] + [(i, p, j, part, 1) for p in range(part)]
            elif side == 0:
                out += [(i, part, j, p, 0) for p in range(parts[j])]
            else:
                out += [(i, p, j, part, 1) for p in range(parts[i])]
        return out

    @F.pandas_udf("array<struct<c1:int,p1:int,c2:int,p2:int,side:int>>")
    def partners(cell: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("c1", "p1", "c2", "p2", "side"), x)) for x in meetings(c, p)] for c, p in zip(cell.tolist(), part.tolist())])

    @F.pandas_udf("int")
    def cell_of(c: pd.Series) -> pd.Series:
        return c.map(cells).astype("int32")

    @F.pandas_udf("int")
    def parts_of(c: pd.Series) -> pd.Series:
        return pd.Series(np.array(parts or [1])[c.to_numpy()].astype("int32"))

    dealt = keyed.withColumn("cell", cell_of("code")).withColumn("part", F.pmod(F.xxhash64("node"), parts_of("cell")).cast("int"))
    rows = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("node", *[F.get("fp", k).alias(f"w{k}") for k in range(words)])).alias("rows"))
    column = lambda name: F.transform("rows", lambda x: x[name]).alias(name)
    tiles = cut(rows.select("cell", "part", column("node"), *[column(f"w{k}") for k in range(words)]))
    spread = tiles.withColumn("to", F.explode(partners("cell", "part"))).select("to.c1", "to.p1", "to.c2", "to.p2", F.struct("to.side", "node", *[f"w{k}" for k in range(words)]).alias("x"))
    keys = ["c1", "p1", "c2", "p2"]
    tasks = int(max(1, min(pairs, 24 + work // 500_000_000)))
    return spread.repartition(tasks, *keys).groupBy(*keys).agg(F.collect_list("x").alias("sides"))


def links(fps: DataFrame, radius: int, words: int = 1, blocks: int = 4, tile: int | None = None) -> DataFrame:
    """Links (a, b) that join all fingerprints within the radius: a spanning forest of each tile pair, not all its pairs."""
    spark = fps.sparkSession
    pairs = tile_pairs(fps, radius, words, blocks, tile)

    def side(x: pa.StructArray, i: int) -> tuple[np.ndarray, np.ndarray]:
        column = lambda name: x.field(name)[i].values.to_numpy()
        return column("node"), np.stack([column(f"w{k}").view(np.uint64) for k in range(words)], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k in range(batch.num_rows):
                sides = batch.column(0)[k].values
                order = np.argsort(sides.field("side").to_numpy())
                nodes, a = side(sides, order[0])
                b = None
                if len(order) == 2:
                    more, b = side(sides, order[1])
                    nodes = np.concatenate([nodes, more])
                if found := forest(a, b, radius):
                    at = np.array(found)
                    yield pa.RecordBatch.from_pydict({"a": pa.array(nodes[at[:, 0]]), "b": pa.array(nodes[at[:, 1]])})

    found = cut(pairs.select("sides").mapInArrow(run, "a long, b long"))
    return found


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document, where fingerprints at `radius` or fewer differing bits are linked.

    Returns the id, fingerprint (16 hex digits) and component_id (the smallest id reachable). Equal fingerprints meet as
    one node, so copies never make pairs. Null and empty texts have the fingerprint zero and are linked like any other;
    null ids keep their row but name no component (null if no member has an id); repeated rows keep one row each.
    """
    found = cut(fingerprints(docs, shingle, 1, id_col, text_col))
    nodes = cut(found.groupBy(F.get("fp", 0).alias("node")).agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    joined = components(links(nodes.select("node", F.array("node").alias("fp")), radius))
    placed = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(placed.join(least, "component").select("node", "component_id", "n"))
    own = found.select(F.col(f"`{id_col}`"), F.get("fp", 0).alias("node"))
    return join_hot(own, named, "node", "n", found.count()).select(id_col, F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def check_block(group: np.ndarray, left: np.ndarray | None, fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of group names that rows within the radius and as similar as asked for join.

    group: rows with equal values count as joined. left: rows with left set are compared only with the others (None: all).
    Every pair that would pass and is left out runs inside one group of those joined.
    """
    far = distances(fps, fps)
    near = np.triu(far <= radius, 1)
    if left is not None:
        near &= left[:, None] != left[None, :]
    near &= group[:, None] != group[None, :]
    sizes = np.array([len(s) for s in sets])
    near &= np.minimum(sizes[:, None], sizes[None, :]) >= similarity * np.maximum(sizes[:, None], sizes[None, :])
    x, y = np.nonzero(near)
    order = np.argsort(far[x, y], kind="stable")
    parent = {g: g for g in group.tolist()}

    def top(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    out, names = [], group.tolist()
    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
        u, v = top(names[i]), top(names[j])
        if u == v:
            continue
        p, q = sets[i], sets[j]
        both = 0
        if len(p) and len(q):
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            both = int((q[at] == p).sum())
        if both >= similarity * (len(p) + len(q) - both):
            parent[max(u, v)] = min(u, v)
            out.append((u, v))
    return out


def _block(pdf: pd.DataFrame, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    fps = np.stack(pdf["fp"].to_numpy()).astype(np.int64).view(np.uint64).reshape(len(pdf), words)
    return fps, [np.frombuffer(s, np.uint64) for s in pdf["set"]]


def _join_blocks(rows: DataFrame, keys: list[str], radius: int, similarity: float, words: int, two: bool = False) -> DataFrame:
    """Links (a, b) of labels that check_block finds in each group of rows; two: rows hold a column `left`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = check_block(pdf["label"].to_numpy(), pdf["left"].to_numpy() if two else None, *_block(pdf, words), radius, similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy(*keys).applyInPandas(run, "a long, b long")


def similar_groups(members: DataFrame, radius: int, similarity: float, words: int) -> DataFrame:
    """node and label (the smallest node of its group), where pairs within the radius whose sets are as similar as asked for are joined.

    members: node, component (links run inside components), fp, set. A component is dealt over blocks of at most about
    BLOCK_ROWS rows and BLOCK_BYTES bytes; each block is checked in itself, which settles components of one block. In the
    others, one member of each group found is checked with the other ones; then blocks with other blocks, where groups of
    over half a block have blocks of their own that needn't meet. So no task gets a whole component, and a large group
    whose members are alike is compared little.
    """
    weight = F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.length("set")) / BLOCK_BYTES)

    def deal(rows: DataFrame, *keys: str) -> DataFrame:
        parts = rows.groupBy(*keys).agg(F.greatest(F.ceil(weight), F.lit(1)).cast("int").alias("parts"))
        return rows.join(parts, [*keys]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf["node"].to_numpy()
        least = {n: n for n in nodes.tolist()}
        for u, v in check_block(nodes, None, *_block(pdf, words), radius, similarity):
            least[max(u, v)] = min(u, v)
        for n in sorted(least):
            least[n] = least[least[n]]
        return pd.DataFrame({"node": nodes, "label": [least[n] for n in nodes.tolist()], "parts": pdf["parts"]})

    dealt = cut(deal(members, "component"))
    first = cut(dealt.groupBy("component", "part").applyInPandas(settle, "node long, label long, parts int"))
    several = first.where("parts > 1")
    if several.isEmpty():
        return first.select("node", "label")
    large = dealt.where("parts > 1").select("node", "component", "fp", "set").join(several.select("node", "label"), "node")
    heads = large.where("node = label").join(several.where("node <> label").select("label").distinct(), "label", "left_semi")
    met = components(_join_blocks(deal(heads, "component"), ["component", "part"], radius, similarity, words)).select(F.col("node").alias("label"), F.col("component").alias("to"))
    some = large.join(met, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    sizes = some.groupBy("label").agg((F.count("*") >= BLOCK_ROWS // 2).alias("big"))
    some = some.join(sizes, "label").withColumns({"rest": ~F.col("big"), "kind": F.when(F.col("big"), F.col("label")).otherwise(0)}).drop("big")
    some = cut(deal(some, "component", "rest", "kind").withColumn("own", F.struct("rest", "kind", "part")))
    blocks = cut(some.select("component", "own").distinct())  # as many rows as blocks
    pairs = blocks.withColumnRenamed("own", "x").join(blocks.withColumnRenamed("own", "y"), "component")
    pairs = pairs.where("x < y and (x.rest or y.rest or x.kind <> y.kind) or x = y and x.rest").withColumn("own", F.explode(F.array_distinct(F.array("x", "y"))))
    spread = some.join(pairs, ["component", "own"]).select("component", "x", "y", F.expr("own = x").alias("left"), "label", "fp", "set")
    crossed = _join_blocks(spread.where("x <> y"), ["component", "x", "y"], radius, similarity, words, two=True)
    inside = _join_blocks(spread.where("x = y"), ["component", "x"], radius, similarity, words)
    last = components(crossed.unionByName(inside)).select(F.col("node").alias("label"), F.col("component").alias("to"))
    placed = some.select("node", "label").join(last, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return first.where("parts = 1").select("node", "label").unionByName(placed)


def _words_digest(text: Column) -> Column:
    """A digest of a text's words: equal for texts that are equal but for ASCII case and white space."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.md5(F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " ")))


def dedupe(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4, radius: int = 66, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near-duplicates; all columns stay, whatever their names.

    Documents are linked if their fingerprints of 64 * words bits differ in at most `radius` bits and the Jaccard
    similarity of their sets of `shingle`-word shingles is at least `similarity`, which is checked on whole texts; the
    fingerprints are of these sets too, so a line repeated more often in one copy doesn't part it from another. Of 256 bits a
    pair at similarity 0.8 differs in 39, with a deviation of 6: at radius 66 about one in a million is missed; texts that
    have nothing in common differ in 128, with a deviation of 8, so that links by chance stay rare among billions.

    Nodes are texts, not ids: rows whose texts are equal but for case and spacing are one node, and rows that share an id
    but no text are two. Null and empty texts, and texts without words, are copies of each other. Ids are of any orderable
    type, a null id is larger than all; of rows with the same id and words one stays, the same on every run unless
    they are equal in all columns. An empty table stays empty.
    """
    content, row = free(docs, "content"), free(docs, "row")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keyed = docs.withColumns({content: _words_digest(F.col(f"`{text_col}`")), row: F.xxhash64(*hashed)})
    found = fingerprints(keyed, shingle, words, id_col, text_col, (content, row), distinct=True)
    best = F.min(F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row"))).alias("best")
    nodes = cut(found.groupBy(F.col(content).alias("content"), "fp").agg(best).withColumn("node", F.monotonically_increasing_id()))
    near = components(links(nodes.select("node", "fp"), radius, words, blocks=1))
    kept = nodes
    if not near.isEmpty():

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(np.array(shingle_hashes(t, shingle), np.uint64)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "set"])

        grouped = near.join(nodes, "node")
        wanted = grouped.select("content", F.col("best.row").alias("row"), "node")
        source = keyed.select(F.col(content).alias("content"), F.col(row).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
        few = source.join(wanted, ["content", "row"]).select("node", "text").mapInArrow(sets, "node long, set binary").groupBy("node").agg(F.min("set").alias("set"))
        groups = similar_groups(grouped.select("node", "component", "fp").join(few, "node"), radius, similarity, words).join(nodes.select("node", "best"), "node")
        stays = groups.groupBy("label").agg(F.min(F.struct("best", "node")).alias("s")).select(F.col("s.node").alias("node"))
        kept = nodes.join(cut(groups.select("node").join(stays, "node", "left_anti")), "node", "left_anti")
    kept = kept.select(F.col("content").alias(content), F.col("best.row").alias(row))
    return keyed.join(kept, [content, row], "left_semi").dropDuplicates([content, row]).drop(content, row)
