"""Tokenising whole texts: trie encoding with decoding, and token counts from prefix tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import ChunkEncoder, PrefixCounter, no_cycles, vocabulary
from .common import only, slices

_WORKERS: dict[tuple, object] = {}


def _worker(kind: type, path: str):
    """An encoder that lives as long as its Python worker, so that later tasks find its memory filled."""
    if (kind, path) not in _WORKERS:
        _WORKERS[kind, path] = kind(vocabulary(path))
    return _WORKERS[kind, path]


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def encode_decode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes every whole text with the trie over its batch's distinct words, and decodes it again.

    Returns the id, n_tokens, and ids (array<int>) and decoded (string) or, with `digests`, their SHA-256: of the decimal
    ids with one space between, and of the decoded text in UTF-8. `vocab`: path of a vocabulary with word ends.
    Null and empty texts have no tokens (digests of the empty string); null or repeated ids and repeated rows keep one
    row each; special strings inside texts become their ids; other columns don't matter. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(ChunkEncoder, vocab)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            with no_cycles():
                rows = encoder.encode(texts)
                rows = [(n, _sha(i), _sha(d)) if digests else (n, [*map(int, i.split())], d) for n, i, d in rows]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, pa.string())], names=["id", "n", "ids", "decoded"])

    source = only(docs, id_col, text_col)
    names = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_tokens long, {names}")


def count_tokens(docs: DataFrame, vocab: str, budget: int = 512, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """Exact token counts of every whole text from the prefix tables of its words.

    Returns the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > budget), fit_chars (characters of the longest prefix
    of at most `budget` tokens: the whole text if it isn't over the limit, else looked up in the tables) and, with
    `prefixes`, prefix_tokens (array<int>: the exact count of text[:p] for every p). `vocab`: path of a byte-level
    vocabulary. Null texts count as empty (0 tokens); null or repeated ids and repeated rows keep one row each. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker(PrefixCounter, vocab)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            with no_cycles():
                found = counter.total(texts, budget)
                tables = [counter.prefixes(t).tolist() for t in texts] if prefixes else None
            columns = [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([n > budget for n, _ in found], pa.bool_()), pa.array([p for _, p in found], pa.int64())]
            names = ["id", "b", "n", "over", "fit"]
            if prefixes:
                columns.append(pa.array(tables, pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = only(docs, id_col, text_col)
    more = ", prefix_tokens array<int>" if prefixes else ""
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long{more}")
