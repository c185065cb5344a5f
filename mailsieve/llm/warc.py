"""WARC archives: writing with revisits, the normaliser for archives that are one gzip stream, and reading by offset."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, only, remove, scratch, slices

#: Digests that occur twice, some 100 bytes each, up to which they are broadcast; bits of the filter for more (16 MB).
MOST_TWICE, MOST_BITS = 100_000, 1 << 27
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long"


def open_dir(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder's URI; the folder exists afterwards."""
    system, path = pa.fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, kind: str) -> bytes:
    """One WARC record; a revisit holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        safe = re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, HTTP payload length and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "length": int(re.search(rb"(?i)content-length: (\d+)", http)[1]), "payload": payload}


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one at a time, whatever pieces it comes in."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", held[: end + 2])[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(file, size: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's bytes in one pass, as one stream or several members."""
    engine = zlib.decompressobj(31)
    while data := file.read(size):
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
    if engine.unconsumed_tail or not engine.eof and engine.flush():
        raise ValueError("the gzip stream is cut off")


def write_archives(records: DataFrame, uri: str, level: int = 6) -> DataFrame:
    """Writes columns page_id, url, html, digest, refers_to, record_type as archives that are one gzip stream each.

    One file a partition, under a name of its task attempt: a repeated task writes another file, and only files in the
    returned manifest (path, records) count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_dir(uri)
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        n, out = 0, None
        for batch in slices(batches):
            for r in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(name, compression=None)
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                out.write(squeeze.compress(record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"], r["record_type"])))
                n += 1
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64())})

    return records.select("page_id", "url", "html", "digest", "refers_to", "record_type").mapInArrow(run, MANIFEST)


def normalise(manifest: DataFrame, uri: str, level: int = 6) -> DataFrame:
    """Rewrites archives so that every record is a gzip member of its own, with an index of offsets beside each file.

    Each archive is inflated once, as a stream; memory holds a record at a time. The index (path + ".idx", a JSON line a
    record: id, type, offset, length) gives every record without inflating the others. Returns the new manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_dir(uri)
        for batch in slices(batches):
            for source in batch.column(0).to_pylist():
                name = f"{path}/{source.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
                n = at = 0
                with system.open_input_stream(source, compression=None) as file, system.open_output_stream(name, compression=None) as out, system.open_output_stream(f"{name}.idx", compression=None) as index:
                    for raw in records_of(inflate(file)):
                        member = gzip.compress(raw, level, mtime=0)
                        head = raw[: raw.index(b"\r\n\r\n")].decode("utf-8", "surrogatepass")
                        found = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
                        index.write(json.dumps({"id": found["WARC-Record-ID"], "type": found["WARC-Type"], "offset": at, "length": len(member)}).encode() + b"\n")
                        out.write(member)
                        at += len(member)
                        n += 1
                yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64())})

    return manifest.select("path").mapInArrow(run, MANIFEST)


def read_archives(manifest: DataFrame, uri: str, id_type: str = "long", payloads: bool = False) -> DataFrame:
    """Reads every record of normalised archives by its index entry and checks it against its digest.

    Returns page_id, payload_bytes and payload_digest (of the full payload, also for revisits), record_type, refers_to
    (null for responses), url and, with `payloads`, the payload (null for revisits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_dir(uri)
        text = id_type == "string"
        key = lambda s: None if s is None or s == "<urn:page:None>" else s[10:-1] if text else int(s[10:-1])
        kind = pa.string() if text else pa.int64()

        def rows(path: str) -> Iterator[dict]:
            with system.open_input_stream(f"{path}.idx", compression=None) as f:
                index = [*map(json.loads, f.read().splitlines())]
            with system.open_input_file(path) as file:
                for entry in index:
                    file.seek(entry["offset"])
                    got = parse(gzip.decompress(file.read(entry["length"])))
                    head = got["headers"]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and (hashlib.sha256(got["payload"]).hexdigest(), len(got["payload"])) != (digest, got["length"]):
                        raise ValueError(f"{path}: {entry['id']} doesn't match its digest")
                    yield {"page_id": key(head["WARC-Record-ID"]), "payload_bytes": got["length"], "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": key(head.get("WARC-Refers-To")), "url": head.get("WARC-Target-URI")} | ({"payload": got["payload"] if head["WARC-Type"] == "response" else None} if payloads else {})

        schema = pa.schema([("page_id", kind), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", kind), ("url", pa.string())] + [("payload", pa.binary())] * payloads)
        for batch in slices(batches):
            for path in batch.column(0).to_pylist():
                held = []
                for row in rows(path):
                    held.append(row)
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return manifest.select("path").mapInArrow(run, f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, url string" + ", payload binary" * payloads)


def _filter(digests: DataFrame, n: int) -> Callable[[Column], Column]:
    """A condition that holds for all the digests and for few others: a Bloom filter of at most MOST_BITS bits, broadcast."""
    bits = min(MOST_BITS, 1 << max(10, (12 * n).bit_length()))
    places = lambda digest: [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) for k in range(4)]
    spread = digests.select(F.explode(F.array(*places(F.col("digest")))).alias("p"))
    words = spread.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("b")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[words["w"].to_numpy()] = words["b"].to_numpy()
    shared = digests.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    @F.pandas_udf("boolean")
    def among(*at: pd.Series) -> pd.Series:
        out = np.ones(len(at[0]), bool)
        for p in at:
            p = p.to_numpy().astype(np.uint64)
            out &= (shared.value[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)) == 1
        return pd.Series(out)

    return lambda digest: among(*places(digest))


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """Adds digest, refers_to and record_type: of equal payloads of `least` bytes or more the smallest page_id is the response.

    What is decided on are ids and digests. Up to MOST_TWICE digests that occur twice are broadcast: no payload moves.
    More of them become a Bloom filter: pages that it leaves out stay where they are, the others are joined, those of hot
    digests without a shuffle. Rows without an id refer to the smallest id among equal payloads (all are responses if
    none has one); a repeated row of the response is a response; an empty table stays empty.
    """
    source = only(pages, "page_id", "url", "html")
    known = source.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    long = F.coalesce(F.octet_length("html") >= least, F.lit(False))
    ids = known.where(long).select("page_id", "digest")
    first = cut(ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"))
    twice = first.count()
    if twice <= MOST_TWICE:
        joined = known.join(F.broadcast(first.drop("n")), "digest", "left")
    else:
        marked = known.withColumn("maybe", long & _filter(first, twice)(F.col("digest")))
        rest = marked.where("maybe").drop("maybe")
        joined = join_hot(rest, first, "digest", "n", first.agg(F.sum("n")).first()[0], "left").unionByName(marked.where("not maybe").drop("maybe").withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType)))
    again = long & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to"), F.when(again, "revisit").otherwise("response").alias("record_type"))


def archive_round_trip(pages: DataFrame, uri: str | None = None, level: int = 6) -> DataFrame:
    """Writes all pages as one-stream archives, normalises them, and reads every record back by its offset.

    A row a page: page_id, payload_bytes, payload_digest, record_type, refers_to, url. Null html is an empty payload;
    null urls write no header; an empty table writes no archive. `uri`: a folder that driver and executors share.
    """
    spark = pages.sparkSession
    uri = uri or scratch(spark, "warc")
    if "://" not in uri:
        uri = f"file://{uri}"
    table = with_revisits(pages)
    write_archives(table, f"{uri}/one", level).write.parquet(f"{uri}/one-manifest")
    one = spark.read.schema(MANIFEST).parquet(f"{uri}/one-manifest")
    files = max(1, one.count())
    normalise(one.repartition(files), f"{uri}/members", level).write.parquet(f"{uri}/manifest")
    remove(spark, f"{uri}/one")
    return read_archives(spark.read.schema(MANIFEST).parquet(f"{uri}/manifest").repartition(files), f"{uri}/members", table.schema["page_id"].dataType.simpleString().replace("bigint", "long"))
