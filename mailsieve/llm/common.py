"""What the operators of this subpackage share: input tables, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition ``[^\x20\x09-\x0D]+``; bytes.split() without arguments cuts at the same six.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Pieces of at most so many rows. Spark itself ends a batch at 64 MB; what a worker makes of the texts in it may be larger."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For sessions of one's own (the queries and the pipeline): rows of an Arrow batch, to keep JVM and workers small. Operators leave sessions alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


_OWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: spark.checkpoint.dir. Only a local session without it gets one of its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='mailsieve-')}")
        found = context.getCheckpointDir()
    elif not context.getCheckpointDir():
        context.setCheckpointDir(found)
    own = context.getCheckpointDir()
    if own not in _OWN:  # Spark keeps checkpoints; its folder for this application's goes when the driver ends
        _OWN.add(own)
        atexit.register(_forget, spark, own)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends at the latest: results may be read until then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session's JVM may be gone
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that scratch() gave out, through Spark's file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends here, and lost executors don't matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a clear error if one is missing or occurs twice."""
    for n in names:
        if df.columns.count(n) != 1:
            raise ValueError(f"needs exactly one column {n}, found {df.columns}")
    return df.select(*(F.col(f"`{n}`") for n in names))


def free(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of one key from which it counts as hot, and keys that can be hot at most.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with a table of one row a key, which has the number of rows of the key in column n, out of `total`.

    Keys with more than HOT_ROWS rows and than a HOT_KEYS-th of all rows are broadcast, HOT_KEYS at most, so that their rows stay where
    they are; the rows of all other keys are shuffled. Column n goes. rows is read twice.
    """
    hot = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    few = F.broadcast(keyed.where(hot).drop(n))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(keyed.where(~hot).drop(n), key, how))
