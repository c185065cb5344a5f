"""Tables of documents from files: requests as JSON lines or Parquet, whole text files, .eml files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "content string, mode string, provider string, is_eml boolean"


def requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; absent fields take their defaults (mode auto, not .eml)."""
    rows = spark.read.schema(REQUEST).json(path)
    return rows.withColumns({"mode": F.coalesce("mode", F.lit("auto")), "is_eml": F.coalesce("is_eml", F.lit(False))})


def utf8(content):
    """Bytes as text, with U+FFFD for what isn't UTF-8."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole files, as UTF-8 with U+FFFD for what isn't."""
    return spark.read.format("binaryFile").load(path).select("path", utf8("content").alias("content"))


def eml_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content (the bytes, as a message's parts name their own charsets) and is_eml of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.lit(True).alias("is_eml"))


#: Rows of an Arrow batch in the queries' sessions and in what a worker makes of one: a worker's memory follows neither the table's size nor a batch's.
BATCH_ROWS = 500


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """For sessions of one's own: what a Python worker holds of texts at once. Operators leave sessions alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most so many rows, as sessions may have batches of any size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: A table below this size for each core may be dealt out anew.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table whose scan has fewer splits than the session has cores, and at most SPREAD_BYTES a core, dealt over all cores: cleaning takes
    far longer than moving so little. Any larger table, and any with enough splits, stays as it is, whatever its number of files."""
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if plan.toRdd().getNumPartitions() >= cores or int(str(plan.optimizedPlan().stats().sizeInBytes())) > cores * SPREAD_BYTES:
        return df
    return df.repartition(cores)
