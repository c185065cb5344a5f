"""History of extractions: an append-only table, read newest first."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, mode string, timestamp timestamp, flow_used string, confidence double, latest_message string, content_preview string, provider string"
MOST, PREVIEW = 1000, 120


def content_preview(content: Column) -> Column:
    return F.translate(F.left(content, F.lit(PREVIEW)), "\n", " ")


def newest(entries: DataFrame, most: int = MOST, by: str = "timestamp", tie: str = "id") -> DataFrame:
    """The newest entries, newest first: a top-k, no full sort."""
    return entries.orderBy(F.desc(by), F.desc(tie)).limit(most)


def entries(responses: DataFrame, content: str, mode: str, provider: str | None, id: Column) -> DataFrame:
    return responses.where("success").select(
        id.alias("id"), F.lit(mode).alias("mode"), F.current_timestamp().alias("timestamp"), "flow_used", "confidence", "latest_message",
        content_preview(F.coalesce(F.col(f"`{content}`"), F.lit(""))).alias("content_preview"), F.lit(provider).cast("string").alias("provider"),
    )


class History:
    """Entries as Parquet files in a folder for each streamed batch and one for all others; appending moves nothing else, so many writers don't meet.
    A missing or empty folder is empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, responses: DataFrame, content: str = "content", mode: str = "auto", provider: str | None = None) -> None:
        """Appends the successful rows of `extract`."""
        entries(responses, content, mode, provider, F.substring(F.expr("uuid()"), 1, 8)).write.mode("append").parquet(f"{self.path}/batch=-1")

    def try_save(self, responses: DataFrame, **options) -> bool:
        """`save` that warns instead of failing: answers are worth more than their record."""
        try:
            self.save(responses, **options)
        except Exception as e:
            warnings.warn(f"history not saved: {e}", stacklevel=2)
            return False
        return True

    def sink(self, content: str = "content", mode: str = "auto", provider: str | None = None) -> Callable[[DataFrame, int], None]:
        """For `writeStream.foreachBatch`: a batch has a folder of its own, so that one that is played again replaces itself. Ids follow from
        batch and row; equal rows of a batch have the same."""
        def save(responses: DataFrame, batch: int) -> None:
            id = F.substring(F.sha2(F.concat_ws("\x00", F.lit(batch), F.col(f"`{content}`"), "flow_used", "latest_message"), 256), 1, 8)
            entries(responses, content, mode, provider, id).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

        return save

    def load(self, most: int = MOST) -> DataFrame:
        try:
            rows = self.spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)
        return newest(rows.select(*[x.split()[0] for x in SCHEMA.split(", ")]), most)

    def compact(self, most: int = MOST) -> None:
        """Leaves the newest entries only. They are written aside, then the folders change places; entries written meanwhile are lost, so let one job do it while
        nothing else writes. A job that dies between the two steps leaves the old entries under the same name with .old."""
        new, old = f"{self.path}.new", f"{self.path}.old"
        self.load(most).write.mode("overwrite").parquet(f"{new}/batch=-1")
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        files = paths(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(paths(old), True)
        files.rename(paths(self.path), paths(old))
        files.rename(paths(new), paths(self.path))
        files.delete(paths(old), True)

    def clear(self) -> None:
        """Without entries, and without folders of batches."""
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        paths(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(paths(self.path), True)
