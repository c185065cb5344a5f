"""Answers of language models, kept by what was asked: a text is asked for once, however often it occurs and whatever fails later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.agents import ANSWER, RESULT, Provider, llm_flow


class Answers:
    """A table of answers as Parquet files. The key of an answer is a digest of text, model and strategy; appending moves nothing else."""

    def __init__(self, spark: SparkSession, path: str, model: str = ""):
        self.spark, self.path, self.model = spark, path, model

    def load(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"digest string, {RESULT}").parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"digest string, {RESULT}")

    def _digest(self, text: Column, strategy: str) -> Column:
        return F.sha2(F.concat_ws("\x00", F.lit(strategy), F.lit(self.model), F.coalesce(text, F.lit(""))), 256)

    def complete(self, df: DataFrame, provider: Callable[[], Provider], text: str = "text", only: str | None = None, strategy: str = "graph", **options) -> DataFrame:
        """The columns of `llm_flow` for every row (nulls where `only` isn't true): looked up, after asking for each different text that isn't in the store yet.

        New answers are appended before this returns, so later actions ask nothing; failures to build the provider aren't kept and are asked
        for again. Equal texts are asked once: they meet by digest. Rows are shuffled by digest, unless the store is small. A table with a column __digest is an error.
        """
        if clash := {c.lower() for c in df.columns} & {*ANSWER.names, "__digest"}:
            raise ValueError(f"the table has columns {sorted(clash)} already")
        wanted = F.lit(True) if only is None else F.coalesce(F.col(only), F.lit(False))
        keyed = df.withColumn("__digest", F.when(wanted, self._digest(F.col(text), strategy)))
        asked = keyed.where(F.col("__digest").isNotNull()).select(F.col("__digest").alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"])
        new = llm_flow(asked.join(self.load().select("digest"), "digest", "left_anti"), provider, "text", None, strategy, **options).drop("text")
        new.where("llm_error is null").write.mode("append").parquet(self.path)
        found = self.load().dropDuplicates(["digest"])
        rows = keyed.join(found, keyed["__digest"] == found["digest"], "left").drop("digest")
        missing = F.col("__digest").isNotNull() & F.col("llm_text").isNull() & F.col("llm_error").isNull()
        return rows.withColumn("llm_error", F.when(missing, "no answer").otherwise(F.col("llm_error"))).select(*[F.col(f"`{c}`") for c in df.columns], *ANSWER.names)
