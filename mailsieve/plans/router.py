"""From documents to responses: which rows the patterns settle and which go to the agents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.agents import TRACE, Provider, llm_flow
from ..operators.preprocess import preprocess
from ..operators.score import THRESHOLD
from ..sources.answers import Answers
from .pipeline import run_pipeline

MODES = ("non_llm", "llm", "auto")
NO_PROVIDER = "no provider"
#: Columns that the router adds or needs for itself.
OWN = ("success", "flow_used", "confidence", "latest_message", "metadata", "agent_trace", "llm_text", "llm_confidence", "llm_iterations", "llm_trace", "llm_error", "__mode", "__source", "__error", "__need")


def route(df: DataFrame, mode: str | None = "auto", threshold: float = THRESHOLD, provider: Callable[[], Provider] | None = None, strategy: str = "graph", in_flight: int = 1, per_second: float = 0, answers: Answers | None = None) -> DataFrame:
    """Responses for preprocessed rows (columns text, error): success, flow_used, confidence, latest_message, error, metadata, agent_trace.

    mode: one of MODES, or None for a column `mode` (null: auto; other values: an error in the row). One pass: the agents
    are asked, inside their tasks, only for mode llm and the unreliable rows of mode auto, with the preprocessed text. A
    provider that can't be built leaves auto rows with the deterministic result; where the model answered in mode auto, that
    result is kept in metadata.non_llm_fallback. With a provider but without `answers`, save the result before
    using it twice: each action asks it again. answers: a store that is asked first and gets what is new, at once (`sources.answers`). in_flight, per_second: those of `llm_flow`. A table that has a column of OWN is an error. strategy: the agents' loop (`operators.agents.flow`). All other columns stay; no shuffle, no union, no second scan.
    """
    if mode is not None and mode not in MODES:
        raise ValueError(f"Unknown mode: {mode}")
    if clash := {c.lower() for c in df.columns} & {*OWN}:
        raise ValueError(f"the table has columns {sorted(clash)} already")
    names = [c for c in df.columns if c not in ("text", "html", "error", "mode")]
    own, none = F.coalesce("mode", F.lit("auto")) if mode is None else F.lit(mode), F.lit(None).cast("string")
    unknown = F.when(~F.col("__mode").isin(*MODES), F.concat(F.lit("Unknown mode: "), F.col("__mode")))
    rows = df.withColumns({"__mode": own, "__source": F.col("text"), "__error": F.col("error")}).withColumn("__error", F.coalesce("__error", unknown))
    rows = run_pipeline(rows.drop("html", "error", "mode"), threshold)
    fine, llm = F.col("__error").isNull(), F.col("__mode") == "llm"
    need = fine & (llm | (F.col("__mode") == "auto") & ~F.col("is_reliable"))
    if provider is None:
        rows = rows.withColumns({"llm_text": none, "llm_confidence": none.cast("double"), "llm_iterations": none.cast("int"), "llm_trace": F.lit(None).cast(TRACE), "llm_error": F.when(need, NO_PROVIDER)})
    elif mode != "non_llm":
        rows, options = rows.withColumn("__need", need), {"strategy": strategy, "in_flight": in_flight, "per_second": per_second}
        rows = answers.complete(rows, provider, "__source", "__need", **options) if answers else llm_flow(rows, provider, "__source", "__need", **options)
    else:
        rows = rows.withColumns({"llm_text": none, "llm_confidence": none.cast("double"), "llm_iterations": none.cast("int"), "llm_trace": F.lit(None).cast(TRACE), "llm_error": none})
    answered, failed = F.col("llm_text").isNotNull(), F.col("llm_error").isNotNull()
    flow = F.when(~fine, "").when(llm, "llm").when(F.col("__mode") == "non_llm", "non_llm").when(answered, "llm (auto mode)").when(failed, "non_llm (auto mode, llm failed)").otherwise("non_llm (auto mode)")
    measured = lambda name: F.when(fine & ~llm, F.col(name)).alias(name)
    details = F.struct(*[measured(f"{k}_score") for k in ("length", "noise", "quality", "readability", "completeness")])
    sizes = [measured(c) for c in rows.columns if c == "original_length" or c.startswith("after_")]
    fallback = F.struct(F.col("score").alias("non_llm_confidence"), F.col("text").alias("non_llm_text"))
    metadata = F.struct(
        *sizes, measured("score").alias("confidence_score"), measured("is_reliable"), details.alias("confidence_details"), measured("noise_found"), measured("quality_found"),
        measured("reduction_ratio"), measured("steps_executed"), F.col("llm_iterations").alias("iterations"), F.col("llm_error"),
        F.when(fine & (F.col("__mode") == "auto") & answered, fallback).alias("non_llm_fallback"),
    )
    return rows.select(
        *[F.col(f"`{c}`") for c in names], (fine & ~(llm & failed)).alias("success"), flow.alias("flow_used"),
        F.when(~fine, 0.0).when(llm | answered, F.coalesce("llm_confidence", F.lit(0.0))).otherwise(F.col("score")).alias("confidence"),
        F.when(~fine, "").when(llm | answered, F.coalesce("llm_text", F.lit(""))).otherwise(F.col("text")).alias("latest_message"),
        F.coalesce("__error", F.when(llm, F.col("llm_error"))).alias("error"), metadata.alias("metadata"), F.col("llm_trace").alias("agent_trace"),
    )


def extract(df: DataFrame, mode: str | None = "auto", content: str = "content", eml: str | None = None, threshold: float = THRESHOLD, provider: Callable[[], Provider] | None = None, **options) -> DataFrame:
    """The latest message of every document, in batch or on a stream: `preprocess`, then `route` with its options."""
    return route(preprocess(df, content, eml), mode, threshold, provider, **options)
