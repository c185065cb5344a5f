"""The deterministic flow: steps that clean a text column one after the other, then the score."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rx import collapse, settled, strip
from ..operators import disclaimer, reply, signature
from ..operators.score import THRESHOLD, score


@dataclass(frozen=True)
class Step:
    """apply: takes a table with a column text and gives it with text cleaned and a boolean __modified; a row stays a row."""

    name: str
    apply: Callable[[DataFrame], DataFrame]


def column_step(name: str, clean: Callable[[Column], Column]) -> Step:
    """A step from any column expression (or UDF); it counts as having modified a text that it changed."""
    return Step(name, lambda df: _put(df.withColumn("__o", clean(F.col("text"))), F.col("__o"), F.col("__o") != F.col("text")))


def _put(df: DataFrame, text: Column, modified: Column) -> DataFrame:
    return df.withColumns({"__modified": modified, "__o": text}).drop("text").withColumnRenamed("__o", "text")


def _replies(df: DataFrame) -> DataFrame:
    for f in (lambda t: reply.rescue(reply.visible_fragments(F.col("text")), F.col("text")), reply.without_quoted_lines, reply.without_reply_headers):
        df = df.withColumn("__o", f(F.col("__o") if "__o" in df.columns else None))
    return _put(df, F.col("__o"), F.col("__o") != F.col("text"))


def _signature(df: DataFrame) -> DataFrame:
    df = df.withColumn("__b", signature.end_block(F.col("text")))
    df = df.withColumn("__o", strip(signature.without_device_lines(signature.cut_at_pattern(signature.cut_at_lines(F.col("text"))))))
    found = F.col("__b.found")
    return _put(df, F.when(found, F.col("__b.body")).otherwise(strip(collapse(F.col("__o")))), found | (F.length("__o") < F.length("text"))).drop("__b")


def _disclaimers(df: DataFrame) -> DataFrame:
    df = df.withColumn("__o", disclaimer.by_phrase(F.col("text"))).withColumn("__o", disclaimer.by_position(F.col("__o")))
    return _put(df, F.col("__o"), F.length("__o") < F.length("text"))


REPLIES, SIGNATURE, DISCLAIMERS = Step("reply_removal", _replies), Step("signature_removal", _signature), Step("disclaimer_removal", _disclaimers)
STEPS = (REPLIES, SIGNATURE, DISCLAIMERS)


def run_pipeline(df: DataFrame, threshold: float = THRESHOLD, steps: Sequence[Step] = ()) -> DataFrame:
    """Cleans the column text and scores what is left; no steps means STEPS. All other columns stay.

    Adds steps_executed (steps that modified the text, then confidence_scoring), original_length, after_<step>_length,
    reduction_ratio (3 digits, 0 for an empty original) and the columns of `score`. Null texts count as
    empty; a table with one of these columns is an error. No shuffle.
    """
    clash = {c for c in df.columns if re.fullmatch(r"__m\d*|__modified", c) or c in ("__o", "__b", "original_length", "reduction_ratio", "steps_executed") or c.startswith("after_")}
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)} already")
    df = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("original_length", F.length("text"))
    names = []
    for step in steps or STEPS:
        size = "after_" + step.name + ("" if step.name.endswith("_removal") else "_step") + "_length"
        df = step.apply(df).withColumnRenamed("__modified", f"__m{len(names)}").withColumn(size, F.length("text"))
        names.append(step.name)
    done = F.array_compact(F.array(*[F.when(F.col(f"__m{i}"), n) for i, n in enumerate(names)], F.lit("confidence_scoring")))
    ratio = F.when(F.col("original_length") > 0, F.bround((F.col("original_length") - F.length("text")) / F.col("original_length"), 3)).otherwise(0.0)
    df = df.withColumns({"steps_executed": done, "reduction_ratio": ratio}).drop(*[f"__m{i}" for i in range(len(names))])
    return score(settled(df, "text"), "text", threshold)
