"""Responses as event rows, for single documents that are watched while they run and for streams of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.agents import SYSTEM, Provider, ask, parse_confidence, parse_text
from ..operators.preprocess import preprocess
from ..operators.score import THRESHOLD
from ..plans.pipeline import run_pipeline
from ..sources.readers import slices

RESULT = "struct<latest_message:string,confidence:double,flow_used:string>"
KINDS = pa.schema([
    ("seq", pa.int32()), ("type", pa.string()), ("agent", pa.string()), ("text", pa.string()), ("message", pa.string()),
    ("result", pa.struct([("latest_message", pa.string()), ("confidence", pa.float64()), ("flow_used", pa.string())])),
])
EVENT = f"seq int, type string, agent string, text string, message string, result {RESULT}"


def sse(event: Column) -> Column:
    """An event as a server-sent line."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def _event(seq: int, kind: str, agent=None, text=None, message=None, result=None) -> Column:
    put = lambda x, t: F.lit(None).cast(t) if x is None else x.cast(t)
    return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("type"), put(agent, "string").alias("agent"), put(text, "string").alias("text"), put(message, "string").alias("message"), put(result, RESULT).alias("result"))


def deterministic_events(df: DataFrame, id_col: str = "doc_id", content: str = "content", threshold: float = THRESHOLD) -> DataFrame:
    """start, one token with the whole text, done; rows that can't be read give one error event. Stateless: append mode works."""
    ready = run_pipeline(preprocess(df, content), threshold)
    result = F.struct(F.col("text").alias("latest_message"), F.col("score").alias("confidence"), F.lit("non_llm").alias("flow_used"))
    events = F.array(_event(0, "start", agent=F.lit("non_llm")), _event(1, "token", text=F.col("text")), _event(2, "done", result=result))
    events = F.when(F.col("error").isNull(), events).otherwise(F.array(_event(0, "error", message=F.col("error"))))
    return ready.select(id_col, events.alias("events")).select(id_col, F.inline_outer("events"))  # inline() filters by the array, which computes it twice


def agent_events(df: DataFrame, provider: Callable[[], Provider], id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """Tokens of the extraction as they come, then cleanup, confidence and done; no validation loop. A failure ends the document's events."""
    ready = preprocess(df, content).select(id_col, "text", "error")

    def events(own: Provider, text: str) -> Iterator[dict]:
        yield {"type": "start", "agent": "extraction"}
        got = ""
        try:
            for piece in own.stream("Give only the latest message of this e-mail:\n\n" + text, SYSTEM["extraction"]):
                got += piece
                yield {"type": "token", "text": piece}
        except Exception as e:
            yield {"type": "error", "message": str(e)}
            return
        yield {"type": "agent_done", "agent": "extraction"}
        yield {"type": "start", "agent": "cleanup"}
        try:
            got = parse_text(ask(own, "cleanup", got), "cleaned_message")
        except Exception:
            pass  # what was extracted stands
        yield {"type": "agent_done", "agent": "cleanup"}
        yield {"type": "start", "agent": "confidence"}
        try:
            sure = parse_confidence(ask(own, "confidence", got))
        except Exception:
            sure = 0.5
        yield {"type": "agent_done", "agent": "confidence"}
        yield {"type": "done", "result": {"latest_message": got, "confidence": sure, "flow_used": "llm_stream"}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            own, why = provider(), None
        except Exception as e:
            own, why = None, str(e)
        for batch in slices(batches):
            for i, (text, error) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                bad = error or why
                rows = [dict.fromkeys(KINDS.names) | {"seq": seq} | e for seq, e in enumerate([{"type": "error", "message": bad}] if bad else events(own, text))]
                key = batch.column(0).take(pa.array([i] * len(rows)))  # the id as it is, in its own type
                yield pa.RecordBatch.from_arrays([key, *[pa.array([r[f.name] for r in rows], f.type) for f in KINDS]], names=[id_col, *KINDS.names])  # a document's events go on at once

    return ready.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {EVENT}")


def extract_events(df: DataFrame, mode: str = "auto", provider: Callable[[], Provider] | None = None, **options) -> DataFrame:
    """Modes llm and auto both stream from the agents; without a provider they give an error event."""
    if mode == "non_llm":
        return deterministic_events(df, **options)

    def none():
        raise ValueError("no provider")

    options.pop("threshold", None)
    return agent_events(df, provider or none, **options)
