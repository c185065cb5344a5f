"""The agent flow for texts that patterns can't settle: extraction, cleanup and validation in a bounded loop, confidence."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.readers import slices

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 1.0, 10.0
#: Cleanups at most. Strategy "sequential" also hands the validation's advice on inside the text.
MOST_CLEANUPS = {"graph": 2, "sequential": 3}
SYSTEM = {
    "extraction": 'You find the newest message in an e-mail thread and drop everything quoted. Answer with JSON: {"extracted_message": "..."}',
    "cleanup": 'You take signatures, disclaimers and leftover markup out of a message and change nothing else. Answer with JSON: {"cleaned_message": "..."}',
    "validation": 'You check that a message is complete and holds nothing quoted. Answer with JSON: {"is_valid": true, "issues": [], "suggested_fix": ""}',
    "confidence": 'You rate how well a message was extracted, from 0.0 to 1.0. Answer with JSON: {"confidence_score": 0.0}',
}
ASK = {
    "extraction": "Give the latest message of this e-mail:\n\n",
    "cleanup": "Clean this message:\n\n",
    "validation": "Check this message:\n\n",
    "confidence": "Rate this message from 0.0 to 1.0:\n\n",
}
TRACE = "array<struct<agent:string,success:boolean,output_preview:string,is_valid:boolean,issues:array<string>,suggested_fix:string,confidence:double>>"
RESULT = f"llm_text string, llm_confidence double, llm_iterations int, llm_trace {TRACE}, llm_error string"
ANSWER = pa.schema([
    ("llm_text", pa.string()), ("llm_confidence", pa.float64()), ("llm_iterations", pa.int32()),
    ("llm_trace", pa.list_(pa.struct([("agent", pa.string()), ("success", pa.bool_()), ("output_preview", pa.string()), ("is_valid", pa.bool_()), ("issues", pa.list_(pa.string())), ("suggested_fix", pa.string()), ("confidence", pa.float64())]))),
    ("llm_error", pa.string()),
])


class Provider(Protocol):
    def invoke(self, prompt: str, system_message: str) -> str: ...

    def stream(self, prompt: str, system_message: str) -> Iterator[str]: ...


class Transient(Exception):
    """A failure that another attempt may mend: rate limits, connections, time-outs, server errors. after: seconds to wait, if the service says so."""

    def __init__(self, *args, after: float | None = None):
        super().__init__(*args)
        self.after = after


class Pace:
    """At most so many requests a second, shared by the threads of a task: each takes the next free moment. 0: no limit."""

    def __init__(self, per_second: float = 0, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.wait, self.free, self.lock = 1 / per_second if per_second else 0.0, clock, wait, 0.0, threading.Lock()

    def __call__(self) -> None:
        if self.gap:
            with self.lock:
                now = self.clock()
                at = max(now, self.free)
                self.free = at + self.gap
            if at > now:
                self.wait(at - now)


class _Paced:
    """A provider that waits for its turn."""

    def __init__(self, own: Provider, pace: Pace):
        self.own, self.pace = own, pace

    def invoke(self, prompt: str, system_message: str) -> str:
        self.pace()
        return self.own.invoke(prompt, system_message)


def salvage(reply: str) -> str:
    """The JSON object in a reply, out of a fenced block or between other words."""
    plain = re.sub(r"```(?:json)?\s*(.*?)\s*```", r"\1", reply, flags=re.S)
    m = re.search(r"\{.*\}", plain, re.S)
    return m[0] if m else plain


def _object(reply: str) -> dict:
    found = json.loads(salvage(reply))
    if not isinstance(found, dict):
        raise ValueError("no object")
    return found


def parse_text(reply: str, field: str) -> str:
    try:
        found = _object(reply)[field]
        if isinstance(found, str):
            return found
    except (ValueError, KeyError):
        pass
    return reply.strip()


def parse_validation(reply: str) -> dict:
    try:
        found = _object(reply)
        valid, issues, fix = found["is_valid"], found.get("issues", []), found.get("suggested_fix", "")
        if isinstance(valid, bool) and isinstance(issues, list) and all(isinstance(x, str) for x in issues) and isinstance(fix, str):
            return {"is_valid": valid, "issues": issues, "suggested_fix": fix}
    except (ValueError, KeyError):
        pass
    low = reply.lower()
    return {"is_valid": "invalid" not in low and "false" not in low, "issues": ["Could not parse structured validation"], "suggested_fix": ""}


def parse_confidence(reply: str) -> float:
    try:
        found = float(_object(reply)["confidence_score"])
        if 0 <= found <= 1:
            return found
    except (ValueError, KeyError, TypeError):
        pass
    m = re.search(r"\d+\.?\d*", reply.replace(",", "."))
    if not m:
        return 0.5
    x = float(m[0])
    return round(min(1.0, x / 100 if x > 1 else x), 3)


def ask(provider: Provider, agent: str, text: str, wait: Callable[[float], None] = time.sleep) -> str:
    """The provider's reply; transient failures are tried again, ATTEMPTS times in all."""
    for attempt in range(ATTEMPTS):
        try:
            return provider.invoke(ASK[agent] + text, SYSTEM[agent])
        except Transient as e:
            if attempt + 1 == ATTEMPTS:
                raise
            wait(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt) if e.after is None else e.after)
    raise AssertionError


def flow(provider: Provider, content: str, wait: Callable[[float], None] = time.sleep, strategy: str = "graph") -> dict:
    """One document through all agents; an agent that fails hands its input on (validation then counts as passed, confidence as 0.5).

    strategy: one of MOST_CLEANUPS. In "sequential" a suggested fix stands behind the text that the next agent gets, so if no
    cleanup follows or it leaves the fix where it is, the result holds it.
    """
    trace: list[dict] = []

    def note(agent: str, success: bool, **more) -> None:
        trace.append({"agent": agent, "success": success, "output_preview": None, "is_valid": None, "issues": None, "suggested_fix": None, "confidence": None} | more)

    def rewrite(agent: str, field: str, text: str) -> str:
        try:
            out, fine = parse_text(ask(provider, agent, text, wait), field), True
        except Exception:
            out, fine = text, False
        note(agent, fine, output_preview=out[:200])
        return out

    text, cleanups = rewrite("extraction", "extracted_message", content), 0
    while True:
        text, cleanups = rewrite("cleanup", "cleaned_message", text), cleanups + 1
        try:
            check = parse_validation(ask(provider, "validation", text, wait))
        except Exception:
            check = {"is_valid": True, "issues": None, "suggested_fix": None}
        note("validation", check["is_valid"], **check)
        if not check["is_valid"] and check["suggested_fix"] and strategy == "sequential":
            text += f"\n\n[Fix needed: {check['suggested_fix']}]"
        if check["is_valid"] or cleanups >= MOST_CLEANUPS[strategy]:
            break
    try:
        sure = parse_confidence(ask(provider, "confidence", text, wait))
    except Exception:
        sure = 0.5
    note("confidence", True, confidence=sure)
    return {"llm_text": text, "llm_confidence": sure, "llm_iterations": cleanups, "llm_trace": trace, "llm_error": None}


def llm_flow(df: DataFrame, provider: Callable[[], Provider], text: str = "text", only: str | None = None, strategy: str = "graph", in_flight: int = 1, per_second: float = 0) -> DataFrame:
    """Adds llm_text, llm_confidence, llm_iterations, llm_trace and llm_error to every row; a provider for each partition.

    provider: builds the provider inside the task; if it can't, every row gets the error. only: a boolean column; the
    provider sees the rows where it is true, the others get nulls. Null texts count as empty. strategy: that of `flow`. in_flight:
    documents that a task has under way at once (the provider must bear as many threads); rows keep their order. per_second: requests
    of a task a second, 0 for any number. Other columns pass in Arrow batches as they are, whatever their types; a table with
    one of the new columns is an error.
    """
    if strategy not in MOST_CLEANUPS:
        raise ValueError(f"Unknown strategy: {strategy}")
    if clash := {c.lower() for c in df.columns} & {*ANSWER.names}:
        raise ValueError(f"the table has columns {sorted(clash)} already")
    texts, asks = df.columns.index(text), None if only is None else df.columns.index(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            own, why = _Paced(provider(), Pace(per_second)), None
        except Exception as e:
            own, why = None, str(e)
        none = dict.fromkeys(ANSWER.names)

        def answer(asked: bool | None, content: str | None) -> dict:
            if not asked:
                return none
            return none | {"llm_error": why} if own is None else flow(own, content or "", strategy=strategy)

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in slices(batches):
                wanted = [True] * batch.num_rows if asks is None else batch.column(asks).to_pylist()
                rows = [*pool.map(answer, wanted, batch.column(texts).to_pylist())]
                columns = [pa.array([r[f.name] for r in rows], f.type) for f in ANSWER]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *ANSWER.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, {RESULT}")
