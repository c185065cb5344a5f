"""Language-model providers over one chat-completions protocol."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.agents import Transient

#: Providers with the place of their protocol, the variable of their key and their default model.
PROVIDERS = {
    "openai": ("https://api.openai.com/v1/", "OPENAI_API_KEY", "gpt-4.1-mini"),
    "azure_openai": (None, "AZURE_OPENAI_API_KEY", "gpt-4.1-mini"),
    "anthropic": ("https://api.anthropic.com/v1/", "ANTHROPIC_API_KEY", "claude-haiku-4-5"),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta/openai/", "GEMINI_API_KEY", "gemini-2.5-flash-lite"),
}


#: A service that wants longer pauses than this gets the next attempt sooner.
MOST_WAIT = 120.0


class NotConfigured(Exception):
    pass


def resolve(name: str) -> str:
    known = name.lower().replace("-", "_")
    if known not in PROVIDERS:
        raise ValueError(f"Unknown provider name: {name}")
    return known


def resolve_column(name: Column) -> Column:
    """The same for a column; null for unknown names."""
    known = F.translate(F.lower(name), "-", "_")
    return F.when(known.isin(*PROVIDERS), known)


def azure_url(endpoint: str) -> str:
    return endpoint + "openai/v1/" if endpoint.endswith(".com/") and "openai/v1" not in endpoint else endpoint


def azure_url_column(endpoint: Column) -> Column:
    return F.when(F.endswith(endpoint, F.lit(".com/")) & ~F.contains(endpoint, F.lit("openai/v1")), F.concat(endpoint, F.lit("openai/v1/"))).otherwise(endpoint)


def retry_after(header: str | None, now: Callable[[], float] = time.time) -> float | None:
    """Seconds to wait by a Retry-After header, a number or a date; None if there is none that makes sense. MOST_WAIT at most."""
    if not header:
        return None
    try:
        seconds = float(header)
    except ValueError:
        try:
            seconds = parsedate_to_datetime(header).timestamp() - now()
        except ValueError:
            return None
    return min(max(seconds, 0.0), MOST_WAIT) if seconds == seconds else None


@dataclass(frozen=True)
class Chat:
    """A provider; rate limits, connections, time-outs and server errors are transient."""

    name: str
    model: str
    key: str | None
    url: str | None
    temperature: float = 0.0
    timeout: float = 60.0

    def is_configured(self) -> bool:
        return bool(self.key and self.url)

    def metadata(self) -> dict:
        return {"provider": self.name, "model": self.model, "temperature": self.temperature}

    def _open(self, prompt: str, system_message: str, stream: bool):
        body = {"model": self.model, "temperature": self.temperature, "stream": stream, "messages": [{"role": "system", "content": system_message}, {"role": "user", "content": prompt}]}
        request = urllib.request.Request(f"{self.url}chat/completions", json.dumps(body).encode(), {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        try:
            return urllib.request.urlopen(request, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                raise RuntimeError(str(e)) from e
            raise Transient(str(e), after=retry_after(e.headers.get("Retry-After"))) from e
        except OSError as e:
            raise Transient(str(e)) from e

    def invoke(self, prompt: str, system_message: str) -> str:
        with self._open(prompt, system_message, False) as answer:
            return json.load(answer)["choices"][0]["message"]["content"] or ""

    def stream(self, prompt: str, system_message: str) -> Iterator[str]:
        with self._open(prompt, system_message, True) as answer:
            for line in answer:
                data = line.decode("utf-8", "replace").strip().removeprefix("data:").strip()
                if data and data != "[DONE]":
                    for choice in json.loads(data).get("choices", []):
                        if piece := (choice.get("delta") or {}).get("content"):
                            yield piece


def provider(name: str, model: str | None = None, temperature: float = 0.0, env=os.environ) -> Chat:
    """A configured provider by name, or NotConfigured."""
    known = resolve(name)
    url, key, default = PROVIDERS[known]
    if known == "azure_openai":
        url, default = azure_url(env.get("AZURE_OPENAI_ENDPOINT", "")), env.get("AZURE_OPENAI_DEPLOYMENT") or default
    out = Chat(known, model or default, env.get(key), url, temperature)
    if not out.is_configured():
        raise NotConfigured(f"{known} provider is not properly configured.")
    return out


def providers_df(spark: SparkSession, env=os.environ) -> DataFrame:
    """name, available and configured of all providers, and which is the default (the first available one)."""
    rows = []
    for name in PROVIDERS:
        try:
            fine = provider(name, env=env).is_configured()
        except NotConfigured:
            fine = False
        rows.append((name, fine, fine))
    first = next((n for n, ok, _ in rows if ok), "none")
    return spark.createDataFrame([(*r, r[0] == first) for r in rows], "name string, available boolean, configured boolean, is_default boolean")


def health_df(spark: SparkSession, version: str = "1") -> DataFrame:
    return spark.createDataFrame([("healthy", version)], "status string, version string")
