"""RFC-822 messages: the first plain and the first HTML part, decoded."""

from __future__ import annotations

import email

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bodies(source: str | bytes) -> tuple[str, str | None]:
    """Plain text (empty if none) and HTML (None if none) of a message; attachments count as parts, unknown charsets as UTF-8."""
    raw = source.encode("utf-8", "replace") if isinstance(source, str) else source
    found: dict[str, str] = {}
    for part in email.message_from_bytes(raw).walk():
        kind = part.get_content_type()
        if kind not in ("text/plain", "text/html") or kind in found or part.is_multipart():
            continue
        payload = part.get_payload(decode=True)
        if payload is None:
            continue
        try:
            found[kind] = payload.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            found[kind] = payload.decode("utf-8", "replace")
    return found.get("text/plain", ""), found.get("text/html")


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "html", "error")]))
def mime_bodies(source: pd.Series) -> pd.DataFrame:
    rows = []
    for x in source:
        try:
            rows.append((*bodies(x), None) if x is not None else (None, None, None))
        except Exception as e:  # the row says what is wrong with it
            rows.append((None, None, f"Failed to parse .eml file: {e}"))
    return pd.DataFrame(rows, columns=["text", "html", "error"], dtype=object)
