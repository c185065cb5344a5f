"""From raw content (plain, HTML or .eml) to normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import squeeze, with_nfc
from ..functions.rx import Spans, is_blank, remove, remove_all, settled, strip, up_to_last
from .html import is_html, with_tree, without_forwarded
from .mime import mime_bodies

#: Attributions and disclaimers that go before anything else.
ATTRIBUTIONS = (r"On\s+.*?wrote:", r">\s*On\s+.*?wrote:")
DISCLAIMERS = (
    r"(?:^|\n)\s*CONFIDENTIALITY NOTICE\s*[:\n].*?(?=\n\n|\Z)",
    r"(?:^|\n)\s*DISCLAIMER\s*[:\n].*?(?=\n\n|\Z)",
    r"(?:^|\n)\s*This\s+(?:e-?mail|message)\s+is\s+confidential.*?(?=\n\n|\Z)",
    r"(?:^|\n)\s*If\s+you\s+have\s+received\s+this\s+(?:e-?mail|message)\s+in\s+error.*?(?=\n\n|\Z)",
    r"(?:^|\n)\s*The\s+information\s+contained.*?is\s+confidential.*?(?=\n\n|\Z)",
    r"(?:^|\n)\s*Please\s+consider\s+the\s+environment\s+before\s+printing",
)
CONTAINED = Spans(r"(?:^|\n)\s*The\s+information\s+contained", (r"is\s+confidential",), r"(?=\n\n)")
EMPTY = "Empty content after preprocessing"


def strip_attributions(text: Column) -> Column:
    return up_to_last(text, "wrote:", lambda t: remove(t, ATTRIBUTIONS))


#: What a text must hold for a disclaimer to match, by pattern.
DISCLAIMER_WORDS = ("ty not", ("cla", "mer"), ("conf", "dent"), ("rece", "ved", "you"), ("nformat", "conta", "ned"), "ronment")


def strip_disclaimers(text: Column) -> Column:
    return strip(remove_all(text, DISCLAIMER_WORDS, [CONTAINED if p == DISCLAIMERS[4] else p for p in DISCLAIMERS]))


def preprocess(df: DataFrame, content: str = "content", eml: str | None = None) -> DataFrame:
    """Adds text (normalised), html (cleaned HTML, empty if the body is plain) and error (null if fine) to every row.

    eml: name of a boolean column that marks RFC-822 sources. The parsers get null for rows they aren't for, so only .eml
    and HTML rows, and texts beyond ASCII, pass through Arrow. Null content counts as empty; an empty result has an error. Content may be
    binary: messages are parsed as bytes, each part in its charset, and anything else is UTF-8; bytes that don't fit become U+FFFD.
    No shuffle; works on streams. Filter rows before: filters on the result stay above the text (`functions.rx.settled`), so that it is computed once.
    """
    if clash := {c.lower() for c in df.columns} & {"text", "html", "error", "__raw", "__eml", "__m", "__p", "__s"}:
        raise ValueError(f"the table has columns {sorted(clash)} already")
    binary, none = isinstance(df.schema[content].dataType, T.BinaryType), F.lit(None).cast("string")
    text = F.col(f"`{content}`").cast("string")
    raw = F.coalesce(F.make_valid_utf8(text) if binary else text, F.lit(""))
    step = df.withColumns({"__raw": raw, "__eml": F.coalesce(F.col(f"`{eml}`"), F.lit(False)) if eml else F.lit(False)})
    if eml:
        step = step.withColumn("__m", mime_bodies(F.when(F.col("__eml"), F.coalesce(F.col(f"`{content}`"), F.lit(b"")) if binary else F.col("__raw"))))
        source = F.when(F.col("__eml"), F.col("__m.html")).when(is_html(F.col("__raw")), F.col("__raw"))
        plain, failed = F.when(F.col("__eml"), F.coalesce("__m.text", F.lit(""))).otherwise(F.col("__raw")), F.col("__m.error")
    else:
        source, plain, failed = F.when(is_html(F.col("__raw")), F.col("__raw")), F.col("__raw"), none
    step = with_tree(step, "__p", without_forwarded(source))
    step = step.withColumns({"text": F.coalesce("__p.text", plain), "html": F.coalesce("__p.html", F.lit("")), "error": F.coalesce(failed, "__p.error")})
    step = with_nfc(step.drop("__raw", "__eml", "__m", "__p").withColumn("text", strip_attributions(F.col("text"))), "text")
    step = settled(step.withColumn("text", strip_disclaimers(squeeze(F.col("text")))), "text")
    return step.withColumn("error", F.coalesce("error", F.when(is_blank(F.col("text")), EMPTY)))
