"""Normalisation of whole texts: Unicode form, line ends, white space, blank lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rx import WS, collapse, let, lines, strip


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def with_nfc(df: DataFrame, column: str) -> DataFrame:
    """Unicode form NFC. ASCII texts have it already: Arrow gets nulls for them."""
    other = F.when(F.col(column).rlike(r"[^\x00-\x7f]"), F.col(column))
    return df.withColumn(column, F.coalesce(nfc(other), F.col(column)))


#: What a squeezed text never holds.
LOOSE = r"[\x00\t-\r\x1c-\x1f\x85\p{Z}](?:(?<=[^ \n])|(?<= )(?:[ \n]|\z)|(?<=\n)(?: |\n\n|\z)|(?<=\A[ \n]))"


def squeeze(text: Column) -> Column:
    """No NUL, \\n as line end, single spaces, at most one empty line in a row, nothing blank at the ends. Texts that are so already are only looked at."""
    def lines_of(t: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(t, r"\x00", ""), "\r\n?", "\n")
        each = F.transform(lines(plain), lambda x: strip(F.regexp_replace(x, f"{WS}+", " ")))
        return strip(collapse(F.array_join(each, "\n")))

    return let(text, lambda t: F.when(t.rlike(LOOSE), lines_of(t)).otherwise(t))
