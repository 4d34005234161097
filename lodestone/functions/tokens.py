"""The token measure: a quarter of the characters, rounded up, or what a model's tokenizer says."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def measured(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A measure of texts by a tokenizer's ``count``, which is sent to the workers; texts for which it fails are estimated.

    A failure is an exception, or anything but a whole number from 0 on.
    """

    def counted(text: str) -> int | None:
        try:
            n = count(text)
        except Exception:  # whatever a tokenizer raises, the text has an estimate
            return None
        return int(n) if isinstance(n, int) and not isinstance(n, bool) and n >= 0 else None

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else counted(t) for t in texts], dtype="Int32")

    counts = F.pandas_udf(run, "int")
    return lambda text: F.coalesce(counts(text), estimate_tokens(text))


def estimate(text: str) -> int:
    """The same for kernels."""
    return estimate_length(len(text))


def estimate_length(characters: int) -> int:
    return math.ceil(characters / 4)
