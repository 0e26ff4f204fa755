"""The few functions that built-in expressions cannot state, over Arrow batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def sequence_ratio(a: str, b: str) -> Column:
    """2 M / T of the matching blocks of two texts, lowered and stripped."""

    @pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, (p or "").strip().lower(), (q or "").strip().lower()).ratio() for p, q in zip(x, y)])

    return ratio(a, b)


def sequence_reaches(a: str, b: str, least: float) -> Column:
    """Whether sequence_ratio is at least so much. Bounds from lengths and from counts of letters settle most unlike pairs without the blocks."""

    @pandas_udf("boolean")
    def reaches(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            m = difflib.SequenceMatcher(None, (p or "").strip().lower(), (q or "").strip().lower())
            out.append(m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least)
        return pd.Series(out, dtype=bool)

    return reaches(a, b)
