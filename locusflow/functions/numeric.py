"""Ratios and comparisons that treat undefined values as C does, and exact fixed-point text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles: null for 0/0, signed infinity for x/0."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(y != 0, F.try_divide(x, y)).when(x > 0, float("inf")).when(x < 0, float("-inf"))


def holds(condition: Column) -> Column:
    """False where a comparison has no value, so that nothing is above or below an undefined ratio."""
    return F.coalesce(condition, F.lit(False))


def _fixed(x: pd.Series, places: int) -> pd.Series:
    v = x.to_numpy(np.float64, na_value=np.nan)
    return pd.Series(np.char.mod(f"%.{places}f", v).astype(object)).where(~np.isnan(v), None)


@F.pandas_udf(StringType())
def fixed3(x: pd.Series) -> pd.Series:
    """Three decimals, ties by the exact binary value (JVM formatting rounds half up); null for undefined values."""
    return _fixed(x, 3)


@F.pandas_udf(StringType())
def fixed5(x: pd.Series) -> pd.Series:
    return _fixed(x, 5)
