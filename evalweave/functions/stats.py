"""Small statistics as columns."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function; meant for one row per comparison."""
    return x.map(math.erfc, na_action="ignore").astype(float)


# Chebyshev coefficients of erfc, relative error below 1.2e-7.
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc_expression(x: Column) -> Column:
    """erfc for x >= 0 inside generated code, for use over many rows."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def mean_std_text(mean: Column, std: Column, digits: int = 1) -> Column:
    """'mean±std' with a fixed number of digits."""
    return F.format_string(f"%.{digits}f±%.{digits}f", mean, std)


def finite(value: Column) -> Column:
    """The value as a finite double; NULL, text, NaN and infinities become NULL (F2)."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


# Tasks receive these functions by value; workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
