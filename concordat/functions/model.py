"""Scalars of recorded model calls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.session import ship

# The increment and finaliser of the split-mix generator, 64-bit arithmetic.
GOLDEN = 0x9E3779B97F4A7C15
FIRST_FACTOR = 0xBF58476D1CE4E5B9
SECOND_FACTOR = 0x94D049BB133111EB
_MASK = (1 << 64) - 1


def derive_seed(base: int, attempt: int) -> int:
    """The seed of a repair attempt: a finaliser over base + attempt * GOLDEN."""
    z = (base + attempt * GOLDEN) & _MASK
    z = ((z ^ (z >> 30)) * FIRST_FACTOR) & _MASK
    z = ((z ^ (z >> 27)) * SECOND_FACTOR) & _MASK
    return z ^ (z >> 31)


@F.pandas_udf(T.DecimalType(20, 0))
def _seeds(base: pd.Series, attempt: pd.Series) -> pd.Series:
    from decimal import Decimal

    return pd.Series([Decimal(derive_seed(int(b), int(a))) for b, a in zip(base, attempt)])


def seed(base: Column | str, attempt: Column | str) -> Column:
    """Unsigned 64-bit, so a decimal: a BIGINT multiplication would overflow."""
    ship(SparkSession.active())
    return _seeds(base, attempt)
