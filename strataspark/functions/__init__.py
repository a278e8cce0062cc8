"""Column expressions of the modelling engine. Angles are degrees; NULL means unknown."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
