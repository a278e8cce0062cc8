"""Colours as text and as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def of_name(name: Column, seed: int = 0) -> Column:
    """A colour that depends on the name and a seed alone, so it's the same on all executors and in all runs."""
    return F.concat(F.lit("#"), F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 6))


def rgb(colour: Column) -> tuple[Column, Column, Column]:
    """Shares of red, green and blue of #rgb or #rrggbb; NULL for other text."""
    digits = F.substring(colour, 2, 6)
    full = F.when(F.length(colour) == 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    full = F.when(colour.rlike("^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"), full)
    return tuple(F.conv(F.substring(full, i, 2), 16, 10).cast("double") / 255.0 for i in (1, 3, 5))
