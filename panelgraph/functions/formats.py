"""Number and p-value formats of the reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "--"
NO_BREAK = "\u00a0"


def plain_number(x: float | None, digits: int = 3) -> str:
    """A decimal comma, a no-break space between thousands; -- for what is not a number."""
    if x is None or not math.isfinite(x):
        return MISSING
    return f"{x:,.{digits}f}".replace(",", NO_BREAK).replace(".", ",")


def plain_integer(x: float | None) -> str:
    return plain_number(x, 0)


def plain_pvalue(p: float | None, floor: float = 0.001) -> str:
    if p is None or not math.isfinite(p):
        return MISSING
    return f"<{floor:.3f}".replace(".", ",") if p < floor else plain_number(p, 3)


def number_column(c: Column, digits: int = 3) -> Column:
    """plain_number as a column."""
    text = F.translate(F.format_number(c, digits), ",.", NO_BREAK + ",")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), MISSING).otherwise(text)


def pvalue_column(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), MISSING).when(p < 0.001, "<0,001").otherwise(number_column(p, 3))
