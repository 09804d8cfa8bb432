"""Columns that are evaluated once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MADE = "__made"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    The value is bound to a lambda variable, which also keeps the expression small: without
    it nested helpers copy one another's inputs until planning takes longer than the job.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace ``columns`` so that nothing above evaluates them again.

    A filter on a projected column is pushed below the projection by copying the column's
    expression into it, over and over for columns built on one another. A one-element
    ``inline`` keeps such filters above it. The values are made in a projection below it: that
    is compiled whatever they contain, an ``inline`` with a lambda in it is not.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, made.alias(MADE)).select(*kept, F.inline(F.array(MADE)))


def pick_once(df: DataFrame, *columns: Column) -> DataFrame:
    """``select`` with the same guarantee; all columns carry an alias."""
    return df.select(F.struct(*columns).alias(MADE)).select(F.inline(F.array(MADE)))
