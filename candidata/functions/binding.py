"""Evaluate an expression once although it is used several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` computed once per row.

    Inside a lambda nothing is shared: an expression that does not depend on the
    lambda's argument would still run for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def explode_once(df: DataFrame, keep: list[Column | str], items: Column, *names: str) -> DataFrame:
    """`keep` and one row per item of an array or entry of a map; empty ones give no row.

    For a plain explode the optimizer adds a filter on the size of the list, which
    computes a derived list a second time. Items must not be null.
    """
    rows = df.select(*keep, F.explode_outer(items).alias(*names))
    return rows.filter(F.col(names[0]).isNotNull())


def inline_once(df: DataFrame, keep: list[Column | str], items: Column, never_null: str) -> DataFrame:
    """As `explode_once`, with the fields of structs as columns; `never_null` is one of them."""
    return df.select(*keep, F.inline_outer(items)).filter(F.col(never_null).isNotNull())
