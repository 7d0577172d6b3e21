"""Helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"


def without(df: DataFrame, *names: str) -> DataFrame:
    """The input without columns that carry the name of a result; the result wins."""
    return df.drop(*names)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read instead of computing them again.

    The optimizer pulls a plain projection into every lambda that uses it; a generated
    row is left alone. Both sides of it stay in generated code.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def words(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def unit_draw(*values: Column) -> Column:
    """A number in (0, 1) that depends on the values alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*values), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Join condition on equal keys, where null equals null."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition
