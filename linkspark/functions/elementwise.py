"""Arithmetic and comparisons of two columns, or of array columns element by element.

Comparisons give 1 or 0 as BIGINT, and null where a value is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    return condition.cast("long")


def multiply(a: Column, b: Column) -> Column:
    return a * b


def exp(a: Column) -> Column:
    return F.exp(a)


def divide(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def greater(a: Column, b: Column) -> Column:
    return flag(a > b)


def equals(a: Column, b: Column) -> Column:
    return flag(a == b)


def both(a: Column, b: Column) -> Column:
    """The product of two flags."""
    return flag(a & b)


def positive_mod(a: Column, n: int) -> Column:
    """The remainder from 0 to n - 1."""
    return F.pmod(a, F.lit(n).cast("long"))


def bits_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def sort_elements(a: Column) -> Column:
    """An array's elements, the smallest first."""
    return F.array_sort(a)
