"""Elementwise operations on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_op(a: Column, b: Column, op: str) -> Column:
    """Elementwise AND, OR or XOR of two equal-length integer arrays."""
    ops = {
        "AND": lambda x, y: x.bitwiseAND(y),
        "OR": lambda x, y: x.bitwiseOR(y),
        "XOR": lambda x, y: x.bitwiseXOR(y),
    }
    if op not in ops:
        raise ValueError(f"unknown bit operation {op!r}; use one of {sorted(ops)}")
    same = F.size(a) == F.size(b)
    return F.when(same, F.zip_with(a, b, ops[op])).otherwise(
        F.raise_error(F.lit("vectors must have the same length"))
    )


def odd_sum(values: Column) -> Column:
    """Sum of the odd elements."""
    odd = F.filter(values, lambda x: x % 2 != 0)
    return F.aggregate(odd, F.lit(0).cast("bigint"), lambda s, x: s + x)


def sqrt_each(values: Column) -> Column:
    """Square root of each element."""
    return F.transform(values, lambda x: F.sqrt(x))
