"""Expressions that the operators share; all JVM-side."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that one branch of ``fanned_out`` makes of a row.
BRANCH = 4


def is_digits(value: Column) -> Column:
    """Non-empty and ASCII digits only, as text: 34 is, 34.0 and -1 aren't."""
    return value.cast("string").rlike(r"\A[0-9]+\z")


def digits_value(value: Column) -> Column:
    """The number that digit text stands for, else NULL; a decimal holds what a long can't."""
    return F.when(is_digits(value), value.cast("string").try_cast("decimal(38,0)"))


def numeric(value: Column) -> Column:
    """The number that a value stands for, floats and negatives included, else NULL."""
    return value.cast("string").try_cast("double")


def numeric_or_zero(value: Column) -> Column:
    """The number of digit text, else 0."""
    return F.coalesce(F.when(is_digits(value), numeric(value)), F.lit(0.0))


def range_label(lower: Column, upper: Column) -> Column:
    """``lower-upper``, NULL if one is."""
    return F.concat(lower.cast("string"), F.lit("-"), upper.cast("string"))


def split_ranges(value: Column) -> Column:
    """The parts of a comma-joined list of ranges."""
    return F.split(value, ",")


def entropy(total: Column, sum_c_ln_c: Column) -> Column:
    """Natural-log entropy from a count's total and the sum of c ln c: ln N - sum / N."""
    return F.when(total > 0, F.ln(total) - sum_c_ln_c / total).otherwise(F.lit(0.0))


def relative_error(original: Column, new: Column) -> Column:
    """(original - new) / original, NULL where the original is 0."""
    return F.try_divide(original - new, original)


def repetition_reward(count: Column) -> Column:
    """What a value that occurs ``count`` times adds to a quality score."""
    return F.when(count > 1, F.tanh(1.0 / (count - 1))).otherwise(F.lit(0.0))


def key_of(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a tuple: together a key of fixed size for column sets of any width."""
    cols = [F.col(f"`{c}`") for c in columns]
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)]


def combinations_count(n: int, r: int | None = None) -> int:
    """C(n, r); without r, the sets of two columns and more."""
    return math.comb(n, r) if r is not None else 2**n - n - 1


def is_null_literal(value: Column) -> Column:
    """NULL or NaN."""
    return value.isNull() | F.coalesce(F.isnan(value.try_cast("double")), F.lit(False))


def unused(df: DataFrame, n: int) -> list[str]:
    """Names for helper columns that the table lacks (Spark doesn't tell upper from lower case)."""
    there = {c.lower() for c in df.columns}
    return [f"_own{i}" for i in range(n + len(there)) if f"_own{i}" not in there][:n]


def fanned_out(df: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """The fields of each struct of ``entries``, a row per entry and row of ``df``; NULL entries give none.

    A union of branches of a few entries each: a branch scans only the columns
    that its entries use, its code stays small enough to be compiled, and its
    partial sums see few kinds of keys.  One explode of all entries took five
    times as long for 45 of them.
    """
    out = None
    for i in range(0, len(entries), BRANCH):
        branch = df.select(F.explode(F.array(*entries[i : i + BRANCH])).alias("entry")).where("entry is not null").select("entry.*")
        out = branch if out is None else out.union(branch)
    return out
