"""Column profiles and first-class identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.config import Settings
from maskwright.functions.scalars import entropy, fanned_out


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position, is_null, h1, h2): a row per cell; values as a pair of hashes, so that what is shuffled has a fixed size.

    NULL has hashes of its own kind (the flag), so counts need no text.
    """
    cells = [F.struct(F.lit(i).alias("position"), F.col(f"`{c}`").isNull().alias("is_null"), F.xxhash64(F.col(f"`{c}`")).alias("h1"), F.xxhash64(F.lit(1), F.col(f"`{c}`")).alias("h2")) for i, c in enumerate(columns)]
    return fanned_out(df, cells)


def _named(columns: Sequence[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), position + 1)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, all columns in one job of two aggregates.

    ``cardinality``: distinct values, NULL as one, per non-null row;
    ``coverage_of_uniques``: values that occur once per non-null row; both NULL
    for a column without values.
    """
    columns = list(columns or df.columns)
    counts = _values(df, columns).groupBy("position", "is_null", "h1", "h2").agg(F.count("*").alias("c"))
    some = ~F.col("is_null")
    total = F.sum(F.when(some, F.col("c")).otherwise(0))
    stats = counts.groupBy("position").agg(
        total.alias("n_values"),
        F.sum(F.when(some, 0).otherwise(F.col("c"))).alias("n_nulls"),
        F.count("*").alias("n_distinct"),
        F.sum(F.when(some & (F.col("c") == 1), 1).otherwise(0)).alias("unique_entries"),
        F.sum(F.when(some, F.col("c") * F.ln("c")).otherwise(0.0)).alias("sum_c_ln_c"),
    )
    ratio = lambda x: F.try_divide(F.col(x).cast("double"), F.col("n_values").cast("double"))
    value = entropy(F.col("n_values").cast("double"), F.col("sum_c_ln_c"))
    return stats.select(
        _named(columns, F.col("position")).alias("colname"),
        "position",
        F.round(value, 6).alias("entropy"),
        F.bround(value, 2).alias("entropy_rounded"),
        ratio("n_distinct").alias("cardinality"),
        "n_distinct",
        "n_values",
        "n_nulls",
        "unique_entries",
        ratio("unique_entries").alias("coverage_of_uniques"),
    )


def first_class_identifiers(profiled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of a profile whose column identifies rows by itself."""
    found = F.col("coverage_of_uniques") * 100 > settings.identifier_coverage
    if settings.identifier_cardinality is not None:
        found = found | (F.col("cardinality") * 100 > settings.identifier_cardinality)
    return profiled.where(found)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all."""
    if not df.columns:
        return df
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if not counts[i]])


def without_identifiers(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Without the columns that identify rows by themselves."""
    return df.drop(*[r["colname"] for r in first_class_identifiers(profile(df), settings).collect()])  # a row per column


def ranked(profiled: DataFrame, by: str = "cardinality") -> DataFrame:
    """(place, colname, value): columns by cardinality or entropy, the greatest first, then by position; those without a value last."""
    order = Window.orderBy(F.col(by).desc_nulls_last(), "position")  # a row per column
    return profiled.select((F.row_number().over(order) - 1).alias("place"), "colname", F.col(by).alias("value"))


def highest_cardinality(profiled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(colname): the member of a column set with the greatest cardinality, the first by position of equals."""
    return ranked(profiled.where(F.col("colname").isin(list(columns)))).where("place = 0").select("colname")


def prefix(df: DataFrame, n: int) -> DataFrame:
    """The first n columns (all, if there are fewer, or if n is 0)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[: n or None]])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) without NULL."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
