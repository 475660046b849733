"""Representatives of column sets and their unique rows.

Rows with a NULL in a set take no part in that set; shares are of all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.scalars import fanned_out, key_of


def representatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations with their ``count``."""
    return df.na.drop(subset=list(columns)).groupBy(*columns).count()


def unique_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations that occur once."""
    return representatives(df, columns).where("count = 1")


def repeated_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return representatives(df, columns).where("count > 1")


def coverage(df: DataFrame, sets: Iterable[Sequence[str]], share: int = 1) -> DataFrame:
    """(set_id, n_unique, n_combinations) of many column sets in one job; ``share``: of one key in so many, chosen by hash.

    A row gives one key per set: the set's number and two hashes, 20 bytes
    whatever the set's width; counting keys has map-side partial sums.
    """
    keys = []
    for i, columns in enumerate(sets):
        h1, h2 = key_of(columns)
        full = F.lit(True)
        for c in columns:
            full = full & F.col(f"`{c}`").isNotNull()
        if share > 1:
            full = full & (F.pmod(h1, F.lit(share)) == 0)
        keys.append(F.when(full, F.struct(F.lit(i).alias("set_id"), h1.alias("h1"), h2.alias("h2"))))
    counted = fanned_out(df, keys).groupBy("set_id", "h1", "h2").agg(F.count("*").alias("c"))
    return counted.groupBy("set_id").agg(F.sum((F.col("c") == 1).cast("long")).alias("n_unique"), F.count("*").alias("n_combinations"))


def coverage_by_grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(gid, n_unique) of the same by GROUPING SETS on the values themselves; gid as grouping_id() over all columns."""
    every = sorted({c for s in sets for c in s}, key=df.columns.index)
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(F.grouping_id().alias("_gid"), F.count("*").alias("_count"), *[F.grouping(c).alias(f"_{i}") for i, c in enumerate(every)])
    null_key = F.lit(False)
    for i, c in enumerate(every):  # NULL in the data, not a column that the set lacks
        null_key = null_key | ((F.col(f"_{i}") == 0) & F.col(c).isNull())
    return grouped.where(~null_key).groupBy(F.col("_gid").alias("gid")).agg(F.sum((F.col("_count") == 1).cast("long")).alias("n_unique"))


def qi_table(spark: SparkSession, found: Iterable[tuple[Sequence[str], int]], n_rows: int) -> DataFrame:
    """(columns, len, unique_rows, coverage_pct) from (set, unique rows)."""
    rows = [(list(c), len(c), int(u), 100.0 * u / n_rows if n_rows else 0.0) for c, u in found]
    return spark.createDataFrame(rows, "columns array<string>, len int, unique_rows long, coverage_pct double")
