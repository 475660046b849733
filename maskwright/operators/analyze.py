"""Statistics of quasi-identifiers; ``qis`` is a table (columns array<string>, len int, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.scalars import combinations_count


def popularity(qis: DataFrame) -> DataFrame:
    """(colname, n): in how many quasi-identifiers a column occurs, most first."""
    return qis.select(F.explode("columns").alias("colname")).groupBy("colname").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "colname")


def most_popular(qis: DataFrame) -> DataFrame:
    return popularity(qis).limit(1)


def popularity_ranks(found: Sequence[Sequence[str]], names: Sequence[str]) -> dict[str, int]:
    """Rank of each column by popularity, first the most popular; ties by the table's order."""
    n = {c: sum(c in qi for qi in found) for c in names}
    return {c: i for i, c in enumerate(sorted((c for c in names if n[c]), key=lambda c: (-n[c], list(names).index(c))))}


def affected_by(qis: DataFrame, column: str) -> DataFrame:
    """Quasi-identifiers that hold a column."""
    return qis.where(F.array_contains("columns", column))


def allowed_columns(qis: DataFrame, names: Sequence[str]) -> DataFrame:
    """(colname, allowed): the columns that occur with it in no quasi-identifier, and itself; columns without another are left out."""
    pairs = qis.select(F.explode("columns").alias("colname"), "columns")
    met = pairs.groupBy("colname").agg(F.array_distinct(F.flatten(F.collect_set("columns"))).alias("met"))
    every = qis.sparkSession.createDataFrame([(c,) for c in names], "colname string")
    own = every.join(F.broadcast(met), "colname", "left")  # a row per column of the table
    free = F.array_except(F.array(*[F.lit(c) for c in names]), F.coalesce("met", F.array().cast("array<string>")))
    allowed = F.array_sort(F.array_distinct(F.concat(free, F.array("colname"))))
    return own.select("colname", allowed.alias("allowed")).where(F.size("allowed") > 1)


def column_statistics(qis: DataFrame, names: Sequence[str]) -> DataFrame:
    """(colname, occurrence, mean_length, n_allowed, allowed_sets, mean_allowed_length): per column that occurs.

    ``n_allowed``: columns of its own allowed set; ``allowed_sets``: different
    allowed sets, of any column that occurs, that hold it, and their mean length.
    """
    rows = qis.select(F.explode("columns").alias("colname"), "len")
    stats = rows.groupBy("colname").agg(F.count("*").alias("occurrence"), F.avg("len").alias("mean_length"))
    allowed = allowed_columns(qis, names).join(stats.select("colname"), "colname")
    sets = allowed.select("allowed").distinct().select(F.explode("allowed").alias("colname"), F.size("allowed").alias("n"))
    sets = sets.groupBy("colname").agg(F.count("*").alias("allowed_sets"), F.avg("n").alias("mean_allowed_length"))
    stats = stats.join(allowed.select("colname", F.size("allowed").alias("n_allowed")), "colname", "left").join(sets, "colname", "left")
    return stats.withColumns({"n_allowed": F.coalesce("n_allowed", F.lit(0)), "allowed_sets": F.coalesce("allowed_sets", F.lit(0).cast("long"))})


def found_by_length(qis: DataFrame, lengths: Sequence[int] | None = None) -> DataFrame:
    """(colname, one column ``{len}_ucc_found`` per length)."""
    rows = qis.select(F.explode("columns").alias("colname"), F.concat(F.col("len").cast("string"), F.lit("_ucc_found")).alias("kind"))
    pivot = rows.groupBy("colname").pivot("kind", [f"{n}_ucc_found" for n in lengths] if lengths else None)
    return pivot.agg(F.count(F.lit(1))).na.fill(0)


def weights(qis: DataFrame, profiled: DataFrame) -> DataFrame:
    """(columns, len, weight, mean_weight): entropies summed and averaged, rounded up."""
    entropies = profiled.select("colname", F.col("entropy").alias("e"))
    keyed = qis.select("columns", "len", F.explode("columns").alias("colname")).join(entropies, "colname")
    return keyed.groupBy("columns", "len").agg(F.ceil(F.round(F.sum("e"), 9)).alias("weight"), F.ceil(F.round(F.avg("e"), 9)).alias("mean_weight"))


def by_length(weighted: DataFrame) -> DataFrame:
    """(len, n, mean_weight) for every length, the greatest too."""
    return weighted.groupBy("len").agg(F.count("*").alias("n"), F.ceil(F.avg("weight")).alias("mean_weight"))


def by_weight(weighted: DataFrame, column: str = "weight") -> DataFrame:
    return weighted.groupBy(column).agg(F.count("*").alias("n"))


def round_statistics(spark: SparkSession, lengths: Sequence[Sequence[int]]) -> DataFrame:
    """(round, n, mean, std) of the lengths found in each round; std is the population's."""
    rows = [(i, int(n)) for i, found in enumerate(lengths) for n in found]
    return spark.createDataFrame(rows, "round int, length int").groupBy("round").agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.stddev_pop("length").alias("std"))


def lattice_sizes(spark: SparkSession, n: int) -> DataFrame:
    """(len, n_sets): column sets of each length."""
    return spark.createDataFrame([(r, combinations_count(n, r)) for r in range(1, n + 1)], "len int, n_sets long")


def moments(df: DataFrame, column: str) -> DataFrame:
    """Mean, deviation, skewness and kurtosis: the shape of a numeric column."""
    v = F.col(column)
    return df.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))


def analyze(qis: DataFrame, profiled: DataFrame) -> dict[str, DataFrame]:
    """All reports."""
    names = [r["colname"] for r in profiled.orderBy("position").collect()]
    weighted = weights(qis, profiled)
    longest = qis.agg(F.max("len")).first()[0] or 2
    return {
        "popularity": popularity(qis),
        "allowed": allowed_columns(qis, names),
        "columns": column_statistics(qis, names),
        "by_length_of_column": found_by_length(qis, list(range(2, longest + 1))),
        "weights": weighted,
        "lengths": by_length(weighted),
        "by_weight": by_weight(weighted),
        "by_mean_weight": by_weight(weighted, "mean_weight"),
        "lattice": lattice_sizes(qis.sparkSession, len(names)),
        "scatter": profiled.select("colname", "entropy", "cardinality").join(popularity(qis), "colname", "left"),
    }

