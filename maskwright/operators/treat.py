"""Treatments of a quasi-identifier: what replaces a column's values, and where.

A treatment changes every row that holds an affected value (``scope="value"``),
or only the rows that are unique (``scope="row"``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.config import Settings
from maskwright.functions.scalars import digits_value, is_digits, numeric, range_label, unused
from maskwright.operators.uniqueness import representatives


#: Parts in which the numbers of a column are sorted, at most.
PARTS = 200


def remap(df: DataFrame, column: str, mapping: DataFrame, where: Column | None = None) -> DataFrame:
    """``column`` by a table (key, new): values without a key stay, keys may lead to NULL.

    A left equi-join; the mapping may be as large as the table, so Spark
    decides whether it is small enough to broadcast.
    """
    names = df.columns
    to = mapping.schema["new"].dataType.simpleString()
    key, value, marked = unused(df, 3)
    keyed = mapping.select(F.col("key").alias(key), F.col("new").alias(value), F.lit(True).alias(marked))
    joined = df.join(keyed, df[f"`{column}`"] == keyed[key], "left")
    hit = F.coalesce(F.col(marked), F.lit(False))
    if where is not None:
        hit = hit & where
    new = F.when(hit, F.col(value)).otherwise(F.col(f"`{column}`").cast(to))
    return joined.select(*[new.alias(c) if c == column else F.col(f"`{c}`") for c in names])


def affected_values(df: DataFrame, columns: Sequence[str], column: str) -> DataFrame:
    """(key): the distinct values of ``column`` in unique rows of ``columns``."""
    return representatives(df, columns).where("count = 1").select(F.col(f"`{column}`").alias("key")).distinct()


# ---------------------------------------------------------------- suppression


def suppress(df: DataFrame, columns: Sequence[str], column: str, settings: Settings = Settings(), scope: str = "value") -> tuple[DataFrame, int]:
    """NULL for affected values, and how many distinct ones; the whole column (and its non-null rows) if unique rows exceed 99 % of them."""
    n_unique = representatives(df, columns).where("count = 1").count()
    n_values = df.where(F.col(f"`{column}`").isNotNull()).count()
    if n_values and 100.0 * n_unique / n_values > settings.suppress_all_pct:
        return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType)), n_values
    keys = affected_values(df, columns, column)
    mapping = keys.withColumn("new", F.lit(None).cast(df.schema[column].dataType))
    if scope == "row":
        return _by_row(df, columns, column, F.lit(None).cast(df.schema[column].dataType)), n_unique
    return remap(df, column, mapping), keys.count()


def _by_row(df: DataFrame, columns: Sequence[str], column: str, new: Column) -> DataFrame:
    """A new value in the rows that are unique under ``columns`` only."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(f"`{c}`").isNotNull()
    n = F.count("*").over(Window.partitionBy(*[F.col(f"`{c}`") for c in columns]))
    to = df.schema[column].dataType
    (unique,) = unused(df, 1)
    marked = df.withColumn(unique, full & (n == 1))
    return marked.withColumn(column, F.when(F.col(unique), new).otherwise(F.col(f"`{column}`")).cast(to)).drop(unique)


# ---------------------------------------------------------------- nearest values


def neighbours(df: DataFrame, column: str) -> DataFrame:
    """(value, lower, upper): the next smaller and greater number of the column, itself at the ends.

    Distinct numbers are parted by bounds near their quantiles and sorted
    within; only the two ends of each part are looked up across parts.
    """
    values = df.select(numeric(F.col(f"`{column}`")).alias("value")).where("value is not null").distinct()
    parts = min(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = values.approxQuantile("value", [i / parts for i in range(1, parts)], 1 / (2 * parts)) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<double>"), lambda b: b < F.col("value")))
    ranged = values.withColumn("part", part)
    inner = Window.partitionBy("part").orderBy("value")
    near = ranged.withColumn("lower", F.lag("value").over(inner)).withColumn("upper", F.lead("value").over(inner))
    ends = ranged.groupBy("part").agg(F.min("value").alias("first"), F.max("value").alias("last"))
    across = Window.orderBy("part")  # a row per partition
    ends = ends.withColumn("before", F.lag("last").over(across)).withColumn("after", F.lead("first").over(across)).select("part", "before", "after")
    return near.join(F.broadcast(ends), "part").select("value", F.coalesce("lower", "before", "value").alias("lower"), F.coalesce("upper", "after", "value").alias("upper"))


def closest(near: DataFrame) -> DataFrame:
    """(value, closest) of ``neighbours``: the nearer neighbour, the lower one if both are; never the value itself unless it is alone."""
    down, up = F.col("value") - F.col("lower"), F.col("upper") - F.col("value")
    choice = F.when(down == 0, F.col("upper")).when(up == 0, F.col("lower")).when(down <= up, F.col("lower")).otherwise(F.col("upper"))
    return near.select("value", choice.alias("closest"))


def _plain(number: Column) -> Column:
    """A whole double without its fraction."""
    return F.when(number == F.floor(number), F.floor(number).cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))


def generalize(df: DataFrame, columns: Sequence[str], column: str) -> tuple[DataFrame, int]:
    """Affected numbers become ``lower-upper`` of their neighbours, other affected values NULL; the column becomes text."""
    keys = affected_values(df, columns, column)
    own = keys.select("key", F.when(is_digits(F.col("key")), numeric(F.col("key"))).alias("v"))
    near = neighbours(df, column)
    mapping = own.join(near, own["v"] == near["value"], "left").select(F.col("key"), range_label(_plain(F.col("lower")), _plain(F.col("upper"))).alias("new"))
    return remap(df, column, mapping), keys.count()


def perturbation_of(reps: DataFrame, columns: Sequence[str], column: str) -> DataFrame:
    """(key, new): for values in unique rows, the nearest number among combinations equal in all other columns.

    NULL unless there is one on either side; the lower one of two equally
    near; of several unique rows with one value, the first by their other
    columns decides.
    """
    others = [c for c in columns if c != column]
    rows = reps.withColumn("_v", digits_value(F.col(f"`{column}`")))
    ordered = Window.partitionBy(F.col("_v").isNull(), *[F.col(f"`{c}`") for c in others]).orderBy("_v", F.col(f"`{column}`").cast("string"))
    rows = rows.withColumn("_lower", F.lag("_v").over(ordered)).withColumn("_upper", F.lead("_v").over(ordered))
    nearest = F.when(F.col("_v") - F.col("_lower") <= F.col("_upper") - F.col("_v"), F.col("_lower")).when(F.col("_lower").isNotNull() & F.col("_upper").isNotNull(), F.col("_upper"))
    to = reps.schema[column].dataType
    unique = rows.where("count = 1").select(F.col(f"`{column}`").alias("key"), nearest.cast("string").cast(to).alias("new"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("rank"))
    return unique.groupBy("key").agg(F.min_by(F.struct("new"), "rank")["new"].alias("new"))


def perturb(df: DataFrame, columns: Sequence[str], column: str) -> tuple[DataFrame, int]:
    mapping = perturbation_of(representatives(df, columns), columns, column)
    return remap(df, column, mapping), mapping.count()


# ---------------------------------------------------------------- choice


@dataclass(frozen=True)
class Choice:
    columns: tuple[str, ...]
    column: str
    treatment: str
    unique_rows: int
    coverage_pct: float


def treatment_type(sample_is_numeric: bool, pct: float, settings: Settings = Settings()) -> str:
    """What fits a column with such a sample value, by the share of unique rows."""
    if settings.treatment:
        return settings.treatment
    if sample_is_numeric and pct < settings.numeric_pct:
        return "perturbation"
    if not sample_is_numeric and pct < settings.text_pct:
        return "suppression"
    return "compartmentation"


def treated_column(columns: Sequence[str], ranks: dict[str, int]) -> str:
    """The member that occurs in most quasi-identifiers; the first of equals."""
    return min(columns, key=lambda c: (ranks.get(c, len(ranks)), list(columns).index(c)))


def choose(df: DataFrame, columns: Sequence[str], ranks: dict[str, int], settings: Settings = Settings()) -> Choice | None:
    """How to treat a quasi-identifier in the table as it is now; None if no row is unique any more.

    One job: unique rows, all rows, and the sample (the first unique row by
    its values).
    """
    column = treated_column(columns, ranks)
    unique = representatives(df, columns).where("count = 1")
    sample = F.min(F.struct(*[F.col(f"`{c}`").cast("string") for c in columns], F.col(f"`{column}`").cast("string").alias("_sample")))["_sample"]
    row = unique.agg(F.count("*").alias("n"), sample.alias("sample")).first()
    if not row["n"]:
        return None
    total = df.count()
    pct = 100.0 * row["n"] / total
    text = row["sample"] or ""
    return Choice(tuple(columns), column, treatment_type(text.isascii() and text.isdigit(), pct, settings), row["n"], pct)


def apply(df: DataFrame, choice: Choice, settings: Settings = Settings()) -> tuple[DataFrame, int]:
    """The treated table and the number of changed values (0 for compartmentation, which changes none)."""
    if choice.treatment == "suppression":
        return suppress(df, choice.columns, choice.column, settings)
    if choice.treatment == "generalization":
        return generalize(df, choice.columns, choice.column)
    if choice.treatment == "perturbation":
        return perturb(df, choice.columns, choice.column)
    return df, 0
