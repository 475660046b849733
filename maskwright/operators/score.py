"""Quality and size of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.functions.scalars import numeric_or_zero, relative_error, repetition_reward
from maskwright.operators.profile import _named, _values


def column_scores(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, colname, score): distinct values, NULL as one, and a reward for every repeated value."""
    columns = list(columns or df.columns)
    counts = _values(df, columns).groupBy("position", "is_null", "h1", "h2").agg(F.count("*").alias("c"))
    reward = F.sum(F.when(F.col("is_null"), 0.0).otherwise(repetition_reward(F.col("c"))))
    return counts.groupBy("position").agg((F.count("*") + reward).alias("score")).select("position", _named(columns, F.col("position")).alias("colname"), "score")


def falsification(df: DataFrame, pairs: Sequence[tuple[str, str]], absolute: bool = False) -> DataFrame:
    """(column, penalty): the sum of relative errors between an original column and a new one beside it."""
    parts = []
    for original, new in pairs:
        error = relative_error(numeric_or_zero(F.col(f"`{original}`")), numeric_or_zero(F.col(f"`{new}`")))
        parts.append(F.coalesce(F.sum(F.abs(error) if absolute else error), F.lit(0.0)).alias(new))
    wide = df.agg(*parts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("penalty")) for _, n in pairs])).alias("p")).select("p.*")


def quality_score(df: DataFrame, columns: Sequence[str] | None = None, penalties: DataFrame | None = None) -> DataFrame:
    """(score): column scores, less penalties, summed and times the number of columns."""
    columns = list(columns or df.columns)
    scores = column_scores(df, columns)
    if penalties is not None:
        scores = scores.join(penalties, F.col("colname") == F.col("column"), "left").withColumn("score", F.col("score") - F.coalesce("penalty", F.lit(0.0)))
    return scores.agg((F.sum("score") * len(columns)).alias("score"))


def score_sweep(df: DataFrame, least: int = 2) -> DataFrame:
    """(n_columns, score) of every prefix of at least ``least`` columns: a column's score is counted once for all prefixes."""
    running = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # a row per column
    n = F.col("position") + 1
    return column_scores(df).select(n.alias("n_columns"), (F.sum("score").over(running) * n).alias("score")).where(F.col("n_columns") >= least)


def data_size(df: DataFrame) -> DataFrame:
    """(bytes): UTF-8 bytes of all values as text."""
    size = F.lit(0)
    for c in df.columns:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"))
