"""Sinks: files, metrics, database tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """Gzip CSV with a header; the path."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("compression", "gzip").csv(path)
    return path


def write_compartments(df: DataFrame, parts: Sequence[Sequence[str]], base: str) -> list[str]:
    return [write_csv(df.select(*[F.col(f"`{c}`") for c in part]), f"{base}/compartment={i}") for i, part in enumerate(parts)]


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_statistics(df: DataFrame, path: str) -> str:
    """Per-column statistics, semicolon-separated."""
    return write_csv(df, path, sep=";")


def append_metrics(spark: SparkSession, path: str, run_id: str, metrics: Mapping[str, float], n_columns: int, treatment: str | None) -> None:
    """(run_id, metric, value, n_columns, treatment), one row per metric."""
    rows = [(run_id, name, float(value), n_columns, treatment) for name, value in metrics.items()]
    spark.createDataFrame(rows, "run_id string, metric string, value double, n_columns int, treatment string").coalesce(1).write.mode("append").parquet(path)


def save_search(spark: SparkSession, path: str, key: str, table: DataFrame) -> None:
    table.select(F.lit(key).alias("fingerprint"), "columns", "len", "unique_rows", "coverage_pct").coalesce(1).write.mode("overwrite").parquet(f"{path}/{key}")


def write_table(df: DataFrame, name: str) -> None:
    """A catalog table, replaced."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.mode("overwrite").saveAsTable(name)


def write_jdbc(df: DataFrame, url: str, name: str, properties: Mapping[str, Any] | None = None, width: int | None = 255, batch: int = 10_000) -> None:
    """A database table, dropped and made anew, every column text of ``width`` (None: the database's own text type).

    Values are bound by the driver, never quoted by hand.
    """
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    writer = text.write.option("batchsize", batch)
    if width:
        writer = writer.option("createTableColumnTypes", ", ".join(f"`{c}` VARCHAR({width})" for c in df.columns))
    writer.jdbc(url, name, mode="overwrite", properties=dict(properties or {}))


def store_compartments(df: DataFrame, parts: Sequence[Sequence[str]], name: str, write=write_table) -> list[str]:
    """Each compartment as a table ``name_i``."""
    names = []
    for i, part in enumerate(parts):
        names.append(f"{name}_{i}")
        write(df.select(*[F.col(f"`{c}`") for c in part]), names[-1])
    return names
