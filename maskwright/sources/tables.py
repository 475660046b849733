"""Sources: CSV and Parquet tables, their schemas, saved searches, compartments."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.config import Settings

SAVED = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("len", T.IntegerType()), T.StructField("unique_rows", T.LongType()), T.StructField("coverage_pct", T.DoubleType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, max_rows: int = 0, columns: Sequence[str] | None = None, sep: str = ",", partitions: int = 0) -> DataFrame:
    """A CSV table with a header; gzip is read too, but by one task per file, hence ``partitions``.

    Without a schema it is inferred, which reads the file twice; max_rows 0: all.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    df = df.select(*columns) if columns else df
    df = df.limit(max_rows) if max_rows else df
    return df.repartition(partitions) if partitions else df


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str], **options: Any) -> DataFrame:
    """A CSV table all of whose columns are strings, projected."""
    header = spark.read.option("header", True).csv(path).columns
    return read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in header]), columns=columns, **options)


def read_schema(spark: SparkSession, path: str) -> list[str]:
    """Column names; no row is read beyond the header."""
    return spark.read.option("header", True).csv(path).columns if not path.rstrip("/").endswith(".parquet") else spark.read.parquet(path).columns


def missing_columns(wanted: Sequence[str], there: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in set(there)]


def read_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON object, such as credentials."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def read_compartments(spark: SparkSession, base: str, n: int) -> list[DataFrame]:
    """What ``sinks.write_compartments`` wrote."""
    return [spark.read.option("header", True).option("inferSchema", True).csv(f"{base}/compartment={i}") for i in range(n)]


def fingerprint(df: DataFrame, n_rows: int, settings: Settings) -> str:
    """Of schema, rows and settings: searches are found again only for the same table and rules."""
    given = json.dumps([df.schema.jsonValue(), n_rows, asdict(settings)], sort_keys=True, default=str)
    return hashlib.sha256(given.encode()).hexdigest()


def saved_search(spark: SparkSession, path: str, key: str) -> list[tuple[tuple[str, ...], int]] | None:
    """The (columns, unique rows) saved under a fingerprint; None if there are none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    rows = spark.read.schema(SAVED).parquet(f"{path}/{key}").orderBy("len", F.col("columns")).collect()
    return [(tuple(r["columns"]), r["unique_rows"]) for r in rows]
