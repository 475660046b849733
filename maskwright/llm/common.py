"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: int | None, modulus: int) -> int:
    """crc32 of the decimal id, modulo; the stated folds are made of it (null: of the empty string)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def fold_of(column: str, modulus: int) -> Column:
    """crc32 of the decimal id, modulo (as ``crc_mod``)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, so that memory stays bounded (one row may exceed it)."""
    for batch in batches:
        start = size = 0
        lengths = batch.column(column).cast(pa.large_binary())
        ends = memoryview(lengths.buffers()[1]).cast("q")[lengths.offset : lengths.offset + len(batch) + 1] if len(batch) else []
        for i in range(len(batch)):
            n = ends[i + 1] - ends[i]
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(batch) > start:
            yield batch.slice(start)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() needs a shared folder: the cluster's ``spark.checkpoint.dir``, else (tests, a single machine) our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
        context.setCheckpointDir(given or os.path.join("/tmp", "checkpoints", f"maskwright-{context.applicationId}"))
