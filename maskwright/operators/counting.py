"""Unique rows of many column sets of a large joined table, within a bounded share of its size on disk.

The joined table is written once, in slices of one column's hash: that filter
goes below the join, so a slice shuffles its part of the inputs only.  Its sets
are then counted by pivot, the column of a set with the most values: the other
columns are dealt out by it in compressed blocks of columns, not as rows, and a
task counts all sets of its rows on dictionary codes (exact, no hashes).  Keys
of 20 bytes per row and set would be many times the table.  Each job's shuffle
files go when it ends.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.operators.uniqueness import coverage
from maskwright.plans import lattice
from maskwright.session import ship

#: Bytes of files from which on a join of them is written instead of cached, and the slices it is written in.
LARGE, SLICES = 64 << 20, 4
#: Columns shuffled at once, rows of a task, and combinations up to which map-side partial sums do.
COLUMNS, TASK_ROWS, FEW = 32, 400_000, 50_000
#: One value in so many (more, if those have over ``TASK_ROWS`` rows) tells most sets with a unique row; columns whose values are tried.
SHARE, TRIED = 64, 10
#: Buckets of a pivot's values that tell whether any value is hot.
FINE = 4096
_PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def slicing_column(df: DataFrame) -> str | None:
    """The first column that comes unchanged from the largest file of a large inner join; None for any other table."""
    if not all(isinstance(f.dataType, _PLAIN) or f.dataType.simpleString() == "string" for f in df.schema.fields):
        return None
    plan = df._jdf.queryExecution().optimizedPlan()
    lines = plan.toString().strip().split("\n")
    if not plan.deterministic() or not all(re.match(r"[\s:+-]*(Project|Filter|Join Inner|Relation)\b", line) for line in lines):
        return None
    leaves = [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())]
    sizes = [int(str(leaf.stats().sizeInBytes())) for leaf in leaves]
    if len(leaves) < 2 or sum(sizes) < LARGE:
        return None
    own = leaves[max(range(len(leaves)), key=sizes.__getitem__)].output()
    ids = {own.apply(i).exprId().id() for i in range(own.size())}
    given = plan.output()
    return next((c for i, c in enumerate(df.columns) if given.apply(i).exprId().id() in ids), None)


def written(df: DataFrame, column: str, path: str) -> DataFrame:
    """The table, written and read again."""
    for i in range(SLICES):
        df.where(F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(SLICES)) == i).write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kinds_of(df: DataFrame) -> list[int]:
    """About how many values each column has."""
    return list(df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first())


def _growing(order: Sequence[int]):
    """From rows (own, columns) to (grown, own): columns that join column ``own`` as long as no row is unique; all rows of some of its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        coded = [pa.concat_arrays(c.chunks).dictionary_encode() for c in pa.Table.from_batches(held).combine_chunks().columns]
        which, codes = coded[0].dictionary.to_numpy()[coded[0].indices.to_numpy()], [c.indices.fill_null(-1).to_numpy().astype(np.int64) + 1 for c in coded[1:]]
        found = []
        for own in np.unique(which).tolist():
            rows, grown, code = which == own, [], None
            for i in [own, *(x for x in order if x != own)]:
                more = codes[i][rows]
                _, wider, counts = np.unique(more if code is None else code * (int(more.max()) + 1) + more, return_inverse=True, return_counts=True)
                if counts.min() > 1:
                    grown, code = [*grown, i], wider.astype(np.int64)
                elif i == own:
                    break
            found.append((lattice.mask_of(grown), own))
        yield pa.RecordBatch.from_arrays([pa.array([str(m) for m, _ in found]), pa.array([o for _, o in found], pa.int32())], names=["grown", "own"])

    return run


def grown_empty_set(df: DataFrame, kinds: Sequence[int]) -> int:
    """A large column set without a unique row, 0 if none is found: without NULLs no set within it has one.

    From each of the columns with the most values a set is grown over all rows
    of a share of that column's values, those with the fewest values first; the
    largest that result are counted in full.
    """
    ship(df.sparkSession)
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: (kinds[i], i))
    share = max(SHARE, df.count() // TASK_ROWS)
    tried = [F.when(F.pmod(F.xxhash64(_plain(df, names[i])), F.lit(share)) == 0, F.lit(i)) for i in order[-TRIED:]]
    sampled = df.select(F.explode(F.array_compact(F.array(*tried))).alias("own"), *[_plain(df, c).alias(str(i)) for i, c in enumerate(names)])
    found = sampled.repartition(TRIED, "own").mapInArrow(_growing(order), "grown string, own int").collect()  # a row per column tried
    masks = {int(r["grown"]) for r in found}
    for mask in sorted((m for m in masks if m.bit_count() > 2), key=lambda m: (-m.bit_count(), m))[:3]:
        rows = coverage(df, [lattice.names_of(mask, names)]).collect()  # a row at most
        if not any(r["n_unique"] for r in rows):
            return mask
    return 0


def _plain(df: DataFrame, column: str) -> Column:
    """The column; -0.0 counts as 0.0, as in a GROUP BY."""
    value = F.col(f"`{column}`")
    return F.when(value == 0, F.lit(0).cast(df.schema[column].dataType)).otherwise(value) if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)) else value


def _once(codes: np.ndarray, size: int) -> int:
    """How many codes below ``size`` occur once."""
    if size <= 8 * len(codes):
        return int((np.bincount(codes, minlength=1) == 1).sum())
    codes = np.sort(codes)
    cut = np.concatenate([[True], codes[1:] != codes[:-1], [True]])
    return int((cut[1:] & cut[:-1]).sum())


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, columns) to (bucket, block): a compressed block of the columns for each bucket and many rows."""
    packed = pa.ipc.IpcWriteOptions(compression="zstd")

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        bucket = rows.column(0).to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows.drop_columns("bucket").take(order).combine_chunks()
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        out = []
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=packed) as stream:
                stream.write_table(rows.slice(start, end - start))
            out.append(sink.getvalue())
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([x.to_pybytes() for x in out], pa.binary())], names=["bucket", "block"])

    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size >= TASK_ROWS:
            yield blocks(held)
            held, size = [], 0
    if held:
        yield blocks(held)


def _counter(sets: Sequence[Sequence[int]]):
    """From the blocks of some buckets to (set_id, n_unique); sets are positions of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buckets.setdefault(bucket, []).append(block)
        while buckets:
            yield count([pa.ipc.open_stream(x).read_all() for x in buckets.popitem()[1]])

    def count(held: list[pa.Table]) -> pa.RecordBatch:
        codes, kinds, there = [], [], []
        for column in pa.concat_tables(held).combine_chunks().columns:
            coded = pa.concat_arrays(column.chunks).dictionary_encode()
            there.append(None if not coded.null_count else coded.is_valid().to_numpy(zero_copy_only=False))
            codes.append(coded.indices.fill_null(0).to_numpy().astype(np.int64))
            kinds.append(max(1, len(coded.dictionary)))
        found = []
        for columns in sets:
            code, size = codes[columns[0]], kinds[columns[0]]
            for i in columns[1:]:
                if size * kinds[i] >= 1 << 62:
                    known, code = np.unique(code, return_inverse=True)
                    size = len(known)
                code, size = code * kinds[i] + codes[i], size * kinds[i]
            full = [there[i] for i in columns if there[i] is not None]
            found.append(_once(code[np.logical_and.reduce(full)] if full else code, size))
        return pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int32()), pa.array(found, pa.int64())], names=["set_id", "n_unique"])

    return run


def _parts(masks: Sequence[int]) -> list[list[int]]:
    """Sets in a row that use few columns together."""
    out: list[list[int]] = []
    used = 0
    for m in masks:
        if not out or (used | m).bit_count() > COLUMNS:
            out.append([])
            used = 0
        out[-1].append(m)
        used |= m
    return out


def _by_keys(df: DataFrame, masks: Sequence[int], per_job: int) -> dict[int, int]:
    out = {}
    for part in lattice.chunks(masks, per_job):
        rows = coverage(df, [lattice.names_of(m, df.columns) for m in part]).collect()  # a row per set
        out |= {part[r["set_id"]]: r["n_unique"] for r in rows}
    return out


def unique_counts(df: DataFrame, masks: Sequence[int], kinds: Sequence[int], n_rows: int, per_job: int) -> dict[int, int]:
    """Unique rows of each set; sets of few combinations, and values of a pivot that fill a task, are counted by keys."""
    ship(df.sparkSession)
    few = [m for m in masks if math.prod(max(1, kinds[i]) for i in lattice.columns_of(m)) <= FEW]
    out = dict.fromkeys(masks, 0) | _by_keys(df, few, per_job)
    by_pivot: dict[int, list[int]] = {}
    for m in sorted(set(masks) - set(few), key=lattice.columns_of):
        by_pivot.setdefault(max(lattice.columns_of(m), key=lambda i: (kinds[i], -i)), []).append(m)
    most = max(TASK_ROWS, n_rows // 1000)  # so that at most a thousand values are hot
    for pivot, own in by_pivot.items():
        name = f"`{df.columns[pivot]}`"
        value = F.xxhash64(_plain(df, df.columns[pivot]))
        there = df.where(F.col(name).isNotNull())
        fine = F.pmod(value, F.lit(FINE))
        full = [r["b"] for r in there.groupBy(fine.alias("b")).count().where(F.col("count") > most).collect()]
        hot = [r["h"] for r in there.where(fine.isin(full)).groupBy(value.alias("h")).count().where(F.col("count") > most).collect()] if full else []
        for part in _parts(own):
            columns = sorted({i for m in part for i in lattice.columns_of(m)})
            sets = [[columns.index(i) for i in lattice.columns_of(m)] for m in part]
            n = max(1, -(-n_rows // TASK_ROWS))
            bucket = F.pmod(F.xxhash64(_plain(df, df.columns[pivot]), F.lit(1)), F.lit(n)).cast("int").alias("bucket")
            cold = (there.where(~value.isin(hot)) if hot else there).select(bucket, *[_plain(df, df.columns[i]).alias(str(i)) for i in columns])
            dealt = cold.mapInArrow(_dealt, "bucket int, block binary").repartition(n, "bucket")
            for r in dealt.mapInArrow(_counter(sets), "set_id int, n_unique long").groupBy("set_id").agg(F.sum("n_unique").alias("n")).collect():
                out[part[r["set_id"]]] += r["n"]
        if hot:
            for m, n in _by_keys(there.where(value.isin(hot)), own, COLUMNS).items():
                out[m] += n
    return out
