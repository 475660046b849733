"""Exact removal of repeated byte strings across documents.

A byte goes if a string of ``LENGTH`` = 50 bytes that covers it also starts in
a document with a smaller id; strings are judged on the input and never cross
documents.  The suffixes that matter are thinned out before they are sorted:

1. Of every window of 50 bytes the anchor is kept: its 16-byte string with the
   least hash, leftmost if equal.  Equal windows have equal anchors at equal
   places, so two documents that share 50 bytes meet at an anchor.  A record is
   the anchor's hash, a hash of its context (the 84 bytes that windows around
   it can reach, and how many of them lie inside the document), and its place.
   Equal contexts within a slice of the input are settled there and then.
2. Records meet by anchor hash.  In a context that a smaller document has too,
   all of it goes.  Anchors with one document end here, almost all.  First
   holders of contexts of anchors with several contexts go on.
3. Their contexts are cut out of the texts and meet by anchor.  The suffixes
   that start with the anchor, and the reversed prefixes that end with it, are
   put in order by deep-shallow sorting; with the common prefixes of neighbours
   every window around the anchor gets a pair of numbers that equal windows
   share, and goes if the smallest document with that pair is smaller.
4. The runs of each document are merged and cut out of its whole text.

Steps 1 and 2 hold numbers only, packed per bucket; the buckets grow in number
with the bytes of the input, so one fits in a worker.  Anchors with more than
``CROWD`` contexts meet by the anchor with 17 more bytes on the left, and
again on the right (one of which equal windows share), instead of in one group.
What is left unbounded is the number of records of a single 16-byte string in
step 2 (28 bytes each) and of a single 33-byte string in step 3.

Defined cases: null text is empty; documents under 50 bytes lose nothing; a
null id is greater than every id; rows with one id are each judged on their own
text, and none loses bytes to another of the same id; extra columns are not
read.  Steps 2 and 3 compare contexts by 64-bit hashes within one anchor and by
their bytes, respectively.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import ensure_checkpoint_dir, slices, texts
from maskwright.llm.stringsort import deep_shallow_sort

LENGTH, ANCHOR = 50, 16
REACH = LENGTH - ANCHOR
HALF = REACH // 2
CROWD = 20_000
#: Bytes of text for each bucket, and of a slice handled at once (longer texts are handled in overlapping segments).
PER_BUCKET, SLICE = 12 << 20, 1 << 20
_NO_ID = np.iinfo(np.int64).max
_ODD = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` = 16 bytes from each position, by doubling."""
    level, size, power = data.astype(np.uint64) + np.uint64(1), 1, _ODD
    while size < ANCHOR:
        level = level[:-size] * np.uint64(power) + level[size:]
        power, size = power * power % 2**64, 2 * size
    return _mix(level)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes (a multiple of 8 wide)."""
    h = np.full(len(rows), 0x243F6A8885A308D3, np.uint64)
    for word in np.ascontiguousarray(rows).view(np.uint64).T:
        h = _mix((h ^ word) + np.uint64(_ODD))
    return h


class _Anchored:
    """Anchors of some documents: hash, document, position, context hash."""

    def __init__(self, documents: list[bytes]):
        gap = LENGTH + 8  # zeros between documents, so that contexts can be cut out anywhere
        lengths = np.array([len(d) for d in documents], np.int64)
        self.starts = gap + np.concatenate([[0], np.cumsum(lengths + gap)[:-1]]) if len(documents) else lengths
        data = np.frombuffer(bytes(gap) + b"".join([d + bytes(gap) for d in documents]), np.uint8)
        hashes = anchor_hashes(data)
        low = np.uint64((1 << 23) - 1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        size, wide = 1, REACH + 1
        while 2 * size <= wide:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < wide:
            least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
        edge = np.zeros(len(data) + 1, np.int8)
        long = lengths >= LENGTH
        edge[self.starts[long]] += 1
        edge[self.starts[long] + lengths[long] - LENGTH + 1] -= 1
        inside = np.cumsum(edge[: len(least)], dtype=np.int8) > 0
        at = (least[inside] & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]  # anchors move forward
        at = at[new]
        self.hash = hashes[at]
        self.document = np.searchsorted(self.starts, at, "right") - 1
        self.position = at - self.starts[self.document]
        left = np.minimum(self.position, REACH)
        right = np.minimum(lengths[self.document] - self.position - ANCHOR, REACH)
        self.context = np.empty(len(at), np.uint64)
        span = np.arange(-REACH, ANCHOR + REACH)
        for i in range(0, len(at), 1 << 15):
            part = slice(i, i + (1 << 15))
            rows = np.zeros((len(at[part]), 88), np.uint8)
            rows[:, :84] = data[at[part][:, None] + span]
            rows[:, 84], rows[:, 85] = left[part], right[part]
            # bytes of the gaps are zero already, for every context alike
            self.context[part] = _hash_rows(rows)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of integers, all first bytes first: equal ones then lie side by side for the shuffle's compression."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplaned(data: memoryview, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def _pack(a: np.ndarray, c: np.ndarray, ids: np.ndarray, variants: np.ndarray, positions: np.ndarray) -> bytes:
    """Records ordered by id; variants of one byte (none) or eight."""
    steps = np.diff(ids, prepend=ids[:1]) if len(ids) else ids
    return len(a).to_bytes(4, "little") + int(ids[0]).to_bytes(8, "little", signed=True) + variants.itemsize.to_bytes(1, "little") + b"".join([a.tobytes(), c.tobytes(), _planes(steps), _planes(variants), _planes(positions)])


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    view, n = memoryview(blob), int.from_bytes(blob[:4], "little")
    first, at, out = int.from_bytes(blob[4:12], "little", signed=True), 13, []
    for kind in (np.uint64, np.uint64):
        out.append(np.frombuffer(view[at : at + 8 * n], kind))
        at += 8 * n
    for kind in (np.int64, np.uint8 if blob[12] == 1 else np.int64, np.uint32):
        out.append(_unplaned(view[at:], n, kind))
        at += np.dtype(kind).itemsize * n
    out[2] = out[2].cumsum() + first
    return tuple(out)


_MARKS = "bucket int, blob binary, id long, variant long, position int, kind int"
_WHOLE, _OPEN, _CROWDED = 0, 1, 2


def _marks(bucket: list, blobs: list, ids: np.ndarray, variants: np.ndarray, positions: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
    """Rows that hold a blob, then rows that hold a mark."""
    n, m = len(blobs), len(ids)
    none = pa.nulls
    columns = [
        pa.concat_arrays([pa.array(bucket, pa.int32()), none(m, pa.int32())]) if m else pa.array(bucket, pa.int32()),
        pa.concat_arrays([pa.array(blobs, pa.binary()), none(m, pa.binary())]) if m else pa.array(blobs, pa.binary()),
        pa.concat_arrays([none(n, pa.int64()), pa.array(ids, pa.int64())]),
        pa.concat_arrays([none(n, pa.int64()), pa.array(variants.astype(np.int64))]),
        pa.concat_arrays([none(n, pa.int32()), pa.array(positions.astype(np.int32))]),
        pa.concat_arrays([none(n, pa.int32()), pa.array(kinds.astype(np.int32))]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "blob", "id", "variant", "position", "kind"])


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _segments(documents: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Documents in groups of at most about ``SLICE`` bytes; longer ones in segments that overlap, so that every window with its context lies in one."""
    overlap = LENGTH - 1 + 2 * REACH
    which, offsets, parts, size = [], [], [], 0
    for i, d in enumerate(documents):
        for offset in range(0, max(1, len(d) - overlap), SLICE):
            part = d[offset : offset + SLICE + overlap] if len(d) > SLICE + overlap else d
            if parts and size + len(part) > SLICE:
                yield which, offsets, parts
                which, offsets, parts, size = [], [], [], 0
            which.append(i)
            offsets.append(offset)
            parts.append(part)
            size += len(part)
            if len(d) <= SLICE + overlap:
                break
    if parts:
        yield which, offsets, parts


def _anchor_step(buckets: int):
    """Step 1: texts to records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            if len(batch) == 0:
                continue
            every_id, every_variant = _ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            if not every_variant.any():
                every_variant = every_variant.astype(np.uint8)
            documents = texts(batch.column(2))
            for which, offsets, parts in _segments(documents):
                found = _Anchored(parts)
                if not len(found.hash):
                    continue
                source = np.array(which)[found.document]
                ids, variants = every_id[source], every_variant[source]
                positions = found.position + np.array(offsets)[found.document]
                if len(offsets) == 1 and len(documents[which[0]]) > len(parts[0]):  # a segment: contexts at its ends are not the document's
                    whole, length = offsets[0], len(documents[which[0]])
                    good = ((positions - whole >= REACH) | (whole == 0)) & ((whole + len(parts[0]) - positions >= REACH + ANCHOR) | (whole + len(parts[0]) == length))
                    a, c, ids, variants, positions = (x[good] for x in (found.hash, found.context, ids, variants, positions))
                else:
                    a, c = found.hash, found.context
                order = np.lexsort((ids, c, a))
                a, c, ids, variants, positions = (x[order] for x in (a, c, ids, variants, positions))
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
                first = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
                known = ids > first  # a smaller document of this slice has the context
                done = ids[known], variants[known], positions[known]
                a, c, ids, variants, positions = (x[~known] for x in (a, c, ids, variants, positions))
                bucket = (a >> np.uint64(20)) % np.uint64(buckets)
                order = np.lexsort((ids, bucket))
                a, c, ids, variants, positions, bucket = (x[order] for x in (a, c, ids, variants, positions, bucket))
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(a) else np.zeros(1, np.int64)
                blobs = [_pack(a[i:j], c[i:j], ids[i:j], variants[i:j], positions[i:j].astype(np.uint32)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield _marks(bucket[cuts[:-1]].astype(np.int32).tolist() if len(a) else [], blobs, *done, np.full(len(done[0]), _WHOLE))

    return run


def _meet(blobs: list[bytes]) -> pa.RecordBatch:
    """Step 2, one bucket."""
    a, c, ids, variants, positions = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
    order = np.argsort(a, kind="stable")
    sorted_a = a[order]
    repeated = np.zeros(len(a), bool)
    repeated[1:] = sorted_a[1:] == sorted_a[:-1]
    repeated[:-1] |= repeated[1:]
    order = order[repeated]  # anchors that occur once are done
    order = order[np.lexsort((ids[order], c[order], a[order]))]
    a, c, ids, variants, positions = (x[order] for x in (a, c, ids, variants, positions))
    if not len(a):
        none = np.zeros(0, np.int64)
        return _marks([], [], none, none, none, none)
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_c = new_a.copy()
    new_c[1:] |= c[1:] != c[:-1]
    group = np.cumsum(new_a) - 1
    first = ids[np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
    contexts = np.bincount(group, new_c)
    starts = np.flatnonzero(new_a)
    several = np.minimum.reduceat(ids, starts) < np.maximum.reduceat(first, starts)  # first holders differ
    whole = ids > first
    going_on = ~whole & ((contexts > 1) & several)[group]
    kinds = np.where(whole, _WHOLE, np.where(contexts[group] > CROWD, _CROWDED, _OPEN))
    out = whole | going_on
    return _marks([], [], ids[out], variants[out], positions[out], kinds[out])


def _meet_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: rows sorted by bucket; marks pass through."""
    number, blobs = None, []
    for batch in batches:
        passed = batch.filter(batch.column(1).is_null())
        if len(passed):
            yield passed
        held = batch.filter(batch.column(1).is_valid())
        for bucket, blob in zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True):
            if bucket != number and blobs:
                yield _meet(blobs)
                blobs = []
            number = bucket
            blobs.append(blob)
    if blobs:
        yield _meet(blobs)


def _context_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: (id, variant, text, open, crowded) to contexts by anchor."""
    span = np.arange(-REACH, ANCHOR + REACH)
    for batch in slices(batches, "text", SLICE):
        if len(batch) == 0:
            continue
        out: list[tuple] = []
        ids, variants, open_, crowded = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for i, v, text, some, more in zip(ids, variants, texts(batch.column(2)), open_, crowded, strict=True):
            positions = np.array([*some, *more], np.int64)
            data = np.frombuffer(bytes(REACH) + text + bytes(REACH), np.uint8)
            contexts = data[positions[:, None] + span + REACH]
            left, right = np.minimum(positions, REACH), np.minimum(len(text) - positions - ANCHOR, REACH)
            rows = np.zeros((len(positions), 16), np.uint8)
            rows[:] = contexts[:, REACH : REACH + ANCHOR]
            keys = _hash_rows(rows).view(np.int64)
            n = len(some)
            if more:  # by 33 bytes, from the left and from the right
                sides = []
                for side, at in ((1, REACH - HALF), (2, REACH)):
                    wide = np.zeros((len(more), 40), np.uint8)
                    wide[:, : ANCHOR + HALF] = contexts[n:, at : at + ANCHOR + HALF]
                    wide[:, 39] = side
                    sides.append(_hash_rows(wide).view(np.int64))
                keys = np.concatenate([keys[:n], *sides])
                again = np.concatenate([np.arange(len(positions)), np.arange(n, len(positions))])
                positions, contexts, left, right = positions[again], contexts[again], left[again], right[again]
            out.append((np.full(len(keys), i if i is not None else _NO_ID), np.full(len(keys), v, np.int64), keys, positions, left * 64 + right, contexts))
        if not out:
            continue
        i, v, k, p, e, x = (np.concatenate(y) for y in zip(*out, strict=True))
        x = np.ascontiguousarray(x)
        held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(v), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), held], names=["key", "id", "variant", "position", "edges", "context"])


def covered_windows(contexts: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """[context, x]: whether the window that begins x bytes before the anchor also occurs around an equal anchor of a smaller document."""
    suffix_order, suffix_lcp = deep_shallow_sort(contexts[:, REACH:])
    prefix_order, prefix_lcp = deep_shallow_sort(np.ascontiguousarray(contexts[:, : REACH + ANCHOR][:, ::-1]))
    n = len(contexts)
    out = np.zeros((n, REACH + 1), bool)
    suffix, prefix = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(REACH + 1):
        fits = np.flatnonzero((left >= x) & (right >= REACH - x))
        suffix[suffix_order] = np.cumsum(suffix_lcp < LENGTH - x)
        prefix[prefix_order] = np.cumsum(prefix_lcp < ANCHOR + x)
        pairs = suffix[fits] * (n + 1) + prefix[fits]
        order = np.lexsort((ids[fits], pairs))
        pairs, own = pairs[order], ids[fits][order]
        new = np.ones(len(pairs), bool)
        new[1:] = pairs[1:] != pairs[:-1]
        if len(pairs):
            out[fits[order], x] = own > own[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _sort_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: contexts sorted by key to runs (id, variant, start, stop); keys are taken together up to a number of rows."""
    held: list[pa.RecordBatch] = []

    def settle(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        contexts = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(-1, 2 * REACH + ANCHOR)
        edges = table.column(4).to_numpy()
        ids, variants, positions = (table.column(i).to_numpy() for i in (1, 2, 3))
        covered = np.zeros((len(ids), REACH + 3), np.int8)
        covered[:, 1:-1] = covered_windows(contexts, edges // 64, edges % 64, ids)
        step = np.diff(covered, axis=1)
        row, begin = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)  # windows x = begin .. end - 1
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(variants[row]), pa.array((positions[row] - end + 1).astype(np.int32)), pa.array((positions[row] - begin + LENGTH).astype(np.int32))], names=["id", "variant", "start", "stop"])

    rows, last = 0, None
    for batch in batches:
        if len(batch) == 0:
            continue
        keys = batch.column(0).to_numpy()
        if rows and rows + len(batch) > 40_000:
            at = int(np.argmax(keys != last)) if (keys != last).any() else len(keys)  # rest of the last key
            if at < len(keys):
                if at:
                    held.append(batch.slice(0, at))
                yield settle(held)
                held, rows, batch = [], 0, batch.slice(at)
        held.append(batch)
        rows, last = rows + len(batch), keys[-1]
    if held:
        yield settle(held)


def _cut_step(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    """Step 4: (id, variant, text, runs) to what is left."""
    for batch in slices(batches, "text", SLICE):
        if len(batch) == 0:
            continue
        starts, stops = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        kept, removed, spans = [], [], []
        for text, begin, end in zip(texts(batch.column(2)), starts, stops, strict=True):
            gone = 0
            runs = []
            if begin:
                b, e = np.array(begin), np.array(end)
                b, e = np.maximum(b, 0), np.minimum(e, len(text))
                order = np.argsort(b, kind="stable")
                b, e = b[order], np.maximum.accumulate(e[order])
                new = np.ones(len(b), bool)
                new[1:] = b[1:] > e[:-1]
                first = np.flatnonzero(new)
                runs = list(zip(b[first].tolist(), e[np.append(first[1:] - 1, len(b) - 1)].tolist(), strict=True))
                gone = sum(y - x for x, y in runs)
            at, parts = 0, []
            for x, y in runs:
                parts.append(text[at:x])
                at = y
            parts.append(text[at:])
            kept.append(b"".join(parts))
            removed.append(gone)
            spans.append(len(runs))
        lengths = [len(k) + r for k, r in zip(kept, removed, strict=True)]
        columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        if with_bytes:
            columns.append(pa.array(kept, pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: unlike a checkpoint it is compressed; cuts the lineage all the same.

    The write's own shuffle files are of no use after it, and Spark is told to
    remove them then (they would lie there until the driver collects garbage).
    """
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document; ``kept`` are the remaining bytes (only ``with_bytes``)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    given = docs.select(F.coalesce(docs[id_column].cast("long"), F.lit(int(_NO_ID))).alias("id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    twice = given.groupBy("id").count().where("count > 1").limit(1).count()
    variant = F.xxhash64("text") if twice else F.lit(0).cast("long")
    given = given.select("id", variant.alias("variant"), "text")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * PER_BUCKET)))
    buckets = max(4 * partitions, -(-size // PER_BUCKET))
    records = given.mapInArrow(_anchor_step(buckets), _MARKS)
    # marks of step 1 are dealt out by id, blobs by bucket
    dealt = records.repartition(partitions, F.coalesce(F.col("bucket").cast("long"), F.col("id"))).sortWithinPartitions("bucket")
    marks = _written(dealt.mapInArrow(_meet_step, _MARKS).select("id", "variant", "position", "kind"))
    # the same rows on both sides of the plan below, so that the texts are shuffled once
    keys = ["id", "variant"] if twice else ["id"]
    own = given if twice else given.select("id", "text")
    position = F.col("position")
    going_on = marks.where(f"kind <> {_WHOLE}").groupBy(*keys).agg(F.collect_list(F.when(F.col("kind") == _OPEN, position)).alias("open"), F.collect_list(F.when(F.col("kind") == _CROWDED, position)).alias("crowded"))
    cut = own.join(going_on, keys)
    if twice:  # equal rows: once is enough
        cut = cut.dropDuplicates(keys)
    cut = cut.select("id", F.col("variant") if twice else F.lit(0).cast("long").alias("variant"), "text", "open", "crowded")
    contexts = cut.mapInArrow(_context_step, "key long, id long, variant long, position int, edges int, context binary")
    runs = contexts.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_sort_step, "id long, variant long, start int, stop int")
    whole = marks.where(f"kind = {_WHOLE}").select("id", "variant", (position - REACH).alias("start"), (position + ANCHOR + REACH).alias("stop"))
    every = whole.union(runs).groupBy(*keys).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    joined = own.join(every, keys, "left").select(F.when(F.col("id") != int(_NO_ID), F.col("id")).cast(kind).alias("doc_id"), F.lit(0).alias("variant"), "text", "starts", "stops")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return joined.mapInArrow(lambda batches: _cut_step(batches, with_bytes), schema)


REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS i, h FROM d WHERE length(h) >= 100),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM w),
f AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM k JOIN f USING (s) WHERE doc_id > first),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true)::INT AS new FROM r),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
p AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY ALL),
q AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE
    array_to_string(list_transform(range(1, len(a) + 2), lambda j: substr(h, 2 * (CASE WHEN j = 1 THEN 0 ELSE b[j - 1] END) + 1, 2 * (CASE WHEN j > len(a) THEN length(h) // 2 ELSE a[j] END - CASE WHEN j = 1 THEN 0 ELSE b[j - 1] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""
