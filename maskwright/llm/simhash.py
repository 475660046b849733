"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint is a row of bytes.  The index lists every distinct fingerprint
under choices of byte positions and the bytes there; within a list the shared
positional bytes of a pair are tallied, pairs below the least number of matches
go, and the rest are verified.

``near_duplicates`` takes the 64-bit SimHash of a text's shingles: eight bytes.
Two that differ in at most ``BITS`` = 4 bits agree in at least four positions,
the guaranteed minimum.  Each is listed under the 70 choices of four positions;
two that link meet in at least one list, and by chance two meet in a list once
in 2^32.  Differing bits are then counted: the links are exact.

``keep_first`` has to find texts whose sets of five-word shingles have a
similarity (shared of all) of ``SIMILARITY`` = 0.8.  Their 64-bit fingerprints
differ in about 10 bits, spread over all bytes, too few bits to tell 0.8 from
0.7.  So it takes the SimHash to ``WIDE`` = 64 bytes, 512 bits: the majority
over all distinct shingles, each hash drawn out to 512 bits.  Of a pair at 0.8
about 78 bits differ and 17 bytes agree.  Each fingerprint is listed under the
64 choices of two neighbouring positions (the last with the first); of pairs at
0.8 one in fifty meets in no list, at 0.85 one in four hundred.  The least
number of matches can't be guaranteed here: ``WIDE_MATCHES`` = 5 shared bytes,
which one in a thousand of the pairs at the bound of bits lacks.  Pairs with
them link if at most ``WIDE_BITS`` = 86 bits differ.

A list is searched from a queue, each fingerprint against those not yet reached,
so m linked ones cost few passes and give at most m - 1 edges (a spanning forest
of the links) instead of all pairs.  A link that a list leaves out joins two
fingerprints which that list has connected already, so components are exact.
Lists over ``LIMIT`` members aren't held: they come back as rows, and are
searched in tiles, each two blocks of the list.  Copies of a fingerprint never
enter the index twice.

Defined cases: null text counts as empty; texts without words have a fingerprint
of zeros and link like any others (in ``keep_first`` one of them stays); very
long texts are read whole, in pieces of bounded size; an empty table gives an
empty result; rows with one id are one document, so their texts link; rows with
a null id are documents of their own, and a group without any id has a null
component_id; extra columns aren't read, whatever their names.  ``keep_first``
decides by row: of each group the row with the smallest id stays (null ids
last, then by the text's hash), rows of one id with other texts stay if they
are alike to no other text, and rows of one id and one text count as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.scalars import unused
from maskwright.llm.common import ensure_checkpoint_dir, slices, texts
from maskwright.llm.graph import components

SHINGLE, SEED, BITS = 4, 42, 4
#: Byte positions that two linked fingerprints share at least.
MATCHES = 8 - BITS
CHOICES = list(combinations(range(8), MATCHES))
#: The wide fingerprint: words of a shingle, similarity looked for, bytes, bytes that links share, bits in which they may differ.
WORDS, SIMILARITY, WIDE, WIDE_MATCHES, WIDE_BITS = 5, 0.8, 64, 5, 86
#: Bytes, shared bytes, groups of ``sampled_fingerprint``.
SAMPLES, SHARED, GROUPS = 128, 97, 10
#: Members from which on a list is searched in tiles.
LIMIT = 20_000
#: Members up to which wide lists are compared all pairs at once, many lists together.
SMALL = 32
#: Linked fingerprints that a task joins up before it hands on what it knows.
HELD = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each run of words, repeats included; of the whole sequence, if it is shorter."""
    words = text.lower().split()  # bytes: A-Z, and white space 0x20 and 0x09-0x0D
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    parts = zip(*[words[i:] for i in range(shingle)], strict=False)
    return np.fromiter([digest(b, SEED) for b in map(b" ".join, parts)], np.uint64, len(words) - shingle + 1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _orders() -> np.ndarray:
    """An odd factor for each sampled byte: the order of the shingles by (hash * factor) mod 2^64."""
    return np.array([xxhash.xxh64_intdigest(bytes([i]), 1) | 1 for i in range(SAMPLES)], np.uint64)


_ORDERS = _orders()


def sampled_fingerprint(text: bytes, shingle: int = WORDS) -> np.ndarray:
    """``SAMPLES`` bytes; byte i is one of the hash of the shingle that is least in order i.  Not a SimHash; no stage uses it."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return np.zeros(SAMPLES, np.uint8)
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[at : at + (1 << 12), None] * _ORDERS).min(0), out=least)
    return (((least ^ (least >> np.uint64(32))) * _ODD) >> np.uint64(56)).astype(np.uint8)


_STEPS = np.array([(i + 1) * int(_ODD) & (1 << 64) - 1 for i in range(WIDE // 8)], np.uint64)


def _drawn_out(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` bytes for each hash: the generator SplitMix64 from it on."""
    x = hashes[:, None] + _STEPS
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.uint8)


def wide_fingerprint(text: bytes, shingle: int = WORDS) -> np.ndarray:
    """``WIDE`` bytes: a bit is 1 if it is set in over half of the distinct shingles' drawn-out hashes."""
    hashes = np.unique(shingle_hashes(text, shingle))
    counts = np.zeros(8 * WIDE, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        counts += np.unpackbits(_drawn_out(hashes[at : at + 255]), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the signed long of every whole text's fingerprint."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def wide_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = WORDS) -> DataFrame:
    """(doc_id, h, fp, bytes): ``h`` is a hash of the text, ``fp`` one of the bytes."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [wide_fingerprint(t, shingle).tobytes() for t in texts(batch.column(2))]
            fp = np.array([xxhash.xxh64_intdigest(x, SEED) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array(found, pa.binary())], names=["doc_id", "h", "fp", "bytes"])

    given = docs.select(docs[id_column].alias("doc_id"), _text_hash(docs[text_column]).alias("h"), docs[text_column].alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, h long, fp long, bytes binary")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(255)


def index(distinct: DataFrame) -> DataFrame:
    """(key, fp): the inverted index; a key is the choice of positions and the bytes there."""
    keys = []
    for number, choice in enumerate(CHOICES):
        key = F.lit(number).cast("long")
        for position in choice:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(position))
        keys.append(key)
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def wide_index(distinct: DataFrame) -> DataFrame:
    """(key, fp, bytes): the same by two neighbouring positions in a ring; a key is a hash, lists that share one are told by verification."""
    ring = F.concat("bytes", F.substring("bytes", 1, 1))
    keys = [F.xxhash64(F.lit(i), F.substring(ring, i + 1, 2)) for i in range(WIDE)]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp", "bytes")


# ---------------------------------------------------------------- lists


def _near_bits(pivot: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which of the rest share enough bytes with the pivot, and differ in few bits."""
    differ = rest ^ pivot
    near = np.flatnonzero((differ == 0).sum(1) >= MATCHES)
    return near[np.bitwise_count(differ[near]).sum(1) <= BITS]


def _near_wide(pivot: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The same for wide fingerprints."""
    differ = rest ^ pivot
    near = np.flatnonzero((differ == 0).sum(-1) >= WIDE_MATCHES)
    return near[np.bitwise_count(differ[near]).sum(-1, dtype=np.int64) <= WIDE_BITS]


def _near_pairs(found: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (rows a, rows b) within many short lists of wide fingerprints, each the rows from its start to its end."""
    sizes = ends - starts
    rows = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
    last = np.repeat(ends, sizes)
    for apart in range(1, int(sizes.max(initial=0))):
        rows, last = rows[rows + apart < last], last[rows + apart < last]
        near = _near_wide(found[rows], found[rows + apart])
        yield rows[near], rows[near] + apart


def _forest(names: np.ndarray, found: np.ndarray, near: Callable) -> Iterator[tuple[int, list[int]]]:
    """Stars (fingerprint, those it reaches first) of a spanning forest of the links among a list's members."""
    left = np.arange(len(names))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            pivot = queue.pop()
            hit = near(found[pivot], found[left])
            if len(hit):
                yield int(names[pivot]), names[left[hit]].tolist()
                queue.extend(left[hit])
                left = np.delete(left, hit)


class _Joined:
    """Sets of linked fingerprints, as one task knows them."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        at = parent.setdefault(x, x)
        while parent[at] != at:
            at = parent[at]
        while parent[x] != at:
            parent[x], x = at, parent[x]
        return at

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> pa.RecordBatch:
        """An edge from each fingerprint to the smallest of its set; forgets them."""
        edges = [(x, root) for x in self.parent if (root := self.root(x)) != x]
        self.parent = {}
        return _rows([], *(zip(*edges, strict=True) if edges else ([], [])))


def _rows(keys, a, b) -> pa.RecordBatch:
    """Edges (a, b), or members a of the lists that are too long to hold."""
    a = pa.array(a, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()) if len(keys) else pa.nulls(len(a), pa.int64()), a, pa.array(b, pa.int64()) if len(b) else pa.nulls(len(a), pa.int64())], names=["key", "a", "b"])


def _search(wide: bool, limit: int | None):
    """From rows (key, fp[, bytes]) sorted by key to edges, and to members of lists over the limit."""
    near = _near_wide if wide else _near_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, held, size = _Joined(), None, [], 0

        def settle() -> None:
            """The links of the list that is held; of an overlong one nothing is."""
            if sum(len(n) for n, _ in held) > 1:
                names, first = np.unique(np.concatenate([n for n, _ in held]), return_index=True)
                for pivot, hit in _forest(names, np.concatenate([f for _, f in held])[first], near):
                    for x in hit:
                        known.join(pivot, x)

        for batch in batches:
            if not len(batch):
                continue
            keys, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, WIDE) if wide else names.view(np.uint8).reshape(-1, 8)
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            lengths = np.diff(cuts)
            # lists of one member that neither begin nor end the batch have no pair
            some = np.flatnonzero((lengths > 1) | (np.arange(len(lengths)) == 0) | (np.arange(len(lengths)) == len(lengths) - 1))
            if wide:
                inner = some[(some > 0) & (some < len(lengths) - 1)]
                short = inner[lengths[inner] <= SMALL]
                for a, b in _near_pairs(found, cuts[short], cuts[short + 1]):
                    for x, y in zip(names[a].tolist(), names[b].tolist(), strict=True):
                        known.join(x, y)
                some = np.setdiff1d(some, short)
            for i in some.tolist():
                part = slice(int(cuts[i]), int(cuts[i + 1]))
                if keys[part.start] != key:
                    settle()
                    key, held, size = int(keys[part.start]), [], 0
                held.append((names[part], found[part]))
                size += part.stop - part.start
                if limit is not None and size > limit:
                    for n, _ in held:
                        yield _rows(np.full(len(n), key), n, [])
                    held = []
            if len(known.parent) > HELD:
                yield known.stars()
        settle()
        yield known.stars()

    return run


_FOUND = "key long, a long, b long"


def _searched(listed: DataFrame, wide: bool, limit: int | None) -> DataFrame:
    return listed.repartition("key").sortWithinPartitions("key").mapInArrow(_search(wide, limit), _FOUND)


def links(distinct: DataFrame, wide: bool = False, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are linked."""
    listed = wide_index(distinct) if wide else index(distinct)
    found = _searched(listed, wide, limit).checkpoint()
    edges, long = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("a").alias("fp"))
    if not long.limit(1).count():
        return edges
    sizes = long.groupBy("key").agg(F.ceil(F.count("*") / limit).alias("blocks"))
    block = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("blocks"))
    tiles = long.join(sizes, "key").withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    tiles = tiles.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp")
    if wide:
        tiles = tiles.join(distinct.select("fp", "bytes"), "fp").select("key", "fp", "bytes")
    return edges.union(_searched(tiles, wide, None).select("a", "b"))


# ---------------------------------------------------------------- groups


def _classes(distinct: DataFrame, edges: DataFrame, label: Column) -> DataFrame:
    """(own, first): of each distinct fingerprint, the least ``label`` that it reaches; labels are structs that end in fp."""
    labelled = distinct.select("fp", label.alias("node"))
    left, right = labelled.select(F.col("fp").alias("a"), F.col("node").alias("na")), labelled.select(F.col("fp").alias("b"), F.col("node").alias("nb"))
    # nodes carry what is asked for, so that no join by component is needed
    reached = components(edges.join(left, "a").join(right, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    reached = reached.select(F.col("node.fp").alias("at"), "component")
    return labelled.join(reached, F.col("fp") == F.col("at"), "left").select(F.col("fp").alias("own"), F.coalesce("component", "node").alias("first"))


def _same_id(marked: DataFrame) -> DataFrame:
    """(a, b): links between the fingerprints of rows that share an id."""
    again = marked.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a <> most").drop("most")
    return marked.join(again, "doc_id").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def _spread(distinct: DataFrame) -> DataFrame:
    """Dealt out anew: few rows become many times as many, which no task should do alone."""
    return distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    ensure_checkpoint_dir(docs.sparkSession)
    marked = fingerprints(docs, id_column, text_column, shingle).checkpoint()
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(_spread(distinct.select("fp"))).union(_same_id(marked))
    classes = _classes(distinct, edges, F.struct(F.col("least").isNull().alias("none"), "least", "fp"))
    named = marked.join(classes, F.col("fp") == F.col("own"))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.least").alias("component_id"))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns: one of each group of texts alike."""
    ensure_checkpoint_dir(docs.sparkSession)
    marked = wide_fingerprints(docs, id_column, text_column, shingle).checkpoint()
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    distinct = marked.groupBy("fp").agg(F.min(row).alias("row"), F.first("bytes").alias("bytes"))
    edges = links(_spread(distinct.select("fp", "bytes")), True)
    classes = _classes(distinct, edges, F.struct("row", "fp"))
    gone = marked.join(classes, F.col("fp") == F.col("own")).where(row != F.col("first.row"))
    own, text, twin = unused(docs, 3)
    gone = gone.select(F.col("doc_id").alias(own), F.col("h").alias(text)).distinct()
    rows = docs.withColumn(twin, _text_hash(docs[text_column]))
    rows = rows.join(gone, rows[id_column].eqNullSafe(gone[own]) & (rows[twin] == gone[text]), "left_anti")
    if marked.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates([id_column, twin])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
