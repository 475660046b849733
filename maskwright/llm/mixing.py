"""Mixing sources to target weights by dependent rounding, in DataFrame expressions only.

A source's rate is its target over its size: every document is taken
floor(rate) times, and once more with the fractional rest as its probability.
Pivotal rounding settles those rests: two open documents are paired, and words
move from one probability to the other, in a random direction whose odds keep
both expectations, until one of them is 0 or 1.  The words that the pair stands
for in expectation never change, so a source's taken words miss their aim by at most
half of the one document that is open at the end (which goes to the nearer
side).  Long documents settle first; what they take too much or too little is
spread over the probabilities of the next class of shorter ones, so that in the
end half of a short document is what remains.

The pairing is a reduction tree: blocks of about ``BLOCK`` documents of one
source fold to one open document each, those fold again in blocks, and so on,
down to one per source.  Sources of any size spread over as many tasks as they
have blocks.  All draws are hashes of ids, so reruns agree.

Defined cases: null text and text without words have size 0 and are taken
floor(rate) times (0 words); a null source is a source, ordered last; sources
without words have target 0; rows with the same id, or a null one, are documents
of their own, told apart by their texts (rows equal in both settle in one
block); very long texts are counted whole; an empty table gives an empty result;
extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.functions.scalars import unused
from maskwright.llm.common import ensure_checkpoint_dir

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 64
#: Sources up to which their table (a few numbers each) is broadcast; beyond, joins by source are shuffled.
BROADCAST = 10_000
#: Sizes in words that part documents into classes; a larger class settles first.
CLASSES = (1024, 128, 24)
_NEAR = 1e-9
_WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size, mark): words of each document, and a hash of its text that tells rows of one id apart."""
    return docs.select(docs[id_column].alias("doc_id"), docs[source_column].alias("source"), F.coalesce(F.regexp_count(docs[text_column], F.lit(_WORDS)), F.lit(0)).cast("long").alias("size"), _mark(docs[text_column]).alias("mark"))


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, n, source_size, target) with one row per source.

    Sharing by weight with a ceiling of ``most`` times the size, the excess
    shared again until nothing is above, settles where every target is the
    smaller of ceiling and level * weight; the level follows from running sums
    of the sources in the order of ceiling / weight.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    # windows over one row per source
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    row = by_source.withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights))).cast("int"))).withColumn("ceiling", F.col("source_size") * float(most))
    row = row.withColumn("ratio", F.col("ceiling") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = row.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    row = row.withColumn("settled", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return row.select("source", "n", "source_size", F.coalesce(F.least("ceiling", F.col("settled") * F.col("weight")), "ceiling").alias("target"))


def _uniform(*columns: Column) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * (2.0**-53)


def _entry(like: Column, p: Column) -> Column:
    return F.struct(*[like[c].alias(c) for c in ("h", "id", "mark", "size")], p.alias("p"))


def _pair(state: Column, x: Column, level: int) -> Column:
    """Pair the open document with the next: one of them is settled, the other stays open."""
    a = state["open"]
    ratio = x["size"] / a["size"]
    up = F.least(1.0 - a["p"], x["p"] * ratio)  # what can move to a
    down = F.least(a["p"], (1.0 - x["p"]) * ratio)  # what can move away from a
    drawn = F.struct(up.alias("up"), down.alias("down"), _uniform(a["h"], x["h"], F.lit(level)).alias("u"))
    moved = F.transform(F.array(drawn), lambda d: F.when(d["u"] * (d["up"] + d["down"]) < d["down"], d["up"]).otherwise(-d["down"]))

    def after(move: Column) -> Column:
        pa, px = a["p"] + move, x["p"] - move / ratio
        is_whole = (pa <= _NEAR) | (pa >= 1 - _NEAR)
        ea, ex = _entry(a, pa), _entry(x, px)
        return F.struct(F.when(is_whole, ex).otherwise(ea).alias("open"), F.concat(state["settled"], F.array(F.when(is_whole, ea).otherwise(ex))).alias("settled"))

    return F.transform(moved, after)[0]


def _fold(rows: DataFrame, level: int) -> DataFrame:
    """(source, block, folded: open document and settled ones) of each block."""
    entries = F.array_sort(F.collect_list(F.struct("h", "id", "mark", "size", "p")))
    grouped = rows.groupBy("source", "block").agg(entries.alias("all"))
    kind = rows.select(F.struct("h", "id", "mark", "size", "p").alias("e")).schema["e"].dataType.simpleString()
    start = F.struct(F.col("all")[0].alias("open"), F.array().cast(f"array<{kind}>").alias("settled"))
    folded = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), start, lambda s, x: _pair(s, x, level))
    return grouped.select("source", "block", folded.alias("f"))


def _settle(rows: DataFrame, largest: int) -> DataFrame:
    """(source, e: settled document) of every row of (source, h, id, mark, size, p, block): the reduction tree."""
    blocks, settled, level = max(1, math.ceil(largest / BLOCK)), None, 0
    while True:
        folded = _fold(rows, level).checkpoint()
        done = folded.select("source", F.explode("f.settled").alias("e"))
        settled = done if settled is None else settled.union(done)
        rows = folded.select("source", "f.open.*", F.floor(F.col("block") / BLOCK).alias("block"))
        if blocks == 1:
            return settled.union(folded.select("source", F.col("f.open").alias("e")))
        blocks, level = math.ceil(blocks / BLOCK), level + 1


def copies(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """(doc_id, mark, size, source, source_size, target, copies) of every row of ``sizes`` (without ``mark`` rows of one id and size settle in one block)."""
    ensure_checkpoint_dir(sizes.sparkSession)
    sizes = sizes if "mark" in sizes.columns else sizes.withColumn("mark", F.lit(0).cast("long"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = aims.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.col("whole"))
    few = aims.count() <= BROADCAST
    side = F.broadcast if few else lambda df: df
    rated = sizes.alias("s").join(side(known).alias("t"), F.expr("s.source <=> t.source")).select("doc_id", "mark", "s.source", "size", "n", "source_size", "target", "whole", "part")
    is_open = (F.col("size") > 0) & (F.col("part") > 0)
    in_class = F.lit(0)
    for i, least in enumerate(CLASSES, 1):
        in_class = F.when(F.col("size") < least, i).otherwise(in_class)
    opened = rated.where(is_open).withColumn("class", in_class)
    classes = opened.groupBy("source", "class").agg(F.sum("size").alias("class_size"), F.count("*").alias("n")).checkpoint()
    largest = {r["class"]: r["n"] for r in classes.groupBy("class").agg(F.max("n").alias("n")).collect()}
    every, owed = [], None
    for number in sorted(largest):
        rows = opened.where(F.col("class") == number).drop("n")
        here = side(classes.where(F.col("class") == number).drop("class")).alias("c")
        rows = rows.alias("r").join(here, F.expr("r.source <=> c.source")).select("doc_id", "mark", "r.source", "size", "part", "class_size", "c.n")
        if owed is None:
            rows = rows.withColumn("owed", F.lit(0.0))
        else:
            rows = rows.alias("r").join(side(owed).alias("o"), F.expr("r.source <=> o.source"), "left").select("doc_id", "mark", "r.source", "size", "part", "class_size", "n", F.coalesce("o.owed", F.lit(0.0)).alias("owed"))
        p = F.least(F.greatest(F.col("part") + F.col("owed") / F.col("class_size"), F.lit(0.0)), F.lit(1.0))
        block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "mark", F.lit(2)), F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)))
        h = F.xxhash64(F.col("doc_id").cast("string"), "mark", F.col("size"), F.lit(1))
        done = _settle(rows.select("source", h.alias("h"), F.col("doc_id").alias("id"), "mark", "size", p.alias("p"), block.alias("block")), largest[number])
        every.append(done)
        missed = done.alias("s").join(side(known).alias("t"), F.expr("s.source <=> t.source")).groupBy("s.source").agg(F.sum(F.col("e.size") * (F.col("part") - F.when(F.col("e.p") >= 0.5, 1).otherwise(0))).alias("owed"))
        owed = (missed if owed is None else missed.union(owed).groupBy("source").agg(F.sum("owed").alias("owed"))).checkpoint()
    flat = rated.where(~is_open).select("doc_id", "mark", "size", "source", "source_size", "target", F.col("whole").alias("copies"))
    for done in every:
        up = done.alias("s").join(side(known).alias("t"), F.expr("s.source <=> t.source")).select(F.col("e.id").alias("doc_id"), F.col("e.mark").alias("mark"), F.col("e.size").alias("size"), "s.source", "source_size", "target", (F.col("whole") + F.when(F.col("e.p") >= 0.5, 1).otherwise(0)).alias("copies"))
        flat = flat.union(up)
    return flat


def _mixed(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    ensure_checkpoint_dir(docs.sparkSession)
    sizes = sized(docs, id_column, text_column, source_column).checkpoint()  # the texts are read once
    return copies(sizes, targets(sizes).checkpoint())


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) of every document."""
    found = _mixed(docs, id_column, text_column, source_column)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """All columns of ``docs``, each row as often as the mix takes it (rows that share id, text and source: each as often as the most taken of them)."""
    own, mark, source, times = unused(docs, 4)
    taken = _mixed(docs, id_column, text_column, source_column).groupBy(F.col("doc_id").alias(own), F.col("mark").alias(mark), F.col("source").alias(source)).agg(F.max("copies").alias(times))
    joined = docs.join(taken, docs[id_column].eqNullSafe(taken[own]) & (_mark(docs[text_column]) == taken[mark]) & docs[source_column].eqNullSafe(taken[source]))
    every = F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))
    return joined.where(F.col(times) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], every.alias(own)).select(*[F.col(f"`{c}`") for c in docs.columns])
