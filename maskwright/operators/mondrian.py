"""l-diverse partitions of rows (Mondrian), level by level.

Every round tries one cut of every open partition at once: along its widest
allowed dimension, at the weighted median of a number or into the children of a
taxonomy node.  A cut stands if all parts are l-diverse; else the dimension is
barred for that partition, which closes when none is left.  Rows carry their
partition, so a round is a few aggregates by partition, however many there are.
Partitions of at most ``LOCAL`` rows are cut to the end in one task each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.session import remove, scratch

LOCAL = 50_000


def frequencies(df: DataFrame, part: str, column: str) -> DataFrame:
    """(part, column, n): value counts of each partition."""
    return df.groupBy(part, column).agg(F.count("*").alias("n"))


def distinct_sensitive(df: DataFrame, part: str, sensitive: str) -> DataFrame:
    return df.groupBy(part).agg(F.count_distinct(sensitive).alias("n"))


def l_diversity(df: DataFrame, keys: Sequence[str], sensitive: str, l: int) -> DataFrame:  # noqa: E741
    """(keys, size, n_sensitive, most, diverse): at least l rows and l sensitive values, none in more than 1/l of the rows."""
    counts = df.groupBy(*keys, sensitive).agg(F.count("*").alias("_c"))
    stats = counts.groupBy(*keys).agg(F.sum("_c").alias("size"), F.count(sensitive).alias("n_sensitive"), F.max("_c").alias("most"))
    return stats.withColumn("diverse", (F.col("size") >= l) & (F.col("n_sensitive") >= l) & (F.col("most") <= F.col("size") / l))


def medians(df: DataFrame, part: str, value: str) -> DataFrame:
    """(part, split, next, low, high): the first value at which half of the partition (rounded down) is reached, and the value after it."""
    counts = df.groupBy(part, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(part).orderBy(value)
    every = Window.partitionBy(part)
    row = counts.withColumn("upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("_c").over(every)).withColumn("next", F.lead(value).over(order))
    reached = F.col("upto") >= F.floor(F.col("total") / 2)
    return row.groupBy(part).agg(F.min_by(value, F.when(reached, F.col(value))).alias("split"), F.min_by("next", F.when(reached, F.col(value))).alias("next"), F.min(value).alias("low"), F.max(value).alias("high"))


def widest(widths: Mapping[str, Column]) -> Column:
    """The name with the greatest width above NULL; the first of equals."""
    entries = F.array(*[F.when(w.isNotNull(), F.struct((-w).alias("w"), F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (n, w) in enumerate(widths.items())])
    return F.array_min(F.array_compact(entries))["n"]


def penalties(df: DataFrame, part: str, qi: Sequence[str], taxonomies: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(ncp, dp): normalised certainty penalty in per cent, and discernibility.

    A number's width is its range, a category's the leaves below the lowest node
    over all values of the partition (0 for a leaf; everything, for a value that
    the taxonomy lacks); both by that of the whole table.
    """
    taxonomies = taxonomies or {}
    numeric = [c for c in qi if c not in taxonomies]
    whole = df.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).cast("double").alias(c) for c in numeric]).first()
    for c, taxonomy in taxonomies.items():
        df = with_taxonomy(df, c, taxonomy)
    # what the least and the greatest path share, all paths of the partition share
    paths = [x for c in taxonomies for x in (F.min(F.struct(f"_path_{c}", f"_cover_{c}")).alias(f"l_{c}"), F.max(f"_path_{c}").alias(f"h_{c}"), F.bool_or(F.col(f"_path_{c}").isNull()).alias(f"n_{c}"))]
    each = df.groupBy(part).agg(F.count("*").alias("size"), *[(F.max(c) - F.min(c)).cast("double").alias(f"w_{c}") for c in numeric], *paths)
    width = F.lit(0.0)
    for c in taxonomies:
        same = F.zip_with(F.col(f"l_{c}._path_{c}"), F.col(f"h_{c}"), lambda a, b: a.eqNullSafe(b))
        parting = F.array_position(same, F.lit(False))
        depth = F.when(parting == 0, F.size(same)).otherwise(parting - 1).cast("int")
        cover = F.get(F.col(f"l_{c}._cover_{c}"), depth - 1)
        width = width + F.when(F.col(f"n_{c}"), 1.0).when(cover > 1, cover / F.get(F.col(f"l_{c}._cover_{c}"), F.lit(0))).otherwise(0.0)
    for c in numeric:
        if whole[c]:
            width = width + F.coalesce(F.col(f"w_{c}") / whole[c], F.lit(0.0))
    return each.agg((F.sum(F.col("size") * width) / (len(qi) * max(whole["n"], 1)) * 100).alias("ncp"), F.sum(F.col("size") * F.col("size")).alias("dp"))


def with_taxonomy(df: DataFrame, column: str, taxonomy: DataFrame) -> DataFrame:
    """Adds ``_path_c`` (nodes from the root to the value) and ``_cover_c`` (leaves below each) from (leaf, path)."""
    nodes = taxonomy.select("leaf", F.posexplode("path").alias("depth", "node"))
    cover = nodes.groupBy("node").agg(F.count_distinct("leaf").alias("leaves"))
    paths = nodes.join(cover, "node").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "leaves"))).alias("p"))
    paths = paths.select("leaf", F.transform("p", lambda x: x["node"]).alias(f"_path_{column}"), F.transform("p", lambda x: x["leaves"]).alias(f"_cover_{column}"))
    return df.join(paths, df[column] == paths["leaf"], "left").drop("leaf")


def mondrian(df: DataFrame, sensitive: str, l: int, qi: Sequence[str] | None = None, taxonomies: Mapping[str, DataFrame] | None = None, max_rounds: int = 200) -> DataFrame:  # noqa: E741
    """The rows with ``part_id`` and ``{c}_generalized`` for each quasi-identifier column.

    qi: all columns but the sensitive one, unless given; those with a taxonomy
    are categories, the others numbers.  Rows with a NULL among them, and
    everything if the table as a whole isn't l-diverse, form partition ``*``.
    """
    spark, taxonomies = df.sparkSession, dict(taxonomies or {})
    qi = list(qi or [c for c in df.columns if c != sensitive])
    own = list(df.columns)
    numbers = [c for c in qi if c not in taxonomies]
    rows = df
    for c, taxonomy in taxonomies.items():
        rows = with_taxonomy(rows, c, taxonomy).withColumn(f"_depth_{c}", F.lit(0))
    usable = F.lit(True)
    for c in qi:
        usable = usable & (F.col(f"_path_{c}").isNotNull() if c in taxonomies else F.col(c).isNotNull())
    everything = (1 << len(qi)) - 1
    rows = rows.withColumn("part_id", F.when(usable, "").otherwise("*")).withColumn("_open", usable).withColumn("_allowed", F.lit(everything))
    ranges = rows.where("_open").agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in numbers]).first() if numbers else {}
    base = scratch(spark, "mondrian")
    whole = l_diversity(rows.where("_open"), ["part_id"], sensitive, l).first()
    if whole is None or not whole["diverse"]:
        rows = rows.withColumn("_open", F.lit(False))
    out = None
    for number in range(max_rounds):  # only open partitions go on to the next round
        rows.write.parquet(f"{base}/{number}")
        rows = spark.read.schema(rows.schema).parquet(f"{base}/{number}")
        sizes = rows.where("_open").groupBy("part_id").agg(F.count("*").alias("_n"))
        large = sizes.where(F.col("_n") > LOCAL) if number < max_rounds - 1 else sizes.where("false")
        small = rows.where("_open").join(large, "part_id", "left_anti").select(*rows.columns)
        finish = _finisher(qi, list(taxonomies), dict(ranges.asDict()) if numbers else {}, sensitive, l, everything)
        done = rows.where("not _open").union(small.groupBy("part_id").applyInArrow(finish, rows.schema))
        out = done if out is None else out.union(done)
        if not large.limit(1).count():
            break
        rows = _round(rows.where("_open").join(large.select("part_id"), "part_id", "left_semi").select(*rows.columns), qi, taxonomies, ranges, sensitive, l, everything)
    out.write.parquet(f"{base}/out")  # the rounds' rows, put together once
    for round_ in range(number + 1):
        remove(spark, f"{base}/{round_}")
    out = spark.read.schema(out.schema).parquet(f"{base}/out")
    # a row per partition; Spark broadcasts them below its size limit, and splits a large partition's join
    ends = [x for i, c in enumerate(qi) if c not in taxonomies for x in (F.min(c).cast("string").alias(f"_low{i}"), F.max(c).cast("string").alias(f"_high{i}"))]
    bounds = out.groupBy("part_id").agg(F.count("*").alias("_n"), *ends).withColumnRenamed("part_id", "_part")
    out = out.join(bounds, out["part_id"] == bounds["_part"])
    values = []
    for i, c in enumerate(qi):
        if c in taxonomies:
            value = F.get(F.col(f"_path_{c}"), F.col(f"_depth_{c}"))
        else:
            value = F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise(F.concat_ws(",", f"_low{i}", f"_high{i}"))
        values.append(value.alias(f"{c}_generalized"))
    return out.select(*own, "part_id", *values)


def _finisher(qi: Sequence[str], categories: Sequence[str], ranges: Mapping[str, float], sensitive: str, l: int, everything: int):  # noqa: E741
    """Cuts one partition to the end, by the same rules as the rounds."""

    def finish(table: pa.Table) -> pa.Table:
        n = table.num_rows
        values = {c: table.column(c).to_numpy().astype(np.float64) for c in qi if c not in categories}
        paths = {c: table.column(f"_path_{c}").to_pylist() for c in categories}
        covers = {c: table.column(f"_cover_{c}").to_pylist() for c in categories}
        depths = {c: table.column(f"_depth_{c}").to_numpy().copy() for c in categories}
        kinds = {v: i for i, v in enumerate(dict.fromkeys(table.column(sensitive).to_pylist()))}
        marks = np.array([kinds[v] for v in table.column(sensitive).to_pylist()])
        null = kinds.get(None, -1)
        parts = [""] * n

        def diverse(rows: np.ndarray) -> bool:
            counts = np.bincount(marks[rows], minlength=len(kinds))
            distinct = (counts > 0).sum() - (null >= 0 and counts[null] > 0)
            return len(rows) >= l and distinct >= l and counts.max() <= len(rows) / l

        def sides_of(rows: np.ndarray, c: str) -> dict[str, np.ndarray]:
            if c in categories:
                d = int(depths[c][rows[0]]) + 1
                names = np.array([paths[c][r][d] if d < len(paths[c][r]) else None for r in rows], object)
                return {s: rows[names == s] for s in dict.fromkeys(names) if s is not None}
            v = values[c][rows]
            distinct, counts = np.unique(v, return_counts=True)
            at = int(np.argmax(np.cumsum(counts) >= len(rows) // 2))
            return {"0": rows[v <= distinct[at]], "1": rows[v > distinct[at]]} if at + 1 < len(distinct) else {}

        stack = [(np.arange(n), table.column("part_id")[0].as_py(), int(table.column("_allowed")[0].as_py()))]
        while stack:
            rows, part, allowed = stack.pop()
            closed = rows
            while allowed:
                widths = {}
                for i, c in enumerate(qi):
                    if allowed >> i & 1:
                        if c in categories:
                            cover = covers[c][rows[0]]
                            width = cover[int(depths[c][rows[0]])]
                            widths[i] = width / cover[0] if width > 1 else 0.0
                        else:
                            v = values[c][rows]
                            widths[i] = float(v.max() - v.min()) / ranges[c] if ranges[c] else 0.0
                best = max(widths, key=lambda i: (widths[i], -i))
                if widths[best] <= 0:
                    break
                sides = sides_of(rows, qi[best])
                if sides and all(map(diverse, sides.values())):
                    for name, own in sides.items():
                        if qi[best] in categories:
                            depths[qi[best]][own] += 1
                        stack.append((own, f"{part}/{name}", everything))
                    closed = rows[:0]
                    break
                allowed &= ~(1 << best)
            for r in closed:
                parts[r] = part
        table = table.set_column(table.column_names.index("part_id"), "part_id", pa.array(parts, pa.string()))
        for c in categories:
            table = table.set_column(table.column_names.index(f"_depth_{c}"), f"_depth_{c}", pa.array(depths[c], pa.int32()))
        return table.set_column(table.column_names.index("_open"), "_open", pa.array([False] * n))

    return finish


def _round(open_rows: DataFrame, qi: Sequence[str], taxonomies: Mapping[str, DataFrame], ranges, sensitive: str, l: int, everything: int) -> DataFrame:  # noqa: E741
    wide = {}
    aggs = []
    for i, c in enumerate(qi):
        if c in taxonomies:
            cover = F.get(F.col(f"_cover_{c}"), F.col(f"_depth_{c}"))
            aggs.append(F.max(F.when(cover > 1, cover / F.col(f"_cover_{c}")[0]).otherwise(0.0)).alias(f"w{i}"))
        else:
            spread = float(ranges[c] or 0.0)
            aggs.append(((F.max(c) - F.min(c)).cast("double") / F.lit(spread) if spread else F.max(F.lit(0.0))).alias(f"w{i}"))
        wide[c] = F.when((F.col("_allowed").bitwiseAND(1 << i) != 0) & (F.col(f"w{i}") > 0), F.col(f"w{i}"))
    chosen = open_rows.groupBy("part_id", "_allowed").agg(*aggs).select("part_id", widest(wide).alias("_dim"))
    tried = open_rows.join(chosen, "part_id")
    numbers = [c for c in qi if c not in taxonomies]
    value = F.lit(None).cast("double")
    for c in numbers:
        value = F.when(F.col("_dim") == c, F.col(c).cast("double")).otherwise(value)
    tried = tried.withColumn("_v", value)
    cuts = medians(tried.where("_v is not null"), "part_id", "_v").where("next is not null").select("part_id", "split")
    tried = tried.join(cuts, "part_id", "left")
    side = F.when(F.col("split").isNotNull(), F.when(F.col("_v") <= F.col("split"), "0").otherwise("1"))
    for c in taxonomies:
        side = F.when(F.col("_dim") == c, F.get(F.col(f"_path_{c}"), F.col(f"_depth_{c}") + 1)).otherwise(side)
    tried = tried.withColumn("_side", side)
    checked = l_diversity(tried.where("_side is not null"), ["part_id", "_side"], sensitive, l).groupBy("part_id").agg(F.bool_and("diverse").alias("_holds"), F.count("*").alias("_sides"))
    settled = tried.join(checked, "part_id", "left").withColumn("_holds", F.coalesce("_holds", F.lit(False)))
    is_category = F.col("_dim").isin(list(taxonomies)) if taxonomies else F.lit(False)
    bit = F.lit(0)
    for i, c in enumerate(qi):
        bit = F.when(F.col("_dim") == c, F.lit(1 << i)).otherwise(bit)
    left = F.col("_allowed").bitwiseAND(F.bitwise_not(bit))
    part = F.when(F.col("_holds"), F.concat(F.col("part_id"), F.lit("/"), F.col("_side"))).otherwise(F.col("part_id"))
    allowed = F.when(F.col("_holds"), F.lit(everything)).otherwise(left)
    still = F.when(F.col("_holds"), F.lit(True)).otherwise(F.col("_dim").isNotNull() & (left != 0))
    for c in taxonomies:
        settled = settled.withColumn(f"_depth_{c}", F.col(f"_depth_{c}") + F.when(F.col("_holds") & is_category & (F.col("_dim") == c), 1).otherwise(0))
    settled = settled.withColumns({"part_id": part, "_allowed": allowed, "_open": still})
    return settled.select(*open_rows.columns)
