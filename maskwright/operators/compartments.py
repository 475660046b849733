"""Vertical partitions of a table in which no two columns conflict."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Graph = dict[str, set[str]]


def conflict_graph(found: Iterable[Sequence[str]], columns: Iterable[str] = ()) -> Graph:
    """Columns joined to those with which they occur in a quasi-identifier."""
    graph: Graph = {c: set() for c in columns}
    for qi in found:
        for c in qi:
            graph.setdefault(c, set())
        for a, b in combinations(qi, 2):
            graph[a].add(b)
            graph[b].add(a)
    return graph


def complement(graph: Graph) -> Graph:
    return {a: {b for b in graph if b != a and b not in near} for a, near in graph.items()}


def maximal_cliques(graph: Graph) -> list[list[str]]:
    """Bron-Kerbosch with pivots; columns keep the graph's order."""
    order = {c: i for i, c in enumerate(graph)}
    out: list[list[str]] = []
    stack = [(frozenset(), set(graph), set())]
    while stack:
        clique, open_, done = stack.pop()
        if not open_ and not done:
            if clique:
                out.append(sorted(clique, key=order.__getitem__))
            continue
        if not open_:
            continue
        pivot = max(sorted(open_ | done, key=order.__getitem__), key=lambda c: len(graph[c] & open_))
        for c in sorted(open_ - graph[pivot], key=order.__getitem__):
            stack.append((clique | {c}, open_ & graph[c], done & graph[c]))
            open_ = open_ - {c}
            done = done | {c}
    return sorted(out, key=lambda q: [order[c] for c in q])


def compartments(columns: Sequence[str], found: Iterable[Sequence[str]], drop_isolated: bool = False) -> list[list[str]]:
    """Maximal sets of columns without a conflict; all columns in one if there is none.

    A column in conflict with every other is a compartment of its own, unless
    ``drop_isolated``.
    """
    free = complement(conflict_graph(found, columns))
    cliques = maximal_cliques(free)
    return [q for q in cliques if len(q) > 1 or len(columns) == 1] if drop_isolated else cliques


def compartment_table(spark: SparkSession, parts: Sequence[Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(i, list(p)) for i, p in enumerate(parts)], "compartment_id int, columns array<string>")


def edges(spark: SparkSession, graph: Graph, loops: bool = False) -> DataFrame:
    """(src, dst), both ways; with ``loops`` every column with itself."""
    rows = [(a, b) for a, near in graph.items() for b in sorted(near)] + [(a, a) for a in graph if loops]
    return spark.createDataFrame(rows, "src string, dst string")


def split(df: DataFrame, parts: Sequence[Sequence[str]]) -> list[DataFrame]:
    return [df.select(*[F.col(f"`{c}`") for c in p]) for p in parts]


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all compartments with ``compartment_id``; columns that one lacks are NULL."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("compartment_id", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def enclosing_circle(points: Sequence[tuple[float, float]]) -> tuple[float, float, float]:
    """Centre and radius of the circle over the two points farthest apart (for drawing a clique)."""
    if len(points) < 2:
        return (*points[0], 0.0) if points else (0.0, 0.0, 0.0)
    (ax, ay), (bx, by) = max(combinations(points, 2), key=lambda p: (p[0][0] - p[1][0]) ** 2 + (p[0][1] - p[1][1]) ** 2)
    return (ax + bx) / 2, (ay + by) / 2, ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5 / 2
