"""The search for quasi-identifiers: column sets under which some row is unique."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.config import Settings
from maskwright.functions.scalars import combinations_count
from maskwright.operators import counting
from maskwright.operators.clusters import cluster_columns
from maskwright.operators.profile import profile
from maskwright.operators.uniqueness import coverage, qi_table
from maskwright.plans import lattice
from maskwright.session import remove, scratch, shuffles_removed


@dataclass
class SearchResult:
    names: list[str]
    n_rows: int
    found: dict[int, int] = field(default_factory=dict)  # mask: unique rows, by length and ids
    evaluated: int = 0
    levels: int = 0
    uncovered: list[str] = field(default_factory=list)
    #: Sets found at each level, for round statistics.
    per_level: list[int] = field(default_factory=list)

    @property
    def total(self) -> int:
        return combinations_count(len(self.names))

    @property
    def sets(self) -> list[tuple[str, ...]]:
        return [lattice.names_of(m, self.names) for m in self.masks]

    @property
    def masks(self) -> list[int]:
        return sorted(self.found, key=lambda m: (m.bit_count(), lattice.columns_of(m)))

    def table(self, spark) -> DataFrame:
        return qi_table(spark, [(lattice.names_of(m, self.names), self.found[m]) for m in self.masks], self.n_rows)


def _evaluate(df: DataFrame, names: Sequence[str], masks: Sequence[int], settings: Settings) -> dict[int, int]:
    """Unique rows of each set; sets go in jobs of ``sets_per_job``, since a job's rows are the table's times its sets."""
    out: dict[int, int] = {}
    for part in lattice.chunks(masks, settings.sets_per_job):
        rows = coverage(df, [lattice.names_of(m, names) for m in part]).collect()  # a row per set
        out |= {part[r["set_id"]]: r["n_unique"] for r in rows}
    return out


def _empty_sets(df: DataFrame, names: Sequence[str], n_rows: int, settings: Settings) -> tuple[list[int], int]:
    """Large column sets without a unique row, and how many were counted: without NULLs no set within them has one either.

    Tried are the whole table, and the columns with the fewest values, about as
    many as have no more combinations than there are rows.
    """
    if len(names) < 3 or not n_rows:
        return [], 0
    kinds = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(names)]).first()
    order = sorted(range(len(names)), key=lambda i: (kinds[i], i))
    product, fits = 1, 0
    for i in order:
        product *= max(1, kinds[i])
        fits += product <= n_rows
    tried = sorted({lattice.mask_of(order[:k]) for k in (len(names), fits - 1, fits, fits + 1) if 3 <= k <= len(names)})
    counts = _evaluate(df, names, tried, settings)
    return [m for m in tried if not counts.get(m, 0)], len(tried)


def _is_scan(df: DataFrame) -> bool:
    """Whether the table is columns of files and nothing more: those are read again as cheaply as a copy of them would be."""
    plan = df._jdf.queryExecution().optimizedPlan()
    lines = plan.toString().strip().split("\n")
    return plan.deterministic() and all(re.match(r"[\s:+-]*(Project|Relation)\b", line) for line in lines) and "Relation" in lines[-1]


def _has_nulls(df: DataFrame) -> bool:
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(f"`{c}`").isNull()
    return bool(df.where(any_null).limit(1).count())


def search(df: DataFrame, settings: Settings = Settings(), entropies: dict[str, float] | None = None) -> SearchResult:
    """Level by level over the lattice of column sets.

    ``exact``: every set with a unique row.  ``minimal``: those without one
    inside (without NULLs a superset always has a unique row, so it isn't
    counted; with NULLs that doesn't hold, and supersets are counted and
    reported only if no found set lies inside).  ``heuristic``: sets that pass
    the weight filter.  ``sampled``, ``drawn`` and ``clustered``: minimal within
    groups of columns (overlapping chunks and random samples, random samples
    alone, clusters).
    """
    names = list(df.columns)
    groups, uncovered = None, []
    if settings.strategy in ("sampled", "drawn", "clustered"):
        plan = _groups(df, settings)
        uncovered = lattice.uncovered(names, plan)
        groups = [lattice.mask_of(map(names.index, group)) for group in plan]
        settings = replace(settings, strategy="minimal")
    if (column := counting.slicing_column(df)) is None:
        return _search(df, settings, entropies, groups, uncovered)
    path = scratch(df.sparkSession, "joined")
    try:
        with shuffles_removed(df.sparkSession):
            return _search(counting.written(df, column, path), settings, entropies, groups, uncovered, by_pivot=True)
    finally:
        remove(df.sparkSession, path)


def _search(df: DataFrame, settings: Settings, entropies: dict[str, float] | None, groups: list[int] | None, uncovered: list[str], by_pivot: bool = False) -> SearchResult:
    names = list(df.columns)
    held = lambda m: groups is None or any(m & g == m for g in groups)  # noqa: E731  a set of several groups is counted once
    cached = not _is_scan(df)
    if cached:  # every level scans it
        df = df.cache()
    try:
        result = SearchResult(names, df.count(), uncovered=uncovered)
        enough = lambda n: n > 0 and (not settings.min_coverage_pct or 100.0 * n / result.n_rows > settings.min_coverage_pct)
        longest = min(settings.max_length or len(names), len(names))
        weights = None
        if settings.strategy == "heuristic":
            known = entropies or {r["colname"]: r["entropy"] for r in profile(df).collect()}
            weights = [known[n] for n in names]
        crm = lattice.mask_of(i for i, n in enumerate(names) if n in settings.crm_columns) if settings.crm_columns is not None else None
        prune = settings.strategy == "minimal" and not settings.min_coverage_pct and not _has_nulls(df)
        kinds = counting.kinds_of(df) if by_pivot else []
        if prune and by_pivot:
            grown = counting.grown_empty_set(df, kinds)
            empty, result.evaluated = [grown] if grown else [], 1
        else:
            empty, result.evaluated = _empty_sets(df, names, result.n_rows, settings) if prune else ([], 0)
        if lattice.mask_of(range(len(names))) in empty:
            return result
        open_sets: list[int] = list(lattice.sets_of(len(names), 1))
        for length in range(2, longest + 1):
            if prune:
                candidates = [m for m in lattice.next_level(open_sets, len(names)) if held(m)]
            else:
                candidates = [m for m in lattice.sets_of(len(names), length) if held(m)]
                if settings.strategy == "minimal":
                    candidates = [m for m in candidates if not lattice.is_covered(m, result.found)]
                elif settings.strategy == "heuristic":
                    candidates = [m for m in candidates if lattice.passes(m, result.masks, weights, crm, settings)]
            if not candidates:
                if prune or settings.stop_on_empty_level:
                    break
                continue
            counted = [m for m in candidates if not any(m & e == m for e in empty)]
            counts = counting.unique_counts(df, counted, kinds, result.n_rows, settings.sets_per_job) if by_pivot else _evaluate(df, names, counted, settings)
            hits = {m: counts[m] for m in counted if enough(counts.get(m, 0))}
            result.found |= hits
            result.evaluated += len(counted)
            result.levels += 1
            result.per_level.append(len(hits))
            open_sets = [m for m in candidates if m not in hits]
        return result
    finally:
        if cached:
            df.unpersist()


def _groups(df: DataFrame, settings: Settings) -> list[list[str]]:
    """Which columns an approximate search takes together; what no group holds together is missed."""
    names = list(df.columns)
    if settings.strategy == "sampled":
        return lattice.chunked_plan(names, settings.seed)
    if settings.strategy == "drawn":
        return lattice.sampling_plan(names, settings.seed)
    return lattice.clustered_plan(cluster_columns(profile(df), settings.seed))


def verify(df: DataFrame, compartments: Sequence[Sequence[str]], settings: Settings = Settings(), search_with: Callable[..., SearchResult] = search) -> dict[tuple[str, ...], list[tuple[str, ...]]]:
    """The quasi-identifiers left in each compartment; empty lists if the treatment held."""
    return {tuple(c): search_with(df.select(*[F.col(f"`{x}`") for x in c]), settings).sets if len(c) > 1 else [] for c in compartments}
