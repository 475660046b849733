"""Column sets as bitmasks: candidates, weights, pruning.  Plain Python over at most some hundred columns."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

from maskwright.config import Settings


def mask_of(columns: Iterable[int]) -> int:
    out = 0
    for c in columns:
        out |= 1 << c
    return out


def columns_of(mask: int) -> tuple[int, ...]:
    return tuple(i for i in range(mask.bit_length()) if mask >> i & 1)


def names_of(mask: int, names: Sequence[str]) -> tuple[str, ...]:
    """Dictionary decode of a set's ids."""
    return tuple(names[i] for i in columns_of(mask))


def weight(mask: int, entropies: Sequence[float]) -> int:
    """Sum of entropies, rounded up."""
    return math.ceil(sum(entropies[i] for i in columns_of(mask)))


def mean_weight(mask: int, entropies: Sequence[float]) -> int:
    """Mean of entropies, rounded up; 0 for the empty set."""
    own = columns_of(mask)
    return math.ceil(sum(entropies[i] for i in own) / len(own)) if own else 0


def is_covered(mask: int, known: Iterable[int]) -> bool:
    """Whether a known set lies within this one."""
    return any(k & mask == k for k in known)


def sets_of(n: int, length: int) -> Iterator[int]:
    return (mask_of(c) for c in combinations(range(n), length))


def next_level(open_sets: Sequence[int], n: int) -> list[int]:
    """Sets one column larger, all of whose subsets are open: candidates for minimal quasi-identifiers."""
    known, out = set(open_sets), set()
    for mask in open_sets:
        for c in range(mask.bit_length(), n):
            wider = mask | 1 << c
            if all(wider & ~(1 << i) in known for i in columns_of(wider)):
                out.add(wider)
    return sorted(out, key=columns_of)


def passes(mask: int, known: Sequence[int], entropies: Sequence[float], crm: int | None, settings: Settings) -> bool:
    """The heuristic filter: no known set inside, a personal column if asked for, and weights that make unique rows likely."""
    mean, length = mean_weight(mask, entropies), mask.bit_count()
    return not (
        is_covered(mask, known)
        or (crm is not None and not mask & crm)
        or weight(mask, entropies) < settings.min_weight
        or mean < settings.min_mean_weight
        or (mean < settings.long_mean_weight and length > settings.long_length)
    )


def saved_pct(evaluated: int, total: int) -> float:
    """Share of the lattice that wasn't evaluated; the share that was is rounded up to hundredths of a per cent."""
    return 100.0 - math.ceil(evaluated / total * 10_000) / 100 if total else 0.0


def chunks(items: Sequence, n: int) -> list[Sequence]:
    return [items[i : i + n] for i in range(0, len(items), n)]


def chunk_size(n: int, cores: int) -> int:
    """Items for a worker at a time."""
    return 1 if n < cores else min(-(-n // cores), 10_000)


# ---------------------------------------------------------------- approximate searches: which columns go together


def sample_columns(names: Sequence[str], size: int, seed: int = 42) -> list[str]:
    """Columns drawn with replacement."""
    return random.Random(seed).choices(list(names), k=size) if names else []


def sampling_plan(names: Sequence[str], seed: int = 42, size: int = 10) -> list[list[str]]:
    """About 1.5 draws for each column, in samples of ``size`` (half of the columns, if fewer)."""
    n = len(names)
    size = size if n > size else max(1, n // 2)
    return [sorted(set(sample_columns(names, size, seed + i)), key=list(names).index) for i in range(math.ceil(n / size * 1.5))] if n else []


def chunked_plan(names: Sequence[str], seed: int = 42, size: int = 20, overhead: float = 0.33, exact_below: int = 15) -> list[list[str]]:
    """Chunks of neighbours that overlap by a third, and half as many random samples as columns; all columns at once if they are few."""
    n = len(names)
    if n < exact_below:
        return [list(names)] if n else []
    step = max(1, round(size * (1 - overhead)))
    plan = [list(names[i : i + size]) for i in range(0, max(1, n - size + step), step)]
    return plan + [sorted(set(sample_columns(names, size, seed + i)), key=list(names).index) for i in range(math.ceil(n / 2))]


def clustered_plan(clusters: Sequence[Sequence[str]], items: int = 2) -> list[list[str]]:
    """For each cluster, its columns with the first ``items`` of every other one that has so many."""
    return [[*own, *other_clusters(clusters, items, i)] for i, own in enumerate(clusters)]


def other_clusters(clusters: Sequence[Sequence[str]], items: int, without: int) -> list[str]:
    return [c for i, cluster in enumerate(clusters) if i != without and len(cluster) >= items for c in cluster[:items]]


def each_cluster(clusters: Sequence[Sequence[str]], items: int) -> list[str]:
    """The first ``items`` columns of each cluster."""
    return [c for cluster in clusters for c in cluster[:items]]


def uncovered(names: Sequence[str], plan: Iterable[Sequence[str]]) -> list[str]:
    """Columns that no sample holds."""
    seen = {c for s in plan for c in s}
    return [c for c in names if c not in seen]

