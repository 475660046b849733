from collections import Counter
from itertools import combinations

from hypothesis import HealthCheck, given, settings as hypothesis_settings
from hypothesis import strategies as st
from maskwright.config import Settings
from maskwright.operators import uniqueness
from maskwright.operators.search import search, verify
from maskwright.plans import lattice


def brute(rows, names, longest=None):
    """Unique rows of every set, NULL rows left out."""
    out = {}
    for n in range(2, (longest or len(names)) + 1):
        for c in combinations(range(len(names)), n):
            counts = Counter(tuple(r[i] for i in c) for r in rows if all(r[i] is not None for i in c))
            out[tuple(names[i] for i in c)] = sum(v == 1 for v in counts.values())
    return out


cell = st.one_of(st.none(), st.integers(0, 2))


@hypothesis_settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, cell, cell, cell), min_size=1, max_size=12))
def test_exact_and_minimal_against_brute_force(spark, rows):
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    truth = {k: v for k, v in brute(rows, names).items() if v}
    exact = search(df, Settings(strategy="exact", stop_on_empty_level=False))
    assert dict(zip(exact.sets, [exact.found[m] for m in exact.masks], strict=True)) == truth
    minimal = search(df, Settings(stop_on_empty_level=False))
    assert set(minimal.sets) == {k for k in truth if not any(set(o) < set(k) for o in truth)}


def test_grouping_sets_tell_null_values_from_missing_columns(spark):
    rows = [(1, None, 1), (1, 2, 1), (2, 2, None), (1, 2, 3)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    sets = [["a", "b"], ["b", "c"], ["a", "c"]]
    truth = brute(rows, ["a", "b", "c"], 2)
    gid = {("a", "b"): 1, ("b", "c"): 4, ("a", "c"): 2}
    found = {r["gid"]: r["n_unique"] for r in uniqueness.coverage_by_grouping_sets(df, sets).collect()}
    hashed = {r["set_id"]: r["n_unique"] for r in uniqueness.coverage(df, sets).collect()}
    for i, s in enumerate(sets):
        assert found[gid[tuple(s)]] == truth[tuple(s)] == hashed[i]


def test_lattice_helpers():
    assert lattice.next_level([0b11, 0b101, 0b110], 3) == [0b111]
    assert lattice.next_level([0b11, 0b101], 3) == []
    assert lattice.is_covered(0b111, [0b101]) and not lattice.is_covered(0b011, [0b101])
    assert lattice.weight(0b11, [1.2, 2.1]) == 4 and lattice.mean_weight(0b11, [1.2, 2.1]) == 2 and lattice.mean_weight(0, []) == 0
    s = Settings()
    assert lattice.passes(0b11, [], [5.0, 4.5], None, s)
    assert not lattice.passes(0b11, [0b1], [5.0, 4.5], None, s)
    assert not lattice.passes(0b11, [], [5.0, 4.5], 0b100, s)
    assert not lattice.passes(0b11, [], [3.0, 2.9], None, s)  # weight 6
    assert not lattice.passes(0b11111, [], [5.5] * 5, None, s) and lattice.passes(0b1111, [], [5.5] * 4, None, s)
    names = [f"c{i}" for i in range(40)]
    assert lattice.uncovered(names, lattice.chunked_plan(names)) == []
    assert lattice.sampling_plan(names) == lattice.sampling_plan(names)
    assert lattice.clustered_plan([["a", "b"], ["c"]], 1) == [["a", "b", "c"], ["c", "a"]]
    assert lattice.chunk_size(3, 8) == 1 and lattice.chunk_size(100, 8) == 13


def test_heuristic_and_threshold(spark):
    df = spark.createDataFrame([(i % 3, i % 5, i) for i in range(15)], "a int, b int, c int")
    found = search(df, Settings(strategy="heuristic", min_weight=0, min_mean_weight=0, long_mean_weight=0))
    assert ("a", "b") in found.sets and ("a", "b", "c") not in found.sets
    assert search(df, Settings(strategy="heuristic", crm_columns=("zzz",))).sets == []
    assert search(df, Settings(strategy="exact", min_coverage_pct=100.0)).sets == []


def test_sampled_and_clustered(spark):
    df = spark.createDataFrame([(i % 3, i % 5, i % 2, i % 7) for i in range(30)], "a int, b int, c int, d int")
    assert set(search(df, Settings(strategy="sampled")).sets) == set(search(df, Settings()).sets)
    truth = {frozenset(s) for s in search(df, Settings(strategy="exact", stop_on_empty_level=False)).sets}
    assert {frozenset(s) for s in search(df, Settings(strategy="clustered")).sets} <= truth


def test_verify(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1)], "a int, b int, c int")
    assert verify(df, [["a", "c"], ["b", "c"], ["a"]]) == {("a", "c"): [], ("b", "c"): [], ("a",): []}
    assert verify(df, [["a", "b"]]) == {("a", "b"): [("a", "b")]}


def test_lineitem_queries_find_all_lengths(spark, tmp_path):
    """Four columns hold all 16 patterns of bits: only all four tell a row; any other column tells it in each pair."""
    from maskwright.queries import LINEITEM, QUERIES

    rows = [tuple(int(x) for x in f"{i:04b}") + (i,) * 6 for i in range(16)]
    spark.createDataFrame(rows, ", ".join(f"{c} int" for c in LINEITEM)).write.parquet(f"{tmp_path}/lineitem.parquet")
    truth = {k: v for k, v in brute(rows, LINEITEM).items() if v}
    truth = {k: v for k, v in truth.items() if not any(set(o) < set(k) for o in truth)}
    assert {len(k) for k in truth} == {2, 4}
    assert {tuple(r["columns"]): r["unique_rows"] for r in QUERIES["qi_minimal_lineitem"](spark, str(tmp_path)).collect()} == truth
    counts = Counter(c for k in truth for c in k)
    assert {r["colname"]: (r["occurrence"], r["mean_length"]) for r in QUERIES["qi_column_statistics"](spark, str(tmp_path)).collect() if r["occurrence"]} == {c: (n, sum(len(k) for k in truth if c in k) / n) for c, n in counts.items()}
    assert {r["colname"]: r["4_ucc_found"] for r in QUERIES["qi_found_by_length"](spark, str(tmp_path)).collect() if r["4_ucc_found"]} == dict.fromkeys(LINEITEM[:4], 1)


@hypothesis_settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(0, n) for n in (1, 1, 2, 4, 9)]), min_size=1, max_size=25))
def test_sets_within_empty_ones_are_not_counted(spark, rows):
    names = ["a", "b", "c", "d", "e"]
    truth = {k: v for k, v in brute(rows, names).items() if v}
    found = search(spark.createDataFrame(rows, "a int, b int, c int, d int, e int"), Settings())
    assert dict(zip(found.sets, [found.found[m] for m in found.masks], strict=True)) == {k: v for k, v in truth.items() if not any(set(o) < set(k) for o in truth)}


def test_a_table_without_unique_rows_ends_at_once(spark):
    df = spark.createDataFrame([tuple([i % 3] * 15) for i in range(30)], ", ".join(f"c{i} int" for i in range(15)))
    found = search(df, Settings())
    assert found.sets == [] and found.evaluated < 6


def test_groups_of_columns(spark, monkeypatch):
    rows = [tuple((i * k) % m for k, m in ((1, 3), (3, 5), (7, 4), (5, 7), (1, 2))) for i in range(16)]
    names, groups = list("abcde"), [["a", "b", "c"], ["b", "c", "d"]]
    truth = {k: v for k, v in brute(rows, names).items() if v and any(set(k) <= set(g) for g in groups)}
    minimal = {k: v for k, v in truth.items() if not any(set(o) < set(k) for o in truth)}
    monkeypatch.setattr(lattice, "chunked_plan", lambda names, seed: groups)
    monkeypatch.setattr(lattice, "sampling_plan", lambda names, seed: groups)
    for strategy in ("sampled", "drawn"):
        found = search(spark.createDataFrame(rows, "a int, b int, c int, d int, e int"), Settings(strategy=strategy))
        assert dict(zip(found.sets, [found.found[m] for m in found.masks], strict=True)) == minimal and found.uncovered == ["e"]
