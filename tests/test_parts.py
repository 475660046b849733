from itertools import combinations

from hypothesis import given
from hypothesis import strategies as st
from maskwright.operators import analyze, clusters, compartments, mondrian, profile, score


@given(st.sets(st.frozensets(st.sampled_from("abcdef"), min_size=2, max_size=3), max_size=6))
def test_compartments_are_maximal_and_free_of_conflicts(found):
    columns = list("abcdef")
    graph = compartments.conflict_graph(found, columns)
    parts = compartments.compartments(columns, found)
    for p in parts:
        assert all(b not in graph[a] for a, b in combinations(p, 2))
        assert all(any(c in graph[a] for a in p) for c in columns if c not in p)
    assert {c for p in parts for c in p} == set(columns)
    assert len({tuple(p) for p in parts}) == len(parts)


def test_compartments_without_conflicts_and_isolated():
    assert compartments.compartments(["a", "b"], []) == [["a", "b"]]
    assert compartments.compartments(["a", "b"], [("a", "b")]) == [["a"], ["b"]]
    assert compartments.compartments(["a", "b", "c"], [("a", "b"), ("a", "c")], drop_isolated=True) == [["b", "c"]]
    assert compartments.enclosing_circle([(0, 0), (2, 0), (1, 0)]) == (1.0, 0.0, 1.0)


def test_union_fills_with_null(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    out = compartments.union(compartments.split(df, [["a"], ["b"]]))
    assert sorted((r["compartment_id"], r["a"], r["b"]) for r in out.collect()) == [(0, 1, None), (1, None, "x")]


def test_scores(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "s string, n int")
    rows = {r["colname"]: r["score"] for r in score.column_scores(df).collect()}
    import math

    assert math.isclose(rows["s"], 3 + math.tanh(1.0)) and rows["n"] == 4
    assert math.isclose(score.quality_score(df).first()["score"], (rows["s"] + 4) * 2)
    sweep = {r["n_columns"]: r["score"] for r in score.score_sweep(df, 1).collect()}
    assert math.isclose(sweep[1], rows["s"]) and math.isclose(sweep[2], (rows["s"] + 4) * 2)
    assert score.data_size(df).first()["bytes"] == 3 + 4
    pairs = spark.createDataFrame([(10, 5), (0, 3), (4, 5)], "o int, n int")
    assert math.isclose(score.falsification(pairs, [("o", "n")]).first()["penalty"], 0.5 - 0.25)
    assert math.isclose(score.falsification(pairs, [("o", "n")], absolute=True).first()["penalty"], 0.75)


def test_statistics(spark):
    qis = spark.createDataFrame([(["a", "b"], 2), (["a", "c", "d"], 3)], "columns array<string>, len int")
    assert [tuple(r) for r in analyze.popularity(qis).collect()] == [("a", 2), ("b", 1), ("c", 1), ("d", 1)]
    allowed = {r["colname"]: r["allowed"] for r in analyze.allowed_columns(qis, list("abcd")).collect()}
    assert allowed == {"b": ["b", "c", "d"], "c": ["b", "c"], "d": ["b", "d"]}
    assert analyze.popularity_ranks([("a", "b"), ("a", "c")], ["a", "b", "c", "d"]) == {"a": 0, "b": 1, "c": 2}
    df = spark.createDataFrame([(i, i % 2, i % 3, i % 5) for i in range(30)], "a int, b int, c int, d int")
    reports = analyze.analyze(qis, profile.profile(df))
    assert {r["len"]: r["n"] for r in reports["lengths"].collect()} == {2: 1, 3: 1}
    assert reports["lattice"].count() == 4 and reports["scatter"].count() == 4


def test_clusters(spark):
    df = spark.createDataFrame([(i, i, i % 2, i % 2) for i in range(20)], "a int, b int, c int, d int")
    found = clusters.kmeans_columns(profile.profile(df), 2)
    by = {r["colname"]: r["cluster"] for r in found.collect()}
    assert by["a"] == by["b"] != by["c"] == by["d"]
    assert clusters.first_of_clusters(found, 1).count() == 2


def test_l_diversity_and_medians(spark):
    df = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("p", 3, "x"), ("q", 1, "x"), ("q", 1, "x")], "part string, v int, s string")
    rows = {r["part"]: r for r in mondrian.l_diversity(df, ["part"], "s", 2).collect()}
    assert (rows["p"]["size"], rows["p"]["n_sensitive"], rows["p"]["most"], rows["p"]["diverse"]) == (3, 2, 2, False)
    assert rows["q"]["diverse"] is False
    cuts = {r["part"]: (r["split"], r["next"], r["low"], r["high"]) for r in mondrian.medians(df, "part", "v").collect()}
    assert cuts == {"p": (1, 2, 1, 3), "q": (1, None, 1, 1)}


def test_mondrian_is_diverse_and_keeps_rows(spark):
    rows = [(i, (i * 7) % 40, f"s{i % 4}") for i in range(40)] + [(None, 1, "s0")]
    df = spark.createDataFrame(rows, "a int, b int, s string")
    out = mondrian.mondrian(df, "s", 2)
    assert out.count() == 41 and out.where("part_id = '*'").count() == 1
    checked = mondrian.l_diversity(out.where("part_id <> '*'"), ["part_id"], "s", 2).collect()
    assert len(checked) > 4 and all(r["diverse"] for r in checked)


def test_mondrian_rounds_equal_local_cuts(spark, monkeypatch):
    taxonomy = spark.createDataFrame([(f"k{i}", ["*", f"g{i % 3}", f"k{i}"]) for i in range(6)], "leaf string, path array<string>")
    rows = [(i % 17, (i * 7) % 40 / 2, f"k{i % 6}", None if i % 9 == 8 else f"s{i % 4}", None if i % 2 else i) for i in range(120)]
    df = spark.createDataFrame(rows, "a int, b double, k string, s string, other int")
    outs = []
    for limit in (50_000, 30, 0):
        monkeypatch.setattr(mondrian, "LOCAL", limit)
        out = mondrian.mondrian(df, "s", 2, ["a", "b", "k"], {"k": taxonomy})
        outs.append(sorted(map(str, out.collect())))
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == 120


def test_mondrian_with_taxonomy(spark):
    leaves = {"cat": "pet", "dog": "pet", "cow": "farm", "pig": "farm"}
    taxonomy = spark.createDataFrame([(k, ["*", v, k]) for k, v in leaves.items()], "leaf string, path array<string>")
    df = spark.createDataFrame([(k, f"s{j}") for k in leaves for j in range(2)], "animal string, s string")
    out = mondrian.mondrian(df, "s", 2, taxonomies={"animal": taxonomy})
    assert {(r["animal"], r["animal_generalized"]) for r in out.collect()} == {(k, k) for k in leaves}
    coarse = mondrian.mondrian(spark.createDataFrame([("cat", "x"), ("dog", "y"), ("cow", "x"), ("pig", "y")], "animal string, s string"), "s", 2, taxonomies={"animal": taxonomy})
    assert {(r["animal"], r["animal_generalized"]) for r in coarse.collect()} == set(leaves.items())


def test_allowed_sets_and_penalties_over_taxonomies(spark):
    qis = spark.createDataFrame([(["a", "b"], 2), (["a", "c"], 2)], "columns array<string>, len int")
    stats = {r["colname"]: r for r in analyze.column_statistics(qis, list("abcd")).collect()}
    # allowed: a with d, b with c and d, c with b and d (one set with the one before)
    assert {c: (r["n_allowed"], r["allowed_sets"], r["mean_allowed_length"]) for c, r in stats.items()} == {"a": (2, 1, 2.0), "b": (3, 1, 3.0), "c": (3, 1, 3.0)}
    taxonomy = spark.createDataFrame([("x", ["*", "l", "x"]), ("y", ["*", "l", "y"]), ("z", ["*", "r", "z"]), ("w", ["*", "r", "w"])], "leaf string, path array<string>")
    rows = [(0, "x"), (0, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "z"), (3, "?")]
    ncp = mondrian.penalties(spark.createDataFrame(rows, "part int, kind string"), "part", ["kind"], {"kind": taxonomy}).first()
    assert abs(ncp["ncp"] - (2 * 0 + 2 * 0.5 + 2 * 1 + 1 * 1) / 7 * 100) < 1e-9 and ncp["dp"] == 13
