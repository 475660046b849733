from maskwright.config import Settings
from maskwright.operators import treat
from maskwright.operators.search import search


def frame(spark, rows, schema="a string, b int"):
    return spark.createDataFrame(rows, schema)


def values(df, c):
    return sorted((r[c] for r in df.collect()), key=lambda x: (x is None, str(x)))


def test_remap_keeps_others_and_allows_null(spark):
    df = frame(spark, [("x", 1), ("y", 2), (None, 3)])
    out = treat.remap(df, "a", spark.createDataFrame([("x", None), ("q", "r")], "key string, new string"))
    assert {r["b"]: r["a"] for r in out.collect()} == {1: None, 2: "y", 3: None} and out.columns == ["a", "b"]


def test_suppression_is_column_wide_and_breaks_the_set(spark):
    rows = [("x", 1), ("x", 1), ("x", 2), ("y", 1), ("y", 1), ("z", 5), ("z", 5)]
    df = frame(spark, rows)
    out, n = treat.suppress(df, ["a", "b"], "a")
    assert n == 1 and values(out, "a") == ["y", "y", "z", "z", None, None, None]
    assert search(out).sets == []
    by_row, m = treat.suppress(df, ["a", "b"], "a", scope="row")
    assert m == 1 and values(by_row, "a").count(None) == 1


def test_suppression_shortcut_above_99_percent(spark):
    all_unique = frame(spark, [(f"v{i}", i) for i in range(10)])
    out, n = treat.suppress(all_unique, ["a", "b"], "a")
    assert n == 10 and values(out, "a") == [None] * 10
    out, n = treat.suppress(frame(spark, [(None, 1), (None, 2)]), ["a", "b"], "a")
    assert n == 0


def test_neighbours_at_ends_and_ties(spark):
    df = frame(spark, [("1", 0), ("3", 0), ("5", 0), ("x", 0), (None, 0), ("3", 1)])
    near = {r["value"]: (r["lower"], r["upper"]) for r in treat.neighbours(df, "a").collect()}
    assert near == {1.0: (1.0, 3.0), 3.0: (1.0, 5.0), 5.0: (3.0, 5.0)}
    assert {r["value"]: r["closest"] for r in treat.closest(treat.neighbours(df, "a")).collect()} == {1.0: 3.0, 3.0: 1.0, 5.0: 3.0}
    assert treat.neighbours(frame(spark, [("x", 1)]), "a").count() == 0


def test_generalization(spark):
    df = frame(spark, [("p", 10), ("p", 10), ("p", 20), ("q", 30), ("q", 30)])
    out, n = treat.generalize(df, ["a", "b"], "b")
    assert n == 1 and values(out, "b") == ["10", "10", "10-30", "30", "30"]
    text, _ = treat.generalize(frame(spark, [("p", 1), ("q", 1), ("q", 1)]), ["a", "b"], "a")
    assert values(text, "a") == ["q", "q", None]


def test_perturbation(spark):
    # within p: 10, 20, 31: 20 is nearer to 10; the ends have a neighbour on one side only
    df = frame(spark, [("p", 10), ("p", 10), ("p", 20), ("p", 31), ("p", 31), ("q", 7)])
    out, n = treat.perturb(df, ["a", "b"], "b")
    assert n == 2 and values(out, "b") == [10, 10, 10, 31, 31, None]
    tie = frame(spark, [("p", 10), ("p", 10), ("p", 20), ("p", 30), ("p", 30)])
    assert values(treat.perturb(tie, ["a", "b"], "b")[0], "b") == [10, 10, 10, 30, 30]


def test_choice(spark):
    assert treat.treatment_type(True, 49.9) == "perturbation" and treat.treatment_type(False, 49.9) == "suppression"
    assert treat.treatment_type(True, 50.0) == "compartmentation"
    assert treat.treatment_type(True, 1, Settings(treatment="generalization")) == "generalization"
    df = frame(spark, [("x", 1), ("x", 1), ("x", 2), ("y", 1), ("y", 1)])
    found = treat.choose(df, ["a", "b"], {"b": 0, "a": 1})
    assert (found.column, found.treatment, found.unique_rows, found.coverage_pct) == ("b", "perturbation", 1, 20.0)
    assert treat.choose(frame(spark, [("x", 1), ("x", 1)]), ["a", "b"], {}) is None
