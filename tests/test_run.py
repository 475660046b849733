import importlib

import pytest
from maskwright.__main__ import main
from maskwright.config import Settings
from maskwright.operators.search import search
from maskwright.operators.uniqueness import unique_rows
from maskwright.plans.pipeline import AnonymizationPipeline
from maskwright.sources import sinks, tables
from maskwright.streaming import jobs


def people(spark, n=60):
    rows = [(i, f"n{i % 4}", i % 3, f"c{i % 5}", None) for i in range(n)] + [(n, "rare", 1, "c1", None)]
    return spark.createDataFrame(rows, "id int, name string, size int, city string, empty string")


def test_pipeline(spark):
    outcome = AnonymizationPipeline(spark, Settings()).run(people(spark), score=True, size=True, evaluate=True)
    assert outcome.dropped == ["id"] and "empty" not in outcome.table.columns
    assert outcome.search.found and outcome.metrics["score"] > 0 and outcome.metrics["bytes"] > 0
    assert set(outcome.left) == {tuple(c) for c in outcome.compartments}


@pytest.mark.parametrize("treatment", ["suppression", "generalization", "perturbation", "compartmentation"])
def test_forced_treatments(spark, treatment):
    outcome = AnonymizationPipeline(spark, Settings(treatment=treatment)).run(people(spark))
    assert all(c.treatment == treatment for c in outcome.choices)
    if treatment == "compartmentation":
        assert all(not search(t).sets for t in outcome.tables() if len(t.columns) > 1)
    if treatment == "suppression":
        assert all(unique_rows(outcome.table, c.columns).count() == 0 for c in outcome.choices)


def test_too_few_columns(spark):
    outcome = AnonymizationPipeline(spark).run(spark.createDataFrame([(1,), (1,)], "a int"))
    assert outcome.search is None and outcome.compartments == [["a"]]


def test_saved_search(spark, tmp_path):
    df = people(spark).drop("id", "empty")
    first = AnonymizationPipeline(spark, Settings(), str(tmp_path)).find(df, {})
    again = AnonymizationPipeline(spark, Settings(), str(tmp_path)).find(df, {})
    assert again.found == first.found and again.evaluated == 0
    assert tables.saved_search(spark, str(tmp_path), tables.fingerprint(df, df.count(), Settings(max_length=2))) is None


def test_sources_and_sinks(spark, tmp_path):
    df = people(spark).drop("empty")
    path = sinks.write_csv(df, f"{tmp_path}/t.csv.gz")
    back = tables.read_csv(spark, path)
    assert back.columns == df.columns and back.count() == 61 and dict(back.dtypes)["size"] == "int"
    assert tables.read_csv(spark, path, max_rows=5).count() == 5 and tables.read_schema(spark, path) == df.columns
    assert tables.read_text_csv(spark, path, ["size"]).dtypes == [("size", "string")]
    parts = [["id", "name"], ["size"]]
    sinks.write_compartments(df, parts, f"{tmp_path}/parts")
    assert [t.columns for t in tables.read_compartments(spark, f"{tmp_path}/parts", 2)] == parts
    for _ in range(2):
        sinks.append_metrics(spark, f"{tmp_path}/m", "r", {"score": 1.0}, 3, None)
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2
    sinks.store_compartments(df, parts, "stored")
    assert spark.table("stored_0").columns == ["id", "name"]
    for name in ("stored_0", "stored_1"):
        spark.sql(f"DROP TABLE {name}")
    (tmp_path / "c.json").write_text('{"user":\n "u"}')
    assert tables.read_config(spark, str(tmp_path / "c.json")) == {"user": "u"}
    assert tables.missing_columns(["id", "x"], df.columns) == ["x"]


def test_jobs(spark, tmp_path):
    store = jobs.JobStore(spark, f"{tmp_path}/jobs")
    assert store.all().count() == 0
    big = store.submit(["name", "size", "city"], 1, "big", ["name", "size", "city"])
    small = store.submit(["name", "size"], 1, "small", ["name", "size", "city"])
    with pytest.raises(jobs.BadRequest):
        store.submit(["nope"], 1, "t", ["name"])
    with pytest.raises(jobs.BadRequest):
        store.submit(None, 1, "t", ["name"])
    with pytest.raises(jobs.UnknownJob):
        store.get("none")
    assert jobs.next_job(store.all()).first()["job_id"] == small["job_id"]
    assert store.update(big["job_id"], ["name", "city"])["columns"] == ["name", "city"]
    done, stored = [], {}

    def handle(job):
        outcome = jobs.run_job(spark, job, lambda: people(spark), store=lambda df, parts, name: stored.update({name: parts}))
        done.append((job["table_name"], outcome.compartments))

    jobs.work(store, handle, f"{tmp_path}/state").awaitTermination()
    assert {n for n, _ in done} == {"big", "small"} and set(stored) == {"big", "small"}
    assert [r["status"] for r in store.all().collect()] == ["failed"]
    with pytest.raises(jobs.UnknownJob):
        store.delete(big["job_id"])


def test_command_line(spark, tmp_path):
    people(spark).write.parquet(f"{tmp_path}/t.parquet")
    metrics = main([f"{tmp_path}/t.parquet", "-o", f"{tmp_path}/out", "--analyze", "yes", "--score", "yes", "--size", "yes"])
    assert metrics["quasi_identifiers"] > 0 and spark.read.parquet(f"{tmp_path}/out/metrics").count() == len(metrics)


def test_entry_and_registered_queries(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_jdbc_sink(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(1, "it's"), (2, None)], "n int, s string")
    for _ in range(2):  # replaced, not appended to
        sinks.write_jdbc(df, url, "stored", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, width=None)
    back = spark.read.jdbc(url, "stored", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    assert sorted((r[0], r[1]) for r in back.collect()) == [("1", "it's"), ("2", None)]


def test_all_columns_are_taken_unless_told_otherwise(spark):
    df = spark.createDataFrame([tuple([i % 2] * 15) for i in range(8)], ", ".join(f"c{i} int" for i in range(15)))
    outcome = AnonymizationPipeline(spark, Settings()).run(df)
    assert outcome.table.columns == df.columns and outcome.cut == []
    outcome = AnonymizationPipeline(spark, Settings(max_columns=4)).run(df)
    assert len(outcome.table.columns) == 4 and outcome.cut == df.columns[4:]


def test_a_failing_job_stays_and_holds_up_none(spark, tmp_path):
    store = jobs.JobStore(spark, f"{tmp_path}/jobs")
    bad = store.submit(["a"], 1, "bad", ["a", "b"])
    store.submit(["a", "b"], 1, "good", ["a", "b"])
    done = []

    def handle(job):
        if job["table_name"] == "bad":
            raise ValueError("no such table\nand more")
        done.append(job["table_name"])

    jobs.work(store, handle, f"{tmp_path}/state").awaitTermination()
    assert done == ["good"]
    assert [(r["job_id"], r["status"], r["cause"]) for r in store.all().collect()] == [(bad["job_id"], "failed", "ValueError: no such table")]
