import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from test_search import brute

from maskwright.config import Settings
from maskwright.operators import counting
from maskwright.operators.search import search

NAMES = ["a", "b", "c", "d", "e"]


def _joined(spark, path, rows):
    """Rows as the join of two files."""
    numbered = [(i, *r) for i, r in enumerate(rows)]
    spark.createDataFrame([r[:4] for r in numbered], "k int, a int, b string, c double").write.parquet(f"{path}/left")
    spark.createDataFrame([(r[0], *r[4:]) for r in numbered], "j int, d int, e timestamp_ntz").write.parquet(f"{path}/right")
    return spark.read.parquet(f"{path}/left").join(spark.read.parquet(f"{path}/right"), F.col("k") == F.col("j")).select(*NAMES)


def _rows(n, nulls, seed=5):
    from datetime import datetime

    draw = random.Random(seed)
    maybe = lambda x: None if nulls and draw.random() < 0.1 else x
    return [(maybe(draw.randrange(40)), maybe(draw.choice("xyzw")), maybe(draw.choice([0.0, -0.0, 1.5, 2.5])), maybe(7 if draw.random() < 0.5 else draw.randrange(60)), maybe(datetime(2020, 1, 1 + draw.randrange(9)))) for _ in range(n)]


@pytest.mark.parametrize("nulls", [False, True])
@pytest.mark.parametrize("few", [0, 50])
def test_large_joins_are_counted_by_pivot_without_a_cache(spark, tmp_path, monkeypatch, nulls, few):
    rows = _rows(150, nulls)
    df = _joined(spark, str(tmp_path), rows)
    for name, value in {"LARGE": 0, "FEW": few, "TASK_ROWS": 50, "COLUMNS": 3, "SHARE": 2}.items():
        monkeypatch.setattr(counting, name, value)
    monkeypatch.setattr(DataFrame, "cache", lambda self: pytest.fail("the join was cached, at many times its files' size"))
    truth = {k: v for k, v in brute(rows, NAMES, 3).items() if v}
    exact = search(df, Settings(strategy="exact", max_length=3, stop_on_empty_level=False))
    assert dict(zip(exact.sets, [exact.found[m] for m in exact.masks], strict=True)) == truth
    minimal = search(df, Settings(max_length=3, stop_on_empty_level=False))
    assert set(minimal.sets) == {k for k in truth if not any(set(o) < set(k) for o in truth)}


def test_shuffles_of_large_joins_are_removed(spark, tmp_path, monkeypatch):
    df = _joined(spark, str(tmp_path), _rows(40, False))
    monkeypatch.setattr(counting, "LARGE", 0)
    seen = []
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    counts = counting.unique_counts
    monkeypatch.setattr(counting, "unique_counts", lambda *a: seen.append(spark.conf.get(key)) or counts(*a))
    search(df, Settings(max_length=2))
    assert seen == ["true"] and spark.conf.get(key) == before


def test_the_grown_set_has_no_unique_row(spark):
    """Copies of rows but for a key: all columns without it."""
    df = spark.range(400).select("id", (F.col("id") % 200).alias("a"), (F.col("id") % 7 * 0).alias("b"), (F.col("id") % 4).alias("c"), (F.col("id") % 100).alias("d"))
    assert counting.grown_empty_set(df, counting.kinds_of(df)) == 0b11110
    assert counting.grown_empty_set(df.select("id", "a", "b"), [400, 200, 1]) == 0


def test_blocks_of_columns_hold_every_row_once_and_give_the_counts(monkeypatch):
    monkeypatch.setattr(counting, "TASK_ROWS", 30)
    draw = random.Random(7)
    rows = [(p % 5, p, draw.choice(["x", "y", None]), draw.choice([0.0, 1.5])) for p in (draw.randrange(40) for _ in range(200))]
    batches = [pa.RecordBatch.from_pydict(dict(zip(["bucket", "0", "1", "2"], map(list, zip(*rows[i : i + 20], strict=True)), strict=True))) for i in range(0, 200, 20)]
    blocks = list(counting._dealt(iter(batches)))
    assert len(blocks) == 5 and all(len(b) == 5 for b in blocks)
    back = [(k, *r.values()) for b in blocks for k, x in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True) for r in pa.ipc.open_stream(x).read_all().to_pylist()]
    assert sorted(map(str, back)) == sorted(map(str, rows))
    sets, found = [[0, 1], [0, 2], [0, 1, 2]], [0, 0, 0]
    for batch in counting._counter(sets)(iter(blocks)):
        found = [a + b for a, b in zip(found, batch[1].to_pylist(), strict=True)]
    keys = lambda s: [k for r in rows if None not in (k := tuple(r[1 + i] for i in s))]
    assert found == [sum(n == 1 for n in Counter(keys(s)).values()) for s in sets]


def test_a_set_is_grown_from_columns_of_many_values(spark):
    """Neither of the keys joins; before, growth began at the columns with the fewest values, with a scan for each step."""
    df = spark.range(1200).select("id", (F.col("id") * 7 % 1200).alias("key"), (F.col("id") % 300).alias("a"), (F.col("id") % 2).alias("b"), (F.col("id") % 100).alias("c"))
    seen, coverage = [], counting.coverage
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(counting, "coverage", lambda *a: seen.append(a) or coverage(*a))
        assert counting.grown_empty_set(df, [1200, 1200, 300, 2, 100]) == 0b11100
    assert len(seen) == 1
