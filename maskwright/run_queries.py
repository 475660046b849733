"""Registered queries over whole runs, plans, files and jobs, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.config import Settings
from maskwright.functions.scalars import combinations_count, is_null_literal, split_ranges
from maskwright.operators import analyze, clusters, compartments, mondrian, profile
from maskwright.operators.search import search
from maskwright.plans import lattice
from maskwright.plans.pipeline import AnonymizationPipeline, Outcome
from maskwright.queries import _PART_QIS, _WEIGHTS, LINEITEM, PART, _minimal_sql, _profile_sql, _unique_sql, query, table
from maskwright.session import scratch
from maskwright.sources import sinks, tables
from maskwright.streaming import jobs

# ---------------------------------------------------------------- whole runs with treatments

#: Columns of runs with treatments, and those of them whose values are whole numbers.
TREATED, NUMBERS = ["p_name", "p_brand", "p_type", "p_size"], ["p_size"]


def _perturbed_sql(source: str, columns: Sequence[str], column: str) -> str:
    """(key, new) of a perturbation."""
    cols, others = ", ".join(columns), ", ".join(c for c in columns if c != column)
    return f"""SELECT key, new FROM (SELECT {column} AS key, CASE WHEN {column} - lo <= hi - {column} THEN lo WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi END AS new,
  row_number() OVER (PARTITION BY {column} ORDER BY {others}) AS rn FROM (SELECT *, lag({column}) OVER o AS lo, lead({column}) OVER o AS hi
    FROM (SELECT {cols}, count(*) AS n FROM {source} WHERE {" AND ".join(f"{c} IS NOT NULL" for c in columns)} GROUP BY {cols}) WINDOW o AS (PARTITION BY {others} ORDER BY {column})) WHERE n = 1) WHERE rn = 1"""


def _run_sql(rounds: int) -> tuple[str, str]:
    """Twins of a default run: the treated table, and what was chosen on the way.

    A step for every column set in the order of the search; those that aren't
    quasi-identifiers, or have no unique row left, change nothing.
    """
    sets = [s for n in range(2, len(TREATED) + 1) for s in combinations(TREATED, n)]
    now, ctes, chosen = "t", [f"t AS MATERIALIZED (SELECT {', '.join(TREATED)} FROM part)"], []
    for r in range(rounds):
        ctes.append(f"q{r} AS MATERIALIZED ({_minimal_sql(now, TREATED, len(TREATED))})")
        ctes.append(f"r{r} AS MATERIALIZED (SELECT c, count(*) AS n FROM (SELECT unnest(columns) AS c FROM q{r}) GROUP BY c)")
        for i, s in enumerate(sets):
            step = f"{r}_{i}"
            ctes.append(f"u{step} AS MATERIALIZED ({_unique_sql(now, s)})")
            order = ", ".join(f"{c}::VARCHAR" for c in s)
            samples = " ".join(f"WHEN '{c}' THEN (SELECT {c}::VARCHAR FROM u{step} ORDER BY {order} LIMIT 1)" for c in s)
            ctes.append(f"""h{step} AS MATERIALIZED (SELECT (SELECT count(*) FROM u{step}) AS n, (SELECT count(*) FROM {now}) AS total, (SELECT count(*) FROM q{r} WHERE columns = {list(s)!r}) > 0 AS wanted,
              (SELECT c FROM r{r} WHERE c IN {s!r} ORDER BY n DESC, list_position({TREATED!r}, c) LIMIT 1) AS chosen)""")
            ctes.append(f"""k{step} AS MATERIALIZED (SELECT chosen, n, CASE WHEN NOT wanted OR n = 0 THEN 'none' WHEN 100.0 * n / total >= 50 THEN 'compartmentation'
              WHEN regexp_full_match(CASE chosen {samples} END, '[0-9]+') THEN 'perturbation' ELSE 'suppression' END AS treatment FROM h{step})""")
            chosen.append(f"SELECT {r}::INT AS round, {list(s)!r} AS columns, chosen AS colname, treatment, n AS unique_rows FROM k{step} WHERE treatment <> 'none'")
            columns, joins = [], ""
            for c in TREATED:
                if c not in s:
                    columns.append(f"{now}.{c}")
                elif c in NUMBERS:
                    ctes.append(f"m{step} AS MATERIALIZED ({_perturbed_sql(now, s, c)})")
                    joins = f"LEFT JOIN m{step} ON m{step}.key = {now}.{c}"
                    columns.append(f"CASE WHEN chosen = '{c}' AND treatment = 'perturbation' AND key IS NOT NULL THEN new ELSE {now}.{c} END AS {c}")
                else:
                    columns.append(f"CASE WHEN chosen = '{c}' AND treatment = 'suppression' AND (k{step}.n * 100.0 > 99 * (SELECT count({c}) FROM {now}) OR {now}.{c} IN (SELECT {c} FROM u{step})) THEN NULL ELSE {now}.{c} END AS {c}")
            ctes.append(f"t{step} AS MATERIALIZED (SELECT {', '.join(columns)} FROM {now} CROSS JOIN k{step} {joins})")
            now = f"t{step}"
    given = f"WITH {', '.join(ctes)} "
    return f"{given}SELECT * FROM {now}", given + " UNION ALL ".join(chosen)


_ONE_ROUND, _TWO_ROUNDS = _run_sql(1), _run_sql(2)


def _run(spark: SparkSession, sf_dir: str, rounds: int = 1) -> Outcome:
    return AnonymizationPipeline(spark, Settings(rounds=rounds)).run(table(spark, sf_dir, "part", TREATED))


@query(_ONE_ROUND[0])
def run_treated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default route: search, choice, treatment of each quasi-identifier in the table as the ones before left it."""
    return _run(spark, sf_dir).table


@query(_ONE_ROUND[1])
def run_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, list(c.columns), c.column, c.treatment, c.unique_rows) for c in _run(spark, sf_dir).choices]
    return spark.createDataFrame(rows, "round int, columns array<string>, colname string, treatment string, unique_rows long")


@query(_TWO_ROUNDS[0])
def run_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same again over what the first round left, quasi-identifiers with NULLs and wider ones included."""
    return _run(spark, sf_dir, 2).table


@query(f"""WITH p AS ({_profile_sql('orders', ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority'])})
SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE (SELECT list_sort(list(colname)) FROM p WHERE coverage_of_uniques * 100 > 80) = ['o_orderkey', 'o_totalprice']""")
def drop_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.without_identifiers(table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]))


_EVALUATED = f"(SELECT count(*) AS n FROM ({_WEIGHTS} SELECT * FROM s WHERE weight >= 7 AND mean_weight >= 5))"


@query(f"SELECT n AS evaluated, {2 ** len(PART) - len(PART) - 1}::BIGINT AS total, 100.0 - ceil(n / {2 ** len(PART) - len(PART) - 1}.0 * 10000) / 100 AS saved_pct FROM {_EVALUATED}")
def search_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "part", PART), Settings(strategy="heuristic", max_length=2))
    return spark.createDataFrame([(found.evaluated, found.total, lattice.saved_pct(found.evaluated, found.total))], "evaluated long, total long, saved_pct double")


# ---------------------------------------------------------------- orders of columns, reports


@query(f"SELECT (row_number() OVER (ORDER BY cardinality DESC, position) - 1)::INT AS place, colname, cardinality AS value FROM ({_profile_sql('lineitem', LINEITEM)})")
def columns_by_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ranked(profile.profile(table(spark, sf_dir, "lineitem", LINEITEM)))


@query(f"SELECT (row_number() OVER (ORDER BY entropy DESC, position) - 1)::INT AS place, colname, entropy AS value FROM ({_profile_sql('part', PART)})")
def columns_by_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ranked(profile.profile(table(spark, sf_dir, "part", PART)), "entropy")


@query(f"SELECT colname FROM ({_profile_sql('lineitem', LINEITEM)}) WHERE colname IN ('l_quantity', 'l_shipdate', 'l_tax') ORDER BY cardinality DESC, position LIMIT 1")
def highest_cardinality_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.highest_cardinality(profile.profile(table(spark, sf_dir, "lineitem", LINEITEM)), ["l_quantity", "l_shipdate", "l_tax"])


_WEIGHED = f"q AS MATERIALIZED ({_PART_QIS}), e AS (SELECT colname, entropy FROM ({_profile_sql('part', PART)})), w AS (SELECT columns, len, ceil(round(sum(entropy), 9)) AS weight, ceil(round(avg(entropy), 9)) AS mean FROM (SELECT columns, len, unnest(columns) AS colname FROM q) JOIN e USING (colname) GROUP BY ALL)"


@query(f"WITH {_WEIGHED} SELECT mean::BIGINT AS mean_weight, count(*) AS n FROM w GROUP BY 1")
def qi_mean_weight_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part", PART)
    return analyze.by_weight(analyze.weights(search(df).table(spark), profile.profile(df)), "mean_weight")


@query(f"""WITH {_WEIGHED} SELECT 'popularity' AS report, (SELECT count(DISTINCT c) FROM (SELECT unnest(columns) AS c FROM q)) AS n UNION ALL SELECT 'weights', (SELECT count(*) FROM w)
UNION ALL SELECT 'lengths', (SELECT count(DISTINCT len) FROM w) UNION ALL SELECT 'by_weight', (SELECT count(DISTINCT weight) FROM w) UNION ALL SELECT 'by_mean_weight', (SELECT count(DISTINCT mean) FROM w)
UNION ALL SELECT 'columns', (SELECT count(DISTINCT c) FROM (SELECT unnest(columns) AS c FROM q)) UNION ALL SELECT 'by_length_of_column', (SELECT count(DISTINCT c) FROM (SELECT unnest(columns) AS c FROM q))
UNION ALL SELECT 'lattice', {len(PART)} UNION ALL SELECT 'scatter', {len(PART)}""")
def analysis_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports at once: how many rows each has."""
    df = table(spark, sf_dir, "part", PART)
    reports = analyze.analyze(search(df).table(spark), profile.profile(df))
    counts = [reports[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("report"), "n") for name in sorted(reports) if name != "allowed"]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query(f"""WITH q AS ({_PART_QIS}), c AS (SELECT unnest({PART!r}) AS a) SELECT DISTINCT l.a AS src, r.a AS dst FROM q, c l, c r WHERE l.a <> r.a AND list_contains(columns, l.a) AND list_contains(columns, r.a) UNION ALL SELECT a, a FROM c""")
def conflict_edges_with_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "part", PART)).sets
    return compartments.edges(spark, compartments.conflict_graph(found, PART), loops=True)


@query(f"""WITH p AS (SELECT entropy AS x, cardinality AS y, position AS i FROM ({_profile_sql('part', PART)})), d AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d FROM p a JOIN p b ON a.i < b.i)
SELECT round((ax + bx) / 2, 6) AS x, round((ay + by_) / 2, 6) AS y, round(sqrt(d) / 2, 6) AS radius FROM d ORDER BY d DESC LIMIT 1""")
def enclosing_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.profile(table(spark, sf_dir, "part", PART)).orderBy("position").collect()  # a row per column
    found = compartments.enclosing_circle([(r["entropy"], r["cardinality"]) for r in rows])
    return spark.createDataFrame([tuple(round(v, 6) for v in found)], "x double, y double, radius double")


@query(f"SELECT unnest([{', '.join(str(LINEITEM[i : i + 4]) for i in range(0, len(LINEITEM), 4))}]) AS columns")
def column_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(list(c),) for c in lattice.chunks(LINEITEM, 4)], "columns array<string>")


@query("SELECT n::INT AS n_columns, CASE WHEN n > 10 THEN 10 ELSE greatest(1, n // 2) END::INT AS size, ceil(n / size * 1.5)::INT AS samples, true AS drawn_from_all, (2 ** n - n - 1)::BIGINT AS lattice FROM (SELECT unnest([2, 5, 10, 11, 25]) AS n)")
def sampling_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for n in (2, 5, 10, 11, 25):
        names = [f"c{i}" for i in range(n)]
        plan = lattice.sampling_plan(names)
        size = 10 if n > 10 else max(1, n // 2)
        rows.append((n, size, len(plan), all(set(s) <= set(names) and 0 < len(s) <= size for s in plan), combinations_count(n)))
    return spark.createDataFrame(rows, "n_columns int, size int, samples int, drawn_from_all boolean, lattice long")


_CLUSTERED = f"c AS (SELECT colname, floor(entropy)::INT AS cluster FROM ({_profile_sql('lineitem', LINEITEM)}))"


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns clustered by whole entropies, which SQL can say too."""
    return profile.profile(table(spark, sf_dir, "lineitem", LINEITEM)).select("colname", F.floor("entropy").cast("int").alias("cluster"))


@query(f"WITH {_CLUSTERED} SELECT colname, cluster FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY colname) <= 2")
def first_columns_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.first_of_clusters(_clustered(spark, sf_dir), 2)


@query(f"""WITH {_CLUSTERED}, l AS (SELECT cluster, list(colname ORDER BY colname) AS own FROM c GROUP BY 1)
SELECT list_concat(own, (SELECT coalesce(flatten(list(o.own[:2] ORDER BY o.cluster)), []) FROM l o WHERE o.cluster <> l.cluster AND len(o.own) >= 2)) AS columns FROM l""")
def groups_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clustered search takes together: a cluster, and samples of the other ones."""
    found: dict[int, list[str]] = {}
    for r in _clustered(spark, sf_dir).orderBy("cluster", "colname").collect():  # a row per column
        found.setdefault(r["cluster"], []).append(r["colname"])
    return spark.createDataFrame([(g,) for g in lattice.clustered_plan(list(found.values()))], "columns array<string>")


# ---------------------------------------------------------------- l-diversity


def _mondrian_sql(rounds: int) -> str:
    """Cuts of all open partitions, round by round (``rounds``: more than any partition needs)."""
    a, b = "p_size", "p_retailprice"
    ctes = [f"s AS (SELECT max({a}) - min({a}) AS a, max({b}) - min({b}) AS b FROM part)", f"t0 AS MATERIALIZED (SELECT {a}, {b}, p_type, '' AS part, 3 AS allowed, true AS open FROM part)"]
    for i in range(rounds):
        ctes += [
            f"""w{i} AS MATERIALIZED (SELECT part, CASE WHEN greatest(x, y) <= 0 THEN 0 WHEN x >= y THEN 1 ELSE 2 END AS dim FROM (SELECT part, CASE WHEN any_value(allowed) & 1 = 1 THEN (max({a}) - min({a})) / any_value(s.a) ELSE -1 END AS x,
  CASE WHEN any_value(allowed) & 2 = 2 THEN (max({b}) - min({b})) / any_value(s.b) ELSE -1 END AS y FROM t{i}, s WHERE open GROUP BY part))""",
            f"v{i} AS MATERIALIZED (SELECT t.*, dim, CASE WHEN dim = 1 THEN {a}::DOUBLE WHEN dim = 2 THEN {b} END AS v FROM t{i} t LEFT JOIN w{i} USING (part))",
            f"""c{i} AS MATERIALIZED (SELECT part, min(v) FILTER (upto >= total // 2) AS split, max(v) AS high FROM (SELECT part, v, sum(count(*)) OVER (PARTITION BY part ORDER BY v) AS upto, sum(count(*)) OVER (PARTITION BY part) AS total
  FROM v{i} WHERE open AND v IS NOT NULL GROUP BY part, v) GROUP BY part)""",
            f"e{i} AS MATERIALIZED (SELECT v.*, CASE WHEN split < high THEN CASE WHEN v <= split THEN '0' ELSE '1' END END AS side FROM v{i} v LEFT JOIN c{i} USING (part))",
            f"""g{i} AS MATERIALIZED (SELECT part, bool_and(size >= 3 AND kinds >= 3 AND most <= size / 3) AS holds FROM (SELECT part, side, sum(n) AS size, count(p_type) AS kinds, max(n) AS most
  FROM (SELECT part, side, p_type, count(*) AS n FROM e{i} WHERE open AND side IS NOT NULL GROUP BY ALL) GROUP BY part, side) GROUP BY part)""",
            f"""t{i + 1} AS MATERIALIZED (SELECT {a}, {b}, p_type, CASE WHEN open AND holds THEN part || '/' || side ELSE part END AS part, CASE WHEN holds THEN 3 ELSE allowed & ~dim END AS allowed,
  open AND CASE WHEN holds THEN true ELSE dim <> 0 AND allowed & ~dim <> 0 END AS open FROM (SELECT e.*, coalesce(g.holds, false) AS holds FROM e{i} e LEFT JOIN g{i} g USING (part)))""",
        ]
    label = lambda c: f"CASE WHEN min({c}) OVER p = max({c}) OVER p THEN {c}::VARCHAR ELSE concat(min({c}) OVER p, ',', max({c}) OVER p) END AS {c}_generalized"
    return f"WITH {', '.join(ctes)} SELECT {a}, {b}, p_type, part AS part_id, {label(a)}, {label(b)} FROM t{rounds} WINDOW p AS (PARTITION BY part)"


@query(_mondrian_sql(30))
def mondrian_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mondrian.mondrian(table(spark, sf_dir, "part", ["p_size", "p_retailprice", "p_type"]), "p_type", 3)


@query("""WITH w AS (SELECT max(p_size) - min(p_size) AS a, max(p_retailprice) - min(p_retailprice) AS b FROM part),
g AS (SELECT p_brand, (max(p_size) - min(p_size)) / any_value(w.a) AS x, (max(p_retailprice) - min(p_retailprice)) / any_value(w.b) AS y FROM part, w GROUP BY 1)
SELECT p_brand, CASE WHEN y > x THEN 'p_retailprice' ELSE 'p_size' END AS widest FROM g""")
def widest_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    whole = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("p_size", "p_retailprice")]).first()
    widths = df.groupBy("p_brand").agg(*[((F.max(c) - F.min(c)) / whole[c]).alias(c) for c in ("p_size", "p_retailprice")])
    return widths.select("p_brand", mondrian.widest({c: F.col(c) for c in ("p_size", "p_retailprice")}).alias("widest"))


@query("""WITH t AS (SELECT p_brand AS leaf, CASE WHEN substr(p_brand, 7)::INT <= 10 THEN 'low' ELSE 'high' END AS node FROM part GROUP BY ALL), n AS (SELECT count(*) AS every, count(*) FILTER (node = 'low') AS low, count(*) FILTER (node = 'high') AS high FROM t),
g AS (SELECT p_type, count(*) AS size, count(DISTINCT leaf) AS leaves, count(DISTINCT node) AS nodes, min(node) AS node, (max(p_size) - min(p_size)) / (SELECT max(p_size) - min(p_size) FROM part) AS w FROM part JOIN t ON leaf = p_brand WHERE p_size % 7 = 0 OR p_brand IN ('Brand#1', 'Brand#2') GROUP BY p_type, p_size % 7 = 0)
SELECT round(sum(size * (w + CASE WHEN leaves = 1 THEN 0 WHEN nodes > 1 THEN 1 WHEN node = 'low' THEN low / every ELSE high / every END)) / (2 * sum(size)) * 100, 6) AS ncp, sum(size * size)::BIGINT AS dp FROM g, n""")
def certainty_penalties_of_taxonomies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    brands = df.select(F.col("p_brand").alias("leaf")).distinct()
    node = F.when(F.substring("leaf", 7, 9).cast("int") <= 10, "low").otherwise("high")
    taxonomy = brands.select("leaf", F.array(F.lit("*"), node, F.col("leaf")).alias("path"))
    some = df.where("p_size % 7 = 0 or p_brand in ('Brand#1', 'Brand#2')").withColumn("part", F.concat_ws("|", "p_type", (F.col("p_size") % 7 == 0).cast("string")))
    return mondrian.penalties(some, "part", ["p_size", "p_brand"], {"p_brand": taxonomy}).select(F.round("ncp", 6).alias("ncp"), "dp")


# ---------------------------------------------------------------- files


@query("SELECT column_name AS colname FROM (DESCRIBE part)")
def schema_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.write_csv(table(spark, sf_dir, "part"), scratch(spark, "schema"))
    return spark.createDataFrame([(c,) for c in tables.read_schema(spark, path)], "colname string")


@query("SELECT least(100, count(*)) AS n, 2::INT AS n_columns FROM part")
def capped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.write_csv(table(spark, sf_dir, "part"), scratch(spark, "capped"))
    df = tables.read_text_csv(spark, path, ["p_name", "p_size"], max_rows=100)
    return df.agg(F.count("*").alias("n")).withColumn("n_columns", F.lit(len(df.columns)))


@query("SELECT p_brand, p_type, NULL::INT AS p_size, 0::INT AS compartment_id FROM part UNION ALL SELECT NULL, NULL, p_size, 1::INT FROM part")
def compartments_read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, parts = scratch(spark, "compartments"), [["p_brand", "p_type"], ["p_size"]]
    sinks.write_compartments(table(spark, sf_dir, "part"), parts, base)
    return compartments.union(tables.read_compartments(spark, base, len(parts)))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_retailprice"])
    return spark.read.schema(df.schema).json(sinks.write_json(df, scratch(spark, "json")))


@query(f"SELECT colname, entropy, n_distinct, unique_entries FROM ({_profile_sql('part', PART)})")
def statistics_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.profile(table(spark, sf_dir, "part", PART))
    return tables.read_csv(spark, sinks.write_statistics(stats, scratch(spark, "statistics")), stats.schema, columns=["colname", "entropy", "n_distinct", "unique_entries"], sep=";")


@query("SELECT * FROM (VALUES ('a', 'seconds', 1.5::DOUBLE, 4::INT, 'suppression'), ('a', 'score', 7.0::DOUBLE, 4::INT, 'suppression'), ('b', 'seconds', 2.5::DOUBLE, 5::INT, NULL)) t(run_id, metric, value, n_columns, treatment)")
def appended_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "metrics")
    sinks.append_metrics(spark, path, "a", {"seconds": 1.5, "score": 7}, 4, "suppression")
    sinks.append_metrics(spark, path, "b", {"seconds": 2.5}, 5, None)
    return spark.read.parquet(path)


@query("SELECT 'kept_0' AS table_name, p_brand AS value FROM part UNION ALL SELECT 'kept_1', p_size::VARCHAR FROM part")
def stored_compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "stored")
    names = sinks.store_compartments(table(spark, sf_dir, "part"), [["p_brand"], ["p_size"]], "kept", lambda df, name: df.write.parquet(f"{base}/{name}"))
    parts = [spark.read.parquet(f"{base}/{name}") for name in names]
    first, second = (df.select(F.lit(name).alias("table_name"), F.col(df.columns[0]).cast("string").alias("value")) for df, name in zip(parts, names, strict=True))
    return first.union(second)


@query("SELECT * FROM (VALUES ('host', 'db'), ('user', 'u')) t(key, value)")
def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "config")
    spark.createDataFrame([('{"host": "db",\n "user": "u"}',)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame(sorted(tables.read_config(spark, path).items()), "key string, value string")


@query("SELECT p_size, p_size IS NULL AS none, ['1,2', '2,5'][1 + p_size % 2] AS ranges, string_split(ranges, ',')[1] AS low FROM part")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = F.when(F.col("p_size") % 2 == 0, "1,2").otherwise("2,5")
    return table(spark, sf_dir, "part").select("p_size", is_null_literal(F.col("p_size")).alias("none"), ranges.alias("ranges"), split_ranges(ranges)[0].alias("low"))


# ---------------------------------------------------------------- jobs


@query("SELECT * FROM (VALUES (['p_brand'], 1::INT, 'one', 'waiting', NULL), (['p_name', 'p_size'], 2::INT, 'two', 'waiting', NULL), (['nope'], 3::INT, 'three', 'failed', 'unknown columns: nope')) t(columns, partner_id, table_name, status, cause)")
def job_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted, changed, deleted and refused jobs."""
    there, store = tables.read_schema(spark, f"{sf_dir}/part.parquet"), jobs.JobStore(spark, scratch(spark, "jobs"))
    store.submit(["p_brand"], 1, "one", there)
    two, gone = store.submit(["p_name"], 2, "two", there), store.submit(["p_type"], 4, "four", there)
    store.update(two["job_id"], ["p_name", "p_size"])
    store.delete(gone["job_id"])
    try:
        store.submit(["nope"], 3, "three", there)
    except jobs.BadRequest:
        pass  # kept as failed
    return store.all().drop("job_id")


@query("SELECT table_name, n, NULL AS cause FROM (SELECT 'brands_0' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'both_0', count(*) FROM part UNION ALL SELECT 'both_1', count(*) FROM part) UNION ALL SELECT 'bad', 0, 'failed'")
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker's stream over three jobs: compartments of two are stored, a failing one is kept and holds up none."""
    base = scratch(spark, "worker")
    store = jobs.JobStore(spark, f"{base}/jobs")
    for columns, name in ((["p_brand"], "brands"), (["p_brand", "p_size"], "both"), (["p_name"], "bad")):
        store.submit(columns, 1, name, PART)
    names: list[str] = []

    def load(name: str) -> DataFrame:
        if name == "bad":
            raise OSError("the table cannot be read")
        return table(spark, sf_dir, "part")

    def handle(job) -> None:
        write = lambda df, name: df.write.parquet(f"{base}/{name}")
        jobs.run_job(spark, job, lambda: load(job["table_name"]), Settings(treatment="compartmentation"), lambda df, parts, name: names.extend(sinks.store_compartments(df, parts, name, write)))

    jobs.work(store, handle, f"{base}/state").awaitTermination()
    left = store.all().select("table_name", F.lit(0).cast("long").alias("n"), F.col("status").alias("cause"))
    for name in names:
        left = left.union(spark.read.parquet(f"{base}/{name}").agg(F.lit(name), F.count("*"), F.lit(None).cast("string")))
    return left
