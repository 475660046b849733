"""The registered queries over the driver's tables, each with a DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.config import Settings
from maskwright.functions.scalars import is_digits, numeric
from maskwright.operators import analyze, clusters, compartments, mondrian, profile, score, treat, uniqueness
from maskwright.operators.search import search
from maskwright.plans import lattice
from maskwright.plans.pipeline import AnonymizationPipeline
from maskwright.session import scratch
from maskwright.sources import sinks, tables
from maskwright.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

PART = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS = ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
CUSTOMER = ["c_nationkey", "c_mktsegment", "c_acctbal"]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# ---------------------------------------------------------------- SQL twins, built from column lists


def _not_null(columns: Sequence[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def _unique_sql(source: str, columns: Sequence[str]) -> str:
    cols = ", ".join(columns)
    return f"SELECT {cols} FROM {source} WHERE {_not_null(columns)} GROUP BY {cols} HAVING count(*) = 1"


def _profile_sql(source: str, columns: Sequence[str]) -> str:
    one = """SELECT '{c}' AS colname, {i} AS position,
      round(CASE WHEN n > 0 THEN ln(n) - s / n ELSE 0 END, 6) AS entropy, round_even(CASE WHEN n > 0 THEN ln(n) - s / n ELSE 0 END, 2) AS entropy_rounded,
      d::DOUBLE / nullif(n, 0) AS cardinality, d AS n_distinct, n AS n_values, z AS n_nulls, u AS unique_entries, u::DOUBLE / nullif(n, 0) AS coverage_of_uniques
    FROM (SELECT sum(CASE WHEN v IS NULL THEN 0 ELSE c END)::BIGINT AS n, sum(CASE WHEN v IS NULL THEN c ELSE 0 END)::BIGINT AS z, count(*) AS d,
        sum((v IS NOT NULL AND c = 1)::INT)::BIGINT AS u, sum(CASE WHEN v IS NULL THEN 0 ELSE c * ln(c) END) AS s
      FROM (SELECT {c} AS v, count(*) AS c FROM {source} GROUP BY 1))"""
    return " UNION ALL ".join(one.format(c=c, i=i, source=source) for i, c in enumerate(columns))


def _coverage_sql(source: str, sets: Sequence[Sequence[str]], where: str = "true") -> str:
    """(columns, len, unique_rows, coverage_pct) of the given sets."""
    rows = [f"SELECT {list(s)!r} AS columns, {len(s)}::INT AS len, (SELECT count(*) FROM ({_unique_sql(source, s)})) AS unique_rows" for s in sets]
    return f"SELECT columns, len, unique_rows, 100.0::DOUBLE * unique_rows / (SELECT count(*) FROM {source}) AS coverage_pct FROM ({' UNION ALL '.join(rows)}) WHERE {where}"


def _minimal_sql(source: str, columns: Sequence[str], longest: int) -> str:
    sets = [s for n in range(2, longest + 1) for s in combinations(columns, n)]
    return f"""WITH c AS ({_coverage_sql(source, sets, 'unique_rows > 0')})
    SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS k WHERE k.len < c.len AND list_has_all(c.columns, k.columns))"""


_PART_QIS = _minimal_sql("part", PART, len(PART))
_LINEITEM_QIS = _minimal_sql("lineitem", LINEITEM, len(LINEITEM))


def _minimal(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    return search(table(spark, sf_dir, name, columns), Settings()).table(spark)


# ---------------------------------------------------------------- profiles


@query(_profile_sql("part", ["p_partkey", *PART]))
def profile_part(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "part", ["p_partkey", *PART]))


@query(_profile_sql("lineitem", LINEITEM))
def profile_lineitem(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "lineitem", LINEITEM))


_NULLED = "(SELECT nullif(p_brand, 'Brand#1') AS p_brand, CASE WHEN p_size > 25 THEN p_size END AS p_size, CAST(NULL AS VARCHAR) AS nothing FROM part)"


def _nulled(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.nullif("p_brand", F.lit("Brand#1")).alias("p_brand"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"), F.lit(None).cast("string").alias("nothing"))


@query(_profile_sql(_NULLED, ["p_brand", "p_size", "nothing"]))
def profile_nulls(spark, sf_dir):
    return profile.profile(_nulled(spark, sf_dir))


@query(f"SELECT p_brand, p_size FROM {_NULLED}")
def drop_empty_columns(spark, sf_dir):
    return profile.drop_empty_columns(_nulled(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, colname, coverage_of_uniques FROM ({_profile_sql(t, c)}) WHERE coverage_of_uniques * 100 > 80" for t, c in (("customer", ["c_custkey", "c_name", *CUSTOMER]), ("orders", ["o_orderkey", "o_totalprice", *ORDERS]))))
def first_class_identifiers(spark, sf_dir):
    parts = [(t, table(spark, sf_dir, t, c)) for t, c in (("customer", ["c_custkey", "c_name", *CUSTOMER]), ("orders", ["o_orderkey", "o_totalprice", *ORDERS]))]
    found = [profile.first_class_identifiers(profile.profile(df)).select(F.lit(t).alias("table_name"), "colname", "coverage_of_uniques") for t, df in parts]
    return found[0].union(found[1])


@query(f"SELECT colname, cardinality FROM ({_profile_sql('part', ['p_partkey', *PART])}) WHERE coverage_of_uniques * 100 > 80 OR cardinality * 100 > 30")
def first_class_by_cardinality(spark, sf_dir):
    return profile.first_class_identifiers(profile.profile(table(spark, sf_dir, "part", ["p_partkey", *PART])), Settings(identifier_cardinality=30.0)).select("colname", "cardinality")


@query("SELECT p_name, p_brand FROM (SELECT * EXCLUDE (p_partkey) FROM part)")
def column_prefix(spark, sf_dir):
    return profile.prefix(table(spark, sf_dir, "part", PART), 2)


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "part"), "p_brand")


# ---------------------------------------------------------------- uniqueness and search


@query("SELECT p_name, p_brand, count(*) AS count FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL GROUP BY ALL")
def representatives(spark, sf_dir):
    return uniqueness.representatives(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


@query(f"SELECT p_brand, p_size, 1::BIGINT AS count FROM ({_unique_sql(_NULLED, ['p_brand', 'p_size'])})")
def unique_rows_with_nulls(spark, sf_dir):
    return uniqueness.unique_rows(_nulled(spark, sf_dir), ["p_brand", "p_size"])


@query("SELECT p_brand, p_size, count(*) AS count FROM part GROUP BY ALL HAVING count(*) > 1")
def repeated_rows(spark, sf_dir):
    return uniqueness.repeated_rows(table(spark, sf_dir, "part"), ["p_brand", "p_size"])


_PAIRS = list(combinations(LINEITEM, 2))


@query(_coverage_sql("lineitem", _PAIRS, "unique_rows > 0"))
def qi_level2_lineitem(spark, sf_dir):
    return search(table(spark, sf_dir, "lineitem", LINEITEM), Settings(strategy="exact", max_length=2)).table(spark)


@query(_PART_QIS)
def qi_minimal_part(spark, sf_dir):
    return _minimal(spark, sf_dir, "part", PART)


@query(_LINEITEM_QIS)
def qi_minimal_lineitem(spark, sf_dir):
    return _minimal(spark, sf_dir, "lineitem", LINEITEM)


@query(_minimal_sql("orders", ORDERS, 4))
def qi_minimal_orders(spark, sf_dir):
    return _minimal(spark, sf_dir, "orders", ORDERS)


@query(_coverage_sql("part", [s for n in (2, 3, 4, 5) for s in combinations(PART, n)], "unique_rows > 0"))
def qi_exact_part(spark, sf_dir):
    return search(table(spark, sf_dir, "part", PART), Settings(strategy="exact")).table(spark)


@query(_coverage_sql("lineitem", _PAIRS, "unique_rows > 0 AND coverage_pct > 10"))
def qi_coverage_threshold(spark, sf_dir):
    return search(table(spark, sf_dir, "lineitem", LINEITEM), Settings(strategy="exact", max_length=2, min_coverage_pct=10.0)).table(spark)


@query(f"SELECT g::BIGINT AS gid, count(*) FILTER (c = 1)::BIGINT AS n_unique FROM (SELECT grouping_id(p_brand, p_type, p_size) AS g, count(*) AS c FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand, p_size), (p_type, p_size))) GROUP BY 1")
def coverage_grouping_sets(spark, sf_dir):
    return uniqueness.coverage_by_grouping_sets(table(spark, sf_dir, "part"), [["p_brand", "p_type"], ["p_brand", "p_size"], ["p_type", "p_size"]])


_WEIGHTS = f"""WITH e AS (SELECT colname, position, entropy FROM ({_profile_sql('part', PART)})),
s AS (SELECT a.colname AS a, b.colname AS b, ceil(round(a.entropy + b.entropy, 9))::BIGINT AS weight, ceil(round((a.entropy + b.entropy) / 2, 9))::BIGINT AS mean_weight FROM e a JOIN e b ON a.position < b.position)"""


@query(f"{_WEIGHTS} SELECT [a, b] AS columns, 2::INT AS len, weight, mean_weight FROM s")
def combination_weights(spark, sf_dir):
    df = table(spark, sf_dir, "part", PART)
    pairs = spark.createDataFrame([(list(p), 2) for p in combinations(PART, 2)], "columns array<string>, len int")
    return analyze.weights(pairs, profile.profile(df))


@query(f"{_WEIGHTS} SELECT a AS first, b AS second FROM s WHERE weight >= 7 AND mean_weight >= 5")
def candidate_filter(spark, sf_dir):
    entropies = {r["colname"]: r["entropy"] for r in profile.profile(table(spark, sf_dir, "part", PART)).collect()}
    kept = [m for m in lattice.sets_of(len(PART), 2) if lattice.passes(m, [], [entropies[c] for c in PART], None, Settings())]
    return spark.createDataFrame([lattice.names_of(m, PART) for m in kept], "first string, second string")


@query(f"SELECT * FROM ({_coverage_sql('part', list(combinations(PART, 2)), 'unique_rows > 0')}) SEMI JOIN ({_WEIGHTS} SELECT [a, b] AS columns FROM s WHERE weight >= 7 AND mean_weight >= 5) USING (columns)")
def qi_heuristic_part(spark, sf_dir):
    return search(table(spark, sf_dir, "part", PART), Settings(strategy="heuristic", max_length=2)).table(spark)


@query(f"""WITH e AS (SELECT colname, entropy FROM ({_profile_sql('lineitem', LINEITEM)})), c AS MATERIALIZED ({_coverage_sql('lineitem', [s for n in range(2, len(LINEITEM) + 1) for s in combinations(LINEITEM, n)], 'unique_rows > 0')}),
w AS (SELECT columns, ceil(round(sum(entropy), 9)) AS weight, ceil(round(avg(entropy), 9)) AS mean FROM (SELECT columns, unnest(columns) AS colname FROM c) JOIN e USING (colname) GROUP BY 1),
p AS (SELECT c.* FROM c JOIN w USING (columns) WHERE list_has_any(columns, ['l_suppkey', 'l_shipdate', 'l_returnflag']) AND weight >= 7 AND mean >= 5 AND NOT (mean < 7 AND len > 4))
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p AS k WHERE k.len < p.len AND list_has_all(p.columns, k.columns))""")
def qi_heuristic_lineitem(spark, sf_dir):
    settings = Settings(strategy="heuristic", crm_columns=("l_suppkey", "l_shipdate", "l_returnflag"), stop_on_empty_level=False)
    return search(table(spark, sf_dir, "lineitem", LINEITEM), settings).table(spark)


#: A table of 24 columns, so that sampled searches take more than one group.
_WIDE = [*LINEITEM, "l_extendedprice", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_nationkey", "c_acctbal", "c_mktsegment", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_WIDE_SQL = f"wide AS MATERIALIZED (SELECT {', '.join(_WIDE)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"


def _wide(spark, sf_dir):
    lines, orders, customers, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    known = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))  # before the lines, which are more
    joined = lines.join(known, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(*_WIDE)


def _planned_sql(plan: Sequence[Sequence[str]]) -> str:
    """The pairs that some group of the plan holds."""
    pairs = [p for p in combinations(_WIDE, 2) if any(set(p) <= set(group) for group in plan)]
    return f"WITH {_WIDE_SQL} SELECT * FROM ({_coverage_sql('wide', pairs, 'unique_rows > 0')})"


@query(_planned_sql(lattice.chunked_plan(_WIDE, Settings().seed)))
def qi_sampled_wide(spark, sf_dir):
    return search(_wide(spark, sf_dir), Settings(strategy="sampled", max_length=2)).table(spark)


@query(_planned_sql(lattice.sampling_plan(_WIDE, Settings().seed)))
def qi_drawn_wide(spark, sf_dir):
    return search(_wide(spark, sf_dir), Settings(strategy="drawn", max_length=2)).table(spark)


# ---------------------------------------------------------------- treatments


def _suppressed_sql(source: str, columns: Sequence[str], column: str, rest: Sequence[str]) -> str:
    others = ", ".join(rest)
    return f"""SELECT {others}, CASE WHEN (SELECT count(*) FROM ({_unique_sql(source, columns)})) * 100.0 > 99 * (SELECT count({column}) FROM {source}) THEN NULL
      WHEN {column} IN (SELECT {column} FROM ({_unique_sql(source, columns)})) THEN NULL ELSE {column} END AS {column} FROM {source}"""


@query(_suppressed_sql("part", ["p_brand", "p_type"], "p_brand", ["p_partkey"]))
def suppress_brand_type(spark, sf_dir):
    return treat.suppress(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_brand")[0].select("p_partkey", "p_brand")


@query(_suppressed_sql("part", ["p_brand", "p_size"], "p_size", ["p_partkey"]))
def suppress_brand_size(spark, sf_dir):
    return treat.suppress(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_size")[0].select("p_partkey", "p_size")


@query(_suppressed_sql("events", ["event_id", "user_id"], "event_id", ["user_id"]))
def suppress_whole_column(spark, sf_dir):
    return treat.suppress(table(spark, sf_dir, "events"), ["event_id", "user_id"], "event_id")[0].select("user_id", "event_id")


@query(f"SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name, p_size) = 1 THEN NULL ELSE p_name END AS p_name FROM part")
def suppress_rows(spark, sf_dir):
    return treat.suppress(table(spark, sf_dir, "part"), ["p_name", "p_size"], "p_name", Settings(suppress_all_pct=100.0), scope="row")[0].select("p_partkey", "p_name")


_NEAR = "SELECT v AS value, coalesce(lag(v) OVER (ORDER BY v), v) AS lower, coalesce(lead(v) OVER (ORDER BY v), v) AS upper FROM (SELECT DISTINCT try_cast(p_size AS DOUBLE) AS v FROM part WHERE p_size IS NOT NULL)"


@query(_NEAR)
def neighbours(spark, sf_dir):
    return treat.neighbours(table(spark, sf_dir, "part"), "p_size")


@query(f"SELECT value, CASE WHEN value = lower THEN upper WHEN value = upper THEN lower WHEN value - lower <= upper - value THEN lower ELSE upper END AS closest FROM ({_NEAR})")
def closest_value(spark, sf_dir):
    return treat.closest(treat.neighbours(table(spark, sf_dir, "part"), "p_size"))


@query(f"""SELECT p_partkey, CASE WHEN p_size IN (SELECT p_size FROM ({_unique_sql('part', ['p_brand', 'p_size'])})) THEN concat(n.lower::BIGINT, '-', n.upper::BIGINT) ELSE p_size::VARCHAR END AS p_size
FROM part LEFT JOIN ({_NEAR}) n ON n.value = p_size""")
def generalize_size(spark, sf_dir):
    return treat.generalize(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_size")[0].select("p_partkey", "p_size")


_PERTURBED = """WITH r AS (SELECT p_name, p_size, count(*) AS c FROM part GROUP BY ALL),
w AS (SELECT *, lag(p_size) OVER o AS lo, lead(p_size) OVER o AS hi FROM r WINDOW o AS (PARTITION BY p_name ORDER BY p_size)),
u AS (SELECT p_size AS key, CASE WHEN p_size - lo <= hi - p_size THEN lo WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi END AS new, row_number() OVER (PARTITION BY p_size ORDER BY p_name) AS rn FROM w WHERE c = 1)"""


@query(f"{_PERTURBED} SELECT p_partkey, CASE WHEN key IS NULL THEN p_size ELSE new END AS p_size FROM part LEFT JOIN (SELECT key, new FROM u WHERE rn = 1) ON key = p_size")
def perturb_size(spark, sf_dir):
    return treat.perturb(table(spark, sf_dir, "part"), ["p_name", "p_size"], "p_size")[0].select("p_partkey", "p_size")


_CHOICES = ["p_name", "p_brand", "p_type", "p_retailprice"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS colname, n AS unique_rows, CASE WHEN digits AND pct < 50 THEN 'perturbation' WHEN NOT digits AND pct < 50 THEN 'suppression' ELSE 'compartmentation' END AS treatment
  FROM (SELECT count(*) AS n, regexp_full_match(min(p_size::VARCHAR || '|' || {c}::VARCHAR).split('|')[1], '[0-9]+') AS digits, 100.0 * count(*) / (SELECT count(*) FROM part) AS pct FROM ({_unique_sql('part', ['p_size', c])})) WHERE n > 0""" for c in _CHOICES))
def treatment_choice(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    found = [treat.choose(df, ["p_size", c], {"p_size": 0}) for c in _CHOICES]
    return spark.createDataFrame([(c, f.unique_rows, f.treatment) for c, f in zip(_CHOICES, found, strict=True) if f], "colname string, unique_rows long, treatment string")


@query("SELECT p_partkey, regexp_full_match(p_size::VARCHAR, '[0-9]+') AS size_is_digits, regexp_full_match(p_retailprice::VARCHAR, '[0-9]+') AS price_is_digits, try_cast(p_retailprice AS DOUBLE) AS price, try_cast(p_brand AS DOUBLE) AS brand FROM part")
def numeric_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", is_digits(F.col("p_size")).alias("size_is_digits"), is_digits(F.col("p_retailprice")).alias("price_is_digits"), numeric(F.col("p_retailprice")).alias("price"), numeric(F.col("p_brand")).alias("brand"))


# ---------------------------------------------------------------- compartments


_COMPARTMENTS = f"""WITH q AS ({_PART_QIS}), c AS (SELECT unnest({PART!r}) AS a, generate_subscripts({PART!r}, 1) AS i),
x AS (SELECT DISTINCT l.a AS a, r.a AS b FROM q, c l, c r WHERE l.a <> r.a AND list_contains(columns, l.a) AND list_contains(columns, r.a)),
s AS (SELECT m, (SELECT list(a ORDER BY i) FROM c WHERE (m >> (i - 1)) & 1 = 1) AS columns FROM range(1, {2 ** len(PART)}) t(m)),
f AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE list_contains(columns, a) AND list_contains(columns, b)))
SELECT columns FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.m <> f.m AND g.m & f.m = f.m)"""


@query(_COMPARTMENTS)
def compartments_part(spark, sf_dir):
    found = [tuple(r["columns"]) for r in _minimal(spark, sf_dir, "part", PART).collect()]
    return compartments.compartment_table(spark, compartments.compartments(PART, found)).select("columns")


_TWO = [["p_brand", "p_type"], ["p_size"]]


@query("SELECT p_brand, p_type, NULL::INT AS p_size, 0::INT AS compartment_id FROM part UNION ALL SELECT NULL, NULL, p_size, 1::INT FROM part")
def compartment_union(spark, sf_dir):
    return compartments.union(compartments.split(table(spark, sf_dir, "part"), _TWO))


@query(f"WITH q AS ({_PART_QIS}), c AS (SELECT unnest({PART!r}) AS a) SELECT DISTINCT l.a AS src, r.a AS dst FROM q, c l, c r WHERE l.a <> r.a AND list_contains(columns, l.a) AND list_contains(columns, r.a)")
def conflict_edges(spark, sf_dir):
    found = [tuple(r["columns"]) for r in _minimal(spark, sf_dir, "part", PART).collect()]
    return compartments.edges(spark, compartments.conflict_graph(found))


@query(f"SELECT array_to_string(columns, ',') AS compartment, 0::INT AS n_left FROM ({_COMPARTMENTS})")
def compartments_verified(spark, sf_dir):
    df = table(spark, sf_dir, "part", PART)
    outcome = AnonymizationPipeline(spark, Settings(treatment="compartmentation")).run(df, evaluate=True)
    return spark.createDataFrame([(",".join(c), len(left)) for c, left in outcome.left.items()], "compartment string, n_left int")


# ---------------------------------------------------------------- sources and sinks


@query("SELECT p_partkey, p_name, p_size FROM part")
def csv_round_trip(spark, sf_dir):
    df = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"])
    return tables.read_csv(spark, sinks.write_csv(df, scratch(spark, "csv")), df.schema)


@query(f"SELECT columns, len, unique_rows, coverage_pct FROM ({_PART_QIS})")
def saved_search(spark, sf_dir):
    df = table(spark, sf_dir, "part", PART)
    path, settings = scratch(spark, "searches"), Settings()
    for _ in range(2):  # the second one reads what the first one saved
        found = AnonymizationPipeline(spark, settings, path).find(df, {})
    return found.table(spark)


# ---------------------------------------------------------------- scores


def _score_sql(source: str, columns: Sequence[str]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS colname, round(count(*) + sum(CASE WHEN v IS NOT NULL AND c > 1 THEN tanh(1.0 / (c - 1)) ELSE 0 END), 6) AS score FROM (SELECT {c} AS v, count(*) AS c FROM {source} GROUP BY 1)" for i, c in enumerate(columns))


@query(_score_sql("part", PART))
def column_scores(spark, sf_dir):
    return score.column_scores(table(spark, sf_dir, "part", PART)).withColumn("score", F.round("score", 6))


@query(f"SELECT round(sum(score) * {len(LINEITEM)}, 2) AS score FROM ({_score_sql('lineitem', LINEITEM)})")
def quality_score(spark, sf_dir):
    return score.quality_score(table(spark, sf_dir, "lineitem", LINEITEM)).select(F.round("score", 2).alias("score"))


@query(f"SELECT (position + 1)::INT AS n_columns, round(sum(score) OVER (ORDER BY position) * (position + 1), 3) AS score FROM ({_score_sql('part', PART)}) QUALIFY position >= 1")
def score_prefix_sweep(spark, sf_dir):
    return score.score_sweep(table(spark, sf_dir, "part", PART)).select("n_columns", F.round("score", 3).alias("score"))


@query("SELECT round(sum(CASE WHEN p_size <> 0 THEN (p_size - (p_size % 10)) / p_size::DOUBLE END), 6) AS penalty FROM part")
def falsification_penalty(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_size", (F.col("p_size") % 10).alias("new"))
    return score.falsification(df, [("p_size", "new")]).select(F.round("penalty", 6).alias("penalty"))


@query("SELECT sum(strlen(p_name) + strlen(p_brand) + strlen(p_type) + strlen(p_size::VARCHAR) + strlen(p_retailprice::VARCHAR))::BIGINT AS bytes FROM part")
def data_size(spark, sf_dir):
    return score.data_size(table(spark, sf_dir, "part", PART))


# ---------------------------------------------------------------- statistics of quasi-identifiers


@query(f"SELECT c AS colname, count(*) AS n FROM (SELECT unnest(columns) AS c FROM ({_PART_QIS})) GROUP BY 1")
def popularity(spark, sf_dir):
    return analyze.popularity(_minimal(spark, sf_dir, "part", PART))


@query(f"SELECT c AS colname, count(*) AS n FROM (SELECT unnest(columns) AS c FROM ({_PART_QIS})) GROUP BY 1 ORDER BY n DESC, c LIMIT 1")
def most_popular(spark, sf_dir):
    return analyze.most_popular(_minimal(spark, sf_dir, "part", PART))


@query(f"SELECT * FROM ({_PART_QIS}) WHERE list_contains(columns, 'p_size')")
def affected_by_column(spark, sf_dir):
    return analyze.affected_by(_minimal(spark, sf_dir, "part", PART), "p_size")


@query(f"""WITH q AS MATERIALIZED ({_LINEITEM_QIS}), c AS (SELECT unnest({LINEITEM!r}) AS a)
SELECT a AS colname, list_sort(list_append((SELECT coalesce(list(b.a), []) FROM c b WHERE b.a <> c.a AND NOT EXISTS (SELECT 1 FROM q WHERE list_contains(columns, b.a) AND list_contains(columns, c.a))), a)) AS allowed FROM c WHERE len(allowed) > 1""")
def allowed_columns(spark, sf_dir):
    return analyze.allowed_columns(_minimal(spark, sf_dir, "lineitem", LINEITEM), LINEITEM)


_ALLOWED = f"""q AS MATERIALIZED ({_LINEITEM_QIS}), s AS (SELECT c AS colname, count(*) AS occurrence, avg(len) AS mean_length FROM (SELECT unnest(columns) AS c, len FROM q) GROUP BY 1),
n AS (SELECT unnest({LINEITEM!r}) AS a),
a AS (SELECT colname, list_sort(list_append((SELECT coalesce(list(a), []) FROM n WHERE a <> colname AND NOT EXISTS (SELECT 1 FROM q WHERE list_contains(columns, a) AND list_contains(columns, colname))), colname)) AS allowed FROM s),
b AS (SELECT m AS colname, count(*) AS allowed_sets, avg(n) AS mean_allowed_length FROM (SELECT unnest(allowed) AS m, len(allowed) AS n FROM (SELECT DISTINCT allowed FROM a WHERE len(allowed) > 1)) GROUP BY 1)"""


@query(f"WITH {_ALLOWED} SELECT s.*, CASE WHEN len(allowed) > 1 THEN len(allowed) ELSE 0 END::INT AS n_allowed, coalesce(allowed_sets, 0) AS allowed_sets, mean_allowed_length FROM s JOIN a USING (colname) LEFT JOIN b USING (colname)")
def qi_column_statistics(spark, sf_dir):
    return analyze.column_statistics(_minimal(spark, sf_dir, "lineitem", LINEITEM), LINEITEM)


@query("SELECT c AS colname, " + ", ".join(f'count(*) FILTER (len = {n}) AS "{n}_ucc_found"' for n in range(2, len(LINEITEM) + 1)) + f" FROM (SELECT unnest(columns) AS c, len FROM ({_LINEITEM_QIS})) GROUP BY 1")
def qi_found_by_length(spark, sf_dir):
    return analyze.found_by_length(_minimal(spark, sf_dir, "lineitem", LINEITEM), list(range(2, len(LINEITEM) + 1)))


_PART_WEIGHTS = f"WITH e AS (SELECT colname, entropy FROM ({_profile_sql('part', PART)})), q AS ({_PART_QIS}), k AS (SELECT columns, len, unnest(columns) AS colname FROM q), w AS (SELECT columns, len, ceil(round(sum(entropy), 9)) AS weight, ceil(round(avg(entropy), 9)) AS mean_weight FROM k JOIN e USING (colname) GROUP BY ALL)"


@query(f"{_PART_WEIGHTS} SELECT len, count(*) AS n, ceil(avg(weight))::BIGINT AS mean_weight FROM w GROUP BY len")
def qi_length_histogram(spark, sf_dir):
    return analyze.by_length(analyze.weights(_minimal(spark, sf_dir, "part", PART), profile.profile(table(spark, sf_dir, "part", PART))))


@query(f"{_PART_WEIGHTS} SELECT weight::BIGINT AS weight, count(*) AS n FROM w GROUP BY 1")
def qi_weight_histogram(spark, sf_dir):
    return analyze.by_weight(analyze.weights(_minimal(spark, sf_dir, "part", PART), profile.profile(table(spark, sf_dir, "part", PART))))


@query("SELECT r::INT AS len, (factorial(10) / (factorial(r::INT) * factorial(10 - r::INT)))::BIGINT AS n_sets FROM range(1, 11) t(r)")
def lattice_sizes(spark, sf_dir):
    return analyze.lattice_sizes(spark, len(LINEITEM))


@query("SELECT * FROM (VALUES (0::INT, 3::BIGINT, 2.0::DOUBLE, 0.0::DOUBLE), (1::INT, 2::BIGINT, 3.5::DOUBLE, 0.5::DOUBLE)) t(round, n, mean, std)")
def round_statistics(spark, sf_dir):
    return analyze.round_statistics(spark, [[2, 2, 2], [3, 4]])


@query("""SELECT round(max(m), 4) AS mean, round(sqrt(avg((x - m) ** 2)), 4) AS std, round(avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5, 4) AS skewness, round(avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 - 3, 4) AS kurtosis
FROM (SELECT l_extendedprice AS x, avg(l_extendedprice) OVER () AS m FROM lineitem)""")
def column_moments(spark, sf_dir):
    return analyze.moments(table(spark, sf_dir, "lineitem"), "l_extendedprice").select(*[F.round(c, 4).alias(c) for c in ("mean", "std", "skewness", "kurtosis")])


# ---------------------------------------------------------------- l-diversity


@query("""SELECT user_id, sum(c)::BIGINT AS size, count(event_type) AS n_sensitive, max(c) AS most, sum(c) >= 3 AND count(event_type) >= 3 AND max(c) <= sum(c) / 3.0 AS diverse
FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY user_id""")
def l_diversity_check(spark, sf_dir):
    return mondrian.l_diversity(table(spark, sf_dir, "events"), ["user_id"], "event_type", 3)


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL")
def frequency_sets(spark, sf_dir):
    return mondrian.frequencies(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("SELECT p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY ALL")
def distinct_sensitive(spark, sf_dir):
    return mondrian.distinct_sensitive(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS c FROM part GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto, sum(c) OVER (PARTITION BY p_brand) AS total, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS nxt FROM c)
SELECT p_brand, arg_min(p_size, p_size) FILTER (upto >= total // 2) AS split, arg_min_null(nxt, p_size) FILTER (upto >= total // 2) AS next, min(p_size) AS low, max(p_size) AS high FROM w GROUP BY p_brand""")
def weighted_medians(spark, sf_dir):
    return mondrian.medians(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("""WITH w AS (SELECT max(p_size) - min(p_size) AS a, max(p_retailprice) - min(p_retailprice) AS b, count(*) AS n FROM part),
g AS (SELECT p_brand, count(*) AS size, max(p_size) - min(p_size) AS a, max(p_retailprice) - min(p_retailprice) AS b FROM part GROUP BY 1)
SELECT round(sum(g.size * (g.a / w.a + g.b / w.b)) / (2 * max(w.n)) * 100, 6) AS ncp, sum(g.size * g.size)::BIGINT AS dp FROM g, w""")
def certainty_penalties(spark, sf_dir):
    return mondrian.penalties(table(spark, sf_dir, "part"), "p_brand", ["p_size", "p_retailprice"]).select(F.round("ncp", 6).alias("ncp"), "dp")


@query("SELECT count(*) AS n_rows, true AS all_diverse, true AS several FROM part")
def mondrian_properties(spark, sf_dir):
    out = mondrian.mondrian(table(spark, sf_dir, "part", ["p_size", "p_retailprice", "p_type"]), "p_type", 3)
    checked = mondrian.l_diversity(out, ["part_id"], "p_type", 3)
    return checked.agg(F.sum("size").alias("n_rows"), F.bool_and("diverse").alias("all_diverse"), (F.count("*") > 1).alias("several"))


@query()
def kmeans_columns(spark, sf_dir):
    return clusters.kmeans_columns(profile.profile(table(spark, sf_dir, "lineitem", LINEITEM)))


# ---------------------------------------------------------------- jobs

_JOBS = [("B7", ["a", "b"], 1, "t1", "waiting", None), ("A1", ["a", "b"], 1, "t2", "waiting", None), ("C3", ["a"], 2, "t3", "failed", "unknown columns: a"), ("D4", ["a", "b", "c"], 2, "t4", "waiting", None)]


@query("SELECT 'A1' AS job_id, ['a', 'b'] AS columns, 1::INT AS partner_id, 't2' AS table_name, 'waiting' AS status, NULL::VARCHAR AS cause")
def next_job(spark, sf_dir):
    return jobs.next_job(jobs.from_json(jobs.to_json(spark.createDataFrame(_JOBS, jobs.JOB))))
