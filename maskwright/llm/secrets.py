"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Each kind is a regular expression whose matches are found in every whole text;
positions come from the lengths of the pieces between matches.  The values of
all matches are counted over the corpus: by owners (``source``) and
repositories (an owner's distinct texts, so that a copied file counts once).
A value with at least ``OWNERS`` owners and ``REPOSITORIES`` repositories is a
widely copied example; any other is a live-looking credential of its owner.

Defined cases: null text counts as empty; a null source is an owner of its own;
repeated ids get the sums of their rows for ``n_live`` and ``n_example``; a null
id gets zeros there, but is masked like any other; very long texts are searched
whole; empty tables give empty results; extra columns aren't read, whatever
their names (``redact`` returns them untouched).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.scalars import unused
from maskwright.llm.common import ensure_checkpoint_dir

OWNERS, REPOSITORIES = 3, 5
MASK = "[SECRET]"
#: Matches that are placed in one fold.
RUN = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # group 1: what is kept in redaction, group 2: the value
    least: int  # characters of the value
    base: bool = True


#: The base kinds, in their order.
KINDS = [
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 12),
    Kind("access", r"()(AKIA[A-Z0-9]+)", 18),
    Kind("hex", r"()([0-9a-f]+)", 16),
    # added by this method
    Kind("vendor", r"()(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, False),
    Kind("url", r"(://[A-Za-z0-9._~%-]+:)([^\s/:@'\"]{4,}(?=@))", 4, False),
    # a private key's body, up to its END line; a key without one: its lines of at least 40 characters
    Kind("key", r"""(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)([^-]*+(?:-(?!----)[^-]*+){0,64}+(?=-----END [A-Z ]{0,20}PRIVATE KEY-----)|(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{40,}+){0,500}+)""", 1, False),
]
#: Quick tests; a text that fails has no match that counts.
_TESTS = {
    "assign": lambda t: t.rlike(r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}"),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike("[0-9a-f]{16}"),
    "vendor": lambda t: t.rlike("gh[pousr]_|xox[abprs]-|k_live_|AIza|eyJ"),
    "url": lambda t: t.contains("://"),
    "key": lambda t: t.contains("PRIVATE KEY-----"),
}


def _spans(text: Column, kind: Kind, order: int) -> Column:
    """array<struct<start, place, stop, kind, value>> of one kind."""
    pattern = F.lit(kind.pattern)
    found = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("value"))
    empty = F.array().cast("array<struct<start:int,place:int,stop:int,kind:string,value:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        kept = x["value"].isNotNull() & (F.length(x["value"]) >= kind.least)
        span = F.struct(start.alias("start"), F.lit(order).alias("place"), stop.alias("stop"), F.lit(kind.name).alias("kind"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.when(kept, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def run(state: Column, part: Column) -> Column:
        """A run of matches; a fold copies what it has gathered at every match, so it gathers few at a time."""
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), empty.alias("spans")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(state["runs"], F.array(x["spans"])).alias("runs")))[0]

    def placed(found: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda i: F.slice(found, i * RUN + 1, F.lit(RUN)))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array(empty).alias("runs")), run, lambda s: F.flatten(s["runs"]))

    folded = F.transform(F.array(found), placed)[0]  # bound, so that the matches are found once
    return F.when(_TESTS[kind.name](text), folded).otherwise(empty)


def find_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, owner, repository, spans) of every row; spans ordered by start, then kind."""
    rows = docs.select(docs[id_column].alias("doc_id"), docs[source_column].alias("owner"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    spans = F.concat(*[_spans(F.col("text"), kind, i) for i, kind in enumerate(KINDS)])
    return rows.select("doc_id", "owner", F.xxhash64("text").alias("repository"), F.array_sort(spans).alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories) of every value in the corpus."""
    values = spans.select("owner", "repository", F.explode("spans").alias("s")).select("owner", "repository", F.sha2(F.col("s.value"), 256).alias("value_hash")).distinct()
    each = values.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return each.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def _is_example() -> Column:
    return (F.col("n_owners") >= OWNERS) & (F.col("n_repositories") >= REPOSITORIES)


def classified(spans: DataFrame) -> DataFrame:
    """(doc_id, value_hash, n, example): values of each document and how often they occur there."""
    own = spans.select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id", F.sha2(F.col("s.value"), 256).alias("value_hash")).agg(F.count("*").alias("n"))
    return own.join(ownership(spans), "value_hash").select("doc_id", "value_hash", "n", _is_example().alias("example"))


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _mended(kind: Kind, text: Column, live: str) -> Column:
    """The text with the values of one kind masked whose hashes the column ``live`` lists."""
    pattern = F.lit(kind.pattern)
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(1)).alias("key"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("value"))

    def mend(x: Column) -> Column:
        hit = (F.length(x["value"]) >= kind.least) & F.array_contains(live, F.sha2(x["value"], 256))
        return F.concat(x["gap"], F.coalesce(x["key"], F.lit("")), F.when(hit, F.lit(MASK)).otherwise(F.coalesce(x["value"], F.lit(""))))

    return F.when(F.col(live).isNotNull() & _TESTS[kind.name](text), F.array_join(F.transform(parts, mend), "")).otherwise(text)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    spans = find_spans(docs, id_column, text_column, source_column).checkpoint()
    counts = classified(spans).groupBy("doc_id").agg(F.sum(F.when(F.col("example"), 0).otherwise(F.col("n"))).alias("live"), F.sum(F.when(F.col("example"), F.col("n")).otherwise(0)).alias("example"))
    counts = counts.withColumnRenamed("doc_id", "own")  # all names here are this module's
    base = [kind for kind in KINDS if kind.base]
    digests = spans.select(
        "doc_id",
        *[_count(k.name) for k in base],
        F.sha2(_listing(F.filter("spans", lambda s: s["place"] < len(base))), 256).alias("base_sha256"),
        _listing(F.col("spans")).alias("spans"),
    )
    joined = digests.join(counts, F.col("doc_id") == F.col("own"), "left")
    return joined.select(*digests.columns, F.coalesce("live", F.lit(0)).alias("n_live"), F.coalesce("example", F.lit(0)).alias("n_example"))


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """All rows and columns; live-looking values in the text become ``MASK``, examples stay."""
    ensure_checkpoint_dir(docs.sparkSession)
    live, own = unused(docs, 2)
    spans = find_spans(docs, id_column, text_column, source_column).where("size(spans) > 0").checkpoint()
    values = classified(spans).where("not example").groupBy("doc_id").agg(F.collect_set("value_hash").alias(live)).withColumnRenamed("doc_id", own)
    joined = docs.join(values, docs[id_column].eqNullSafe(values[own]), "left")
    for kind in sorted(KINDS, key=lambda k: k.name != "key"):  # keys first: other kinds may match within them
        joined = joined.withColumn(text_column, _mended(kind, F.col(f"`{text_column}`"), live))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The twin's kinds: DuckDB's engine has no possessive repeats, so that it knows a private key by its header line only and differs where there is one.
_TWINS = [Kind("vendor", f"{k.pattern[:-1]}|-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----)", k.least, k.base) if k.name == "vendor" else k for k in KINDS if k.name != "key"]


def _kind_sql(kind: Kind, order: int) -> str:
    pattern = kind.pattern.replace("'", "''").replace("(?=@)", "")
    # DuckDB's engine has no lookahead: there the match includes the @, which is cut off
    tail = 1 if "(?=@)" in kind.pattern else 0
    pattern += "@" if tail else ""
    return f"""SELECT k, {order} AS place, '{kind.name}' AS kind,
  list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[:i-1], lambda x: length(x))), 0) AS start, length(w[i]) - {tail} AS n, v[i] AS value
FROM (SELECT k, unnest(range(1, len(w) + 1)) AS i, g, w, v FROM (SELECT k, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', 2) AS v FROM d) WHERE len(w) > 0)
WHERE length(v[i]) >= {kind.least}"""


SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED ({' UNION ALL '.join(_kind_sql(k, i) for i, k in enumerate(_TWINS))}),
u AS (SELECT DISTINCT value, coalesce(source, '\x01null') AS o, t FROM s JOIN d USING (k)),
f AS (SELECT value, count(DISTINCT o) >= {OWNERS} AND count(*) >= {REPOSITORIES} AS example FROM u GROUP BY value),
c AS (SELECT doc_id, count(*) FILTER (NOT example) AS live, count(*) FILTER (example) AS example FROM s JOIN f USING (value) JOIN d USING (k) GROUP BY doc_id),
a AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', start::BIGINT, ':', (start + n)::BIGINT), ',' ORDER BY start, place) FILTER (place < 3) AS base,
  string_agg(concat(kind, ':', start::BIGINT, ':', (start + n)::BIGINT), ',' ORDER BY start, place) AS every
  FROM s GROUP BY k)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans,
  coalesce(live, 0) AS n_live, coalesce(c.example, 0) AS n_example
FROM d LEFT JOIN a USING (k) LEFT JOIN c ON c.doc_id = d.doc_id
"""
