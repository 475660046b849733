"""Command line: ``python -m maskwright TABLE [options]``."""

from __future__ import annotations

import argparse
import uuid

from maskwright.config import TREATMENTS, Settings
from maskwright.operators.analyze import analyze
from maskwright.operators.profile import profile
from maskwright.plans.pipeline import AnonymizationPipeline
from maskwright.session import session
from maskwright.sources import sinks, tables


def parser() -> argparse.ArgumentParser:
    yes_no = {"choices": ("yes", "no")}
    p = argparse.ArgumentParser(prog="maskwright", description="Find and treat re-identification risk in a table.")
    p.add_argument("table", help="a CSV (.csv, .csv.gz) or Parquet table")
    p.add_argument("-o", "--output", default=None, help="folder for results")
    p.add_argument("-n", "--ncol", type=int, default=0, help="number of columns (0: all)")
    p.add_argument("--exact", default="no", **yes_no, help="count every column set")
    p.add_argument("--strategy", default=None, choices=("exact", "minimal", "heuristic", "sampled", "drawn", "clustered"))
    p.add_argument("--treat", default="yes", **yes_no)
    p.add_argument("--evaltreat", default="yes", **yes_no, help="search the result again")
    p.add_argument("--treatment", default="no", choices=("no", *TREATMENTS), help="force one treatment")
    p.add_argument("--analyze", default="no", **yes_no)
    p.add_argument("--score", default="no", **yes_no)
    p.add_argument("--size", default="no", **yes_no)
    p.add_argument("--cache", default="yes", **yes_no, help="keep searches below the output folder")
    p.add_argument("--max-rows", type=int, default=0, help="number of rows (0: all)")
    return p


def main(argv: list[str] | None = None) -> dict[str, float]:
    a = parser().parse_args(argv)
    spark = session()
    settings = Settings(max_rows=a.max_rows, max_columns=a.ncol, strategy=a.strategy or ("exact" if a.exact == "yes" else "minimal"), treatment=None if a.treatment == "no" else a.treatment)
    df = spark.read.parquet(a.table) if ".parquet" in a.table else tables.read_csv(spark, a.table)
    df = df.limit(a.max_rows) if a.max_rows else df
    cache = f"{a.output}/cache" if a.output and a.cache == "yes" else None
    outcome = AnonymizationPipeline(spark, settings, cache).run(df, treat=a.treat == "yes", score=a.score == "yes", size=a.size == "yes", evaluate=a.evaltreat == "yes")
    print({"dropped": outcome.dropped, "cut": outcome.cut, "compartments": outcome.compartments, "left": {k: v for k, v in outcome.left.items() if v}} | outcome.metrics)
    if a.output:
        sinks.write_compartments(outcome.table, outcome.compartments, f"{a.output}/tables")
        sinks.append_metrics(spark, f"{a.output}/metrics", uuid.uuid4().hex, outcome.metrics, a.ncol, settings.treatment)
        if outcome.search is not None:
            found = outcome.search.table(spark)
            sinks.write_json(found, f"{a.output}/quasi_identifiers")
            if a.analyze == "yes":
                for name, report in analyze(found, profile(df.select(*outcome.search.names))).items():
                    (sinks.write_statistics if name in ("columns", "by_length_of_column") else sinks.write_json)(report, f"{a.output}/reports/{name}")
    return outcome.metrics


if __name__ == "__main__":
    main()
