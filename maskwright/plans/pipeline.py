"""The whole run: profile, search, treat, partition, measure, verify."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from maskwright.config import Settings
from maskwright.operators import compartments as parts_of
from maskwright.operators.analyze import popularity_ranks
from maskwright.operators.profile import drop_empty_columns, first_class_identifiers, prefix, profile
from maskwright.operators.score import data_size, quality_score
from maskwright.operators.search import SearchResult, search, verify
from maskwright.operators.treat import Choice, apply, choose
from maskwright.plans.lattice import saved_pct
from maskwright.session import scratch
from maskwright.sources.sinks import save_search
from maskwright.sources.tables import fingerprint, saved_search


@dataclass
class Outcome:
    table: DataFrame
    dropped: list[str]
    search: SearchResult | None
    choices: list[Choice] = field(default_factory=list)
    outstanding: list[tuple[str, ...]] = field(default_factory=list)
    compartments: list[list[str]] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)
    left: dict[tuple[str, ...], list[tuple[str, ...]]] = field(default_factory=dict)
    #: Columns beyond ``max_columns``, if that is set.
    cut: list[str] = field(default_factory=list)

    def tables(self) -> list[DataFrame]:
        return parts_of.split(self.table, self.compartments)


class AnonymizationPipeline:
    """``run`` takes a table through all steps; every step is also usable on its own."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings(), cache: str | None = None):
        self.spark, self.settings, self.cache = spark, settings, cache

    def prepare(self, df: DataFrame) -> tuple[DataFrame, list[str], dict[str, float]]:
        """Without empty columns and first-class identifiers, those, and the entropies of the rest."""
        df = drop_empty_columns(prefix(df, self.settings.max_columns))
        profiled = profile(df).cache()
        dropped = [r["colname"] for r in first_class_identifiers(profiled, self.settings).orderBy("position").collect()]
        entropies = {r["colname"]: r["entropy"] for r in profiled.collect()}
        profiled.unpersist()
        return df.drop(*dropped), dropped, entropies

    def find(self, df: DataFrame, entropies: dict[str, float]) -> SearchResult:
        if not self.cache:
            return search(df, self.settings, entropies)
        key = fingerprint(df, df.count(), self.settings)
        saved = saved_search(self.spark, self.cache, key)
        if saved is None:
            result = search(df, self.settings, entropies)
            save_search(self.spark, self.cache, key, result.table(self.spark))
            return result
        spot = {c: i for i, c in enumerate(df.columns)}
        return SearchResult(list(df.columns), df.count(), {sum(1 << spot[c] for c in columns): n for columns, n in saved})

    def treat(self, df: DataFrame, result: SearchResult) -> tuple[DataFrame, list[Choice], list[tuple[str, ...]], int]:
        """Each quasi-identifier in turn, in the table as the ones before left it; those to be compartmented are outstanding."""
        ranks = popularity_ranks(result.sets, result.names)
        choices, outstanding, changed = [], [], 0
        for qi in result.sets:
            choice = choose(df, qi, ranks, self.settings)
            if choice is None:
                continue
            choices.append(choice)
            if choice.treatment == "compartmentation":
                outstanding.append(tuple(qi))
                continue
            df, n = apply(df, choice, self.settings)
            changed += n
            if len(choices) % self.settings.checkpoint_every == 0:
                df = self._cut(df)
        return df, choices, outstanding, changed

    def _cut(self, df: DataFrame) -> DataFrame:
        """Plans would grow with every treatment; checkpoint() goes to the shared folder."""
        scratch(self.spark, "")  # sets the folder, if none is set
        return df.checkpoint()

    def run(self, df: DataFrame, treat: bool = True, score: bool = False, size: bool = False, evaluate: bool = False) -> Outcome:
        began = time.time()
        ready, dropped, entropies = self.prepare(df)
        outcome = Outcome(ready, dropped, None, compartments=[list(ready.columns)] if ready.columns else [], cut=df.columns[self.settings.max_columns :] if self.settings.max_columns else [])
        if len(ready.columns) >= 2:
            outcome.search = self.find(ready, entropies)
            outcome.metrics |= {"search_seconds": time.time() - began, "quasi_identifiers": len(outcome.search.found), "evaluated": outcome.search.evaluated, "saved_pct": saved_pct(outcome.search.evaluated, outcome.search.total)}
            if treat:
                began, changed, result = time.time(), 0, outcome.search
                for number in range(self.settings.rounds):
                    if number:
                        result = search(outcome.table, self.settings)
                    outcome.table, choices, outstanding, n = self.treat(outcome.table, result)
                    outcome.choices += choices
                    outcome.outstanding += [q for q in outstanding if q not in outcome.outstanding]
                    changed += n
                    if not any(c.treatment != "compartmentation" for c in choices):
                        break
                outcome.compartments = parts_of.compartments(ready.columns, outcome.outstanding, self.settings.drop_isolated)
                outcome.metrics |= {"treatment_seconds": time.time() - began, "changed_values": changed, "compartments": len(outcome.compartments)}
        if score:
            outcome.metrics["score"] = sum(quality_score(t).first()["score"] for t in outcome.tables())
        if size:
            outcome.metrics["bytes"] = sum(data_size(t).first()["bytes"] for t in outcome.tables())
        if evaluate and outcome.search is not None:
            outcome.left = verify(outcome.table, outcome.compartments, self.settings)
        return outcome
