"""The whole run: read, profile, map, assist, clean and merge, find duplicates and conflicts, validate, summarise.

One plan from sources to records; the driver stops once, after mapping, as the mappings (a row a column) decide which
columns the scan reads.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.config import FULL_NAME, Config
from tributary.functions.cut import cut, kept
from tributary.operators import decisions, duplicates, escalations, mapping, merge, profile, trail
from tributary.sources.delimited import usable

STEPS = ("ingest", "profile", "map", "ai_assist", "transform", "reconcile", "validate", "summarize")


@dataclass(frozen=True)
class Result:
    profiles: DataFrame
    mappings: DataFrame
    records: DataFrame
    pairs: DataFrame
    escalations: DataFrame
    rules: DataFrame
    config: Config
    audit: DataFrame | None = None  # of the run's steps
    events: DataFrame | None = None

    @property
    def status(self) -> str:
        return "ready_to_push" if self.escalations.filter("status = 'open'").isEmpty() else "awaiting_human"

    def counts(self) -> dict[str, int]:
        """In one pass over each table."""
        m = self.mappings.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("auto", "escalated", "ignored")]).first()
        r = self.records.agg(F.count(F.lit(1)).alias("people"), F.sum("n_transforms").alias("transforms"), F.count_if(F.size("flags") == 0).alias("clean")).first()
        e = self.escalations.agg(F.count_if(F.col("status") == "open").alias("open")).first()
        s = self.profiles.groupBy("file_ord").agg(F.max("rows").alias("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("source_rows")).first()
        return {**s.asDict(), **m.asDict(), **r.asDict(), **e.asDict()}

    def decided(self, choices: DataFrame) -> Result:
        """After decisions(escalation_id, choice, reject, at)."""
        return self.after(cut(decisions.resolve(self.escalations, choices, self.records), "decisions"))

    def after(self, done: DataFrame) -> Result:
        """After decisions that count."""
        return replace(
            self,
            records=cut(decisions.apply(self.records, done, self.config), "records"),
            mappings=cut(decisions.set_mappings(self.mappings, done), "mappings"),
            escalations=cut(decisions.close(self.escalations, done), "escalations"),
            rules=self.rules.unionByName(decisions.human_rules(done)),
        )


def run(sources: list[tuple[str, DataFrame]], config: Config | None = None, helper: Callable[[DataFrame, DataFrame], DataFrame] | None = None, folder: str | None = None, at: int | None = None) -> Result:
    """sources: (file name, frame of string columns with row_idx), in order; files without rows are left out. at: the time
    that the run's events and audit rows tell, in milliseconds; now if it is left out.

    With a folder every step's table stays there: a run that was stopped goes on behind its last whole step.
    """
    config = config or Config()
    alive = usable([df for _, df in sources])
    sources = [(name, df) for name, df in sources if any(df is x for x in alive)]
    step = (lambda df, name: kept(df, f"{folder.rstrip('/')}/{name}")) if folder else cut
    cells = None
    for i, (name, df) in enumerate(sources):
        one = profile.long_cells(df, i, name)
        cells = one if cells is None else cells.unionByName(one)
    profiles = step(profile.profile_columns(cells, config.policy.samples), "profiles")
    proposed = mapping.propose(profiles, config)
    mappings = step(mapping.assist(proposed, profiles, helper, config), "mappings")
    rows = mappings.collect()  # one row a source column
    assisted = None if helper is None else sum(r["status"] == "auto" for r in rows) - proposed.filter("status = 'auto'").count()
    mappings = mappings.sparkSession.createDataFrame(rows, mappings.schema)
    records = step(merge_mapped(sources, rows, config), "records")
    pairs = step(duplicates.record_pairs(records), "pairs")
    found = step(escalations.numbered(
        escalations.duplicates(pairs),
        escalations.conflicts(records, config),
        escalations.value_issues(records, config),
        escalations.validate(records, escalations.skip_set(pairs), config),
        escalations.of_mappings(mappings),
        escalations.required_without_source(mappings, config),
    ), "escalations")
    audit, events = trail.of_run(profiles, mappings, records, found, int(time.time() * 1000) if at is None else at, assisted)
    return Result(profiles, mappings, records, pairs, found, step(escalations.delta_rules(cells, config), "rules"), config, audit, events)


def merge_mapped(sources: list[tuple[str, DataFrame]], mappings: list, config: Config) -> DataFrame:
    """Records of sources by their mappings. Escalated and ignored columns wait, but for a whole name."""
    used: dict[int, list[tuple[int, str, str]]] = {}
    for m in mappings:
        if m["target"] is not None and m["status"] != "ignored" and (m["status"] != "escalated" or m["target"] == FULL_NAME):
            used.setdefault(m["file_ord"], []).append((m["col_ord"], m["header"], m["target"]))
    parts = [merge.Source(df, i, name, tuple((h, t) for _, h, t in sorted(used.get(i, [])))) for i, (name, df) in enumerate(sources)]
    return merge.merge_sources(parts, config)
