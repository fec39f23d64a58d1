"""Consolidation: age, decay and archive events in one pass over the days in scope."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import SCOPES, Config


def in_scope(events: DataFrame, scope: str, today: date, day: str = "day") -> DataFrame:
    """session: the day of today; day: from a week before today on, later days too; full: all.  A filter on the partition column."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    if scope == "session":
        return events.where(F.col(day) == F.lit(today))
    return events.where(F.col(day) >= F.lit(today - timedelta(days=7))) if scope == "day" else events


def classify(events: DataFrame, reference: Column, config: Config = Config(), ts: str = "ts") -> DataFrame:
    """Add ``age``, ``computed_score`` and ``action``.

    unconsolidated events aren't touched, nor those of age 0 or without a usable time (``kept``); others decay, to ``archived``
    if the new score is under the threshold, else ``decayed`` if it differs from the old, else ``kept``.  Without a score there
    is nothing to decay: kept.
    """
    age = X.age_in_days(ts, reference)
    df = events.withColumn("age", age).withColumn("computed_score", X.apply_decay("decay_score", "age", config.half_life_days))
    ages = F.coalesce(F.col("age") > 0, F.lit(False)) & F.col("decay_score").isNotNull()
    action = (
        F.when(X.is_unconsolidated(), "unconsolidated")
        .when(~ages, "kept")
        .when(F.col("computed_score") < config.archive_threshold, "archived")
        .when(~F.col("computed_score").eqNullSafe(F.col("decay_score")), "decayed")
        .otherwise("kept")
    )
    return df.withColumn("action", action)


def kept(classified: DataFrame) -> DataFrame:
    """What stays, with its new score."""
    score = F.when(F.col("action") == "decayed", F.col("computed_score")).otherwise(F.col("decay_score"))
    return classified.where("action <> 'archived'").withColumn("decay_score", score)


def archived(classified: DataFrame) -> DataFrame:
    """What goes to the archive, with the score it had."""
    return classified.where("action = 'archived'")


def report(classified: DataFrame, *by: str) -> DataFrame:
    """Counts over all events, or by the given columns; one pass with partial aggregation."""
    return classified.groupBy(*by).agg(
        F.count("*").alias("events_scanned"),
        F.count_if(F.col("action") == "unconsolidated").alias("unconsolidated"),
        F.count_if(F.col("action") == "decayed").alias("decayed"),
        F.count_if(F.col("action") == "archived").alias("archived"),
    )


#: The lines of a report.
REPORT = """Consolidation {run}complete:
  Scope: {scope}
  Events scanned: {events_scanned}
  Unconsolidated (need LLM distillation): {unconsolidated}
  Decay applied: {decayed}
  Archived (score < {threshold:g}): {archived}
  MEMORY_INDEX.md: {chars} chars ({state})"""


def render_report(counts: dict, scope: str, index_chars: int, dry_run: bool, config: Config = Config()) -> str:
    run, state = ("(DRY RUN) ", "preview") if dry_run else ("", "regenerated")
    text = REPORT.format(run=run, scope=scope, threshold=config.archive_threshold, chars=index_chars, state=state, **counts)
    if counts["unconsolidated"]:
        text += f"\n\n{counts['unconsolidated']} events wait to be distilled into knowledge files and marked as consolidated."
    if index_chars > config.index_max_chars:
        text += f"\n\nThe index is over its target of {config.index_max_chars} chars: merge knowledge files or archive old entries."
    return text
