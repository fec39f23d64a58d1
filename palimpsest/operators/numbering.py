"""Running numbers without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.scratch import saved


def numbered(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], name: str = "seq") -> DataFrame:
    """``df`` with ``name``: the place of each row in its group, from 1, in the given order (which has to tell rows apart).

    Rows are dealt out by ranges of (group, order), so that a group of any size is spread over tasks; each task numbers what it
    has, and what lies before it in a group is the sum over the few counts by (group, task).  Without ``by`` all is one group.
    The numbered rows are written once, since numbers by place don't stand a second run of the plan.
    """
    spread = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    rows = saved(spread, "numbered")
    counts = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each (group, task)
    starts = counts.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__part").alias("__of"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__by_{c}")), by, F.col("__part") == F.col("__of"))
    return rows.join(starts, same).withColumn(name, F.col("__place") + F.col("__shift") + 1).select(*df.columns, name)


def running_counts(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], counts: dict[str, Column]) -> DataFrame:
    """``df`` with how many rows of the group, up to and with each row, meet the given conditions.

    As in :func:`numbered`, a group of any size is spread over tasks by ranges; each part counts for itself, and what lies before it is
    a sum over a row for each (group, part).
    """
    spread = df.repartitionByRange(*by, *order).withColumns({"__part": F.spark_partition_id(), **{f"__c_{k}": c.cast("long") for k, c in counts.items()}})
    rows = saved(spread, "running")
    within = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *(F.coalesce(F.sum(f"__c_{k}").over(within), F.lit(0)).alias(f"__r_{k}") for k in counts))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each (group, part)
    parts = rows.groupBy(*by, "__part").agg(*(F.sum(f"__c_{k}").alias(f"__s_{k}") for k in counts))
    starts = parts.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__part").alias("__of"), *(F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in counts))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__by_{c}")), by, F.col("__part") == F.col("__of"))
    return inside.join(starts, same).select(*df.columns, *((F.col(f"__r_{k}") + F.col(f"__b_{k}")).alias(k) for k in counts))
