"""The star-schema test tables seen as event memory: events, links, knowledge files, conversations, traces and stacks."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.numbering import numbered
from ..sinks.scratch import shared_dir
from ..sinks.store import write_files

#: The time that ages are measured to, and what "today" is for scopes.
REFERENCE = "2024-03-15 00:00:00"
TODAY = "2024-01-28"
DANGLING = "evt_00000000_000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reference():
    return F.lit(REFERENCE).cast("timestamp")


def mem_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without ids: no shuffle.  k, the number in ``props``, stands for the strength and the links of an event."""
    e = table(spark, sf_dir, "events")
    k, n = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    kind = F.when(n % 50 == 0, "correction")
    for given, name in (("purchase", "decision"), ("view", "observation"), ("click", "insight"), ("signup", "preference")):
        kind = kind.when(F.col("event_type") == given, name)
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("date").alias("day"), kind.otherwise("error").alias("type"), (F.col("value") / 100).alias("importance"),
        (n % 4 != 0).alias("consolidated"), F.when(n % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.25) + F.lit(0.0075) * k).alias("decay_score"), F.when(k > 0, n - k).alias("assoc_event_id"),
        F.when(n % 7 == 0, F.concat(F.lit("ke_"), F.format_string("%03d", k))).alias("assoc_ke"), "props",
    )


def mem_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``seq`` and ``id``, numbered by day."""
    return numbered(mem_base(spark, sf_dir), ("day",), ("event_id",)).withColumn("id", X.event_id("day", "seq"))


def mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``associations``, ``content``, ``tags`` and the order ``ord``; a link that no event answers is spelled as DANGLING."""
    m = mem_ids(spark, sf_dir)
    other = m.select(F.col("event_id").alias("__to"), F.col("id").alias("__to_id"))
    linked = F.when(F.col("assoc_event_id").isNotNull(), F.coalesce("__to_id", F.lit(DANGLING)))
    df = m.join(other, F.col("assoc_event_id") == F.col("__to"), "left").withColumn("associations", F.filter(F.array(linked, "assoc_ke"), lambda x: x.isNotNull()))
    return df.withColumns({"content": F.col("props"), "tags": F.array(F.col("type")), "ord": F.col("event_id")}).drop("__to", "__to_id")


def know_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, content)``: a knowledge file for each document, with a title, a description and one entry that holds the whole text."""
    d, three = F.col("doc_id"), lambda c: F.format_string("%03d", c)
    word = F.when(d % 6 == 0, "high").when(d % 6 == 1, "medium").when(d % 6 == 2, "low").when(d % 6 == 3, F.concat(F.lit("0."), (d % 10).cast("string"))).when(d % 6 == 4, "High").otherwise("1.2.3")
    body = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n> Notes for "), F.col("source"), F.lit("\n<!-- knowledge_entry: ke_"), three(d), F.lit(" -->\n## Entry "), d.cast("string"), F.lit("\n"),
        F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n**Confidence**: "), word, F.lit("\n**Associations**: ke_"), three((d * 7 + 3) % 100), F.lit(", evt_20240101_"), three(d % 20 + 1),
        F.lit(" [ke_001]\n<!-- /knowledge_entry -->"),
    )
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), d.cast("string"), F.lit(".md")).alias("file"), body.alias("content"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "prompt").when(F.col("event_type") == "signup", "mem").otherwise("tool")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"))


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(workspace, current_path, current_focus, pending_siblings)`` of each customer that has orders, by their status."""
    of = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))), lambda k: k.cast("string"))
    focus = F.coalesce(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).cast("string"), F.lit("None"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("workspace")).agg(of("F").alias("current_path"), focus.alias("current_focus"), of("O").alias("pending_siblings"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions on the focus queue of their user."""
    name = F.when(F.col("event_type") == "signup", "plan").when(F.col("event_type") == "view", "push").when(F.col("event_type") == "click", "complete").when(F.col("event_type") == "purchase", "overflow").otherwise("scratchpad_refill")
    n = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("workspace"), F.col("event_id").alias("seq"), name.alias("action"), F.concat(F.lit("goal "), n).alias("goal"), F.concat(F.lit("focus "), n).alias("focus"),
        F.array(F.concat(F.lit("a"), n), F.concat(F.lit("b"), n)).alias("siblings"),
    )


def new_workspace(spark: SparkSession) -> str:
    """A folder for a workspace below the shared one, which has to be a mounted file system; it goes when the application ends."""
    scheme, _, path = shared_dir(spark).rpartition("://")
    if scheme not in ("", "file"):
        raise ValueError("a workspace lies on a mounted file system")
    at = f"{path.removeprefix('file:')}/palimpsest/workspace-{uuid.uuid4().hex}"
    os.makedirs(at)
    atexit.register(shutil.rmtree, at, True)
    return at


def event_files(spark: SparkSession, sf_dir: str, folder: str, broken: bool = False) -> int:
    """All events as JSONL, a file for each day.  broken: with blank lines, and lines that aren't JSON on every seventh day of a month."""
    m = mem(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    event = F.to_json(F.struct("id", stamp, "type", "content", "tags", "importance", "associations", "consolidated", "decay_score", F.col("event_id").alias("more")))
    lines = m.select(F.concat(F.col("day").cast("string"), F.lit(".jsonl")).alias("file"), "event_id", F.dayofmonth("day").alias("d"), event.alias("line"))
    extra = F.array(F.struct(F.lit(0).alias("k"), F.col("line").alias("line")))
    if broken:
        blank = F.when(F.col("event_id") % 10 == 0, F.struct(F.lit(1).alias("k"), F.lit("  ").alias("line")))
        bad = F.when((F.col("event_id") % 50 == 0) & (F.col("d") % 7 == 0), F.struct(F.lit(2).alias("k"), F.lit("{bad").alias("line")))
        extra = F.array_compact(F.concat(extra, F.array(blank, bad)))
    return write_files(lines.select("file", "event_id", F.explode(extra).alias("x")).select("file", F.struct("event_id", "x.k").alias("ord"), "x.line"), Path(folder))
