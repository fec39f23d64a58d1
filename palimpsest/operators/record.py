"""Recording: ids by day, the daily log, and conversations that are worth an event of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sinks.scratch import saved
from .numbering import numbered

#: What an automatic record is given.
AUTO_TYPE, AUTO_IMPORTANCE, AUTO_TAG, AUTO_CHARS = "insight", 0.6, "auto-recorded", 500


def next_sequence(lines: DataFrame, day: str = "day") -> DataFrame:
    """``(day, next_seq)``: one more than the lines a day has, those in between that are blank included."""
    return lines.groupBy(day).agg((F.count("*") + 1).cast("long").alias("next_seq"))


def next_in_files(spark: SparkSession, folder) -> DataFrame:
    """``(file, next_seq)`` for each event file that has a line: one more than its lines up to the last that isn't blank."""
    lines = spark.read.text(f"{folder}/*.jsonl").select(F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos")).alias("at"), "value")
    lines = saved(lines.select("file", "at", (X.trimmed("value") != "").alias("said")), "lines")
    last = lines.where("said").groupBy("file").agg(F.max("at").alias("last"))
    return next_sequence(lines.join(last, "file").where(F.col("at") <= F.col("last")), "file")


def assign_ids(new: DataFrame, existing: DataFrame | None = None, day: str = "day", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Add ``seq`` and ``id``: numbers go on where each day of ``existing`` ends, in the given order, which has to tell rows apart."""
    df = numbered(new, (day,), order, "seq")
    if existing is not None:
        base = existing.groupBy(F.col(day).alias("__day")).agg(F.count("*").alias("__n"))
        df = df.join(base, F.col(day) == F.col("__day"), "left").withColumn("seq", F.col("seq") + F.coalesce("__n", F.lit(0))).drop("__day", "__n")
    return df.withColumn("id", X.event_id(day, "seq"))


def new_events(inputs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Events from ``(ts, type, content[, tags, importance, associations])`` with defaults for what isn't given."""
    has = set(inputs.columns)
    given = lambda c, default: F.coalesce(F.col(c), default) if c in has else default
    none = F.array().cast("array<string>")
    df = inputs.select(
        "ts", F.col("ts").cast("date").alias("day"), "type", "content", given("tags", none).alias("tags"), given("importance", F.lit(0.5)).cast("double").alias("importance"), given("associations", none).alias("associations")
    )
    df = assign_ids(df, existing)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.select("id", stamp.alias("timestamp"), "type", "content", "tags", "importance", "associations", F.lit(False).alias("consolidated"), F.lit(1.0).alias("decay_score"), "day", "ts")


def plain_number(x: Column, decimals: int = 4) -> Column:
    """A double as people write it: up to so many decimals, none that are zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{decimals}f", x), "0+$", ""), r"\.$", "")


def log_entry() -> Column:
    """The text that the daily log has for an event: a head, the content, tags, id and links."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", "), F.lit(" | "))).otherwise(F.lit(""))
    links = F.when(F.size("associations") > 0, F.concat(F.lit(" | Assoc: "), F.array_join("associations", ", "))).otherwise(F.lit(""))
    head = F.concat(F.lit("### "), F.date_format("ts", "HH:mm"), F.lit(" — "), F.col("type"), F.lit(" [importance: "), plain_number(F.col("importance")), F.lit("]"))
    return F.concat_ws("\n", head, "content", F.concat(tags, F.lit("ID: "), F.col("id"), links), F.lit(""))


def last_turns(turns: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """``(session, last_user, last_assistant, n_user, n_assistant, new_session)``, one pass with partial aggregation."""
    of = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col(order)))
    n = lambda role: F.count_if(F.col("role") == role)
    df = turns.groupBy(session).agg(of("user").alias("last_user"), of("assistant").alias("last_assistant"), n("user").alias("n_user"), n("assistant").alias("n_assistant"))
    return df.withColumn("new_session", (F.col("n_user") <= 1) & (F.col("n_assistant") == 0))


def auto_records(turns: DataFrame, words: tuple[str, ...] = X.TRIGGERS, session: str = "session_id", order: str = "seq") -> DataFrame:
    """``(session, type, content, importance, tags)`` for sessions whose last messages have one of the words.

    The whole messages are looked through; their first 500 characters each are recorded.
    """
    last = last_turns(turns, session, order).where(F.col("n_user") + F.col("n_assistant") > 0)
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, AUTO_CHARS)
    hit = last.where(X.has_trigger(F.col("last_user"), F.col("last_assistant"), words))
    content = F.concat(F.lit("User: "), cut("last_user"), F.lit("\nAsst: "), cut("last_assistant"))
    return hit.select(session, F.lit(AUTO_TYPE).alias("type"), content.alias("content"), F.lit(AUTO_IMPORTANCE).alias("importance"), F.array(F.lit(AUTO_TAG)).alias("tags"))
