"""The pulse of sessions: tool calls since memory was last used, and a notice when they become too many.

A memory tool sets the count to 0, any other tool adds 1.  A prompt of a session that isn't new emits a notice with the count if
it is at least the limit, and sets it to 0.  The reset depends on the count itself, so this is a fold, not a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.numbering import running_counts

LIMIT = 5
KINDS = ("tool", "mem", "prompt")


def kind_of_tool(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")).startswith("memory_"), F.lit("mem")).otherwise(F.lit("tool"))


def _counted(trace: DataFrame) -> DataFrame:
    if "new_session" not in trace.columns:
        trace = trace.withColumn("new_session", F.lit(False))
    return running_counts(trace.where(F.col("kind").isin(*KINDS)), ("session_id",), ("seq",), {"stretch": F.col("kind") == "mem", "tools": F.col("kind") == "tool"})


def session_ticks(trace: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(session_id, ticks)``: the count of each session at the end of a trace, as the keyed state of the stream has it."""
    counted = _counted(trace)
    last = counted.join(notices(trace, limit).select("session_id", "seq", F.lit(True).alias("fired")), ["session_id", "seq"], "left")
    reset = F.max(F.when((F.col("kind") == "mem") | F.col("fired"), F.col("tools")))
    return last.groupBy("session_id").agg((F.max("tools") - F.coalesce(reset, F.lit(0))).alias("ticks"))


def notices(trace: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(session_id, seq, ticks)``: the notices of a finished trace ``(session_id, seq, kind[, new_session])``; seq tells its rows apart.

    Uses of memory and tool calls are counted up to each row, a session being spread over tasks.  Of the prompts of a stretch between
    two uses of memory only the first at each number of tool calls can fire; the fold goes over those.  It is the one step that takes a
    stretch as a whole, since whether a prompt fires depends on the one that fired before it.
    """
    runs = _counted(trace).groupBy("session_id", "stretch", "tools").agg(
        F.max(F.col("kind") == "mem").alias("begins"), F.min(F.when((F.col("kind") == "prompt") & ~F.coalesce("new_session", F.lit(False)), F.col("seq"))).alias("seq")
    )
    first = runs.groupBy("session_id", "stretch").agg(F.min(F.when(F.col("begins"), F.col("tools"))).alias("before"), F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("seq", "tools")))).alias("prompts"))
    none = F.array().cast("array<struct<seq:bigint,ticks:bigint>>")
    begin = F.struct(F.coalesce("before", F.lit(0)).cast("long").alias("base"), none.alias("out"))

    def over(a: Column, x: Column) -> Column:
        ticks = (x["tools"] - a["base"]).cast("long")
        fired = F.struct(x["tools"].cast("long").alias("base"), F.concat(a["out"], F.array(F.struct(x["seq"].cast("long").alias("seq"), ticks.alias("ticks")))).alias("out"))
        return F.when(ticks >= limit, fired).otherwise(a)

    return first.select("session_id", F.explode(F.aggregate("prompts", begin, over, lambda a: a["out"])).alias("x")).select("session_id", "x.seq", "x.ticks")


def stream_notices(stream: DataFrame, limit: int = LIMIT, ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """The same over a stream, with the count of each session as keyed state that ends after ``ttl_ms`` of silence.

    Needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB one.  Rows of a batch are taken by ``seq``.
    """
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import LongType, StructField, StructType

    state = StructType([StructField("ticks", LongType())])

    class Pulse(StatefulProcessor):
        def init(self, handle) -> None:
            self.count = handle.getValueState("ticks", state, ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            every = pd.concat(list(rows)).sort_values("seq", kind="stable")
            ticks, out = int(self.count.get()[0]) if self.count.exists() else 0, []
            for seq, kind, new in zip(every["seq"], every["kind"], every["new_session"], strict=True):
                if kind == "mem":
                    ticks = 0
                elif kind == "tool":
                    ticks += 1
                elif kind == "prompt" and not new and ticks >= limit:
                    out.append((key[0], int(seq), ticks))
                    ticks = 0
            self.count.update((ticks,))
            yield pd.DataFrame(out, columns=["session_id", "seq", "ticks"])

        def close(self) -> None:
            pass

    return stream.groupBy("session_id").transformWithStateInPandas(Pulse(), "session_id string, seq long, ticks long", "Append", "ProcessingTime")


#: What a prompt is told.
FOCUS_HEAD = "## 🎯 Active Focus\n"
TELEMETRY = "> 📊 **System Health Telemetry:**\n> - Unconsolidated Events: {} (If > 3, consider calling `memory_consolidate`)\n> - Active Focus Stack: {}/7 slots filled"
INDEX = "> 📁 **Available Memory Index (Partial):**\n> - `memory/knowledge/user-prefs.md` (User preferences & coding style)\n> - `memory/knowledge/architecture.md` (System design decisions)\n> - `memory/YYYY-MM-DD.md` (Recent historical events)"
WAKE = "> New session: check what is known before going on.\n"
OVERLOAD = "> {} tool calls without using memory: record what was found.\n"
CONTEXT_HEAD, CONTEXT_FOOT = "<!-- Memory Context (Live) -->\n", "\n<!-- End Memory Context -->"


def _filled(template: str, *values: Column) -> Column:
    parts = template.split("{}")
    return F.concat(*(x for pair in zip(map(F.lit, parts), (*values, F.lit("")), strict=True) for x in pair))


def context(prompts: DataFrame, fired: DataFrame, stacks: DataFrame, telemetry: DataFrame) -> DataFrame:
    """``(session_id, seq, context)`` of each prompt: focus, wake-up of a new session or overload, null if there is nothing to say.

    A wake-up and an overload tell the state of the memory and where its index begins.
    prompts: ``(session_id, seq, workspace, new_session)``; stacks: ``(workspace, view, used)``; telemetry: ``(workspace, unconsolidated)``.
    """
    df = prompts.join(fired, ["session_id", "seq"], "left").join(stacks, "workspace", "left").join(telemetry, "workspace", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    health = F.concat(_filled(TELEMETRY, number("unconsolidated"), number("used")), F.lit("\n>\n" + INDEX))
    focus = F.when(F.coalesce(F.trim("view"), F.lit("")) != "", F.concat(F.lit(FOCUS_HEAD), F.trim("view")))
    wake = F.when(F.col("new_session"), F.concat(F.lit(WAKE), health))
    over = F.when(~F.col("new_session") & F.col("ticks").isNotNull(), F.concat(_filled(OVERLOAD, F.col("ticks").cast("string")), health))
    told = F.filter(F.array(focus, wake, over), lambda s: s.isNotNull())
    text = F.concat(F.lit(CONTEXT_HEAD), F.array_join(told, "\n\n"), F.lit(CONTEXT_FOOT))
    return df.select("session_id", "seq", F.when(F.size(told) > 0, text).alias("context"))


def stream_auto_records(stream: DataFrame, words: tuple[str, ...] = X.TRIGGERS, ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """Automatic records over a stream ``(session_id, seq, role, text)``: ``(session_id, seq, content)``.

    A row of role ``end`` closes an exchange; it is recorded if the last message of either side has one of the words.  Those two
    messages are the keyed state of a session.
    """
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import StringType, StructField, StructType

    from ..operators.record import AUTO_CHARS

    state = StructType([StructField("user", StringType()), StructField("assistant", StringType())])

    class Exchange(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", state, ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            every = pd.concat(list(rows)).sort_values("seq", kind="stable")
            said, out = dict(zip(("user", "assistant"), self.last.get() if self.last.exists() else (None, None), strict=True)), []
            for seq, role, text in zip(every["seq"], every["role"], every["text"], strict=True):
                if role in said:
                    said[role] = text
                elif role == "end" and any(x is not None for x in said.values()):
                    user, assistant = (x or "" for x in said.values())
                    if any(w in f"{user}\n{assistant}".lower() for w in words):
                        out.append((key[0], int(seq), f"User: {user[:AUTO_CHARS]}\nAsst: {assistant[:AUTO_CHARS]}"))
            self.last.update((said["user"], said["assistant"]))
            yield pd.DataFrame(out, columns=["session_id", "seq", "content"])

        def close(self) -> None:
            pass

    return stream.groupBy("session_id").transformWithStateInPandas(Exchange(), "session_id string, seq long, content string", "Append", "ProcessingTime")
