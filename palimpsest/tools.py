"""The four tools and the hooks on a workspace folder: record, explore, consolidate and work, with their files as side effects.

What is computed comes from the operators; this module only reads, writes and words.  The clock is an argument everywhere.
"""

from __future__ import annotations

import json
from datetime import date, datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import consolidate as C
from .operators import graph as G
from .operators import knowledge as K
from .operators import record as R
from .operators import working as W
from .operators.numbering import numbered
from .schema import EVENT, EVENT_TYPES, Config
from .sinks import store
from .sinks.scratch import saved
from .sources.workspace import Paths, event_lines, files_in_scope, read_events, read_json, read_knowledge, read_text


#: The focus queue as it stands where an event comes first.
FIRST_STACK = {"project_goal": "Checking system...", "current_path": [], "current_focus": "Initializing", "pending_siblings": []}

#: What is said of an event that was recorded.
RECORDED = "Event recorded: {id}\nType: {type} | Importance: {importance:g}\nWritten to: .memory/events/{day}.jsonl + memory/{day}.md"


def iso(now: datetime) -> str:
    return now.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


class MemoryWorkspace:
    def __init__(self, spark: SparkSession, workspace: str, config: Config = Config()):
        self.spark, self.at, self.config = spark, Paths(str(workspace)), config

    # Events

    def record(self, content: str, type: str, now: datetime, tags=(), importance: float | None = None, associations=()) -> dict:  # noqa: A002
        """Append an event to its day (UTC) and to the daily log, and note the activity; returns the event."""
        if type not in EVENT_TYPES:
            raise ValueError(f"unknown type: {type}")
        day = iso(now)[:10]
        path = self.at.day_events(day)
        text = read_text(path).strip()
        seq = len(text.split("\n")) + 1 if text else 1  # blank lines in between count
        event = {
            "id": f"evt_{day.replace('-', '')}_{seq:03d}", "timestamp": iso(now), "type": type, "content": content, "tags": list(tags), "importance": 0.5 if importance is None else importance,
            "associations": list(associations), "consolidated": False, "decay_score": 1.0,
        }
        store.append_line(path, json.dumps(event, ensure_ascii=False))
        stack = read_json(self.at.focus_stack, FIRST_STACK)
        store.write_json(self.at.focus_stack, stack | {"last_updated": iso(now)})
        rows = self.spark.createDataFrame([event], EVENT).withColumn("ts", F.to_timestamp("timestamp"))
        store.append_line(self.at.day_log(day), rows.select(R.log_entry().alias("x")).first().x)
        return event

    def events(self, lenient: bool = False):
        """All live events, written once so that a file that is replaced isn't read again; ``ord`` is their order by file and line."""
        df = read_events(self.spark, self.at.events, lenient).withColumn("ts", F.try_to_timestamp("timestamp"))
        return numbered(df, (), ("file", "block", "pos"), "ord")

    def explore(self, entry_id: str, depth: int = 2, direction: str = "both", rank: bool = False) -> tuple[list, str]:
        """The nodes around an entry, in the order they are met (or by score), and the same as text; visited events are reinforced."""
        events, entries = self.events(), K.entries(read_knowledge(self.spark, self.at.knowledge))
        nodes, edges = G.nodes(events, entries), G.edges(events, entries, direction)
        roots = self.spark.createDataFrame([(entry_id,)], "root string")
        found, dangling = G.explore_all(roots, nodes, edges, depth)
        rows = sorted(G.described(found, nodes).collect(), key=lambda r: (r.depth, r.at))  # the answer
        changed = G.reinforce(events, found.unionByName(dangling)).withColumn("new_score", F.when(F.col("reinforced"), F.lit(1.0)))
        self._rewrite(changed.withColumn("gone", F.lit(False)))
        text = G.render(rows, entry_id, depth, direction)
        return sorted(rows, key=lambda r: -r.score) if rank else rows, text

    def consolidate(self, now: datetime, scope: str = "session", dry_run: bool = False) -> tuple[dict, str]:
        """Decay and archive the events in scope and write the index; returns the counts and the report.

        The scope is answered from the names of the files: those out of it aren't opened.
        """
        last = read_json(self.at.focus_stack, {}).get("last_updated")
        reference = F.to_timestamp(F.lit(last or iso(now)))
        store.settle_moves(self.at.events, self.at.archive)
        names = files_in_scope(self.at.events, scope, date.fromisoformat(iso(now)[:10]))
        events = read_events(self.spark, self.at.events, names=names).withColumn("ts", F.try_to_timestamp("timestamp"))
        chosen = saved(C.classify(events, reference, self.config), "chosen")
        counts = C.report(chosen).first().asDict()
        files = read_knowledge(self.spark, self.at.knowledge)
        # The files are read once; the index goes line by line, by way of no text that holds all of it.
        index = K.index_pieces(saved(K.index_rows(files), "index")) if self.at.knowledge.is_dir() else iter(["\n".join((*K.INDEX_HEAD, K.INDEX_EMPTY))])
        chars = 0

        def counted():
            nonlocal chars
            for x in index:
                chars += len(x)
                yield x

        if not dry_run:
            self._rewrite(chosen.withColumns({"new_score": F.when(F.col("action") == "decayed", F.col("computed_score")), "gone": F.col("action") == "archived"}))
            store.write_pieces(self.at.index, counted())
        else:
            for _ in counted():
                pass
        counts |= {"index_chars": chars, "index_regenerated": not dry_run}
        return counts, C.render_report(counts, scope, chars, dry_run, self.config)

    def _rewrite(self, events) -> None:
        """Write the files in which a score changes or an event goes, each by one task; keys that the schema doesn't know are kept."""
        events = saved(events.select("file", "block", "pos", "_raw", "new_score", "gone"), "rewrite")
        touched = events.where(F.col("new_score").isNotNull() | F.col("gone")).select("file").distinct()
        store.rewrite_days(events.join(touched, "file", "left_semi"), self.at.events, self.at.archive)

    # Working memory

    def _stack(self, pad: str = "", goal: str = W.NO_GOAL, focus: str = W.NO_FOCUS) -> W.Focus:
        s = read_json(self.at.focus_stack, {})
        return W.Focus(s.get("project_goal", goal), list(s.get("current_path") or []), s.get("current_focus", focus), list(s.get("pending_siblings") or []), s.get("last_updated", ""), W.sections(pad))

    def work(self, action: str, now: datetime, **given) -> str:
        """One action on the focus queue; files are written for those that change something.  ValueError if it can't be done.

        In the scratchpad only the section concerned changes, and it is written only if it does; keys of the queue's file that
        aren't known here stay.
        """
        pad, clock = read_text(self.at.scratchpad), iso(now)[11:16]
        state = self._stack(pad, *((W.REFILL_GOAL, W.REFILL_FOCUS) if action == "scratchpad_refill" else ()))
        before, pending = json.dumps([vars(state)], default=str), list(state.pending)
        listed = {k: tuple(v) if k in ("path", "siblings") else v for k, v in given.items()}
        said, insight = W.step(state, W.Action(action, at=iso(now), **listed))
        if insight:
            self.record(insight, "insight", now, importance=0.6)
        if action != "status" and json.dumps([vars(state)], default=str) != before:
            if action != "scratchpad_append":
                known = {"project_goal": state.goal, "current_path": state.path, "current_focus": state.focus, "pending_siblings": state.pending, "last_updated": state.updated}
                store.write_json(self.at.focus_stack, read_json(self.at.focus_stack, {}) | known)
                store.write_text(self.at.focus_view, W.render_view(state))
            if action == "overflow":
                new = W.with_overflow(pad, given.get("section") or W.OVERFLOW, pending, clock)
            elif action == "scratchpad_append":
                new = W.with_note(pad, given["section"], given["content"], clock)
            else:
                new = W.without_items(pad, W.OVERFLOW, len(state.pending) - len(pending)) if action == "scratchpad_refill" else pad
            if new != pad:
                store.write_text(self.at.scratchpad, new)
        return said if action in ("status", "overflow", "scratchpad_append", "scratchpad_refill") else f"{said}\n\n{W.render_status(state)}"

    # Calls by name

    def call(self, tool: str, now: datetime, **given) -> dict:
        """A tool by its name; what it says as ``{"content": [{"type": "text", "text": ...}]}``, errors too."""
        try:
            if tool == "memory_record":
                e = self.record(now=now, **given)
                text = RECORDED.format(day=iso(now)[:10], **e)
            elif tool == "memory_explore":
                text = self.explore(**given)[1]
            elif tool == "memory_consolidate":
                text = self.consolidate(now, **given)[1]
            elif tool == "memory_working":
                text = self.work(now=now, **given)
            else:
                raise ValueError(f"unknown tool: {tool}")
        except ValueError as e:
            text = f"Error: {e}"
        return {"content": [{"type": "text", "text": text}]}

    # Hooks

    def telemetry(self) -> dict:
        """Unconsolidated events over all files, line by line, and how full the queue is (0 if there is none)."""
        lines = event_lines(self.spark, self.at.events).where(F.col("parsed").isNotNull())
        loose = F.coalesce(F.try_variant_get("parsed", "$.consolidated", "boolean"), F.lit(False))
        n = lines.where(~loose).count()
        return {"unconsolidated": n, "used": self._stack().used() if self.at.focus_stack.is_file() else 0}

    def agent_end(self, messages: list[dict], now: datetime, words: tuple[str, ...] = X.TRIGGERS) -> dict | None:
        """Record the last exchange if it has one of the words; returns the event.  A content may be a list of parts with texts."""
        plain = lambda c: c if isinstance(c, str) else "\n".join(p.get("text") or "" for p in c or [])
        rows = [("s", i, m.get("role"), plain(m.get("content"))) for i, m in enumerate(messages)]
        turns = self.spark.createDataFrame(rows, "session_id string, seq long, role string, text string")
        found = R.auto_records(turns, words).first()
        return self.record(found.content, found.type, now, found.tags, found.importance) if found else None
