"""Working memory: a focus queue that actions change one after the other, and views of it.

The rules are written once, in :func:`step`, for one state and one action; :func:`fold` applies them to any number of workspaces,
each worked through in order as its rows stream by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

SLOTS = 7
#: Names and texts that a state can hold.
OVERFLOW = "Pending Items (Overflow)"
NO_GOAL, NO_FOCUS, DONE = "Not set", "None", "Done (Pending new goal)"
REFILL_GOAL, REFILL_FOCUS = "Restored", "Refilling..."
PAD_HEAD, SECTION_HEAD, NOTE, ITEM = "# Scratchpad", "## {}", "- [{}] {}", "- {}"
#: What is said, and how a queue is written.
SAID = {
    "saved": "Focus updated.",
    "completed": "Completed: {}",
    "overflowed": "Overflowed {} items to scratchpad.md under [{}].",
    "nothing pending": "No pending siblings to overflow.",
    "noted": "Appended note to scratchpad.md [{}].",
    "no overflow": "No overflow section found in scratchpad.md.",
    "empty": "Overflow section is empty.",
    "full": "Focus stack is already at or near limit (7). Cannot refill yet.",
    "refilled": "Refilled {} items from scratchpad to focus stack. {} items remain in overflow.",
    "plan needs": "Action 'plan' requires 'goal' and 'focus'.",
    "push needs": "Action 'push' requires 'siblings' array.",
    "append needs": "Action 'scratchpad_append' requires 'section' and 'content'.",
    "unknown": "Unknown action: {}",
}
GOAL_LINE, TIME_LINE, PATH_HEAD, FOCUS_LINE, NEXT_HEAD = "**Project Goal:** {}", "**Last Updated:** {}", "**Path:**", "**🚀 FOCUS:** {}", "**Upcoming:**"
PATH_ITEM, NEXT_ITEM = "  └─ {}", "  - {}"
PATH_HIDDEN, NEXT_HIDDEN = "  └─ ... ({} earlier steps hidden)", "  - ... ({} later steps pending in backend queue)"
STATUS_HEAD, STATUS_FOOT = "## Current Focus Stack", "*Backend Queue: {} items (Auto-truncating to 7 for MD frontend)*"


@dataclass
class Focus:
    goal: str = NO_GOAL
    path: list[str] = field(default_factory=list)
    focus: str = NO_FOCUS
    pending: list[str] = field(default_factory=list)
    updated: str = ""
    scratchpad: dict[str, list[str]] = field(default_factory=dict)  # newest first in each section

    def used(self) -> int:
        return len(self.path) + 1 + len(self.pending)


@dataclass(frozen=True)
class Action:
    action: str
    goal: str | None = None
    focus: str | None = None
    path: tuple[str, ...] = ()
    siblings: tuple[str, ...] = ()
    insight: str | None = None
    next_focus: str | None = None
    section: str | None = None
    content: str | None = None
    at: str = ""


def step(state: Focus, a: Action) -> tuple[str, str | None]:
    """Apply an action to a state.  Returns what to say, and an insight to record if there is one; raises ValueError if it can't."""
    if a.action == "status":
        return render_status(state), None
    if a.action == "plan":
        if not a.goal or not a.focus:
            raise ValueError(SAID["plan needs"])
        state.goal, state.path, state.focus, state.pending = a.goal, list(a.path), a.focus, list(a.siblings)
        said = SAID["saved"]
    elif a.action == "push":
        if not a.siblings:
            raise ValueError(SAID["push needs"])
        state.pending.extend(a.siblings)
        said = SAID["saved"]
    elif a.action == "complete":
        said = SAID["completed"].format(state.focus)
        state.focus = a.next_focus or (state.pending.pop(0) if state.pending else DONE)
    elif a.action == "overflow":
        if not state.pending:
            return SAID["nothing pending"], None
        section = a.section or OVERFLOW
        said = SAID["overflowed"].format(len(state.pending), section)
        state.scratchpad[section] = state.pending + state.scratchpad.get(section, [])
        state.pending = []
    elif a.action == "scratchpad_append":
        if not a.section or not a.content:
            raise ValueError(SAID["append needs"])
        state.scratchpad[a.section] = [a.content, *state.scratchpad.get(a.section, [])]
        return SAID["noted"].format(a.section), None
    elif a.action == "scratchpad_refill":
        items = state.scratchpad.get(OVERFLOW)
        if not items:
            return SAID["no overflow" if items is None else "empty"], None
        room = max(0, SLOTS - state.used())
        if not room:
            return SAID["full"], None
        moved, rest = items[:room], items[room:]
        state.pending.extend(moved)
        if rest:
            state.scratchpad[OVERFLOW] = rest
        else:
            del state.scratchpad[OVERFLOW]
        said = SAID["refilled"].format(len(moved), len(rest))
    else:
        raise ValueError(SAID["unknown"].format(a.action))
    state.updated = a.at or state.updated
    return said, a.insight if a.action == "complete" and a.insight else None


def render_status(s: Focus) -> str:
    """The whole queue."""
    head = [STATUS_HEAD, "", GOAL_LINE.format(s.goal), TIME_LINE.format(s.updated), ""]
    queue = [PATH_HEAD, *map(PATH_ITEM.format, s.path), "", FOCUS_LINE.format(s.focus), "", NEXT_HEAD, *map(NEXT_ITEM.format, s.pending), ""]
    return "\n".join([*head, *queue, STATUS_FOOT.format(s.used())])


def render_view(s: Focus) -> str:
    """At most seven lines of the queue: the last steps of the path, the focus, the first of what is pending."""
    behind = min(3, len(s.path))
    ahead = min(SLOTS - 1 - behind, len(s.pending))
    behind = min(len(s.path), SLOTS - 1 - ahead)  # what isn't needed ahead goes to the path
    hidden, later = len(s.path) - behind, len(s.pending) - ahead
    parts = [[GOAL_LINE.format(s.goal), TIME_LINE.format(s.updated)]]
    if s.path:
        parts.append([PATH_HEAD, *[PATH_HIDDEN.format(hidden)] * (hidden > 0), *map(PATH_ITEM.format, s.path[hidden:])])
    parts.append([FOCUS_LINE.format(s.focus)])
    if s.pending:
        parts.append([NEXT_HEAD, *map(NEXT_ITEM.format, s.pending[:ahead]), *[NEXT_HIDDEN.format(later)] * (later > 0)])
    return "\n\n".join("\n".join(p) for p in parts)


def items_of(text: str) -> list[str]:
    """Items of a list in Markdown, without bullets and clock times."""
    return [x for x in map(_item, text.split("\n")) if x]


def _item(line: str) -> str:
    return re.sub(r"^[-*]\s*(\[\d{2}:\d{2}\])?\s*", "", line).strip()


def items(text: Column | str) -> Column:
    """:func:`items_of` as an expression."""
    lines = F.split(text, "\n")
    return F.filter(F.transform(lines, lambda x: X.trimmed(F.regexp_replace(x, r"^[-*]\s*(\[\d{2}:\d{2}\])?\s*", ""))), lambda x: x != "")


def noted(pads: DataFrame, clock: str) -> DataFrame:
    """``(key, text)`` from ``(key, text, section, content)``: each scratchpad with a note in a section; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [with_note(t or "", s, c, clock) for t, s, c in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], ["key", "text"])

    return pads.select(F.col("key").cast("long").alias("key"), "text", "section", "content").mapInArrow(run, "key long, text string")


def sections(pad: str) -> dict[str, list[str]]:
    """The items of each section of a scratchpad.  A section goes from its ``## `` line to the next heading of any level; what stands
    below a heading of another level belongs to none.  Of two sections of one name the first counts."""
    out: dict[str, list[str]] = {}
    lines = pad.split("\n")
    for i, line in enumerate(lines):
        if line.startswith("## "):
            out.setdefault(line[3:].strip(), items_of("\n".join(lines[i + 1 : _section_end(lines, i)])))
    return out


def _section_end(lines: list[str], head: int) -> int:
    return next((k for k in range(head + 1, len(lines)) if re.match(r"#{1,6} ", lines[k])), len(lines))


def _section_at(lines: list[str], section: str) -> int | None:
    return next((k for k, line in enumerate(lines) if line.startswith("## ") and line[3:].strip() == section), None)


def with_note(pad: str, section: str, content: str, clock: str) -> str:
    """The scratchpad with a note behind the head of a section, which is added at the end if it isn't there; all else stays as it is."""
    note = NOTE.format(clock, content)
    lines = pad.split("\n")
    at = _section_at(lines, section)
    if at is None:
        return f"{pad.rstrip() or PAD_HEAD}\n\n{SECTION_HEAD.format(section)}\n{note}\n"
    text = "\n".join([*lines[: at + 1], note, *lines[at + 1 :]])
    return text if text.endswith("\n") else text + "\n"


def with_overflow(pad: str, section: str, items: list[str], clock: str) -> str:
    """The scratchpad with the items of a queue in a section, in their order, behind a line with the time."""
    return with_note(pad, section, "\n" + "\n".join(map(ITEM.format, items)), clock)


def without_items(pad: str, section: str, n: int) -> str:
    """The scratchpad without the first ``n`` items of a section (and the lines with nothing but a time before them), or without the
    section if no item is left; all else stays as it is."""
    lines = pad.split("\n")
    at = _section_at(lines, section)
    if at is None:
        return pad
    end = _section_end(lines, at)
    found = [k for k in range(at + 1, end) if _item(lines[k])]
    if len(found) <= n:
        return "\n".join([*lines[:at], *lines[end:]]).rstrip() + "\n"
    return "\n".join([*lines[: at + 1], *(x for x in lines[at + 1 : found[n]] if not x.strip()), *lines[found[n] :]])


def focus_view(stacks: DataFrame) -> DataFrame:
    """``(workspace, shown_path, current_focus, shown_pending, hidden_path, hidden_pending, used)`` from ``(workspace, current_path,
    current_focus, pending_siblings)``, as expressions."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    n_path, n_pending = size("current_path"), size("pending_siblings")
    path, pending = X.view_limits(n_path, n_pending, SLOTS)

    def last(c: str, n: Column) -> Column:
        return F.when(n > 0, F.slice(c, F.greatest(F.lit(1), F.size(c) - n + 1), n)).otherwise(F.slice(c, F.lit(1), F.lit(0)))

    return stacks.select(
        "workspace", last("current_path", path).alias("shown_path"), "current_focus", F.slice("pending_siblings", F.lit(1), pending).alias("shown_pending"),
        (n_path - path).alias("hidden_path"), (n_pending - pending).alias("hidden_pending"), X.stack_usage("current_path", "pending_siblings").alias("used"),
    )


def focus_frontends(stacks: DataFrame, goal: str = NO_GOAL, updated: str = "") -> DataFrame:
    """``(workspace, text)``: :func:`render_view` of each queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [render_view(Focus(goal, p or [], f, q or [], updated)) for p, f, q in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["workspace", "text"])

    return stacks.select(F.col("workspace").cast("long").alias("workspace"), "current_path", "current_focus", "pending_siblings").mapInArrow(run, "workspace long, text string")


def fold(actions: DataFrame) -> DataFrame:
    """The last state of each workspace: ``(workspace, goal, path, focus, pending, overflow, n_done, n_refused)``.

    actions: ``(workspace, seq, action, goal, focus, siblings)``.  Workspaces are dealt out by hash and each is worked through in
    order of ``seq`` from sorted batches; only the states at hand are in memory, however long a history is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done, refused, out = None, None, 0, 0, []

        def emit():
            return {"workspace": key, "goal": state.goal, "path": state.path, "focus": state.focus, "pending": state.pending, "overflow": state.scratchpad.get(OVERFLOW, []), "n_done": done, "n_refused": refused}

        for b in batches:
            for r in b.to_pylist():
                if state is None or r["workspace"] != key:
                    if state is not None:
                        out.append(emit())
                    key, state, done, refused = r["workspace"], Focus(), 0, 0
                try:
                    step(state, Action(r["action"], goal=r["goal"], focus=r["focus"], siblings=tuple(r["siblings"] or ())))
                    done += 1
                except ValueError:
                    refused += 1
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state is not None:
            out.append(emit())
        yield pa.RecordBatch.from_pylist(out, schema)

    strings = pa.list_(pa.string())
    schema = pa.schema([("workspace", pa.int64()), ("goal", pa.string()), ("path", strings), ("focus", pa.string()), ("pending", strings), ("overflow", strings), ("n_done", pa.int64()), ("n_refused", pa.int64())])
    df = actions.select(F.col("workspace").cast("long").alias("workspace"), "seq", "action", "goal", "focus", "siblings")
    dealt = df.repartition("workspace").sortWithinPartitions("workspace", "seq")
    return dealt.mapInArrow(run, "workspace long, goal string, path array<string>, focus string, pending array<string>, overflow array<string>, n_done long, n_refused long")
