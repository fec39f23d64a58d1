"""A workspace on disk: where its parts are, and readers for them that take a missing folder as empty."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import date, timedelta
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, SCOPES
from ..sinks.scratch import saved


@dataclass(frozen=True)
class Paths:
    """The fixed places below a workspace, which is given, never taken from the environment."""

    workspace: str

    @classmethod
    def of(cls, *given: str | os.PathLike | None) -> Paths:
        """The first workspace that is given (by the call, then by the settings), or else the current folder."""
        return cls(next((str(g) for g in given if g), os.getcwd()))

    def _at(self, *parts: str) -> Path:
        return Path(self.workspace, *parts)

    @property
    def events(self) -> Path:
        return self._at(".memory", "events")

    @property
    def archive(self) -> Path:
        return self._at(".memory", "archive")

    @property
    def active(self) -> Path:
        return self._at(".memory", "active")

    @property
    def focus_stack(self) -> Path:
        return self._at(".memory", "active", "focus_stack.json")

    @property
    def focus_view(self) -> Path:
        return self._at(".memory", "active", "focus_stack.md")

    @property
    def scratchpad(self) -> Path:
        return self._at(".memory", "active", "scratchpad.md")

    @property
    def memory(self) -> Path:
        return self._at("memory")

    @property
    def knowledge(self) -> Path:
        return self._at("memory", "knowledge")

    @property
    def skills_verified(self) -> Path:
        return self._at("memory", "skills", "verified")

    @property
    def skills_drafts(self) -> Path:
        return self._at("memory", "skills", "drafts")

    @property
    def skills_registry(self) -> Path:
        return self._at("memory", "skills", "_registry.json")

    @property
    def dot_memory(self) -> Path:
        return self._at(".memory")

    @property
    def events_schema(self) -> Path:
        return self._at(".memory", "events", "_schema.json")

    @property
    def scripts(self) -> Path:
        return self._at(".memory", "scripts")

    @property
    def index(self) -> Path:
        return self._at("MEMORY_INDEX.md")

    def catalog(self, day: str) -> list[tuple[str, str]]:
        """``(name, path)`` of every place, with the files of one day."""
        fixed = [(k, str(getattr(self, k))) for k, v in vars(Paths).items() if isinstance(v, property)]
        return [*fixed, ("day_events", str(self.day_events(day))), ("day_log", str(self.day_log(day)))]

    def day_events(self, day: str) -> Path:
        return self.events / f"{day}.jsonl"

    def day_log(self, day: str) -> Path:
        return self.memory / f"{day}.md"


def read_json(path: Path, fallback: dict) -> dict:
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return fallback


def read_text(path: Path, fallback: str = "") -> str:
    try:
        return path.read_text(encoding="utf-8")
    except OSError:
        return fallback


def event_files(folder: Path | str) -> list[str]:
    """The names of a folder's ``*.jsonl`` files, in order; those that begin with ``.`` or ``_`` aren't events."""
    return sorted(p.name for p in Path(folder).glob("[!._]*.jsonl"))


def files_in_scope(folder: Path | str, scope: str, today: date) -> list[str]:
    """The event files that a consolidation looks at: ``session``: that of today; ``day``: names (without the ending) from seven days ago
    on, compared as text, so that other names sort as they are spelled; ``full``: all."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    least = (today - timedelta(days=7)).isoformat()
    return [f for f in event_files(folder) if scope == "full" or scope == "session" and f == f"{today.isoformat()}.jsonl" or scope == "day" and f.removesuffix(".jsonl") >= least]


def event_lines(spark: SparkSession, folder: Path | str, names: list[str] | None = None) -> DataFrame:
    """``(file, day, block, pos, value, parsed)``: non-blank lines of the ``*.jsonl`` files of a folder; ``parsed`` is null if it isn't JSON.

    The day is the file's name, kept as text since files may be named otherwise.  (block, pos) is the order of a file's lines:
    the part of the file that a task has read, and the place in that task.  names: only these files are read.
    """
    found = event_files(folder) if names is None else names
    if not found:
        return spark.createDataFrame([], "file string, day string, block long, pos long, value string, parsed variant")
    at = f"{folder}/*.jsonl" if names is None else [f"{folder}/{f}" for f in found]
    lines = spark.read.text(at).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    lines = lines.where(~F.col("value").rlike(r"^\s*$"))
    return lines.select("file", F.regexp_replace("file", r"\.jsonl$", "").alias("day"), "block", "pos", "value", F.try_parse_json("value").alias("parsed"))


def _typed(lines: DataFrame) -> DataFrame:
    get = lambda f: F.try_variant_get("parsed", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
    return lines.select(*(get(f) for f in EVENT.fields), "file", "day", "block", "pos", F.col("value").alias("_raw"))


def read_events(spark: SparkSession, folder: Path | str, lenient: bool = False, names: list[str] | None = None) -> DataFrame:
    """Events with ``file``, ``day``, ``block``, ``pos`` and ``_raw`` (the line as it was, so that unknown keys survive a rewrite).

    strict: a file with any line that isn't JSON gives nothing; lenient: only such lines don't.  A field of another type is null.
    """
    lines = event_lines(spark, folder, names)
    if not lenient:
        bad = lines.where(F.col("parsed").isNull()).select("file").distinct()
        lines = lines.join(bad, "file", "left_anti")
    return _typed(lines.where(F.col("parsed").isNotNull()))


#: Files of a task, and files and bytes of a batch.
TASK_FILES, BATCH_FILES, BATCH_BYTES = 20_000, 1000, 8_000_000


def read_knowledge(spark: SparkSession, folder: Path | str) -> DataFrame:
    """``(file, content)`` of the ``*.md`` files of a folder, each whole; the folder is on a mounted file system.

    A task lists the folder, and the names are dealt out: Spark's own reader would list them on the driver and count each as 4 MB, so
    that 32 small files were a task.
    """
    folder = str(folder)

    def listed():
        with os.scandir(folder) as found:
            yield from (e.name for e in found if e.name.endswith(".md") and e.name[0] not in "._" and e.is_file())

    if not os.path.isdir(folder) or next(listed(), None) is None:
        return spark.createDataFrame([], "file string, content string")

    def names(batches):
        for _ in batches:
            every = listed()
            while some := list(islice(every, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["file"])

    def contents(batches):
        for b in batches:
            some, texts, size = [], [], 0
            for name in b.column(0).to_pylist():
                texts.append(Path(folder, name).read_bytes())
                some.append(name)
                size += len(texts[-1])
                if size > BATCH_BYTES or len(some) >= BATCH_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(texts, pa.binary())], ["file", "content"])
                    some, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(texts, pa.binary())], ["file", "content"])

    files = saved(spark.range(1, numPartitions=1).mapInArrow(names, "file string"), "names")
    parts = max(4 * spark.sparkContext.defaultParallelism, files.count() // TASK_FILES)
    return files.repartition(parts).mapInArrow(contents, "file string, content binary").withColumn("content", F.col("content").cast("string"))
