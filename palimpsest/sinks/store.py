"""Writers for day-partitioned event tables and for the small files of a workspace."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_line(path: Path, line: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as f:
        f.write(line + "\n")


def write_text(path: Path, text: str) -> None:
    """Replace a small file as a whole: written beside it, then renamed."""
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    beside.write_text(text, encoding="utf-8")
    os.replace(beside, path)


def write_json(path: Path, value: dict) -> None:
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False))


def write_pieces(path: Path, pieces: Iterable[str]) -> None:
    """As :func:`write_text`, piece by piece."""
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with beside.open("w", encoding="utf-8") as f:
        f.writelines(pieces)
    os.replace(beside, path)


def write_event_lines(path: Path, lines: Iterable[str]) -> None:
    """A day's events, one JSON object a line; an empty file where none is left."""
    write_pieces(path, (f"{x}\n" for x in lines))


def _lines(path: Path) -> Iterator[str]:
    try:
        with path.open(encoding="utf-8") as f:
            yield from (x for x in (y.removesuffix("\n") for y in f) if x.strip())
    except FileNotFoundError:
        return


def _digest(path: Path) -> str:
    if not path.is_file():
        return ""
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class DayMove:
    """A day that is replaced by what is kept of it, with what goes at the end of its archive, equal lines and all.

    Lines go to files beside the two as they come, so that a day of any size takes no memory; :meth:`done` puts those in place.  The
    archive comes first, so that nothing is lost in between; a note beside it tells how long it was and what the day held, so that a
    run that breaks off is undone by :func:`settle_moves` before the next and no line is archived twice.
    """

    def __init__(self, day: Path, archive: Path):
        self.day, self.archive, self.old = day, archive, 0
        self.kept, self.moved = self._open(day), None

    def _open(self, path: Path):
        path.parent.mkdir(parents=True, exist_ok=True)
        return path.with_name(f".{path.name}.{uuid.uuid4().hex}").open("w", encoding="utf-8")

    def keep(self, line: str) -> None:
        self.kept.write(f"{line}\n")

    def move(self, line: str) -> None:
        if self.moved is None:
            self.moved = self._open(self.archive)
            for x in _lines(self.archive):
                self.moved.write(f"{x}\n")
                self.old += 1
        self.moved.write(f"{line}\n")

    def done(self) -> None:
        self.kept.close()
        if self.moved is None:
            os.replace(self.kept.name, self.day)
            return
        self.moved.close()
        note = self.archive.with_name(f".{self.archive.name}.move")
        write_json(note, {"lines": self.old, "day": _digest(self.day)})
        os.replace(self.moved.name, self.archive)
        os.replace(self.kept.name, self.day)
        note.unlink()

    def drop(self) -> None:
        """What was written beside goes, and all stays as it was."""
        for f in (self.kept, self.moved):
            if f is not None:
                f.close()
                Path(f.name).unlink(missing_ok=True)


def move_lines(day: Path, kept: Iterable[str], archive: Path, moved: Iterable[str]) -> None:
    """Replace a day as :class:`DayMove` does."""
    move = DayMove(day, archive)
    for x in kept:
        move.keep(x)
    for x in moved:
        move.move(x)
    move.done()


def settle_moves(events: Path, archive: Path) -> None:
    """Undo moves that broke off: where the day is still as it was, its archive is cut to the length it had."""
    for note in archive.glob(".*.move") if archive.is_dir() else ():
        name, was = note.name[1 : -len(".move")], json.loads(note.read_text(encoding="utf-8"))
        if _digest(events / name) == was["day"]:
            write_event_lines(archive / name, islice(_lines(archive / name), was["lines"]))
        note.unlink()


def write_files(lines: DataFrame, folder: Path) -> int:
    """Write ``(file, ord, line)`` as text files, the lines of each in order, every file by one task; returns how many."""
    folder = str(folder)

    def run(batches):
        name, f, done = None, None, []
        for b in batches:
            for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, Path(folder, file).open("w", encoding="utf-8")
                    done.append(file)
                f.write(line + "\n")
        if f is not None:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    Path(folder).mkdir(parents=True, exist_ok=True)
    return lines.repartition("file").sortWithinPartitions("file", "ord").select("file", "line").mapInArrow(run, "file string").count()


def rewrite_days(rows: DataFrame, events: Path, archive: Path) -> int:
    """Write the day files that ``rows`` names: ``(file, block, pos, _raw, new_score, gone)``, with all lines of each; returns how many.

    A line with a new score gets it and keeps all else; those that are gone move to the archive.  A file is one task's work and
    goes by as its rows come in order, none by way of the driver.  The rows must not come from the files themselves.
    """
    events, archive = str(events), str(archive)

    def run(batches):
        name, move, done = None, None, []
        try:
            for b in batches:
                for r in b.to_pylist():
                    if r["file"] != name:
                        if move is not None:
                            move.done()
                        name, move = r["file"], DayMove(Path(events, r["file"]), Path(archive, r["file"]))
                        done.append(name)
                    if r["gone"]:
                        move.move(r["_raw"])
                    else:
                        move.keep(r["_raw"] if r["new_score"] is None else json.dumps(json.loads(r["_raw"]) | {"decay_score": r["new_score"]}, ensure_ascii=False))
            if move is not None:
                move.done()
        except BaseException:
            if move is not None:
                move.drop()
            raise
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    return rows.repartition("file").sortWithinPartitions("file", "block", "pos").mapInArrow(run, "file string").count()


def write_days(events: DataFrame, table: str, mode: str = "append") -> None:
    """Append to a Parquet table partitioned by ``day``."""
    events.write.mode(mode).partitionBy("day").parquet(table)


def replace_days(events: DataFrame, table: str, days: list[str]) -> None:
    """Replace the given days of a table by what ``events`` has of them; a day of which nothing is left goes.

    The rows may come from the table itself: they are written to a staging folder first, and folders are swapped only when all
    is there.  Dynamic partition overwrite would leave emptied days as they were.
    """
    spark = events.sparkSession
    fs_path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    staging = f"{table.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    events.where(F.col("day").cast("string").isin(*days)).write.partitionBy("day").parquet(staging)
    fs = fs_path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for day in days:  # out of the way, in, and only then deleted: at any time the day is there or beside the table
        at, old, new = fs_path(f"{table}/day={day}"), fs_path(f"{staging}/_old-{day}"), fs_path(f"{staging}/day={day}")
        if fs.exists(at):
            fs.rename(at, old)
        if fs.exists(new):
            fs.rename(new, at)
    fs.delete(fs_path(staging), True)
    spark.catalog.refreshByPath(table)


def archive_days(events: DataFrame, archive: str, run_id: str) -> bool:
    """Append archived events once for each run: a run whose mark is there already does nothing, so a retry can't double them."""
    spark = events.sparkSession
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{archive.rstrip('/')}/_runs/{run_id}")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(mark):
        return False
    # Files of this run get their own folder below each day, so that a run that broke off is simply written again.
    events.withColumn("run", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run").parquet(archive)
    fs.create(mark).close()
    return True
