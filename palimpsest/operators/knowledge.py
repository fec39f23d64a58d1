"""Knowledge files: blocks between markers, what they state of themselves, and an index of the files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

#: The markers around an entry, and the head of an index.
START, END = "<!-- knowledge_entry: ", "<!-- /knowledge_entry -->"
INDEX_HEAD = (
    "# Long-Term Memory Index",
    "> **Core Project Context & User Knowledge**",
    "> This is a lightweight index. If a file looks relevant, use the `read` or `memory_explore` tool to fetch its full contents.",
    "",
)
INDEX_EMPTY = "(No knowledge files yet. Consolidation will populate this.)"


def entries(files: DataFrame) -> DataFrame:
    """``(file, id, content, importance, associations, ord)`` from ``(file, content)``.

    A block goes from its start marker to the first end marker behind it, whatever is between; without one it is none, and the
    next file that has the id counts.  Of several blocks of an id the first does, by file and place.
    """
    at = files.select("file", "content", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(START + r"(\S+) -->"), 1))).alias("id"))
    marker = F.concat(F.lit(START), F.col("id"), F.lit(" -->"))
    start = F.instr("content", marker)
    end = F.expr(f"locate('{END}', content, instr(content, concat('{START}', id, ' -->')))")
    at = at.withColumn("start", start).withColumn("end", end).where(F.col("end") > 0)
    block = F.substring("content", F.col("start"), F.col("end") - F.col("start") + len(END))
    first = at.groupBy("id").agg(F.min_by(F.struct("file", block.alias("content")), F.struct("file", "start")).alias("x"))
    first = first.select("x.file", "id", "x.content")
    return first.select("file", "id", "content", X.confidence("content").alias("importance"), X.associations("content").alias("associations"), F.lit(0).cast("long").alias("ord"))


def index_rows(files: DataFrame) -> DataFrame:
    """``(file, n_entries, title, description)`` from ``(file, content)``: of its lines, those that head entries are counted,
    the first title is taken, or else the file's name, and the first line of text, up to 100 characters."""
    lines: Column = F.split("content", "\n")
    df = files.select("file", lines.alias("lines"))
    titles = F.filter("lines", lambda s: s.startswith("# "))
    texts = F.filter("lines", lambda s: (X.trimmed(s) != "") & ~s.startswith("# ") & (F.length(s) > 5) & ~s.startswith("<!--"))
    title = F.coalesce(F.get(titles, F.lit(0)), F.concat(F.lit("# "), F.replace("file", F.lit(".md"), F.lit(""))))
    text = F.substring(F.regexp_replace(F.get(texts, F.lit(0)), r"^[>|│]\s*", ""), 1, 100)
    return df.select(
        "file",
        F.size(F.filter("lines", lambda s: X.trimmed(s).startswith("## "))).alias("n_entries"),
        F.regexp_replace(title, r"^#\s*", "").alias("title"),
        F.coalesce(F.when(F.length(text) == 100, F.concat(text, F.lit("..."))).otherwise(text), F.lit("")).alias("description"),
    )


def index_line() -> Column:
    return F.concat(F.lit("- `memory/knowledge/"), F.col("file"), F.lit("` ("), F.col("n_entries").cast("string"), F.lit(" entries) — **"), F.col("title"), F.lit("**: "), F.col("description"))


def index_lines(rows: DataFrame) -> DataFrame:
    """``(part, file, line)``: the head (parts 0 to 3) and a line for each file (part 4); sorted by part and file they are the index.

    Lines stay rows, so that an index of any number of files can be sorted and written in parallel.
    """
    spark = rows.sparkSession
    head = spark.range(len(INDEX_HEAD)).select(F.col("id").cast("int").alias("part"), F.lit("").alias("file"), F.get(F.array(*map(F.lit, INDEX_HEAD)), F.col("id").cast("int")).alias("line"))
    return head.unionByName(rows.select(F.lit(len(INDEX_HEAD)).alias("part"), "file", index_line().alias("line")))


def index_pieces(rows: DataFrame) -> Iterator[str]:
    """The index of a workspace, line by line as the driver gets it, each but the first with the break before it."""
    for k, r in enumerate(index_lines(rows).orderBy("part", "file").toLocalIterator()):
        yield f"\n{r.line}" if k else r.line


def render_index(rows: DataFrame) -> str:
    """The index of a workspace as one text."""
    return "".join(index_pieces(rows))
