"""Token counts: pieces are counted once for each distinct pre-token of the corpus, then joined to each document's pre-token frequencies.

No id is ever made.  The join has two ways that give the same sums: pre-tokens that many places share sit in a dictionary of
at most ``DICTIONARY`` entries that every executor gets; all others go through a shuffled join on the pre-token.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_row, frequent, saved, tokenizer_path
from .word_bpe import PreTokenizer, loaded

#: The most pre-tokens that the broadcast dictionary may hold (of up to 200 bytes each).
DICTIONARY = 1 << 17
#: A counter of this many entries is handed on, so that a worker's memory doesn't grow with its partition.
FLUSH = 200_000


def _count_pre_tokens(path: str):
    def run(batches):
        pre, seen = loaded(PreTokenizer, path), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])
        for b in batches:
            for text in b.column(0):
                if (t := text.as_py()) is not None:
                    seen.update(x for x in pre.split(t) if x.__class__ is str) if "<|" in t else seen.update(pre.plain(t))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return run


def _count_pieces(path: str):
    def run(batches):
        pieces = loaded(PreTokenizer, path).pieces
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(pieces, part.column(0).to_pylist()), pa.int32())], ["piece", "n", "pieces"])

    return run


def pre_token_table(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``(piece, n, pieces)``: each distinct pre-token, how often the corpus has it, and how many tokens it becomes."""
    path = path or tokenizer_path()
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_count_pre_tokens(path), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(_count_pieces(path), "piece string, n long, pieces int")


def _frequencies(path: str, common):
    def run(batches):
        pre, known = loaded(PreTokenizer, path), common.value
        row = first_row()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, texts = part.column(0), part.column(1).to_pylist()
                rows: list[list] = [[], [], [], []]
                for t in texts:
                    t = t or ""
                    freq = Counter(pre.split(t))
                    n, rare, times = 0, [], []
                    for p, f in freq.items():
                        if (k := 1 if p.__class__ is int else known.get(p)) is not None:
                            n += k * f
                        else:
                            rare.append(p)
                            times.append(f)
                    for col, x in zip(rows, (len(t.encode("utf-8")), n, rare, times), strict=True):
                        col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(texts)), pa.int64()), ids, *map(pa.array, rows, kinds)], ["row", "doc_id", "n_bytes", "n_common", "rare", "times"])
                row += len(texts)

    return run


def token_counts(docs: DataFrame, path: str | None = None, dictionary: int = DICTIONARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for each row of ``docs``, with the whole text counted.

    A null text counts as empty (0 bytes, 0 tokens).  A null ``doc_id`` is kept.  Rows that repeat come out as often as they
    went in, each with a row number of its own on the way, so that however many equal rows never meet in one group.  (The number
    is the row's place in its partition: ``docs`` has to be read from a table, or made by a plan that a retry repeats.)  Special
    strings in a text count as one token each, as in the library.  Only the two named columns are read, so that others may have
    any name.  An empty table gives an empty result.
    """
    path = path or tokenizer_path()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = saved(pre_token_table(docs, path), "pre-tokens")
    least, top = frequent(pieces, "piece", "n", dictionary)
    common = docs.sparkSession.sparkContext.broadcast({r.piece: r.pieces for r in top.collect()})
    rest = pieces.where((F.col("n") < least) | (F.octet_length("piece") > 200)).select("piece", "pieces")
    freq = docs.mapInArrow(_frequencies(path, common), f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_common long, rare array<string>, times array<int>")
    rows = freq.select("row", "doc_id", "n_bytes", "n_common", F.posexplode_outer(F.arrays_zip("rare", "times")).alias("at", "x"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    rows = rows.select(
        # What belongs to the document goes with its first row alone.
        "row", *(F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_bytes", "n_common")), F.col("x.times").alias("times"),
        # A document without rare pre-tokens keeps one row; its key has a space, which no pre-token has, and spreads over the tasks.
        F.coalesce("x.rare", F.concat(F.lit(" "), F.col("row").cast("string"))).alias("piece"),
    )
    summed = rows.join(rest, "piece", "left").groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "n_bytes", "n_common")), F.sum(F.coalesce(F.col("pieces") * F.col("times"), F.lit(0)).cast("long")).alias("n_rare")
    )
    return summed.select("doc_id", "n_bytes", (F.col("n_common") + F.col("n_rare")).alias("n_tokens"))
