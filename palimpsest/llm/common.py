"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.scratch import saved, shared_dir  # noqa: F401

#: Word separators of every operator here: the space and the ASCII controls \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
A_TO_Z, a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, A_TO_Z, a_to_z)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once for each row, however often ``use`` or its lambdas name it."""
    return F.transform(F.array(value), use)[0]


def apart(df: DataFrame) -> DataFrame:
    """``df`` behind a border for the optimiser: a filter above isn't pushed below it, where it would work out again, for each of
    its terms, all that its columns are made of."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__row")).select("__row.*")


#: The most bytes that a broadcast table may have.
BROADCAST_BYTES = 16_000_000


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, with a broadcast hint if what it holds is counted to take at most ``max_bytes``; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if (df.select(F.sum(_bytes(df))).first()[0] or 0) <= max_bytes else df


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row: strings and arrays by what they hold, 16 for each column and element besides."""

    def of(c: Column, kind) -> Column:
        name = kind.typeName()
        if name in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
        if name == "array":
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + of(x, kind.elementType)), F.lit(16).cast("long"))
        if name == "struct":
            return sum((of(c[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
        return F.lit(16).cast("long")

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files lie on this machine (the same on every executor)."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def first_row() -> int:
    """The number of a partition's first row: rows numbered from there on differ over the whole table.  For use in a Python task."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 40


def frequent(counts: DataFrame, key: str, count: str, most: int, max_bytes: int = 200) -> tuple[int, DataFrame]:
    """A threshold on ``count`` that at most ``most`` rows reach, and those rows (keys of up to ``max_bytes`` only).

    The rows are what a dictionary of bounded size may hold; whatever is left out has to go an exact way (a shuffled join).
    The threshold comes from a histogram of under 1,000 bins, so that no list of keys is sorted or collected for it.
    """
    bins = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("long")
    seen, at = 0, None
    for r in sorted(counts.groupBy(bins.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.b):
        seen += r.n
        if seen > most:
            break
        at = r.b
    # A threshold in counts, so that later filters need no logarithm: the least count that falls into bin `at`.
    least = 1 << 62 if at is None else next(c for c in range(max(1, int(2 ** (at / 16)) - 2), int(2 ** (at / 16)) + 4) if _bin(c) >= at)
    top = counts.where((F.col(count) >= least) & (F.octet_length(key) <= max_bytes))
    return least, top


def _bin(c: int) -> int:
    return math.floor(math.log2(c) * 16)
