"""Schemas, enumerations and settings of the event memory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Kinds of events, and of scopes of a consolidation.
EVENT_TYPES = ("decision", "observation", "insight", "error", "preference", "correction")
SCOPES = ("session", "day", "full")
DIRECTIONS = ("forward", "backward", "both")

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("importance", T.DoubleType()),
        T.StructField("associations", T.ArrayType(T.StringType())),
        T.StructField("consolidated", T.BooleanType()),
        T.StructField("decay_score", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Config:
    """half_life_days: of the decay; archive_threshold: scores below it are archived; index_max_chars: target of the index."""

    half_life_days: float = 30.0
    archive_threshold: float = 0.2
    index_max_chars: int = 5000
