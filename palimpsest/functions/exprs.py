"""Scalar functions as column expressions: they stay inside Catalyst and whole-stage code generation.

None of them reads a clock: what is relative to now takes the time as an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: The weights of a score, and the number of links that counts in full.
W_SEARCH, W_IMPORTANCE, W_LINKS, FULL_LINKS, DEFAULT_SEARCH = 0.60, 0.25, 0.15, 5, 0.5
#: What stands for a confidence given as a word, and for one that can't be read.
CONFIDENCE_WORDS = {"high": 0.9, "medium": 0.6, "low": 0.3}
CONFIDENCE_DEFAULT = 0.5
#: Words that make a conversation worth recording.
TRIGGERS = ("decided", "preference", "remember", "prefer", "决定", "偏好", "记住", "以后都", "不要", "喜欢")


def _col(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def round4(x: Column) -> Column:
    """Four decimals, halves up.  Not ``round``, which goes by the decimal digits and so differs on some doubles."""
    return F.floor(x * 10000 + 0.5) / F.lit(10000.0)


def decay_multiplier(age: Column | str, half_life: float = 30.0) -> Column:
    return F.exp(-(F.log(F.lit(2.0)) / F.lit(float(half_life))) * _col(age))


def apply_decay(score: Column | str, age: Column | str, half_life: float = 30.0) -> Column:
    return round4(_col(score) * decay_multiplier(age, half_life))


def age_in_days(ts: Column | str, reference: Column) -> Column:
    """Whole blocks of 24 hours from ``ts`` to the reference, at least 0; null if either is."""
    ms = F.unix_millis(reference.cast("timestamp")) - F.unix_millis(_col(ts).cast("timestamp"))
    days = F.floor(ms / DAY_MS).cast("long")
    return F.when(days < 0, F.lit(0).cast("long")).otherwise(days)


def compute_score(importance: Column | str, links: Column | str, search: Column | float = DEFAULT_SEARCH) -> Column:
    """0.60 search + 0.25 importance (within 0..1) + 0.15 links / 5 (at most 1), to four decimals; null if an argument is."""
    imp, n = _col(importance), _col(links)
    inside = F.when(imp < 0, F.lit(0.0)).when(imp > 1, F.lit(1.0)).otherwise(imp)
    full = F.when(n > FULL_LINKS, F.lit(1.0)).otherwise(n / F.lit(float(FULL_LINKS)))
    return round4(F.lit(W_SEARCH) * _col(search) + F.lit(W_IMPORTANCE) * inside + F.lit(W_LINKS) * full)


def event_id(day: Column | str, seq: Column | str) -> Column:
    """``evt_YYYYMMDD_NNN``: at least three digits, never fewer than the number has."""
    return F.concat(F.lit("evt_"), F.date_format(_col(day), "yyyyMMdd"), F.lit("_"), F.format_string("%03d", _col(seq)))


def trimmed(text: Column | str) -> Column:
    """Without white space of any script, byte order marks included, at either end."""
    return F.regexp_replace(_col(text), r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def is_unconsolidated(c: Column | str = "consolidated") -> Column:
    return ~F.coalesce(_col(c), F.lit(False))


def number_prefix(text: Column) -> Column:
    """The number that a text begins with, as a lenient parser reads it; null without one."""
    return F.regexp_extract(text, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")


def confidence(content: Column | str) -> Column:
    """The confidence an entry states: a number, or high, medium or low in lower case; 0.5 where it states none, or 0."""
    found = F.nullif(F.regexp_extract(_col(content), r"(?i)\*\*Confidence\*\*:\s*([\d.]+|high|medium|low)", 1), F.lit(""))
    number = number_prefix(found)
    out = F.when((number.isNull()) | (number == 0), F.lit(CONFIDENCE_DEFAULT)).otherwise(number)
    for word, value in CONFIDENCE_WORDS.items():
        out = F.when(found == word, F.lit(value)).otherwise(out)
    return F.coalesce(out, F.lit(CONFIDENCE_DEFAULT))


def associations(content: Column | str) -> Column:
    """Ids on the first line of associations: tokens between commas and spaces that begin with ke_ or evt_."""
    line = F.regexp_extract(_col(content), r"(?i)\*\*Associations?\*\*:\s*(.+)", 1)
    return F.filter(F.split(line, r"[,\s]+"), lambda s: s.startswith("ke_") | s.startswith("evt_"))


def shortened(text: Column | str, most: int = 300) -> Column:
    c = _col(text)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def has_trigger(user: Column, assistant: Column, words: tuple[str, ...] = TRIGGERS) -> Column:
    """Whether either text has one of the words anywhere, whatever the case."""
    both = F.lower(F.concat(F.coalesce(user, F.lit("")), F.lit("\n"), F.coalesce(assistant, F.lit(""))))
    out = F.lit(False)
    for w in words:
        out = out | both.contains(w)
    return out


def stack_usage(path: Column | str, pending: Column | str) -> Column:
    size = lambda c: F.when(_col(c).isNull(), 0).otherwise(F.size(_col(c)))
    return size(path) + 1 + size(pending)


def view_limits(n_path: Column, n_pending: Column, slots: int = 7) -> tuple[Column, Column]:
    """How many steps of the path (the last) and of what is pending (the first) a view of so many slots shows, the focus taking one."""
    path = F.least(F.lit(3), n_path)
    room = F.lit(slots - 1) - path
    pending = F.least(room, n_pending)
    return F.least(n_path, path + room - pending), pending


#: The functions as SQL sees them.
SQL_FUNCTIONS = {
    "mem_round4(x DOUBLE) RETURNS DOUBLE": "floor(x * 10000 + 0.5D) / 10000D",
    "mem_decay(score DOUBLE, age BIGINT, half_life DOUBLE) RETURNS DOUBLE": "floor(score * exp(-(ln(2D) / half_life) * age) * 10000 + 0.5D) / 10000D",
    "mem_age_days(ts TIMESTAMP, reference TIMESTAMP) RETURNS BIGINT": "greatest(0L, cast(floor((unix_millis(reference) - unix_millis(ts)) / 86400000D) as bigint))",
    "mem_score(importance DOUBLE, links BIGINT, search DOUBLE) RETURNS DOUBLE": "floor((0.60D * search + 0.25D * greatest(0D, least(1D, importance)) + 0.15D * least(1D, links / 5D)) * 10000 + 0.5D) / 10000D",
    "mem_event_id(day DATE, seq BIGINT) RETURNS STRING": "concat('evt_', date_format(day, 'yyyyMMdd'), '_', format_string('%03d', seq))",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions available to SQL as temporary functions; returns their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.partition("(")[0] for s in SQL_FUNCTIONS]
