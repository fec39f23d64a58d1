"""Quality rules as a ledger of bits.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for each rule that fails.  A
policy is a mask over those bits with a version, so that policies can be changed, compared and taken apart afterwards without
reading a text again: :func:`apply_policies` applies any number of them, :func:`ablations` says what each rule alone costs, from
counts by bit pattern.

All of it is DataFrame functions.  The words of a text are handled inside its row: nothing is exploded or shuffled.  The one
exception is :func:`toxic_terms`, which learns the terms of toxic texts in each language from labels: there the words of labelled
texts are counted by a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, saved, small

#: What is counted as a symbol, and terms of abuse.
SYMBOLS = r"[#*$%&|<>]"
ABUSE = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SPACES = " \t\n\x0b\x0c\r"
#: What makes a word a toxic term of a language: the least number of its toxic texts with the word, their least share, and how many
#: times the share of clean texts that is.  The least share bounds the number of terms, whatever the corpus.
TERM_TEXTS, TERM_SHARE, TERM_RATIO = 4, 0.1, 20


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, an SQL condition over the measurements, is true."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
    Rule(5, "capitals", "100 * n_capitals > 35 * word_chars"),
    Rule(6, "abuse", "n_abuse >= 2 and 500 * n_abuse > n_words"),
)
#: Holds only where terms are given to :func:`ledger`.
TOXIC = Rule(7, "toxic_terms", "n_toxic_terms >= 2")
#: The rules that fail a document by contract, whatever the policy.
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Reject a document if more than ``tolerance`` of the named rules fail."""

    version: str
    rules: tuple[str, ...]
    tolerance: int = 0

    def mask(self) -> int:
        bits = {r.name: r.bit for r in (*RULES, TOXIC)}
        return sum(1 << bits[n] for n in self.rules)

    def keeps(self, bits: Column) -> Column:
        return F.bit_count(bits.bitwiseAND(F.lit(self.mask()).cast("long"))) <= self.tolerance


POLICIES = (Policy("v1", BASE), Policy("v2", tuple(r.name for r in RULES)))
#: For ledgers with toxic terms.
LABELLED = Policy("v3", (*POLICIES[-1].rules, TOXIC.name))


def _terms(text: Column) -> Column:
    """The different words of a text, in lower case: letters and digits of any script."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+")), "")


def toxic_terms(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, terms)`` for each language that has any: the words that are frequent in its toxic texts and rare in its clean ones.

    labels: ``(doc_id, toxic)``.  An id is toxic if any of its labels is; ids and labels that are null say nothing.  Equal texts
    count once, as toxic if one of them is.  A null language is one more language.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).where("text is not null").join(small(known), "__id")
    # Of equal texts in a language one id speaks, and of its rows each for its share: words are then added up where they are read.
    ids = texts.groupBy("lang", "h", "__id").agg(F.max("toxic").alias("toxic"), F.count("*").alias("rows"))
    heads = ids.groupBy("lang", "h").agg(F.min("__id").alias("head"), F.min_by("rows", "__id").alias("rows"), F.max("toxic").alias("any_toxic"))
    heads = saved(heads.select(F.col("lang").alias("__lang"), F.col("h").alias("__h"), "head", "rows", "any_toxic"), "heads")
    every = heads.groupBy(F.col("__lang").alias("lang")).agg(F.sum("any_toxic").cast("long").alias("toxic"), (F.count("*") - F.sum("any_toxic")).cast("long").alias("clean"))
    once = texts.drop("toxic").join(small(heads), F.expr("lang <=> __lang and h = __h and __id = head"))
    share = lambda c: F.round(F.sum(c / F.col("rows"))).cast("long")
    words = once.select("lang", "rows", "any_toxic", F.explode(_terms(F.col("text"))).alias("word")).groupBy("lang", "word").agg(share(F.col("any_toxic")).alias("t"), share(1 - F.col("any_toxic")).alias("c")).where(F.col("t") >= TERM_TEXTS)
    # Half a text more than seen, so that a word that no clean text has needs evidence too.
    found = words.alias("w").join(small(every).alias("e"), F.col("w.lang").eqNullSafe(F.col("e.lang"))).where(
        (F.col("t") >= TERM_SHARE * F.col("toxic")) & (F.col("t") * F.col("clean") >= TERM_RATIO * (F.col("c") + 0.5) * F.col("toxic"))
    ).select("w.lang", "word")
    return saved(found.groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("terms")), "terms")


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES, terms: DataFrame | None = None, lang: str = "lang", abuse: tuple[str, ...] = ABUSE) -> DataFrame:
    """``(doc_id, *keep, <measurements>, fail_bits)`` for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Measurements: n_words; word_chars (code points in words); n_symbols; n_lines (of those
    split at \\n, the ones with a word); n_dup_lines (those equal to an earlier one); n_repeat_words (words in 3-word windows
    found twice or more in the text, the first included); n_capitals (A-Z); n_abuse (the words given as ``abuse``).
    A null or empty text has 0 everywhere.  Repeated rows and null ids stay as they are; an empty table gives an empty result.
    keep: other columns of ``docs`` to carry; the rest is not read, so its names can't clash.
    terms: what :func:`toxic_terms` has found.  Then there is one more measurement, n_toxic_terms (different terms of the document's
    language), and one more rule, ``TOXIC``.
    """
    given = [F.col(doc_id).alias("doc_id"), *(F.col(k).alias(f"__kept_{k}") for k in keep)]
    through = ["doc_id", *(f"__kept_{k}" for k in keep)]
    if terms is not None:
        given.append(F.col(lang).alias("__lang"))
    df = docs.select(*given, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    if terms is not None:
        known = small(terms.select(F.col("lang").alias("__of"), F.col("terms").alias("__terms")))
        n_terms = F.coalesce(F.size(F.array_intersect(_terms(F.col("__text")), "__terms")), F.lit(0)).cast("long")
        df = df.join(known, F.col("__lang").eqNullSafe(F.col("__of")), "left").select(*through, "__text", F.when(F.col("__terms").isNull(), F.lit(0)).otherwise(n_terms).cast("long").alias("n_toxic_terms"))
        through, rules = [*through, "n_toxic_terms"], (*rules, TOXIC)
    trimmed = F.trim(F.col("__text"), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("__text", "\n"), lambda s: F.trim(s, F.lit(SPACES)) != "")
    df = df.select(
        *through, words.alias("__words"), lines.alias("__lines"), F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("__text", F.lit("[A-Z]")).cast("long").alias("n_capitals"), F.regexp_count("__text", F.lit(r"(?i)\b(" + "|".join(map(re.escape, abuse)) + r")\b")).cast("long").alias("n_abuse"),
    )
    through += ["n_symbols", "n_capitals", "n_abuse"]
    n = F.size("__words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))).otherwise(F.array().cast("array<long>"))
    df = df.select(
        *through, n.cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"), F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), windows.alias("__windows"),
    )
    through += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    # Equal windows lie side by side once sorted with their places; most texts have none, and are not sorted.
    pairs = F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:long,i:int>>"))
    df = df.select(*through, pairs.alias("__pairs"))
    again = F.filter("__pairs", lambda s, k: F.coalesce(s["h"] == F.get("__pairs", k - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get("__pairs", k + 1)["h"], F.lit(False)))
    df = df.select(*through, F.sort_array(F.transform(again, lambda s: s["i"])).alias("__at"))
    # A window covers three words, less what the next one covers too.
    covered = F.aggregate(F.transform("__at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.select(*through, covered.cast("long").alias("n_repeat_words"))
    through += ["n_repeat_words"]
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return apart(df.select("doc_id", *(F.col(f"__kept_{k}").alias(k) for k in keep), *through[1 + len(keep) :], bits.alias("fail_bits")))


def base_failed(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(Policy("base", BASE).mask()).cast("long")) != 0


def apply_policies(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with a column ``kept_<version>`` for each policy."""
    return entries.withColumns({f"kept_{p.version}": p.keeps(F.col("fail_bits")) for p in policies})


def ablations(entries: DataFrame, policy: Policy = LABELLED, rules: tuple[Rule, ...] = (*RULES, TOXIC)) -> DataFrame:
    """``(version, rule, n_failed, n_only, n_kept_without)`` for each rule of a policy.

    n_failed: documents in which the rule fails; n_only: those it alone rejects; n_kept_without: documents kept without it.
    Documents are first counted by bit pattern, so what is compared has at most 2^rules rows whatever the corpus.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    mine = [r for r in rules if r.name in policy.rules]
    out = patterns.select("fail_bits", "n", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in mine))).alias("r"))
    bits, bit = F.col("fail_bits"), F.col("r.bit")
    mask = F.lit(policy.mask()).cast("long")
    without = F.bit_count(bits.bitwiseAND(mask.bitwiseAND(F.bitwise_not(bit)))) <= policy.tolerance
    counted = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("long")
    return out.groupBy(F.col("r.rule").alias("rule")).agg(
        counted(bits.bitwiseAND(bit) != 0).alias("n_failed"), counted(without & ~policy.keeps(bits)).alias("n_only"), counted(without).alias("n_kept_without")
    ).select(F.lit(policy.version).alias("version"), "rule", "n_failed", "n_only", "n_kept_without")
