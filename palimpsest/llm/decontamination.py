"""Benchmark decontamination with a distributed positional inverted index.

1. Windows of the benchmark (8 consecutive words of an item, or all words of a shorter one) are made.  Items of equal words are one
   from here on.
2. The corpus frequency of every benchmark term is counted over all documents.  The ``ANCHORS`` rarest terms of each window are to
   be looked for.
3. The index stores postings ``(term, document, position)`` of those terms.
4. Lists are intersected along diagonals: a posting of a term that an item has at some offset speaks for the item's beginning at
   (position - offset).  Postings of one document, item and beginning meet in one group of bounded size, as bits by offset; a window
   is a candidate if the bits of all its anchors are there.
5. What is left is few: only there are the words of the document looked up and compared with the whole window.

A passage that many documents share makes long lists, but a list is only met with the few places of the benchmark that have its
term.  Tables of the benchmark are broadcast up to a number of bytes and joined by a shuffle beyond it.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, bound, lower_ascii, saved, small

#: Words of a window.
WINDOW = 8
#: How many of a window's terms are looked for in the index, and of an item's for proximity.
ANCHORS, NEAR_TERMS = 2, 3
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lowered, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``; none if it is null."""
    # lower() is quicker and says the same where a text has ASCII characters only.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BREAKS), "")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, h, text)``.  The hash keeps apart rows of one id with different texts; rows equal in both have equal results."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def benchmark_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(tid, words, items)``: the distinct word lists of the benchmark, each with the sorted ids (as strings) of its items."""
    w = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    return w.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.xxhash64("words").alias("tid"), "words", "items")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n)``: how often the documents have each of the given terms; 0 where none has it."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    met = tokens.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(met, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchored_windows(items: DataFrame, counts: DataFrame, size: int = WINDOW, how_many: int = ANCHORS) -> DataFrame:
    """``(tid, at, length, words, anchors)``: the windows that may occur, at their offset in the item; anchors are the
    ``(term, offset)`` of the rarest terms.

    Windows with a term that no document has are dropped: they can't occur.  ``size`` is 56 at most.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - size))
    w = items.select("tid", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("words", i + 1, size).alias("words")))).alias("w")).select("tid", "w.at", "w.words")
    each = w.select("tid", "at", "words", F.posexplode("words").alias("k", "term")).join(small(counts), "term")
    ranked = each.groupBy("tid", "at").agg(F.first("words").alias("words"), F.sort_array(F.collect_list(F.struct("n", "k", "term"))).alias("a")).where(F.col("a")[0]["n"] > 0)
    rarest = F.transform(F.slice("a", 1, how_many), lambda x: F.struct(x["term"].alias("term"), (F.col("at") + x["k"]).alias("offset")))
    return ranked.select("tid", "at", F.size("words").alias("length"), "words", rarest.alias("anchors"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, doc_id, h, pos)``: where documents have the terms."""
    tokens = docs.select("doc_id", "h", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return tokens.join(small(terms), "term").select("term", "doc_id", "h", "pos")


def candidates(index: DataFrame, windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(doc_id, h, tid, begin, ats)``: places where a document has all anchors of windows, by intersecting their lists.

    ``ats`` are the windows' offsets in the item, which would begin at ``begin``.
    """
    group = 64 - size  # a group holds the windows that begin in so many offsets: they end within 63
    named = windows.select("tid", F.explode("anchors").alias("a")).select("a.term", "tid", "a.offset").distinct()
    met = index.join(small(named), "term").select("doc_id", "h", "tid", (F.col("pos") - F.col("offset")).alias("begin"), "offset")
    # An offset counts for the windows that begin in its group, and near the head of a group for those of the group before too.
    own = F.floor(F.col("offset") / group).cast("int")
    groups = F.when((F.col("offset") % group < size - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    met = met.select("doc_id", "h", "tid", "begin", "offset", F.explode(groups).alias("g"))
    found = met.groupBy("doc_id", "h", "tid", "begin", "g").agg(F.bit_or(F.expr(f"shiftleft(1L, offset - g * {group})")).alias("bits"))
    place = F.floor(F.col("at") / group).cast("int").alias("g")
    need = F.aggregate("anchors", F.lit(0).cast("long"), lambda m, a: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (a["offset"] - F.col("g") * group).cast("int"))))
    asked = windows.select("tid", "at", "anchors", place).select("tid", "at", "g", need.alias("need"))
    least = asked.agg(F.min(F.bit_count("need"))).first()[0] or 0  # most groups hold fewer bits than any window needs
    met = found.where(F.bit_count("bits") >= least).join(small(asked), ["tid", "g"])
    met = met.where((F.col("bits").bitwiseAND(F.col("need")) == F.col("need")) & (F.col("begin") + F.col("at") >= 0))
    return met.groupBy("doc_id", "h", "tid", "begin").agg(F.sort_array(F.collect_set("at")).alias("ats"))


def proximity_matches(
    docs: DataFrame, items: DataFrame, slop: int = 20, terms: int = NEAR_TERMS, least: int = 2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(doc_id, item, n_terms)``: documents in which ``least`` or more of the rarest ``terms`` distinct terms of an item lie within
    ``slop`` words of one of them, with the most that do.

    Rarest: by the corpus count, then by spelling, of the terms that documents have.  An item with fewer terms needs all that it
    has, but two at least.  Null ids of items match nothing; documents of equal id and text are one.
    """
    docs = _keyed(docs, doc_id, text)
    known = saved(benchmark_items(items, item_id, item_text), "items")
    own = saved(known.select("tid", F.explode(F.array_distinct("words")).alias("term")), "item-terms")
    counts = saved(term_counts(docs, own.select("term").distinct()), "term-counts")
    ranked = own.join(small(counts.where("n > 0")), "term").groupBy("tid").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term"))), 1, terms).alias("a")).where(F.size("a") > 1)
    named = saved(ranked.select("tid", F.least(F.lit(least), F.size("a")).alias("least"), F.posexplode("a").alias("k", "x")).select("tid", "least", "k", "x.term"), "near-terms")
    index = saved(postings(docs, named.select("term").distinct()), "postings")
    # Each place, at its block of slop + 1 words and as a neighbour of the blocks beside it: all that lies within the slop meets there.
    size = slop + 1
    block = F.floor(F.col("pos") / size)
    at = index.join(small(named), "term").select("doc_id", "h", "tid", "least", "k", "pos", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    # A block has 3 (slop + 1) places at most, so a group is bounded whatever the document.
    met = at.groupBy("doc_id", "h", "tid", "block").agg(F.max("least").alias("least"), F.collect_set(F.struct("pos", "k")).alias("x")).where(F.size("x") > 1)
    near = lambda p: F.size(F.array_distinct(F.transform(F.filter("x", lambda y: F.abs(y["pos"] - p["pos"]) <= slop), lambda y: y["k"])))
    most = F.array_max(F.transform(F.filter("x", lambda p: F.floor(p["pos"] / size) == F.col("block")), near))
    done = met.select("doc_id", "h", "tid", "least", most.alias("n")).where(F.col("n") >= F.col("least")).groupBy("doc_id", "h", "tid").agg(F.max("n").cast("long").alias("n_terms"))
    return done.join(small(known.select("tid", "items")), "tid").select("doc_id", F.explode("items").alias("item"), "n_terms")


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, h, at)``: for each document with candidates, all of them as ``(places, words, items)`` with places ``(begin, ats)``; ``h`` is the text's xxhash64.

    They have the anchors of windows in their places; whether the other words agree too is for the caller to see, who has the text.
    """
    docs = _keyed(docs, doc_id, text)
    known = saved(benchmark_items(items, item_id, item_text), "items")
    counts = saved(term_counts(docs, known.select(F.explode("words").alias("term")).distinct()), "term-counts")
    windows = saved(anchored_windows(known, counts, size), "windows")
    index = saved(postings(docs, windows.select(F.explode("anchors.term").alias("term")).distinct()), "postings")
    found = saved(candidates(index, windows, size), "candidates")
    # An item's words come once for each document, however often it has them.
    placed = found.groupBy("doc_id", "h", "tid").agg(F.collect_list(F.struct("begin", "ats")).alias("places")).join(small(known), "tid")
    return placed.groupBy("doc_id", "h").agg(F.collect_list(F.struct("places", "words", "items")).alias("at"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, n_words, n_hit, items)`` for each row of ``docs``.

    n_hit: words inside an occurrence of a window; items: sorted ids, as strings, of the items that have such a window.
    A null text has no words, a null item id isn't looked for, an item without words has no window; without a benchmark
    everything is clean, and an empty table gives an empty result.  Repeated rows and null ids stay as they are; of windows with
    equal words each counts, and terms equally rare are taken by their place.  keep: other columns of ``docs`` to carry; no more
    are read, so that their names can't clash.
    """
    found = matches(docs, items, size, doc_id, text, item_id, item_text).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("at").alias("__at"))
    kept = [F.col(k).alias(f"__kept_{k}") for k in keep]
    own = docs.select(F.col(doc_id).alias("doc_id"), *kept, F.xxhash64(text).alias("__text_h"), F.col(text).alias("__text"))
    kept = [f"__kept_{k}" for k in keep]

    # Candidates are compared where the words are; most documents have none.
    def verified(w: Column, x: Column) -> Column:
        n = F.least(F.lit(size), F.size(x["words"]))

        def starts(p: Column) -> Column:
            same = F.filter(p["ats"], lambda at: F.slice(w, p["begin"] + at + 1, n) == F.slice(x["words"], at + 1, n))
            return F.transform(same, lambda at: F.struct((p["begin"] + at).alias("start"), n.alias("length")))

        return F.struct(F.flatten(F.transform(x["places"], starts)).alias("places"), x["items"].alias("items"))

    done = bound(F.struct(words_of(F.col("__text")).alias("w"), F.col("__at").alias("at")), lambda v: F.struct(F.size(v["w"]).cast("long").alias("n"), F.filter(F.transform(v["at"], lambda x: verified(v["w"], x)), lambda x: F.size(x["places"]) > 0).alias("hits")))
    out = own.join(found, F.expr("doc_id <=> __id and __text_h = __h"), "left").select("doc_id", *kept, done.alias("__done"))
    out = apart(out).select("doc_id", *kept, F.col("__done.n").alias("n_words"), F.col("__done.hits").alias("__hits"))
    begin = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))

    def over(a: Column, x: Column) -> Column:
        stop = x["start"] + x["length"]
        return F.struct(F.greatest(a["stop"], stop).alias("stop"), (a["n"] + F.greatest(stop - F.greatest(a["stop"], x["start"]), F.lit(0))).alias("n"))

    covered = F.aggregate(F.sort_array(F.flatten(F.transform("__hits", lambda x: x["places"]))), begin, over, lambda a: a["n"])
    items_of = F.sort_array(F.array_distinct(F.flatten(F.transform("__hits", lambda x: x["items"]))))
    return out.select(
        "doc_id", *(F.col(f"__kept_{k}").alias(k) for k in keep), "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(items_of, F.array().cast("array<string>")).alias("items")
    )
