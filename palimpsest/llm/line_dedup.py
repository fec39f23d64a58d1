"""Line deduplication by winnowing over line hashes.

Terms, for the non-blank lines of a document: the *gram* at a line is the shortest run of lines from there with
``GRAM_WORDS`` words or more; the *span* at a line is the shortest run from there with ``MIN_WORDS`` or more.

1. *Winnow*: of all grams inside a span, the one of least hash is a fingerprint (the rightmost of equals).  A run of
   ``MIN_WORDS`` words that two places share contains a span whose grams are equal in both, so both have the same fingerprint.
2. *Join positions*, of fingerprints that have more than one place.  Never are all pairs of a group made:
   - Where there are two places, each sends the lines around it: those before, and those behind, that make ``MIN_WORDS`` words.
   - Where there are more, the first may share less with a later one than another does.  The spans that selected the
     fingerprint are joined as a whole instead, each with its first occurrence in the corpus (documents in order of id).
3. *Extend*: two places are compared line by line to both sides.  What is sent is enough, however long the run is: a run has a
   fingerprint at most ``MIN_WORDS`` words from each of its lines, and what agrees up to the last line sent has so many words.
   Spans are joined at each of their lengths up to where the next one ends, so that the lines behind the last span count too.
4. *Delete*: runs of ``MIN_WORDS`` words or more go from the later place; the first occurrence stays.

DataFrame functions only.  What is shuffled is a few lines for each shared fingerprint, never a document for each of its partners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, bound, saved

GRAM_WORDS = 25
MIN_WORDS = 50
SPACES = " \t\n\x0b\x0c\r"


def line_arrays(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, no, hash, words)``, one row for each distinct (id, text): line numbers, hashes and word counts of non-blank lines."""
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.struct(i.alias("no"), F.xxhash64(s).alias("h"), F.regexp_count(s, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")))
    at = apart(docs.where(F.col("text").isNotNull()).select("doc_id", "h", F.filter(lines, lambda x: x["w"] > 0).alias("l"))).where(F.size("l") > 0)
    return at.select("doc_id", "h", F.col("l.no").alias("no"), F.col("l.h").alias("hash"), F.col("l.w").alias("words"))


def _until(words: int, i: Column) -> Column:
    """How many lines from index ``i`` on have that many words; null if the document ends before.

    Every line has a word, so that no more lines than words are looked at; mostly the next few are enough.
    """
    few = sum((F.coalesce(F.get("words", i + k), F.lit(0)) for k in range(1, 4)), F.get("words", i)) >= words
    begin = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct((a["w"] + x).alias("w"), (a["n"] + F.when(a["w"] < words, 1).otherwise(0)).alias("n"))
    return F.aggregate(F.slice("words", i + 1, F.when(few, 4).otherwise(words)), begin, step, lambda a: F.when(a["w"] >= words, a["n"]))


def fingerprints(lines: DataFrame, gram_words: int = GRAM_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``lines`` with ``(k, picked, sn)``: ``k`` has the winnowed places ``(key, at)``, sorted; for each line ``sn`` is the number of
    lines of the span from there and ``picked`` the place that the span selects, both null where no span begins."""
    own = ("doc_id", "h", "no", "hash", "words")
    index = lambda: F.sequence(F.lit(0), F.size("words") - 1)
    df = lines.select(*own, F.transform(index(), lambda i: _until(gram_words, i)).alias("gn"), F.transform(index(), lambda i: _until(min_words, i)).alias("sn"))
    grams = bound(F.struct("hash", "gn"), lambda v: F.transform(v["gn"], lambda n, i: F.when(n.isNotNull(), F.xxhash64(F.slice(v["hash"], i + 1, n)))))
    df = apart(df.select(*own, "gn", "sn", grams.alias("gram")))

    # Inside the span at i, the grams at i + k that end there too; the least, and of equals the last.  The arrays are bound
    # once for each row: a column that only a lambda names could otherwise be worked out anew for every element.
    def pick(v: Column) -> Column:
        inside = lambda i, n: F.filter(F.transform(F.slice(v["gram"], i + 1, n), lambda g, k: F.struct(g.alias("g"), (-(i + k)).alias("at"), (k + F.get(v["gn"], i + k)).alias("end"))), lambda x: x["end"] <= n)
        return F.transform(v["sn"], lambda n, i: F.when(n.isNotNull(), -F.array_min(inside(i, n))["at"]))

    df = apart(df.select(*own, "gram", "sn", bound(F.struct("gram", "gn", "sn"), pick).alias("picked")))
    keys = bound(F.struct("picked", "gram"), lambda v: F.transform(F.array_distinct(F.array_compact(v["picked"])), lambda i: F.struct(F.get(v["gram"], i).alias("key"), i.alias("at"))))
    return apart(df.select(*own, F.sort_array(keys).alias("k"), "picked", "sn")).where(F.size("k") > 0)


def _before(words: int, v: Column, at: Column) -> Column:
    """How many lines before ``at`` make so many words, or all that are there if they make fewer."""
    near = F.reverse(F.slice(v["words"], F.greatest(at - words, F.lit(0)) + 1, F.least(at, F.lit(words))))
    return _enough(words, near)


def _behind(words: int, v: Column, at: Column) -> Column:
    return _enough(words, F.slice(v["words"], at + 2, words))


def _enough(words: int, near: Column) -> Column:
    begin = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
    return F.aggregate(near, begin, lambda a, x: F.struct((a["w"] + x).alias("w"), (a["n"] + F.when(a["w"] < words, 1).otherwise(0)).alias("n")), lambda a: a["n"])


def shared_places(prints: DataFrame) -> DataFrame:
    """``prints``, of documents that share a fingerprint, with ``p``: its places ``(key, at, crowd)``; crowd: the key has three or more."""
    rows = prints.select("doc_id", "h", F.explode("k").alias("x")).select("doc_id", "h", "x.key", "x.at")
    # Written, so that a join may split what a frequent key brings into one task.
    counts = saved(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > 2).alias("crowd")), "keys")
    met = rows.join(counts, "key").groupBy(F.col("doc_id").alias("p_id"), F.col("h").alias("p_h")).agg(F.collect_list(F.struct("key", "at", "crowd")).alias("p"))
    return prints.join(met, F.expr("doc_id <=> p_id and h = p_h")).drop("p_id", "p_h", "k")


def crowded_runs(places: DataFrame) -> DataFrame:
    """``(doc_id, h, run)``: spans of crowded fingerprints that have an earlier occurrence."""

    def spans(v: Column) -> Column:
        ats = F.transform(F.filter(v["p"], lambda x: x["crowd"]), lambda x: x["at"])
        starts = F.filter(F.transform(v["sn"], lambda n, i: F.struct(i.alias("i"), n.alias("n"))), lambda x: x["n"].isNotNull() & F.array_contains(ats, F.get(v["picked"], x["i"])))
        # From line i on: the lines up to where the span from the next line ends belong to no other start.
        most = lambda x: F.greatest(x["n"], F.coalesce(F.get(v["sn"], x["i"] + 1), F.size(v["hash"]) - x["i"]))
        run = lambda x, m: _run(v["no"], x["i"], x["i"] + m - 1)
        return F.flatten(F.transform(starts, lambda x: F.transform(F.sequence(x["n"], most(x)), lambda m: F.struct(F.xxhash64(F.slice(v["hash"], x["i"] + 1, m)).alias("key"), run(x, m).alias("run")))))

    crowded = places.where(F.exists("p", lambda x: x["crowd"]))
    rows = crowded.select("doc_id", "h", F.explode(bound(F.struct("sn", "picked", "p", "hash", "no"), spans)).alias("x")).select("doc_id", "h", "x.key", "x.run")
    rows = saved(rows, "spans")
    place = F.struct("doc_id", "h", F.col("run.a").alias("a"))
    first = saved(rows.groupBy("key").agg(F.min(place).alias("src"), F.count("*").alias("n")).where("n > 1").select("key", "src"), "first-spans")
    later = ~(F.col("src.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("src.h") == F.col("h")) & (F.col("src.a") == F.col("run.a")))
    return rows.join(first, "key").where(later).select("doc_id", "h", "run")


def _run(no: Column, a: Column, b: Column) -> Column:
    """A run from the a-th to the b-th line that isn't blank, and the line numbers of those two."""
    return F.struct(a.alias("a"), b.alias("b"), F.get(no, a).alias("first"), F.get(no, b).alias("last"))


def paired_runs(places: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, h, run)``: what the later of two places of a fingerprint shares with the earlier, if it has enough words."""

    def around(v: Column) -> Column:
        def one(x: Column) -> Column:
            size = F.struct(x["key"].alias("key"), x["at"].alias("at"), _before(min_words, v, x["at"]).alias("nb"), _behind(min_words, v, x["at"]).alias("nf"))
            cut = lambda z, c: F.slice(v[c], z["at"] - z["nb"] + 1, z["nb"] + z["nf"] + 1)
            return bound(size, lambda z: F.struct(z["key"].alias("key"), z["at"].alias("at"), z["nb"].alias("nb"), cut(z, "hash").alias("hash"), cut(z, "words").alias("words"), cut(z, "no").alias("no")))

        return F.transform(F.filter(v["p"], lambda x: ~x["crowd"]), one)

    single = places.where(F.exists("p", lambda x: ~x["crowd"]))
    rows = single.select("doc_id", "h", F.explode(bound(F.struct("p", "hash", "words", "no"), around)).alias("x"))
    place = F.struct("doc_id", "h", "x.at", "x.nb", "x.hash", "x.words", "x.no")
    two = rows.groupBy(F.col("x.key").alias("key")).agg(F.min(place).alias("s"), F.max(place).alias("d"))
    rear = lambda c: F.reverse(F.slice(f"{c}.hash", F.lit(1), F.col(f"{c}.nb")))
    front = lambda c: F.slice(f"{c}.hash", F.col(f"{c}.nb") + 1, F.size(f"{c}.hash"))
    two = two.select("d", _agreeing(rear("s"), rear("d")).alias("eb"), _agreeing(front("s"), front("d")).alias("ef")).where("ef > 0")
    total = F.aggregate(F.slice("d.words", F.col("d.nb") - F.col("eb") + 1, F.col("eb") + F.col("ef")), F.lit(0), lambda s, w: s + w)
    begin, at = F.col("d.nb") - F.col("eb"), F.col("d.at") - F.col("eb")
    run = F.struct(at.alias("a"), (at + F.col("eb") + F.col("ef") - 1).alias("b"), F.get("d.no", begin).alias("first"), F.get("d.no", begin + F.col("eb") + F.col("ef") - 1).alias("last"))
    return two.where(total >= min_words).select("d.doc_id", "d.h", run.alias("run"))


def _agreeing(x: Column, y: Column) -> Column:
    """How many elements two arrays have in common from the start."""
    differ = F.array_position(F.zip_with(x, y, lambda s, t: F.coalesce(s == t, F.lit(False))), False)
    return F.when(differ == 0, F.size(x)).otherwise(differ - 1).cast("int")


def repeated_runs(lines: DataFrame, gram_words: int = GRAM_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, h, runs)``: for each document the runs ``(a, b, first, last)`` that occurred before, sorted."""
    if not lines.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        lines = lines.dropDuplicates(["doc_id", "h"])  # rows equal in id and text are one document
    prints = saved(fingerprints(lines, gram_words, min_words), "fingerprints")
    places = saved(shared_places(prints), "places")
    found = crowded_runs(places).unionByName(paired_runs(places, min_words))
    return found.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("run")).alias("runs"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), gram_words: int = GRAM_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, *keep, text, n_lines, n_deleted)`` for each row of ``docs``, the text without runs that occurred before.

    Before means: in a document of lower id (null ids come first; of equal ids, the lower text hash first), or earlier in the
    same document.  Rows equal in id and text are one document given more than once: they get equal results, and one doesn't
    count as a repeat of the other.  A null text stays null, with 0 lines.  n_lines counts the lines split at \\n, n_deleted
    those that go; blank lines inside a deleted run go with it.  An empty table gives an empty result.  keep: other columns to
    carry; no others are read.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), *(F.col(k).alias(f"__kept_{k}") for k in keep), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    lines = saved(line_arrays(given.select("doc_id", "h", "text")), "lines")
    runs = repeated_runs(lines, gram_words, min_words).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "runs")
    df = given.join(runs, F.expr("doc_id <=> __id and h = __h"), "left")
    # Runs become one sorted list of disjoint stretches, so that lines and stretches are gone through once.
    none = F.array().cast("array<struct<a:int,b:int,first:int,last:int>>")
    kept = ("doc_id", *(f"__kept_{k}" for k in keep))
    df = df.select(*kept, "text", F.coalesce("runs", none).alias("runs"))
    merged = F.aggregate("runs", none, lambda a, r: F.when(F.size(a) == 0, F.array(r)).otherwise(_merged(a, r)))
    df = apart(df.select(*kept, "text", merged.alias("runs")))
    lines_of = F.split("text", "\n")
    # What lies between two stretches is cut out as a slice: its length is at least 0.
    stretches = F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")))
    edges = F.concat(F.array(F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))), stretches)
    df = df.select(*kept, "text", "runs", lines_of.alias("lines"), edges.alias("edges"))
    parts = F.flatten(F.transform("edges", lambda r, i: F.slice("lines", r["last"] + 2, F.coalesce(F.get("edges", i + 1)["first"], F.size("lines")) - r["last"] - 1)))
    deleted = F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    return apart(df.select(
        "doc_id", *(F.col(f"__kept_{k}").alias(k) for k in keep), F.when(F.size("runs") == 0, F.col("text")).otherwise(F.array_join(parts, "\n")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), deleted.alias("n_deleted"),
    ))


def _merged(a: Column, r: Column) -> Column:
    """Runs that overlap or follow each other, with at most blank lines between, become one."""
    last = F.element_at(a, -1)
    beyond = r["b"] > last["b"]
    joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"), last["first"].alias("first"), F.when(beyond, r["last"]).otherwise(last["last"]).alias("last"))
    return F.when(r["a"] <= last["b"] + 1, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(r)))
