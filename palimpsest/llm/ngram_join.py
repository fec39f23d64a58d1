"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. Every document becomes its set of five-word shingles (64-bit hashes), and from it a set id (128 bits) and band hashes.  The
   numbers of bands and rows follow from the target recall at the threshold.
2. Documents of one set are one representative from here on, with its number of copies.
3. A shuffle on band hashes gives each bucket; buckets of the same members are one.  Each member is compared with its bucket's
   least one on the full sets (a star, never all pairs), and components of the links found are the first classes.
4. In buckets whose members are now in several classes, those outside the largest are compared with all of the bucket, in blocks:
   what a star can't see.  Components over all links are the classes.  Texts that only share a band by chance stay apart.
5. Links are counted inside classes, of all pairs, also those that no band brings together.  A class, like a bucket, is cut into
   blocks, and each pair of blocks is one task's work, of bounded memory, which gives one row for each member, not for each pair.
   In a large class sets are sent as what they lack of, and have beyond, a reference set R that its members resemble; then
   |A and B| = |R| - |lack A| - |lack B| + |lack A and lack B| + |more A and more B|, exactly, whatever R is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small
from .components import components
from .word_bpe import loaded

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Members of a block: a twentieth of the group between these bounds; and about the most shingles.
BLOCK, CELL_SHINGLES = (128, 4096), 8_000_000
#: Classes of so many members get a reference set, made of about REFERENCES of them.
LARGE, REFERENCES = 512, 32
#: The side of a tile of pairs that a task holds at once.
TILE = 2048


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows for which so many bands as reach the recall at the threshold need ``most`` hashes at most.

    A pair of similarity s meets in some band with probability 1 - (1 - s^rows)^bands; more rows mean fewer false candidates.
    """
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


class _Words(dict):
    """Hashes of words, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    def __init__(self, words: int):
        self.n, self.seen = words, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingles of a text; one of fewer words is one shingle, a null or wordless one none."""
        words = text.encode("utf-8").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(self.seen) > 300_000:
            self.seen.clear()
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def _set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


class Hasher:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20_240_607)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """The band hashes of a set."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            least = np.minimum(least, (np.multiply.outer(x[at : at + 2048], self.a) + self.b).min(axis=0))
        m, out = least.astype(np.uint64).reshape(self.bands, self.rows), np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            out = (out ^ m[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def _sketch(words: int, bands: int, rows: int):
    def run(batches):
        shingler, hasher = loaded(Shingler, words), loaded(Hasher, bands, rows)
        for b in batches:
            sid, n, keys = [], [], []
            for text in b.column(2):
                s = shingler(text.as_py())
                sid.append(_set_id(s) if len(s) else None)
                n.append(len(s))
                keys.append(hasher(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sid, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "sid", "n", "bands"])
        shingler.seen.clear()  # an idle worker holds no words

    return run


def _sets(words: int):
    """``(sid, data)`` from ``(sid, text)``: the full sets."""

    def run(batches):
        shingler = loaded(Shingler, words)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingler(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["sid", "data"])
        shingler.seen.clear()

    return run


def _linked(per_mille: int):
    """Of ``(a, b, x, y)`` those ``(a, b)`` whose sets x and y are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * 1000 >= per_mille * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _against(batches):
    """``(sid, data, r, lack)`` from ``(sid, data, ref)``: a set as it is, or against a reference set of size r, of which it lacks so many."""
    for b in batches:
        out: list[list] = [[], [], []]
        for data, ref in zip(b.column(1), b.column(2), strict=True):
            s, r, lack = np.frombuffer(data.as_buffer(), np.uint64), 0, 0
            if ref.is_valid:
                ref = np.frombuffer(ref.as_buffer(), np.uint64)
                missing = np.setdiff1d(ref, s, assume_unique=True)
                r, lack = len(ref), len(missing)
                s = np.concatenate((np.setdiff1d(s, ref, assume_unique=True) & ~np.uint64(1), missing | np.uint64(1)))
            for col, v in zip(out, (s.tobytes(), r, lack), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(out, (pa.binary(), pa.int64(), pa.int64()), strict=True))], ["sid", "data", "r", "lack"])


def _reference(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The shingles that at least half of some members have."""
    found, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("data")]), return_counts=True)
    # The last bit tells what is lacking from what is there, so that R keeps one of two shingles that differ in it alone.
    found = found[2 * n >= table.num_rows]
    found = found[np.unique(found >> np.uint64(1), return_index=True)[1]]
    return pa.table({"comp": pa.array([key[0].as_py()], pa.binary()), "ref": pa.array([found.tobytes()], pa.binary())})


def shared(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """How many columns each row of a shares with each row of b; both are (column, row) pairs sorted by column, and a number of rows."""
    (ca, ra, na), (cb, rb, nb) = a, b
    out = np.zeros(na * nb, np.float32)
    ua, sa, da = np.unique(ca, return_index=True, return_counts=True)
    ub, sb, db = np.unique(cb, return_index=True, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    sa, da, sb, db = sa[ia], da[ia], sb[ib], db[ib]
    wide = da.astype(np.int64) * db > max(64, na * nb // 100)
    # Few rows have the column: each pair of them is counted.
    fa, fda, fb, fdb = sa[~wide], da[~wide], sb[~wide], db[~wide]
    pairs = np.cumsum(fda.astype(np.int64) * fdb)
    cut = 0
    while cut < len(fa):
        end = max(cut + 1, int(np.searchsorted(pairs, (pairs[cut - 1] if cut else 0) + 4_000_000, "right")))
        x, dx, y, dy = fa[cut:end], fda[cut:end], fb[cut:end], fdb[cut:end]
        left = np.repeat(x, dx) + _within(dx)  # entries of a, each to be met with all of its column's in b
        times = np.repeat(dy, dx)
        i = np.repeat(ra[left], times)
        j = rb[np.repeat(np.repeat(y, dx), times) + _within(times)]
        out += np.bincount(i * nb + j, minlength=na * nb)
        cut = end
    out = out.reshape(na, nb)
    # Many have it: a product of matrices.
    wa, wda, wb, wdb = sa[wide], da[wide], sb[wide], db[wide]
    for cut in range(0, len(wa), 1024):
        x, dx, y, dy = wa[cut : cut + 1024], wda[cut : cut + 1024], wb[cut : cut + 1024], wdb[cut : cut + 1024]
        ma, mb = np.zeros((na, len(x)), np.float32), np.zeros((nb, len(x)), np.float32)
        ma[ra[np.repeat(x, dx) + _within(dx)], np.repeat(np.arange(len(x)), dx)] = 1
        mb[rb[np.repeat(y, dy) + _within(dy)], np.repeat(np.arange(len(x)), dy)] = 1
        out += ma @ mb.T
    return out


def _within(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def tile(self, linked: np.ndarray, i0: int, j0: int) -> None:
        """Join what a matrix of links between rows i0.. and j0.. connects: a breadth-first walk from each row not yet met."""
        todo = linked.any(1)
        while todo.any():
            start = int(todo.argmax())
            rows = np.zeros(len(todo), bool)
            rows[start] = True
            met = np.zeros(linked.shape[1], bool)
            front = rows.copy()
            while front.any():
                new = linked[front].any(0) & ~met
                met |= new
                front = linked[:, new].any(1) & ~rows
                rows |= front
            todo &= ~rows
            for i in np.flatnonzero(rows).tolist():
                self.join(i0 + start, i0 + i)
            for j in np.flatnonzero(met).tolist():
                self.join(i0 + start, j0 + j)


def _compare(threshold: float):
    per_mille = round(threshold * 1000)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sids, first = table.column("sid").to_pylist(), {}
        for k, s in enumerate(sids):
            first.setdefault(s, k)  # a set may come twice if its document does
        keep = [first[s] for s in sorted(first)]  # from the least on: the least of a component is its root
        get = lambda c: table.column(c).to_numpy()[keep]
        data = table.column("data")
        sets = [np.frombuffer(data[k].as_py(), np.uint64) for k in keep]
        side = get("block") if key[1].as_py() != key[2].as_py() else None
        links, root = compare(sets, get("n"), get("r"), get("lack"), get("copies"), per_mille, side)
        names = [sids[k] for k in keep]
        return pa.table({"sid": pa.array(names, pa.binary()), "links": pa.array(links), "root": pa.array([names[r] for r in root], pa.binary())})

    return run


def compare(sets: list[np.ndarray], n: np.ndarray, r: np.ndarray, lack: np.ndarray, copies: np.ndarray, per_mille: int, side: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """For each set its links to the others (their copies counted), and the first of those that its links reach.

    side: with it, only sets of different sides are compared.
    """
    links, union = np.zeros(len(sets), np.int64), _Union(len(sets))
    if side is None:
        tiles = [np.arange(at, min(at + TILE, len(sets))) for at in range(0, len(sets), TILE)]
        pairs = [(i, j) for i in range(len(tiles)) for j in range(i, len(tiles))]
    else:
        two = [np.flatnonzero(side == k) for k in np.unique(side)]
        tiles, of = [], []
        for k, members in enumerate(two):
            for at in range(0, len(members), TILE):
                tiles.append(members[at : at + TILE])
                of.append(k)
        pairs = [(i, j) for i in range(len(tiles)) for j in range(i + 1, len(tiles)) if of[i] != of[j]]
    order = np.concatenate(tiles) if tiles else np.zeros(0, np.int64)
    place = np.cumsum([0, *(len(t) for t in tiles)])
    entries: dict[int, tuple] = {}

    def listed(k: int) -> tuple:
        if k not in entries:
            if len(entries) > 2:  # no more than a few tiles are held in this form
                entries.clear()
            mine = [sets[x] for x in tiles[k]]
            column, row = np.concatenate(mine), np.repeat(np.arange(len(mine)), [len(x) for x in mine])
            by = np.argsort(column, kind="stable")
            entries[k] = (column[by], row[by], len(mine))
        return entries[k]

    for i, j in pairs:
        a, b = listed(i), listed(j)
        x, y = tiles[i], tiles[j]
        both = shared(a, b) + (r[x] - lack[x])[:, None] - lack[y][None, :]
        linked = both * 1000 >= per_mille * (n[x][:, None] + n[y][None, :] - both)
        if i == j:
            np.fill_diagonal(linked, False)
        links[x] += linked @ copies[y].astype(np.int64)
        if i != j:
            links[y] += copies[x].astype(np.int64) @ linked
        union.tile(linked, int(place[i]), int(place[j]))
    # The union numbers sets by their place in the tiles; what is asked for is the least set.
    least: dict[int, int] = {}
    for k, x in enumerate(order.tolist()):
        root = union.root(k)
        least[root] = min(least.get(root, x), x)
    out = list(range(len(sets)))
    for k, x in enumerate(order.tolist()):
        out[x] = least[union.root(k)]
    return links, out


def _blocks(count: Column, shingles: Column) -> Column:
    """Into how many blocks so many members with so many shingles are cut."""
    return F.greatest(F.ceil(count / F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), F.ceil(count / 20)))), F.ceil(shingles / CELL_SHINGLES), F.lit(1)).cast("int")


def _compared(rows: DataFrame, group: str, threshold: float) -> DataFrame:
    """``(sid, links, root)`` for ``(group, at, sid, copies, n, block, data, r, lack)``: at has the pairs ``(i, j)`` of blocks that a row is in."""
    cells = rows.withColumn("at", F.explode("at")).select(F.col(group).alias("of"), "at.i", "at.j", "sid", "copies", "n", "block", "data", "r", "lack")
    return cells.groupBy("of", "i", "j").applyInArrow(_compare(threshold), "sid binary, links long, root binary")


def _pairs_with(blocks: Column, own: Column) -> Column:
    return F.transform(blocks, lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))


def _beyond_stars(tied: DataFrame, first: DataFrame, full: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """``(a, b)``: links between members of a bucket that are in different classes by stars alone; None if no bucket has such."""
    placed = saved(tied.select("key", "sid").join(first.withColumnRenamed("v", "sid"), "sid"), "placed")
    mixed = saved(placed.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("key"), "mixed")
    if mixed.isEmpty():
        return None
    placed = saved(placed.join(mixed, "key").join(sets.select("sid", "n"), "sid"), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    parts = saved(parts.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("big"), F.max("m").alias("m"), F.max_by("s", F.struct("m", "root")).alias("s"), F.sum("m").alias("all_m"), F.sum("s").alias("all_s")), "parts")
    cut = parts.select("key", "big", _blocks(F.col("m"), F.col("s")).alias("gb"), _blocks(F.col("all_m") - F.col("m"), F.col("all_s") - F.col("s")).alias("go"))
    other = F.col("root") != F.col("big")
    h = F.xxhash64("sid")
    rows = placed.join(cut, "key").select("key", "sid", "n", other.alias("other"), "go", "gb", F.when(other, F.pmod(h, F.col("go"))).otherwise(F.col("go") + F.pmod(h, F.col("gb"))).cast("int").alias("block"))
    # Blocks 0..go-1 hold the members outside the largest class: they meet all blocks, the others meet only them.
    last = F.when(F.col("other"), F.col("go") + F.col("gb") - 1).otherwise(F.col("go") - 1)
    rows = rows.select("key", "sid", "n", "block", _pairs_with(F.sequence(F.lit(0), last), F.col("block")).alias("at"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("lack"))
    found = _compared(rows.join(full, "sid"), "key", threshold)
    return saved(found.where("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b")).distinct(), "more-links")


def _counted(classes: DataFrame, full: DataFrame, threshold: float, large: int) -> DataFrame:
    """``(sid, links)`` from ``(sid, comp, copies, n)``: how many rows each set is linked to in its class, copies counted."""
    sizes = saved(classes.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("s")).where("size > 1"), "sizes")
    members = saved(classes.join(sizes, "comp"), "members")
    # A class of two has the one link that made it.
    one = F.struct("sid", "copies")
    two = members.where("size = 2").groupBy("comp").agg(F.min(one).alias("x"), F.max(one).alias("y"))
    pairs = two.select(F.explode(F.array(F.struct("x.sid", F.col("y.copies").alias("links")), F.struct("y.sid", F.col("x.copies").alias("links")))).alias("p")).select("p.sid", "p.links")
    more = members.where("size > 2")
    # About REFERENCES members of each large class, by their hash, give its reference set.
    wanted = more.where((F.col("size") >= large) & (F.pmod(F.xxhash64("sid", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("size") / REFERENCES))) == 0))
    refs = saved(wanted.select("sid", "comp").join(full, "sid").groupBy("comp").applyInArrow(_reference, "comp binary, ref binary"), "references")
    asked = more.select("sid", "comp").join(full, "sid").join(small(refs), "comp", "left").select("sid", "data", "ref")
    sent = asked.mapInArrow(_against, "sid binary, data binary, r long, lack long")
    g = _blocks(F.col("size"), F.col("s"))
    block = F.pmod(F.xxhash64("sid"), g).cast("int")
    rows = more.select("comp", "sid", "copies", "n", block.alias("block"), _pairs_with(F.sequence(F.lit(0), g - 1), block).alias("at"))
    found = _compared(rows.join(sent, "sid"), "comp", threshold).groupBy("sid").agg(F.sum("links").alias("links"))
    return pairs.unionByName(found)


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, doc_id: str = "doc_id", text: str = "text", large: int = LARGE) -> DataFrame:
    """``(doc_id, class_id, n_links)``, one row for each row of ``docs``.

    Documents are linked if the Jaccard similarity of their word shingles is ``threshold`` or more; words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, and a text of fewer than ``words`` of them is one shingle.  A class is a component
    of links, its id the least doc_id in it; n_links is how many other rows a row is linked to, copies counted each.
    Null and wordless texts are linked to nothing and are their own class.  Null ids are kept; a class of null ids alone has a
    null id.  Repeated rows are copies.  Other columns aren't read.  An empty table gives an empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    per_mille = round(threshold * 1000)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()  # ids may be anything that has an order
    sketches = saved(docs.mapInArrow(_sketch(words, bands, rows), f"doc_id {kind}, h long, sid binary, n long, bands array<long>"), "sketches")
    # bands are the same for all rows of a set; max() serves to take one of them.
    some = sketches.where("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    sets = saved(some.select("sid", "rep.doc_id", "rep.h", "copies", "n", "bands"), "sets")
    members = sets.select("sid", "n", F.explode("bands").alias("key"))
    met = members.groupBy("key").agg(F.min(F.struct("sid", "n")).alias("c"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(7))).alias("y")).where("size > 1")
    # Written, so that the join may split what a frequent key brings into one task.
    buckets = saved(met.groupBy("size", "x", "y").agg(F.min("key").alias("key"), F.min("c").alias("c")).select("key", "c"), "buckets")
    tied = saved(members.join(buckets, "key").select("key", "sid", "n", F.col("c.sid").alias("b"), F.col("c.n").alias("nb")), "tied")

    needed = tied.select("sid").distinct().join(sets.select("sid", F.col("doc_id").alias("rep"), F.col("h").alias("rep_h")), "sid")
    if not sketches.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "h"])
    # Texts meet the members by a shuffle at every size: a broadcast that only small inputs get would hide what large ones cost.
    asked = docs.join(needed.hint("merge"), F.expr("doc_id <=> rep and h = rep_h"))
    full = saved(asked.select("sid", "text").mapInArrow(_sets(words), "sid binary, data binary"), "full")

    enough = F.least("n", "nb") * 1000 >= F.greatest("n", "nb") * per_mille
    ties = tied.where((F.col("sid") != F.col("b")) & enough).select(F.col("sid").alias("a"), "b").distinct()
    sided = ties.join(full.select(F.col("sid").alias("a"), F.col("data").alias("x")), "a").join(full.select(F.col("sid").alias("b"), F.col("data").alias("y")), "b").select("a", "b", "x", "y")
    links = saved(sided.mapInArrow(_linked(per_mille), "a binary, b binary"), "links")
    alone = tied.select(F.col("sid").alias("a"), F.col("sid").alias("b")).distinct()
    first = components(links.unionByName(alone))
    more = _beyond_stars(tied, first, full, sets, threshold)
    classes = first if more is None else components(links.unionByName(alone).unionByName(more))
    classes = saved(classes.select(F.col("v").alias("sid"), F.col("root").alias("comp")).join(sets.select("sid", "copies", "n"), "sid"), "classes")

    totals = _counted(classes, full, threshold, large)
    known = sets.select("sid", "doc_id", "copies").join(totals, "sid", "left").join(classes.select("sid", "comp"), "sid", "left")
    known = saved(known.select("sid", "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "sid").alias("root")), "classes")
    ids = saved(known.groupBy("root").agg(F.min("doc_id").alias("class_id")), "ids")
    by_set = known.join(ids, "root").select("sid", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = sketches.select("doc_id", "sid").join(by_set, "sid", "left")
    return out.select("doc_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
