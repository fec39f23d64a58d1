"""Language-model scores from a Brown class-based bigram model.

    P(word | word before) = P(class | class before) * P(word | class)

Training gathers from all training texts; what the driver and each worker hold is bounded by parameters, never by the corpus:

1. *Counts* of every word, as a table.  The ``DICTIONARY`` most frequent form a dictionary; texts are written once as its ids, with
   the other words beside them.
2. *Exchange clustering of the dictionary*: bigrams are counted over all texts and dealt out by word.  The ``CORE`` most frequent words
   are clustered first, word by word, on the driver.  Then come distributed rounds over all words of ``LEAST`` occurrences or more:
   every task has the classes and the matrix of class bigrams, and moves its words to where the likelihood gains most; half of the
   words may move in a round, and a round that makes the corpus less likely is taken back.
3. *All other words* of so many occurrences, however many there are, are exchanged once, each on its own, against the classes of their
   neighbours; they stay a table.  Only words that occur once, or never next to a word with a class, are in one of four residual
   classes by their spelling.
4. *Transitions* between classes are counted over all texts and smoothed by addition.

Scoring looks words up in the dictionary and sends all others through a shuffled join with the table of their classes and counts, so
that every word counts with its own, however rare.
"""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.scratch import temporary_tables
from .common import first_row, frequent, saved

#: Bounds of what the driver and each executor hold.
DICTIONARY, CORE, CLASSES = 1 << 17, 1024, 128
#: Occurrences from which a word is clustered, and rounds of the distributed exchange.
LEAST, ROUNDS = 2, 2
#: Added to the count of every class transition.
SMOOTHING = 0.5
#: Words, and bytes of words, that a task gathers before it passes their counts on.
FLUSH, FLUSH_BYTES = 400_000, 1 << 26
#: What ends a phrase.
CLOSING = ".,;:!?)\"'"
_CLOSING = frozenset(CLOSING.encode())
RESIDUAL = 4
#: Words whose gains a task works out at once: of the dictionary, which have many classes beside them, and of the others.
MOVED, CHUNK = 128, 512


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, with A-Z lowered."""
    return text.encode("utf-8").lower().split() if text else []


def _residual(word: bytes) -> int:
    return 2 * (not word.isascii()) + (word[-1] in _CLOSING)


def _residual_sql(word: Column) -> Column:
    return F.when(F.octet_length(word) != F.length(word), 2).otherwise(0) + F.when(F.right(word, F.lit(1)).isin(*CLOSING), 1).otherwise(0)


def _count_words(batches):
    seen: Counter = Counter()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
    for b in batches:
        for text in b.column(0):
            seen.update(tokens(text.as_py()))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    if seen:
        yield out()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all texts."""
    return docs.select(F.col(text).alias("text")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_IDS: list = [None, {}]


def _ids(shared) -> dict[bytes, int]:
    """The dictionary of a broadcast list of words, made once in each worker; the list is kept, so that it can't be mistaken for another."""
    if _IDS[0] is not shared.value:
        _IDS[:] = shared.value, {w: i for i, w in enumerate(shared.value)}
    return _IDS[1]


def _packed(ids: np.ndarray) -> bytes:
    """Ids as bytes, the lowest of all first, then the next: the upper ones are mostly alike and compress well."""
    return ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _encode(shared_words):
    """``(row, doc_id, use, ids, rare)`` of each text: dictionary ids, -1 for other words, packed, and those, with a space between; row: a
    number of its own."""

    def run(batches):
        ids, row = _ids(shared_words), first_row()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), ([], [])
                for text in part.column(2):
                    words = tokens(text.as_py())
                    x = np.fromiter(map(ids.get, words, repeat(-1)), np.int32, len(words))
                    out[0].append(_packed(x))
                    out[1].append(b" ".join([words[i] for i in np.flatnonzero(x < 0).tolist()]).decode("utf-8"))
                columns = [pa.array(range(row, row + part.num_rows), pa.int64()), part.column(0), part.column(1), pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "use", "ids", "rare"])
                row += part.num_rows
        pa.default_memory_pool().release_unused()

    return run


def encoded(docs: DataFrame, shared_words) -> DataFrame:
    """``(row, doc_id, use, ids, rare)`` from ``(doc_id, use, text)``."""
    return docs.mapInArrow(_encode(shared_words), f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, use boolean, ids binary, rare string")


def _sequences(packed: pa.BinaryArray, border: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a column behind one another, each between two borders, and where the texts begin."""
    edge = np.array([border], np.int64)
    parts = [x for data in packed for x in (edge, _unpacked(data.as_buffer()), edge)]
    begin = np.cumsum([0, *(len(data.as_buffer()) // 4 + 2 for data in packed)])[:-1].astype(np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), begin


def _words(column: pa.StringArray) -> pa.StringArray:
    """The words of all texts of a column of words with spaces between."""
    return pc.split_pattern(column.filter(pc.not_equal(column, "")), " ").flatten()


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _lists(key: np.ndarray, n: np.ndarray, span: int) -> pa.RecordBatch:
    """Sorted keys w * span + v and their counts, as a row ``(w, data)`` for each w: v with its count in the bits above, four bytes each.

    A count that has no room goes in several of those.
    """
    most = (1 << (32 - span.bit_length())) - 1
    times = -(-n // most)
    if len(times) and times.max() > 1:
        left = np.repeat(n, times) - _within(times) * most
        key, n = np.repeat(key, times), np.minimum(left, most)
    w, data = key // span, ((n << span.bit_length()) | (key % span)).astype("<u4")
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
    offsets = pa.py_buffer((np.append(first, len(w)) * 4).astype(np.int32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(w[first].astype(np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(data.tobytes())])], ["w", "data"])


def _within(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _bigrams(size: int):
    """``(w, data)``: the neighbours of each id over all texts, on either side, some millions at a time: v = id of the one before, or
    size + 1 + id of the one behind, as :func:`_lists` packs them; ``size`` is the border."""

    def run(batches):
        held, n, span = [], 0, 2 * (size + 1)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                x, begin = _sequences(b.column(0).slice(at, 1024), size)
                use = (x[:-1] >= 0) & (x[1:] >= 0)
                use[begin[1:] - 1] = False  # from the end of one text to the start of the next
                left, right = x[:-1][use], x[1:][use]
                held += [left * span + right + size + 1, right * span + left]
                n += len(left)
                if n > 2_000_000:
                    yield _lists(*np.unique(np.concatenate(held), return_counts=True), span)
                    held, n = [], 0
        if held:
            yield _lists(*np.unique(np.concatenate(held), return_counts=True), span)
        pa.default_memory_pool().release_unused()

    return run


def _neighbours(batch: pa.RecordBatch, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From ``(w, data)`` with lists of packed neighbours: the words, and of all their neighbours the place of the word, v and count."""
    of, v, n = _listed(batch.column(1).flatten(), span)
    return batch.column(0).to_numpy(), np.repeat(np.arange(batch.num_rows), _lengths(batch.column(1)))[of], v, n


def _listed(data: pa.BinaryArray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all that lists packed by :func:`_lists` hold: the place of the list, v and count."""
    bounds = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int32)
    x = np.frombuffer(data.buffers()[2], "<u4")[bounds[0] // 4 : bounds[-1] // 4].astype(np.int64) if bounds[-1] > bounds[0] else np.zeros(0, np.int64)
    bits = span.bit_length()
    return np.repeat(np.arange(len(data)), np.diff(bounds) // 4), x & ((1 << bits) - 1), x >> bits


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's counts."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _merged(span: int):
    """``(w, data)`` with one list for each word, in which each neighbour stands once."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, MOVED):
                w, of, v, n = _neighbours(b.slice(at, MOVED), span)
                out = _lists(*_summed(w[of].astype(np.int64) * span + v, n), span)
                one = pa.ListArray.from_arrays(pa.array(np.arange(out.num_rows + 1, dtype=np.int32)), out.column(1))
                yield pa.RecordBatch.from_arrays([out.column(0), one], ["w", "data"])
        pa.default_memory_pool().release_unused()

    return run


def _contexts(batch: pa.RecordBatch, classes: np.ndarray, self_too: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the words of ``(w, data)``: w, and how often each class stands on either side, [word, side, class].

    Neighbours without a class don't count, nor, unless self_too, the word itself.
    """
    c = int(classes[-1]) + 1
    w, at, v, n = _neighbours(batch, 2 * len(classes))
    side, near = v // len(classes), v % len(classes)
    use = (classes[near] >= 0) & (self_too | (near != w[at]))
    key = (at[use] * 2 + side[use]) * c + classes[near[use]]
    return w, np.bincount(key, n[use], len(w) * 2 * c).reshape(len(w), 2, c)


def _core_pairs(size: int, core: int):
    """``(key, n)``: bigrams among the core and the border, which is the number ``core`` in them, from what stands behind a word."""

    def run(batches):
        t = np.zeros((core + 1) ** 2, np.int64)
        for b in batches:
            w, at, v, n = _neighbours(b, 2 * (size + 1))
            a, b_ = w[at].astype(np.int64), v - (size + 1)
            use = (b_ >= 0) & ((b_ < core) | (b_ == size)) & ((a < core) | (a == size))
            np.add.at(t, np.where(a == size, core, a)[use] * (core + 1) + np.where(b_ == size, core, b_)[use], n[use])
        key = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(t[key])], ["key", "n"])

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))  # 0 at 0


def gains(context: np.ndarray, own: np.ndarray, g: np.ndarray, k: int) -> np.ndarray:
    """What the log likelihood of class bigrams gains with each word in each of the first k classes, over it being in none.

    context: [word, side, class], without the word itself; own: the class that a word is in, -1 for none; g: class bigrams, with the
    words where they are.  Only classes that a word has beside it are gone through.  Exact, but that bigrams of a class with itself
    are worked out for either side on its own.
    """
    out = np.zeros((len(own), k))
    for side, grid in ((1, g), (0, g.T)):  # the word before its neighbour, and behind it
        w, c = np.nonzero(context[:, side])
        if not len(w):
            continue
        r = context[w, side, c][:, None]
        x, was = grid[:k, c].T.copy(), _f(grid[:k])[:, c].T.copy()  # bigrams of each class with the neighbour's
        mine = np.flatnonzero((own[w] >= 0) & (own[w] < k))
        at = mine, own[w[mine]]
        x[at] = np.maximum(x[at] - r[mine, 0], 0)
        was[at] = _f(x[at])
        mine = np.flatnonzero(c == own[w])  # where the neighbour's class is its own, the word stands on the other side too
        x[mine] = np.maximum(x[mine] - context[w[mine], 1 - side, :k], 0)
        was[mine] = _f(x[mine])
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        out[w[first]] += np.add.reduceat(_f(x + r) - was, first)
        total, n = np.repeat(grid.sum(1)[None, :k], len(own), 0), context[:, side].sum(1)
        mine = np.flatnonzero((own >= 0) & (own < k))
        total[mine, own[mine]] -= n[mine]
        total = np.maximum(total, 0)
        out -= _f(total + n[:, None]) - _f(total)
    return out


def _moves(shared, k: int, round_: int):
    """``(w, c)``: words of ``(w, data)`` that go to another class."""

    def run(batches):
        classes, g, movable = shared.value
        for b in batches:
            for at in range(0, b.num_rows, MOVED):
                w, context = _contexts(b.slice(at, MOVED), classes, False)
                use = movable[w] & ((classes[w] < 0) if round_ == 0 else ((w + round_) % 2 == 0) | (classes[w] < 0)) & (context.sum((1, 2)) > 0)
                w, context = w[use], context[use]
                own = classes[w]
                gain = gains(context, own, g, k)
                best = gain.argmax(1)
                go = (own < 0) | (gain[np.arange(len(w)), best] > gain[np.arange(len(w)), np.maximum(own, 0)] + 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(w[go].astype(np.int64)), pa.array(best[go].astype(np.int64))], ["w", "c"])

    return run


def _class_bigrams(shared):
    """``(key, n)``: bigrams of classes, from ``(w, data)``."""

    def run(batches):
        classes = shared.value
        c = int(classes[-1]) + 1
        g = np.zeros((c, c))
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                w, context = _contexts(b.slice(at, CHUNK), classes, True)
                has = classes[w] >= 0
                np.add.at(g, classes[w[has]], context[has, 1])
        key = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(g.ravel()[key].astype(np.int64))], ["key", "n"])

    return run


def _gathered(parts):
    """From ``(words, numbers)`` of some texts at a time those of many: their distinct words, and for each word its place in those, and
    its number."""
    words, numbers, n, size = [], [], 0, 0

    def out():
        coded = pa.concat_arrays(words).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.concatenate(numbers)

    for w, x in parts:
        words.append(w)
        numbers.append(x)
        n, size = n + len(w), size + w.nbytes
        if n > FLUSH or size > FLUSH_BYTES:
            yield out()
            words, numbers, n, size = [], [], 0, 0
    if n:
        yield out()


def _rare_contexts(shared_classes):
    """``(word, data)``: for words outside the dictionary how often each code stands for their neighbours, some hundred thousand words
    at a time, as :func:`_lists` packs them: code = class before * (classes + 1) + class behind; the number of classes stands for a
    neighbour that isn't in the dictionary either."""

    def run(batches):
        classes = shared_classes.value
        c = int(classes[-1]) + 1

        def parts():
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    b = batch.slice(start, 1024)  # (ids, rare)
                    x, _ = _sequences(b.column(0), len(classes) - 1)
                    of = np.where(x >= 0, classes[x], c)
                    at = np.flatnonzero(x < 0)
                    yield _words(b.column(1)), of[at - 1] * (c + 1) + of[at + 1]

        for words, w, code in _gathered(parts()):
            rows = _lists(*np.unique(w * (c + 1) ** 2 + code, return_counts=True), (c + 1) ** 2)
            yield pa.RecordBatch.from_arrays([words.take(rows.column(0)), rows.column(1)], ["word", "data"])
        pa.default_memory_pool().release_unused()

    return run


def _merged_codes(batches, span: int):
    """``(word, data)`` with one row for each word, from rows sorted by word.

    Of a word that fills batches only its counts by code are held.
    """

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        words = pa.concat_arrays([b.column(0) for b in held])
        new = np.append(True, pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False))
        of, code, n = _listed(pa.concat_arrays([b.column(1) for b in held]), span)
        rows = _lists(*_summed((np.cumsum(new) - 1)[of] * span + code, n), span)
        return pa.RecordBatch.from_arrays([words.take(pa.array(np.flatnonzero(new))), rows.column(1)], ["word", "data"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            rows = merged([*held, b])
            held = [rows.slice(rows.num_rows - 1)]  # may go on in the next batch
            if rows.num_rows > 1:
                yield rows.slice(0, rows.num_rows - 1)
    yield from held


def _assign(shared, k: int):
    """``(word, n, cls, data)`` from ``(word, data)``, sorted by word: the class of each word, by one exchange."""

    def run(batches):
        classes, g = shared.value  # classes: how many, the border included
        for b in _merged_codes(batches, (classes + 1) ** 2):
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                words, context, n = part.column(0), *_code_counts(part, classes)
                cls = np.array([classes - 1 - RESIDUAL + _residual(w.as_py().encode("utf-8")) for w in words], np.int64)
                may = np.flatnonzero((n >= LEAST) & (context.sum((1, 2)) > 0) & (k > 0))
                if len(may):
                    cls[may] = gains(context[may], np.full(len(may), -1), g, k).argmax(1)
                yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64)), pa.array(cls.astype(np.int32)), part.column(1)], ["word", "n", "cls", "data"])

    return run


def _code_counts(part: pa.RecordBatch, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """From ``data`` the contexts [word, side, class], and how often each word occurs."""
    rows = part.num_rows
    at, code, n = _listed(part.column("data"), (classes + 1) ** 2)
    both = [np.bincount(at * (classes + 1) + c, n, rows * (classes + 1)).reshape(rows, classes + 1)[:, :classes] for c in (code // (classes + 1), code % (classes + 1))]
    return np.stack(both, 1), np.bincount(at, n, rows)


def _rare_transitions(classes: int):
    """``(key, n)``: bigrams of classes in which one word is in the dictionary and the other isn't."""

    def run(batches):
        t = np.zeros((classes, classes))
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                cls, (context, _) = part.column("cls").to_numpy(), _code_counts(part, classes)
                np.add.at(t, cls, context[:, 1])
                np.add.at(t.T, cls, context[:, 0])
        key = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(t.ravel()[key].astype(np.int64))], ["key", "n"])

    return run


def _rare_pairs(batches):
    """``(a, b, n)``: neighbours of which neither is in the dictionary, and how often they are met, some hundred thousand at a time."""

    def parts():
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                b = batch.slice(start, 1024)
                x, _ = _sequences(b.column(0), 0)
                yield _words(b.column(1)), np.append(np.diff(np.flatnonzero(x < 0)) == 1, [False] * bool((x < 0).any()))

    for words, w, on in _gathered(parts()):  # on: whether the next word stands right behind
        first = np.flatnonzero(on)
        key, n = np.unique(w[first] * len(words) + w[first + 1], return_counts=True)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(key // len(words))), words.take(pa.array(key % len(words))), pa.array(n.astype(np.int64))], ["a", "b", "n"])


def exchange(bigrams: np.ndarray, n_classes: int, rounds: int = 12) -> np.ndarray:
    """Exchange clustering: the class of each word but the last (the border, a class of its own), from a matrix of bigrams.

    Words start in classes by rank, modulo their number, and move one at a time to where the sum of n log n over class bigrams,
    less the same over class totals on both sides, is largest.  Ends when no word moves, or after ``rounds``.
    """
    m = len(bigrams) - 1
    k = min(n_classes, m)
    if k <= 0:
        return np.zeros(0, np.int64)
    cls = np.append(np.arange(m) % k, k)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    onto = np.zeros((m + 1, k + 1))
    onto[np.arange(m + 1), cls] = 1
    g = onto.T @ bigrams @ onto
    left, right, every = bigrams.sum(1), bigrams.sum(0), np.arange(k)
    cols = np.ascontiguousarray(bigrams.T)
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            a = cls[w]
            r, q, s = np.bincount(cls, bigrams[w], k + 1), np.bincount(cls, cols[w], k + 1), bigrams[w, w]
            r[a] -= s  # to and from the other words
            q[a] -= s
            g[a] -= r
            g[:, a] -= q
            g[a, a] -= s
            rows, columns = g[:k], g[:, :k].T
            gain = (f(rows + r) - f(rows)).sum(1) + (f(columns + q) - f(columns)).sum(1)
            d = g[every, every]  # the diagonal was changed twice
            gain += f(d + r[:k] + q[:k] + s) + f(d) - f(d + r[:k]) - f(d + q[:k])
            tl, tr = np.bincount(cls, left, k + 1), np.bincount(cls, right, k + 1)
            tl[a] -= left[w]
            tr[a] -= right[w]
            tl, tr = tl[:k], tr[:k]
            gain -= f(tl + left[w]) - f(tl) + f(tr + right[w]) - f(tr)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            g[b] += r
            g[:, b] += q
            g[b, b] += s
            moved += b != a
            cls[w] = b
        if not moved:
            break
    return cls[:m]


@dataclass
class BrownModel:
    words: list[bytes]  # the dictionary, most frequent first
    counts: np.ndarray  # of each
    classes: np.ndarray  # of each, then the border's
    transitions: np.ndarray  # log10 P(class | class before)
    totals: np.ndarray  # log10 of what a word's count is divided by, for each class
    rest: DataFrame  # (word, n, cls) of all other words
    total: int  # training tokens, with one end for each text
    types: int  # distinct ones
    ends: int  # texts


def _matrix(counts: DataFrame, side: int) -> np.ndarray:
    """``(key, n)`` as a matrix of ``side`` rows and columns."""
    got = counts.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side)
    out[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(side, side)


def cluster(neighbours: DataFrame, bigrams: np.ndarray, counts: np.ndarray, spelled: np.ndarray, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, int, np.ndarray, list[float]]:
    """The class of each dictionary word and of the border, the number of exchange classes, the class bigrams, and what a class tells of
    the next (the mean mutual information, which the likelihood grows with) after each round.

    neighbours: ``(w, data)``, a row for each word; bigrams: those among the core and the border; spelled: the residual class of each
    word, from 0.
    """
    sc = neighbours.sparkSession.sparkContext
    core = exchange(bigrams, n_classes)
    k = int(core.max()) + 1 if len(core) else 0
    classes = np.full(len(counts) + 1, -1, np.int64)
    classes[: len(core)] = core
    movable = np.append(counts >= LEAST, False)
    classes[:-1] = np.where(~movable[:-1] & (classes[:-1] < 0), k + spelled, classes[:-1])
    classes[-1] = k + RESIDUAL
    matrix = lambda c: _matrix(neighbours.mapInArrow(_class_bigrams(sc.broadcast(c)), "key long, n long"), k + RESIDUAL + 1)
    settled = lambda c: np.append(np.where(c[:-1] < 0, k + spelled, c[:-1]), c[-1])  # noqa: E731  words that never met a class
    likely: list[float] = []
    before, last = None, False
    for round_ in range(rounds + 1 if k else 1):
        last = last or round_ == rounds or not k
        g = matrix(settled(classes) if last else classes)
        now = float((_f(g).sum() - _f(g.sum(0)).sum() - _f(g.sum(1)).sum()) / max(g.sum(), 1) + np.log(max(g.sum(), 1)))
        if round_ > 1 and now < likely[-1]:
            classes, g, last = before, matrix(settled(before)), True
        elif round_ > 0:
            likely.append(now)
        if last:
            break
        moved = neighbours.mapInArrow(_moves(sc.broadcast((classes, g, movable)), k, round_), "w long, c long").toArrow()
        before, classes = classes, classes.copy()
        classes[moved.column("w").to_numpy()] = moved.column("c").to_numpy()
        last = not moved.num_rows
    return settled(classes), k, g, likely


def fit(docs: DataFrame, use: Column | None = None, doc_id: str = "doc_id", text: str = "text", dictionary: int = DICTIONARY, core: int = CORE, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[BrownModel, DataFrame]:
    """A model learnt from the rows of ``docs`` for which ``use`` is true (all, without it), and all rows as its dictionary writes them.

    Null texts are empty and count as one end each.  Without texts every word is unseen.  Words equally frequent are ordered by their
    spelling.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.lit(True).alias("use") if use is None else F.coalesce(use, F.lit(False)).alias("use"), F.col(text).alias("text"))
    with temporary_tables(docs.sparkSession):
        _, top = frequent(saved(word_counts(docs.where("use")), "words"), "word", "n", dictionary)
        known = sorted(((r.n, r.word) for r in top.collect()), key=lambda r: (-r[0], r[1]))
    words, counts = [w.encode("utf-8") for _, w in known], np.array([n for n, _ in known], np.int64)
    size, core = len(words), min(core, len(words))
    every = saved(encoded(docs, sc.broadcast(words)), "encoded", compression="zstd")
    mine = every.where("use").select("ids", "rare")
    ends = mine.count()

    parts = mine.select("ids").mapInArrow(_bigrams(size), "w int, data binary")
    lists = parts.groupBy("w").agg(F.collect_list("data").alias("data")).mapInArrow(_merged(2 * (size + 1)), "w int, data array<binary>")
    spelled = np.array([_residual(w) for w in words], np.int64)
    with temporary_tables(docs.sparkSession):
        neighbours = saved(lists, "neighbours", compression="zstd")
        bigrams = _matrix(neighbours.where((F.col("w") < core) | (F.col("w") == size)).mapInArrow(_core_pairs(size, core), "key long, n long"), core + 1)
        bigrams[core, core] = 0  # empty texts say nothing of classes
        classes, k, t, _ = cluster(neighbours, bigrams, counts, spelled, n_classes, rounds)
    border = int(classes[-1])

    shared = sc.broadcast(classes)
    codes = mine.mapInArrow(_rare_contexts(shared), "word string, data binary").repartition("word").sortWithinPartitions("word")
    # A word has at most as many codes as there are pairs of classes, however often it occurs.
    placed = saved(codes.mapInArrow(_assign(sc.broadcast((border + 1, t)), k), "word string, n long, cls int, data binary"), "classes", compression="zstd")
    rest = placed.select("word", "n", "cls")
    t = t + _matrix(placed.mapInArrow(_rare_transitions(border + 1), "key long, n long"), border + 1)
    both = mine.mapInArrow(_rare_pairs, "a string, b string, n long")
    both = both.join(rest.select(F.col("word").alias("a"), F.col("cls").alias("x")), "a").select("b", "x", "n").join(rest.select(F.col("word").alias("b"), F.col("cls").alias("y")), "b")
    t += _matrix(both.select((F.col("x") * (border + 1) + F.col("y")).cast("long").alias("key"), "n"), border + 1)
    t = (t + SMOOTHING) / (t.sum(1, keepdims=True) + SMOOTHING * (border + 1))
    # Words of a class share its total by their counts; in residual classes each counts once more, and so does one unseen word.
    of_class, types_of = np.bincount(classes[:-1], counts, border + 1), np.bincount(classes[:-1], minlength=border + 1)
    for r in rest.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        of_class[r.cls] += r.n
        types_of[r.cls] += r.v
    total, types = int(of_class.sum()) + ends, int(types_of.sum()) + (ends > 0)
    residual = np.arange(border + 1) >= k
    return BrownModel(words, counts, classes, np.log10(t), np.log10(np.where(residual, of_class + types_of + 1, np.maximum(of_class, 1))), rest, total, types, ends), every


def train(docs: DataFrame, **given) -> BrownModel:
    """The model of :func:`fit`, from every row of ``docs``; only the column of texts is read."""
    return fit(docs.withColumn("__no_id", F.lit(None).cast("long")), doc_id="__no_id", **given)[0]


def _emissions(counts: np.ndarray, classes: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """log10 P(word | class) of words with such counts in such classes."""
    more = classes >= len(totals) - 1 - RESIDUAL  # in a residual class
    return np.log10(np.maximum(counts + more, 1e-300)) - totals[classes]


#: What the dictionary's words give for a text: n_tokens, n_known, base and score.
HEAD = "<qqdd"
#: Bits for a word's class; its count is above them.
FOUND = 16


def _score(shared_model):
    """``(doc_id, head, row, at, word)``: for each text a row with what the dictionary's words give, worked out for all texts of a batch at
    once, and a row for each other word, with its place and neighbours in ``at``.  (What differs from row to row stands side by side, and
    in few bytes: so it compresses best.)"""

    def run(batches):
        classes, transitions, emissions, log_counts, log_total, log_ends = shared_model.value
        border = int(classes[-1])
        edge = np.zeros((border + 2, border + 2))  # the last stands for a word that isn't in the dictionary
        edge[:-1, :-1] = transitions
        classes = np.append(classes, border + 1)  # of id -1
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                x, begin = _sequences(b.column(2), len(classes) - 2)
                c, of = classes[x], np.repeat(np.arange(b.num_rows), np.diff(np.append(begin, len(x))))
                step = edge[c[:-1], c[1:]]
                step[begin[1:] - 1] = 0  # from the end of one text to the start of the next
                got, rare = np.flatnonzero((x >= 0) & (x < len(classes) - 2)), np.flatnonzero(x < 0)
                add = lambda i, v: np.bincount(of[i], v, b.num_rows)  # noqa: B023, E731
                n = np.bincount(of, minlength=b.num_rows) - 1  # two borders less, one end more
                known = np.bincount(of[got], minlength=b.num_rows)
                base = add(got, log_counts[x[got]]) + log_ends - n * log_total
                score = np.bincount(of[:-1], step, b.num_rows) + add(got, emissions[x[got]])
                heads = pa.array([struct.pack(HEAD, *v) for v in zip(n.tolist(), known.tolist(), base.tolist(), score.tolist(), strict=True)], pa.binary())
                rows, ids = b.column(0), b.column(1)
                # A text's own row has a key that no word has, and spreads over the tasks.
                own = pc.binary_join_element_wise("", rows.cast(pa.string()), " ")
                yield pa.RecordBatch.from_arrays([ids, heads, rows, pa.nulls(len(rows), pa.int64()), own], ["doc_id", "head", "row", "at", "word"])
                if len(rare):
                    places = (rare - begin[of[rare]]) * (border + 2) ** 2 + c[rare - 1] * (border + 2) + c[rare + 1]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(rare), ids.type), pa.nulls(len(rare), pa.binary()), rows.take(pa.array(of[rare])), pa.array(places.astype(np.int64)), _words(b.column(3))], ["doc_id", "head", "row", "at", "word"])
        pa.default_memory_pool().release_unused()

    return run


def _add_rare(shared_model):
    """The scores of texts from rows ``(doc_id, head, row, at, found)``, sorted by row: what the head has, and what the other words add by
    their places, classes and counts."""

    def run(batches):
        transitions, totals = shared_model.value
        c = len(totals)
        edge = np.zeros((c + 1, c + 1))
        edge[:-1, :-1] = transitions

        def done(table: pa.Table) -> pa.RecordBatch:
            row = table.column("row").to_numpy()
            own = table.filter(pc.is_valid(table.column("head")))
            order = np.argsort(own.column("row").to_numpy())
            own = own.take(pa.array(order)).combine_chunks()
            rare = table.filter(pc.is_valid(table.column("at")))
            row, at, found = (rare.column(k).to_numpy() for k in ("row", "at", "found"))
            order = np.lexsort((at, row))
            of, at, n, cls = np.searchsorted(own.column("row").to_numpy(), row[order]), at[order], found[order] >> FOUND, found[order] & ((1 << FOUND) - 1)
            pos, code = at // (c + 1) ** 2, at % (c + 1) ** 2
            more = edge[code // (c + 1), cls] + edge[cls, code % (c + 1)] + _emissions(n, cls, totals)
            near = np.flatnonzero((of[1:] == of[:-1]) & (pos[1:] == pos[:-1] + 1))
            more[near] += transitions[cls[near], cls[near + 1]]
            add = lambda v: np.bincount(of, v, own.num_rows)
            heads = np.array([struct.unpack(HEAD, h.as_py()) for h in own.column("head")], np.float64).reshape(-1, 4)
            values = [heads[:, 0].astype(np.int64), heads[:, 1].astype(np.int64) + add(n > 0).astype(np.int64), heads[:, 2] + add(np.log10(n + 1.0)), heads[:, 3] + add(more)]
            ids = own.column("doc_id")
            return pa.RecordBatch.from_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, *map(pa.array, values)], ["doc_id", "n_tokens", "n_known", "base", "score"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            row = b.column("row").to_numpy()
            if len(row) and row[0] != row[-1]:  # what belongs to the last row may go on in the next batch
                cut = int(np.searchsorted(row, row[-1]))
                yield done(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                held = [b.slice(cut)]
        if held:
            yield done(pa.Table.from_batches(held))
        pa.default_memory_pool().release_unused()

    return run


def score(docs: DataFrame, model: BrownModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`scores` of ``docs``, which need not be those that the model has learnt from."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.lit(False).alias("use"), F.col(text).alias("text"))
    return scores(encoded(docs, docs.sparkSession.sparkContext.broadcast(model.words)), model)


def scores(docs: DataFrame, model: BrownModel) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of :func:`encoded` documents.

    n_tokens: words and one end; n_known: those that training has seen; base_score: log10 probability under add-one unigrams
    of the training tokens; score: under the model.  A null text is empty: one end.  Null ids and repeated rows are kept, each with a
    row number of its own on the way, so that equal rows never meet in one group.  (The number is the row's place in its partition:
    documents have to be read from a table, or made by a plan that a retry repeats.)  Other columns aren't read, so that they may have
    any name; an empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    log_total = float(np.log10(model.total + model.types + 1))
    emissions = _emissions(model.counts, model.classes[:-1], model.totals)
    parts = (model.classes, model.transitions, emissions, np.log10(model.counts + 1.0), log_total, float(np.log10(model.ends + 1)))
    flat = docs.select("row", "doc_id", "ids", "rare").mapInArrow(_score(sc.broadcast(parts)), f"doc_id {kind}, head binary, row long, at long, word string")
    # A word that training hasn't seen is in the residual class of its spelling, with a count of 0.
    unseen = F.lit(len(model.totals) - 1 - RESIDUAL) + _residual_sql(F.col("word"))
    rest = model.rest.select("word", F.shiftleft("n", FOUND).bitwiseOR(F.col("cls").cast("long")).alias("found"))
    met = flat.join(rest.hint("shuffle_hash"), "word", "left").select("doc_id", "head", "row", "at", F.coalesce("found", unseen.cast("long")).alias("found"))
    done = met.repartition("row").sortWithinPartitions("row").mapInArrow(_add_rare(sc.broadcast((model.transitions, model.totals))), f"doc_id {kind}, n_tokens long, n_known long, base double, score double")
    return done.select("doc_id", "n_tokens", (F.col("n_known") + F.lit(int(model.ends > 0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def held_out(doc_id: Column, fold: int = 2, folds: int = 7) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
