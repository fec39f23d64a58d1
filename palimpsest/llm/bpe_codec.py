"""BPE encoding and decoding by speculation and verification.

1. *Speculate*: a greedy longest match over the vocabulary proposes tokens for every distinct pre-token of a batch, in one pass
   of an Aho-Corasick automaton over all of them.
2. *Verify*: a row of tokens is what the merges would give if, and only if, each token is what its own string merges to and no
   adjacent pair would have merged across its border.  Both are tested for all pairs at once with array operations, by undoing
   the merges of the two sides from the last to the first and looking for a rule across the border that came earlier.
3. Words in which a test fails (and only those) are merged exactly.

Words are worked out once in each Python worker and kept in a cache of bounded size; nothing is shuffled.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path
from .word_bpe import PreTokenizer, byte_chars, loaded

#: About the most words that a worker keeps in each of two generations, while it works on a partition.
CACHE = 120_000
#: Words of more characters are merged one by one.
LONG = 64
#: Stands for the end of a word; no byte is written with it.
END = ""


class Words(dict):
    """The number of each word, and by number its ids, which lie in arrays: the collector has nothing to walk through.

    A word that isn't there gets the next number when it is asked for, and is listed in ``new`` until its ids are added.
    """

    def __init__(self, special):
        self.new: list[str] = []
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.add(special, np.arange(len(special)), np.ones(len(special), np.int64), np.array(special, np.int32))

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.size) + len(self.new)
        self.new.append(word)
        return n

    def add(self, words: list, begin: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """begin, size: where the ids of each word lie in ``ids``."""
        self.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.begin, self.size = np.concatenate((self.begin, begin + len(self.ids))), np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one behind the other, and how many each has."""
        size = self.size[numbers]
        return self.ids[_runs(self.begin[numbers], size)], size


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1 and so on, ``size`` of them for each run."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    def __init__(self, path: str):
        import ahocorasick

        self.pre = PreTokenizer(path)
        model = self.pre.spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        mark = lambda t: t.removesuffix(suffix) + END if suffix and t.endswith(suffix) else t
        self.vocab = {mark(t): i for t, i in model["vocab"].items()}
        n = 1 + max([*self.vocab.values(), *self.pre.special.values()])
        self.strings = [""] * n  # of each id, as the library writes it
        for t, i in [*model["vocab"].items(), *self.pre.special.items()]:
            self.strings[i] = t
        # rank[id]: when a token is made; -1 for single characters, which are there from the start.
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys = []
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b = mark(a), mark(b)
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[x, y] = (r, z)
            self.rank[z], self.left[z], self.right[z] = r, x, y
            keys.append((x, y))
        n += 1  # the last number is no token's: it stands between words
        self.n = n
        self.made_by = np.zeros(len(keys), np.int64)  # the token of each rank
        for r, z in self.merges.values():
            self.made_by[r] = z
        # The rules by pair, in a table with open places, for many look-ups at once.
        self.none, self.bits = len(keys) + 1, max(8, (4 * len(keys)).bit_length())
        self.slot_key, self.slot_rank = np.full((1 << self.bits) + len(keys) + 1, -1, np.int64), np.full((1 << self.bits) + len(keys) + 1, self.none, np.int64)
        pairs = np.array([x * n + y for x, y in keys], np.int64)
        for k, r, at in zip(pairs.tolist(), range(len(keys)), self.slot(pairs).tolist(), strict=True):
            while self.slot_key[at] not in (-1, k):
                at += 1
            self.slot_key[at], self.slot_rank[at] = k, r
        made = np.flatnonzero(self.rank >= 0)
        self.sound = np.ones(n, bool)  # tokens that their own string merges to
        self.sound[made] = self.apart(self.left[made], self.right[made], self.rank[made])
        # A child that isn't sound makes its parents unsound; parents come later.
        for z in made[np.argsort(self.rank[made])]:
            self.sound[z] &= self.sound[self.left[z]] and self.sound[self.right[z]]
        self.pre.spec = None
        self.longest = ahocorasick.Automaton()
        self.length = np.zeros(n, np.int64)  # of each token, in characters
        for t, i in self.vocab.items():
            self.longest.add_word(t, i)
            self.length[i] = len(t)
        self.longest.make_automaton()
        self.char = np.zeros(256, "<u4")  # the character that is written for each byte; 255 is none of UTF-8 and ends a word
        for b, c in [*byte_chars().items(), (255, END)]:
            self.char[b] = ord(c)
        self.string_column = pa.array(self.strings, pa.string())
        self.forget()

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The place at which the search for a pair begins."""
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rules(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of the rule that joins each pair of tokens; ``none`` where no rule does."""
        key = x * self.n + y
        at = self.slot(key)
        there = self.slot_key[at]
        out = np.where(there == key, self.slot_rank[at], self.none)
        left = np.flatnonzero((there != key) & (there >= 0))  # another pair has the place: look at the next one
        while len(left):
            at[left] += 1
            there = self.slot_key[at[left]]
            hit = there == key[left]
            out[left[hit]] = self.slot_rank[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: no rule joins the end of one with the start of the other before both are complete.

        limit: only rules of a lower rank count.  At one rank the leftmost pair merges first, so a rule across the border
        that is also the last of the right side wins, and one that is also the last of the left side loses.
        """
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), self.none, np.int64) if limit is None else limit
        while len(live):
            good = self.rules(a, b) >= limit
            ok[live[~good]] = False
            rx, ry = self.rank[a], self.rank[b]
            undo_left = rx > ry
            go = np.flatnonzero(good & (undo_left | (ry >= 0)))
            a, b, rx, ry, undo_left, live = a[go], b[go], rx[go], ry[go], undo_left[go], live[go]
            limit = np.where(undo_left, rx, ry + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return ok

    def exact(self, word: str) -> list[int]:
        """Merge by rank, the leftmost first, as the definition says; with a heap, for words of any length."""
        ids = [self.vocab[c] for c in (*word[:-2], word[-2:])] if word.endswith(END) else [self.vocab[c] for c in word]
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], after[i] = z, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := merges.get((z, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, z, ids[after[j]], m[1]))
            if before[i] >= 0 and (m := merges.get((ids[before[i]], z))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], z, m[1]))
        return [x for x in ids if x >= 0]

    def exact_batch(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`exact` for many short words: each round joins the leftmost pair of least rank in every word at once.

        Returns where the ids of each word lie (begin and size), and all ids.
        """
        vocab, between = self.vocab, self.n - 1
        ids = np.array([x for w in words for x in (*map(vocab.__getitem__, w[:-2]), vocab[w[-2:]], between)], np.int64)
        size = np.array([len(w) for w in words], np.int64)  # the END is one character with the last, and one number stands behind
        begin, sizes, done_ids, n_done = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        word = np.arange(len(words))
        rank = np.append(self.rules(ids[:-1], ids[1:]), self.none) if len(ids) else ids
        while len(word):
            first = np.cumsum(size) - size
            least = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
            done = least >> 32 == self.none
            keep = np.repeat(~done, size)
            if done.any():
                sizes[word[done]] = size[done] - 1
                begin[word[done]] = n_done + np.cumsum(size[done] - 1) - (size[done] - 1)
                done_ids.append(ids[~keep & (ids != between)])
                n_done += len(done_ids[-1])
            hit = least[~done] & 0xFFFFFFFF
            ids[hit] = self.made_by[rank[hit]]
            rank[hit] = self.rules(ids[hit], ids[hit + 2])
            rank[hit - 1] = self.rules(ids[hit - 1], ids[hit])  # of the first word: the last place, where no rule is
            keep[hit + 1] = False
            ids, rank, word, size = ids[keep], rank[keep], word[~done], size[~done] - 1
        return begin, sizes, np.concatenate(done_ids) if done_ids else ids

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Where the ids of each word lie (begin and size), all ids, and how many words had to be merged exactly."""
        written = np.frombuffer(b"\xff".join([*map(str.encode, words), b""]), np.uint8)
        ends = np.flatnonzero(written == 255) + 1  # words lie one behind the other; END closes each
        shown = self.char[written].tobytes().decode("utf-32-le")
        found = np.fromiter(chain.from_iterable(self.longest.iter_long(shown)), np.int64).reshape(-1, 2)
        stop, ids = found[:, 0] + 1, np.ascontiguousarray(found[:, 1])
        start = stop - self.length[ids]
        owner = np.searchsorted(ends, stop, "left")
        begin = np.concatenate(([0], ends[:-1]))
        good = np.bincount(owner, self.length[ids], len(words)).astype(np.int64) == ends - begin  # the proposal leaves no gap
        good[owner[(start < begin[owner]) | ~self.sound[ids]]] = False
        same = np.flatnonzero((owner[1:] == owner[:-1]) & good[owner[1:]])
        good[owner[same[~self.apart(ids[same], ids[same + 1])]]] = False
        bad = np.flatnonzero(~good)
        size, ids = np.bincount(owner, minlength=len(words)), ids[good[owner]]
        size[bad] = 0
        at, parts, n = np.cumsum(size) - size, [ids], len(ids)
        short = bad[ends[bad] - begin[bad] <= LONG]
        where, size[short], more = self.exact_batch([shown[i:j] for i, j in zip(begin[short].tolist(), ends[short].tolist(), strict=True)])
        at[short] = where + n
        parts.append(more)
        n += len(more)
        for k in bad[ends[bad] - begin[bad] > LONG].tolist():
            parts.append(np.array(self.exact(shown[begin[k] : ends[k]]), np.int64))
            at[k], size[k] = n, len(parts[-1])
            n += len(parts[-1])
        return at, size, np.concatenate(parts), len(bad)

    def work_out(self, words: list[str]) -> int:
        """Put the ids of words into the cache; returns how many had to be merged exactly."""
        if not words:
            return 0
        begin, size, ids, n_exact = self.solve(words)
        self.words.add(words, begin, size, ids)
        return n_exact

    def learn(self) -> None:
        """Put the ids of all new words into the cache: those that the older half knows move on, the others are worked out."""
        words = self.words.new
        known = np.array([self.older.get(w, -1) for w in words], np.int64)
        old = np.flatnonzero(known >= 0)
        ids, n = self.older.of(known[old])
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[old], size[old] = np.cumsum(n) - n, n
        if len(rest := np.flatnonzero(known < 0)):
            at, size[rest], more, _ = self.solve([words[k] for k in rest.tolist()])
            begin[rest] = at + len(ids)
            ids = np.concatenate((ids, more))
        self.words.add(words, begin, size, ids)
        self.words.new = []

    def forget(self) -> None:
        special = sorted(set(self.pre.special.values()))
        self.words, self.older = Words(special), Words(special)

    def encode_columns(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin, with the end of the last, and the ids of all texts."""
        if self.words.new:
            self.forget()  # a batch before broke off and left words without ids
        if len(self.words) > CACHE:  # an older half goes, but what is used again moves on to the newer one
            self.older, self.words = self.words, Words(sorted(set(self.pre.special.values())))
        split = [self.pre.split(t) for t in texts]
        ends = np.cumsum([0, *map(len, split)])
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, ends[-1])
        self.learn()
        ids, size = self.words.of(numbers)
        return np.concatenate(([0], np.cumsum(size)))[ends], ids

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut, ids = self.encode_columns(texts)
        ids = ids.tolist()
        return [ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def decode_column(self, ids: pa.ListArray) -> pa.Array:
        """:meth:`decode` of each row."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.string_column.take(ids.values)), " ")

    def decode(self, ids) -> str:
        """As the library without a decoder: the tokens' strings with one space between them."""
        return " ".join(map(self.strings.__getitem__, ids))


def _encode(path: str, decode: bool):
    def run(batches):
        codec = loaded(Codec, path)
        for b in batches:
            keys, column = b.column(0), b.column(1)
            at = 0
            while at < b.num_rows:  # some MB of text at a time
                texts, size = [], 0
                while at + len(texts) < b.num_rows and size < 1_000_000:
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                cut, ids = codec.encode_columns(texts)
                got = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(texts)), got, *([codec.decode_column(got)] if decode else [])], ["doc_id", "ids", "decoded"][: 2 + decode])
                at += len(texts)
        codec.forget()  # an idle worker holds no words
        pa.default_memory_pool().release_unused()

    return run


def _decode(path: str):
    def run(batches):
        codec = loaded(Codec, path)
        for b in batches:
            texts = pa.array([codec.decode(x.as_py() or ()) for x in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], ["doc_id", "decoded"])

    return run


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for each row: the whole text as token ids.

    A null text is empty and gives no ids.  A null ``doc_id`` and repeated rows are kept as they are.  Special strings become
    their ids.  Only the two named columns are read, so that others may have any name; an empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_encode(path or tokenizer_path(), False), f"doc_id {_kind(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, decoded)`` from ``(doc_id, ids)``; null or empty ids decode to the empty string."""
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(path or tokenizer_path()), f"doc_id {_kind(encoded)}, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: :func:`encode` followed by :func:`decode` of the ids, in one pass over the rows."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_encode(path or tokenizer_path(), True), f"doc_id {_kind(docs)}, ids array<int>, decoded string")
