"""Byte-level BPE encoding and decoding by a two-tier look-up.

A text is split by the vocabulary's pattern. The distinct pre-tokens of a batch go first through a minimal perfect hash
of the vocabulary, all at once: one table of displacements and one of as many slots as there are tokens; what stands in
the slot is compared. Misses are merged from their bytes, linked left to right, with a heap of adjacent pairs by rank.
Results of a pre-token are kept in a memo of bounded size, so a word is merged about once a task. A batch's ids are then
laid out at once: each pre-token has a slot, and its ids lie in one array for all slots. Decoding lays out tokens' bytes
in the same way.

Defined results: null text encodes as empty; bytes that aren't UTF-8 are read as U+FFFD; text that looks like a special
token is ordinary text; repeated rows are encoded each; other columns are ignored; unknown ids in decode() are an error.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from agendum.llm.common import by_bytes, by_sizes, text_of, utf8
from agendum.llm.vocab import ranks as read_ranks
from agendum.llm.wordhash import mix

#: Pre-tokens that a task remembers before it forgets them all.
MEMO = 300_000


class PerfectHash:
    """A minimal perfect hash by displacement: a key of hash h in bucket b has the slot mix(h + d[b]) mod n."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        hashes, bucket = self._parts(keys)
        self.shift = np.zeros(self.buckets, np.int64)
        slots = np.full(n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(cuts)
        for b in np.argsort(-sizes, kind="stable"):  # the fullest first
            own = order[cuts[b] : cuts[b + 1]]
            if len(own) < 2:
                break
            self.shift[b], at = self._free(slots, hashes[own])
            slots[at] = own
        free = iter(np.flatnonzero(slots < 0).tolist())
        for b in np.flatnonzero(sizes == 1):  # a lone key takes any slot, named as -1 - slot
            slot = next(free)
            self.shift[b], slots[slot] = -1 - slot, order[cuts[b]]
        self.slots = slots
        self.keys = keys

    def _parts(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        return h, ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def _free(self, slots: np.ndarray, hashes: np.ndarray) -> tuple[int, np.ndarray]:
        """The least shift that sends all keys of a bucket to free slots, and these."""
        for first in range(0, 1 << 24, 64):
            tries = self._slot(hashes, np.arange(first, first + 64)[:, None])
            ordered = np.sort(tries, 1)
            fits = (slots[tries] < 0).all(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if fits.any():
                i = int(np.argmax(fits))
                return first + i, tries[i]
        raise ValueError("two keys hash alike")

    def find(self, keys: list[bytes]) -> list[int]:
        """The number of each key, -1 for those that aren't there."""
        if not keys or not self.n:
            return [-1] * len(keys)
        hashes, bucket = self._parts(keys)
        shift = self.shift[bucket]
        at = self.slots[np.where(shift < 0, -1 - shift, self._slot(hashes, shift))].tolist()
        own = self.keys
        return [i if own[i] == k else -1 for i, k in zip(at, keys, strict=True)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of least rank is joined, the leftmost first, until none has a rank."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it's joined to the one before
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, j = heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != j:
            continue  # one of its parts has changed since
        end[i], end[middle] = j, 0
        if j < n:
            before[j] = i
            if (r := ranks.get(piece[i : end[j]])) is not None:
                heappush(heap, (r, i, end[j]))
        if i and (r := ranks.get(piece[before[i] : j])) is not None:
            heappush(heap, (r, before[i], j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Slots(dict):
    """Numbers of pre-tokens, given in the order in which they are first asked for; `fresh` lists the new ones."""

    fresh: list[str]

    def __missing__(self, word: str) -> int:
        slot = self[word] = len(self)
        self.fresh.append(word)
        return slot


def laid_out(chosen: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[starts : starts + sizes] of all that is chosen, one after the other, and the place where each ends."""
    n = sizes[chosen]
    ends = np.cumsum(n)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[chosen] - (ends - n), n)], ends


def ascii_split(pattern: str):
    """The pattern for texts of ASCII only, where it needs no tables of Unicode; None if it has parts unknown here."""
    space = r"\t-\r "
    for a, b in ((r"[^\s\p{L}\p{N}]", f"[^{space}A-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        pattern = pattern.replace(a, b)
    return None if r"\p" in pattern else re.compile(pattern).findall


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.ascii = ascii_split(pattern) or self.split
        keys = list(ranks)
        self.hash, self.ids = PerfectHash(keys), [ranks[k] for k in keys]
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.slots, self.begins, self.counts, self.found = Slots(), array("q"), array("q"), array("i")

    def _learn(self, words: list[str]) -> None:
        """The ids of new pre-tokens: whole ones by the perfect hash, all at once, others by merging."""
        keys = [x.encode() for x in words]
        for key, i in zip(keys, self.hash.find(keys), strict=True):
            own = [self.ids[i]] if i >= 0 else merged(key, self.ranks)
            self.begins.append(len(self.found))
            self.counts.append(len(own))
            self.found.extend(own)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the places where texts begin and end."""
        if len(self.slots) > MEMO:
            self._forget()
        slots, chosen, sizes = self.slots, [], [0]
        slots.fresh = []
        for text in texts:
            pieces = (self.ascii if text.isascii() else self.split)(text)
            sizes.append(len(pieces))
            chosen.extend(map(slots.__getitem__, pieces))
        self._learn(slots.fresh)
        ids, ends = laid_out(np.array(chosen, np.int64), np.array(self.begins, np.int64), np.array(self.counts, np.int64), np.array(self.found, "<i4"))
        return ids, np.concatenate(([0], ends))[np.cumsum(sizes)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each id's end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        return laid_out(ids, self.starts, self.sizes, self.bytes)


@lru_cache(maxsize=2)
def coder(name: str) -> Coder:
    return Coder(read_ranks(name), public_tokenizers.PATTERN)


def encode(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(name)
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in by_bytes(texts):
                ids, ends = own.encode([(t or b"").decode() for t in texts[i:j]])
                lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, ids, bytes): the bytes that the ids stand for; null ids decode as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(name)
        for batch in batches:
            lists = batch.column(1)
            for i, j in by_sizes(4 * (n or 0) for n in pa.compute.list_value_length(lists).to_pylist()):
                part = lists.slice(i, j - i)
                sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(part), 0), np.int64)
                data, ends = own.decode(part.flatten().to_numpy(zero_copy_only=False))
                places = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
                found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns] + [found], ["doc_id", "ids", "bytes"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, ids array<int>, bytes binary")
