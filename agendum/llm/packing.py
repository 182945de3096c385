"""Packing of tokenised documents into windows by the sum-of-squares rule, online and without a shuffle.

Each task reads its documents in order. A document's whole windows are cut off as sequences of their own; what is left
goes to the fill level h that minimises the sum over levels of the squared number of partly filled windows there, which
a level array tracks (ties: the fullest level; level 0 opens a window). At the end of a task, or when `most_open`
windows are open, those whose fill isn't free of padding are settled: their pieces are laid out one after the other and
cut into whole windows, and the last one into lengths that are powers of two, which need no padding.

Sequence ids are the task's partition number shifted by 33 bits plus a running number, so that a task that is run again
gives the same rows, and packing grows by tasks alone. Ids are those of the `tokenizers` library for a byte-level .json
file; they are made by `tiktoken` from that file's ranks, which is several times faster (see `Ids`).

Defined results: null or empty text is the end id alone; bytes that aren't UTF-8 are read as U+FFFD; texts may be of any
length and hold runs of any length; repeated rows are packed each; a null id stays null; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from agendum.llm.common import text_of
from agendum.llm.vocab import byte_level

WINDOW = 2048
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: Characters that the library splits at a time; its patterns give up on runs of about a million.
LONG = 500_000


class Ids:
    """Token ids of texts as `tokenizers` gives them for a byte-level file, strings of added tokens as these.

    A text of over `long` characters is cut between pre-tokens, where no merge reaches over; a single pre-token of that
    length is merged without the pattern.
    """

    def __init__(self, name: str, long: int = LONG):
        ranks, self.added = byte_level(name)
        self.coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.split, self.long = regex.compile(public_tokenizers.PATTERN), long
        self.added_split = regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= self.long:
            return self.coder.encode_to_numpy(text, allowed_special="all")
        parts, at = [], 0
        for m in self.added_split.finditer(text):
            parts += [*self._plain(text[at : m.start()]), np.array([self.added[m.group()]], "<u4")]
            at = m.end()
        return np.concatenate([np.empty(0, "<u4"), *parts, *self._plain(text[at:])])

    def _plain(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text in which no string is special, part by part.

        A part that ends in white space would be split otherwise than inside the text, so parts end after other
        pre-tokens, and white space before a forced cut is merged by itself.
        """
        whole = lambda part: self.coder.encode_to_numpy(part, disallowed_special=())
        alone = lambda piece: np.array(self.coder._core_bpe.encode_single_piece(piece.encode()), "<u4")
        at = safe = 0
        spaces: list[str] = []  # since the last safe end
        for m in self.split.finditer(text):
            piece = m.group()
            if m.end() - at > self.long and m.start() > at:
                if safe > at:
                    yield whole(text[at:safe])
                yield from map(alone, spaces)
                at = safe = m.start()
                spaces = []
            if len(piece) > self.long:
                yield alone(piece)
                at = safe = m.end()
            elif piece[-1].isspace():
                spaces.append(piece)
            else:
                safe, spaces = m.end(), []
        if at < len(text):
            yield whole(text[at:])


class Packer:
    """Online sum-of-squares packing; `done` collects closed pieces (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0, most_open: int = 4096):
        self.window, self.sequence, self.most_open = window, first_sequence, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.done: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        for start in range(0, n - self.window + 1, self.window):
            self._close([(doc, start, ids[start : start + self.window], n)])
        if rest := n % self.window:
            self._place((doc, n - rest, ids[n - rest :], n), rest)

    def _place(self, piece: tuple, size: int) -> None:
        """Moving a window from h to h + size changes the sum by 2 (N[h + size] - N[h] + 1); filling it by 1 - 2 N[h]."""
        window, levels = self.window, self.levels
        change = 2 * (levels[size:window] - levels[: window - size] + 1)
        change[0] = 2 * levels[size] + 1
        change[1:][levels[1 : window - size] == 0] = np.iinfo(np.int64).max
        h = window - size - 1 - int(np.argmin(change[::-1]))
        if levels[window - size] and 1 - 2 * levels[window - size] <= change[h]:
            h = window - size
        pieces = self._take(h) if h else []
        pieces.append(piece)
        if h + size == window:
            self._close(pieces)
            return
        self.open[h + size].append(pieces)
        levels[h + size] += 1
        self.n_open += 1
        if self.n_open >= self.most_open:
            self.settle()

    def _take(self, h: int) -> list:
        self.levels[h] -= 1
        self.n_open -= 1
        return self.open[h].pop()

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.done.append((doc, start, ids, n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def settle(self) -> None:
        """Close all open windows; none needs padding afterwards."""
        stream = []
        for h in range(self.window - 1, 0, -1):
            while self.levels[h]:
                pieces = self._take(h)
                if h & (h - 1) == 0:
                    self._close(pieces)
                else:
                    stream += pieces
        left = sum(len(p[2]) for p in stream)
        sizes = [self.window] * (left // self.window) + [1 << b for b in range(self.window.bit_length(), -1, -1) if left % self.window >> b & 1]
        at, held = 0, []
        for doc, start, ids, n in stream:
            while len(ids):
                part = ids[: sizes[at] - sum(len(p[2]) for p in held)]
                held.append((doc, start, part, n))
                start, ids = start + len(part), ids[len(part) :]
                if sum(len(p[2]) for p in held) == sizes[at]:
                    self._close(held)
                    at, held = at + 1, []

    def flush(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents: SCHEMA, with ids as little-endian unsigned 32-bit numbers."""

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        docs_, starts, ids, totals, sequences, offsets = zip(*pieces, strict=True)
        columns = [pa.array(docs_, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), *(pa.array(x, pa.int64()) for x in (totals, sequences, offsets))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = Ids(name), np.array([end_id], "<u4")
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.concatenate((coder(text.as_py() or "").astype("<u4", copy=False), end)))
                if len(packer.done) >= 2000:
                    yield rows(packer.flush())
        packer.settle()
        if packer.done:
            yield rows(packer.flush())

    return docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(run, SCHEMA)
