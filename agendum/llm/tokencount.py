"""Token counts by batch encoding: Arrow functions that return lengths only.

Texts are encoded in batches of about equal bytes. A text of over `long` characters is first cut before single spaces
between characters that aren't white space. That is safe where no piece of the vocabulary has the space mark after
another character, the text is taken as it is, and a space is put before it: then no merge reaches over the cut, and
the space put before a part stands for the one that was cut off. Where a model isn't like this, texts stay whole.

Defined results: null text counts as empty, with 0 bytes and 0 tokens; bytes that aren't UTF-8 are read as U+FFFD, which
also is what n_bytes counts; repeated rows are counted each; other columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from agendum.llm.common import by_bytes, text_of, utf8

LONG = 32_000
MARK = "▁"
_CUT = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")


class Counter:
    def __init__(self, name: str, long: int = LONG):
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.long = long if self._splits() else None

    def _splits(self) -> bool:
        """Whether texts can be cut before a single space."""
        inside = any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size()))
        probe = "a  b Ａ "
        as_is = "".join(self.model.encode(probe, out_type=str, num_threads=1)).startswith(f"{MARK}a{MARK * 2}b")
        return not inside and as_is

    def parts(self, text: str) -> list[str]:
        if not self.long or len(text) <= self.long:
            return [text]
        out, at = [], 0
        while len(text) - at > self.long:
            cut = _CUT.search(text, at + self.long)
            if not cut:
                break
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.parts(t) for t in texts]
        lengths = iter([len(x) for x in self.model.encode([p for own in parts for p in own], num_threads=1)])
        return [sum(next(lengths) for _ in own) for own in parts]


@lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    return Counter(name)


def count_tokens(docs: DataFrame, name: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(name)
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(1))]
            for i, j in by_bytes(texts, 1 << 20):
                n = own.count([t.decode() for t in texts[i:j]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
