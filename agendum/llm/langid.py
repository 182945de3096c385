"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to 3, learned from its texts in lower case: after a context that was seen
n times with q different next bytes, a byte seen c times costs -log2(c / (n + q)) bits and the escape to the next
shorter context -log2(q / (n + q)); below order 0 every byte costs 8 bits; an unseen context costs nothing to leave.
The statistics are frozen after learning, so the cost of a byte depends on it and the three before it only. A text's
exact code length in a language is the sum over all its bytes, taken by table look-up of its 4-grams: those met in
learning are priced beforehand, others when they occur. The shortest code wins (ties: the smaller name); the score is
the posterior probability of the winner for texts of equal prior.

Learning takes a bounded sample: of each language the `sample` texts whose ids have the least hashes, fewer where there
are so many languages that all together would pass `all_langs`, but `least` at any rate. Every language is learned. The
texts are counted on the executors; the driver gets counts of 4-grams. Of every four texts one is kept from learning, to
find how many bits a byte a text of the language takes: one that takes far more (`fits` is false) is in none of the
learned languages, or noise. Everything else is over all rows and whole texts.

Defined results: null text, or text without a letter, gives `und` and score 0; with nothing to learn from, every text
does; bytes that aren't UTF-8 are read as U+FFFD; repeated rows give repeated results; null ids are never learned from,
keep a null `held_out`, and are filtered by their texts like others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from agendum.llm.common import Workspace, by_bytes, id_crc, text_of, unit_hash, utf8

ORDER = 3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SLOTS = 22


def lowered(text: bytes) -> np.ndarray:
    """The text in lower case after three line feeds, so that its first byte has a full context."""
    return np.frombuffer(b"\n\n\n" + text.decode("utf-8", "replace").lower().encode(), np.uint8)


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n-grams that end at each byte from the fourth on, as numbers."""
    out = data[ORDER + 1 - n : len(data) - n + 1].astype(np.uint32)
    for i in range(1, n):
        out = out << np.uint32(8) | data[ORDER + 1 - n + i : len(data) - n + 1 + i]
    return out


class _Order:
    """Costs of one order: bits of each seen (context, byte), and of the escape from each context."""

    def __init__(self, per_lang: list[tuple[np.ndarray, np.ndarray]]):
        self.events, self.bits = self._table(per_lang, self._event_bits)
        self.contexts, self.escape = self._table([self._escapes(*x) for x in per_lang], lambda keys, bits: bits)
        self.escape = np.nan_to_num(self.escape, nan=0.0)

    @staticmethod
    def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        contexts, where = np.unique(keys >> np.uint32(8), return_inverse=True)
        return contexts, where, np.bincount(where, counts, len(contexts)), np.bincount(where, minlength=len(contexts))

    def _event_bits(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        _, where, n, q = self._totals(keys, counts)
        return np.log2((n + q)[where] / counts)

    def _escapes(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        contexts, _, n, q = self._totals(keys, counts)
        return contexts, np.log2((n + q) / q)

    @staticmethod
    def _table(per_lang, bits) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in per_lang]))
        out = np.full((len(keys), len(per_lang)), np.nan)
        for i, (k, c) in enumerate(per_lang):
            out[np.searchsorted(keys, k), i] = bits(k, c)
        return keys, out

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys


Counts = tuple[np.ndarray, np.ndarray]


def summed(keys: np.ndarray, counts: np.ndarray) -> Counts:
    """Equal keys as one, in order, with their counts added."""
    out, where = np.unique(keys, return_inverse=True)
    return out, np.bincount(where, counts, len(out)).astype(np.int64)


def counted(texts: list[bytes]) -> Counts:
    """The 4-grams of texts with their counts, in pieces of bounded memory."""
    found = (np.empty(0, np.uint32), np.empty(0, np.int64))
    for text in texts:
        data = lowered(text)
        for i in range(ORDER, len(data), 1 << 20):
            keys = grams(data[i - ORDER : i + (1 << 20)], ORDER + 1)
            found = summed(np.concatenate((found[0], keys)), np.concatenate((found[1], np.ones(len(keys), np.int64))))
    return found


class Trees:
    """The frozen context trees of all languages, from the counts of their 4-grams, whose ends count the shorter ones."""

    def __init__(self, counts: dict[str, Counts]):
        self.langs = sorted(counts)
        self.orders = [_Order([summed(keys & np.uint32((1 << 8 * (o + 1)) - 1), n) for keys, n in map(counts.get, self.langs)]) for o in range(ORDER + 1)]
        self.keys = self.orders[ORDER].events
        self.costs = self._price(self.keys)
        self.most = np.full(len(self.langs), np.inf)
        self._slots = None

    def _price(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each 4-gram's last byte in each language."""
        total = np.zeros((len(keys), len(self.langs)))
        open_ = np.ones(total.shape, bool)
        for o in range(ORDER, -1, -1):
            order, own = self.orders[o], keys & np.uint32((1 << 8 * (o + 1)) - 1)
            at, hit = order.find(order.events, own)
            bits = np.where(hit[:, None], order.bits[at], np.nan)
            seen = open_ & ~np.isnan(bits)
            total[seen] += bits[seen]
            open_ &= ~seen
            at, hit = order.find(order.contexts, own >> np.uint32(8))
            total += np.where(open_ & hit[:, None], order.escape[at], 0.0)
        return total + 8.0 * open_

    def _index(self) -> np.ndarray:
        """Direct look-up by hash; where keys share a slot the last one holds it and others are searched for."""
        if self._slots is None:
            self._slots = np.zeros(1 << _SLOTS, np.int32)
            self._slots[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        return self._slots

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Exact bits of the whole text in each language, in pieces of bounded memory."""
        data, slots, bits = lowered(text), self._index(), np.zeros(len(self.langs))
        for i in range(ORDER, len(data), 1 << 20):
            keys = grams(data[i - ORDER : i + (1 << 20)], ORDER + 1)
            at = slots[self._slot(keys)]
            miss = np.flatnonzero(self.keys[at] != keys)
            if len(miss):
                where, hit = _Order.find(self.keys, keys[miss])
                at[miss] = where
                fresh, n = np.unique(keys[miss[~hit]], return_counts=True)
                if len(fresh):
                    bits += n @ self._price(fresh)
                    at = np.delete(at, miss[~hit])
            bits += np.bincount(at, minlength=1) @ self.costs[: int(at.max()) + 1] if len(at) > len(self.keys) else self.costs[at].sum(0)
        return bits

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """The language, its posterior, and whether the text takes no more bits than texts of that language do."""
        if not self.langs or text is None or not _LETTER.search(text.decode("utf-8", "replace")):
            return UNKNOWN, 0.0, False
        bits = self.code_lengths(text)
        best = int(np.argmin(bits))
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()), bool(bits[best] <= self.most[best] * len(text) + SLACK)


class NoTrees(Trees):
    def __init__(self):
        self.langs = []


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learned from."""

    sample: int = 500
    all_langs: int = 8000
    least: int = 8


#: Languages whose shares are broadcast, a few MB; where there are more, they are joined.
MOST_BROADCAST = 50_000
#: Bits that any text may take beyond its language's rate: as many as 16 unpredictable bytes.
SLACK = 128.0


def learn(labelled: DataFrame, bound: Sample = Sample()) -> Trees:
    """Trees from (doc_id, text, lang) rows; rows without text or lang teach nothing."""
    rows = labelled.select("doc_id", text_of("text").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and length(text) > 0 and lang is not null")
    sizes = rows.groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return NoTrees()
    most = max(bound.least, min(bound.sample, bound.all_langs // len(sizes)))
    shares = rows.sparkSession.createDataFrame([(r["lang"], 1.5 * most / r["count"]) for r in sizes], "lang string, share double")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    shares = F.broadcast(shares) if len(sizes) <= MOST_BROADCAST else shares
    near = rows.withColumn("h", unit_hash(F.col("doc_id"), F.lit("langid"))).join(shares, "lang").where("h < share")
    work = Workspace(rows.sparkSession)
    sample, _ = work.put("sample", near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("lang", "k", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                keys, n = counted(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    found = sample.where("k % 4 > 0").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    of, gram, n = names.indices.to_numpy(), found.column("gram").to_numpy().astype(np.uint32), found.column("n").to_numpy()
    trees = Trees({lang: summed(gram[of == i], n[of == i]) for i, lang in enumerate(names.dictionary.to_pylist())})
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            langs, texts = batch.column(0), utf8(batch.column(1))
            bits = [own.code_lengths(t)[own.langs.index(x)] / len(t) if x in own.langs else None for x, t in zip(langs.to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([langs, pa.array(bits, pa.float64())], ["lang", "rate"])

    kept = sample.where("k % 4 = 0").select("lang", "text").mapInArrow(rate, "lang string, rate double").groupBy("lang").agg(F.greatest(2 * F.avg("rate"), 1.25 * F.max("rate")).alias("most"))
    rates = {r["lang"]: r["most"] for r in kept.collect()}
    shared.unpersist()
    trees.most = np.array([rates.get(x) or max(filter(None, rates.values()), default=np.inf) for x in trees.langs])
    work.drop("sample")
    return trees


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, lang_pred, score, fits) of every row of docs, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in by_bytes(texts):
                found = [shared.value.predict(x) for x in texts[i:j]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "fits"])

    return docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, fits boolean")


def languages(docs: DataFrame, bound: Sample = Sample(), folds: int = 5) -> DataFrame:
    """identify() with trees learned from the rows whose id's crc32 isn't divisible by folds; held_out marks the others."""
    held = id_crc(F.col("doc_id")) % folds == 0
    trees = learn(docs.where(~held), bound)
    return identify(docs, trees).select("doc_id", held.alias("held_out"), "lang_pred", "score", "fits")


def in_known_language(docs: DataFrame, bound: Sample = Sample(), least: float = 0.5, folds: int = 5) -> DataFrame:
    """The documents that fit their language and whose posterior of it is `least` or more; the others go. Each row is
    judged by its own text, where it is."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs.where(id_crc(F.col("doc_id")) % folds != 0), bound))

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(x) for x in utf8(texts)]
        return pa.array([fits and score >= least for _, score, fits in found], pa.bool_())

    return docs.where(known(text_of("text")))
