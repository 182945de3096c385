"""Approximate nearest neighbours by a permutation index.

`pivots` vectors are the reference points: of the `sample` vectors of least hash, each next pivot is the one farthest
from those before it, so that a crowded region gets no more of them than its extent asks for. The sample only places
pivots; every vector is indexed and can be found. Every vector is represented by its `prefix` nearest pivots in order,
posted in their inverted files, and homed with its nearest one. A query opens the homes of its own `probe` nearest
pivots, ranks what lives there by the footrule distance of the two permutations (cut at `prefix`), summed up from the
inverted files, and reranks the best `share` of each block by the exact inner product in double precision. Homes are
laid into blocks of at most `block` vectors (a larger one is split over several), queries into blocks too, so no task's
input grows with the table.

The footrule distance of two cut permutations is a constant less twice the sum over shared pivots of
min(prefix - rank, prefix - rank), so a block keeps, for each pivot, the column of prefix - rank of its vectors.

To find largest inner products among vectors of any length, stored vectors get one more component that makes all of
them as long as the longest, and queries a zero. Equal vectors are indexed once, with their smallest k + 1 ids, which
is all that an answer of k can need.

Defined results: rows with a null id, and vectors that are null, empty, zero, of another dimension than most, or that
hold null or non-finite components, take no part; rows that repeat a vec_id count once (the least vector, if they
differ); fewer than k candidates are all returned; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from agendum.llm.common import cut_lineage


@dataclass(frozen=True)
class Index:
    """prefix is at most 255. A block of queries is large, as each block of vectors goes to every one of them."""

    pivots: int = 256
    prefix: int = 64
    probe: int = 208
    share: float = 0.25
    block: int = 16_384
    queries: int = 32_768
    sample: int = 4096


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector): one row an id, vectors in double precision, only those that take part."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    kept = rows.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: x + F.lit(0.0)).alias("vector"))
    return kept.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the unit vectors x, farthest first, from the first of them."""
    gap, chosen = np.full(len(x), np.inf), []
    while len(chosen) < min(n, len(x)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, 2 - 2 * (x @ x[chosen[-1]]))
        gap[chosen] = -np.inf
    return x[chosen]


def _permuted(rows: DataFrame, pivots: np.ndarray, longest: float, stored: bool, index: Index) -> DataFrame:
    """Adds `near`, the ordered numbers of the prefix nearest pivots, and for queries those to open."""
    n = min(len(pivots), index.prefix if stored else max(index.prefix, index.probe))
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",near:array<smallint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("vector").to_pylist(), float).reshape(batch.num_rows, -1)
            extra = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0)) if stored else np.zeros(len(x))
            length = np.sqrt((x * x).sum(1) + extra**2)
            near = np.argsort(-(np.column_stack((x, extra)) / length[:, None]) @ pivots.T, 1, kind="stable")[:, :n]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int16).tolist(), pa.list_(pa.int16()))], [*batch.schema.names, "near"])

    return rows.mapInArrow(run, schema)


def _layout(sizes: dict[int, int], index: Index) -> tuple[list[list[int]], int]:
    """The blocks of each file, and their number: small files share a block, a large one is split over several."""
    homes: list[list[int]] = [[] for _ in range(index.pivots)]
    blocks, room = 0, 0
    for file, n in sorted(sizes.items()):
        if n > index.block:
            parts = -(-n * 5 // (4 * index.block))  # hashes don't split evenly
            homes[file] = list(range(blocks, blocks + parts))
            blocks, room = blocks + parts, 0
            continue
        if n > room:
            blocks, room = blocks + 1, index.block
        homes[file], room = [blocks - 1], room - n
    return homes, blocks


def _best(stored: pa.Table, asked: pa.Table, k: int, index: Index) -> pa.Table:
    """The best k + 1 stored vectors of one block for each query of one block."""
    names = ["query", "rep", "score"]
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    if not stored.num_rows or not asked.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
    flat = lambda t, c, kind: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(t.num_rows, -1)
    near, x, reps = flat(stored, "near", np.int64), flat(stored, "vector", float), stored.column("rep").to_numpy()
    l = near.shape[1]
    files = np.zeros((index.pivots, len(reps)), np.uint8)  # a pivot's inverted file is a row: prefix - rank of each vector, 0 outside
    files[near, np.arange(len(reps))[:, None]] = l - np.arange(l)
    weight = (l - np.arange(l)).astype(np.uint8)[:, None]
    out: list[tuple] = []
    for query, q, own in zip(asked.column("query").to_pylist(), flat(asked, "vector", float), flat(asked, "near", np.int64), strict=True):
        opened = np.zeros(index.pivots, bool)
        opened[own[: index.probe]] = True
        at = np.flatnonzero(opened[near[:, 0]])
        if not len(at):
            continue
        keep = max(16 * k, int(np.ceil(index.share * len(at))))
        if keep < len(at):
            shared = np.minimum(files[own[:l]], weight).sum(0, dtype=np.uint16)[at].astype(np.int32)
            at = at[np.argpartition(-shared, keep)[:keep]]
        if len(at) > k + 1:  # those that can be among the best, whatever the order of the sums
            rough = x[at] @ q
            at = at[rough >= np.partition(rough, -k - 1)[-k - 1] - 1e-9 * np.abs(rough).max()]
        score = (x[at] * q).sum(1)
        first = np.lexsort((reps[at], -score))[: k + 1]
        out += zip([query] * len(first), reps[at][first].tolist(), score[first].tolist(), strict=True)
    columns = list(zip(*out, strict=True)) or [()] * 3
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, index: Index = Index()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query (a condition on vec_id) its k nearest others."""
    spark = rows.sparkSession
    known = cut_lineage(usable(rows))
    empty = "query_id long, rank int, vec_id long, score double"
    common = known.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], empty)
    known = known.where(F.size("vector") == common["d"])
    first_ids = Window.partitionBy("vector").orderBy("vec_id")  # the limit on row_number also cuts before the shuffle
    members = known.withColumn("n", F.row_number().over(first_ids)).where(F.col("n") <= k + 1)
    distinct = cut_lineage(members.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    longest = float(np.sqrt(distinct.agg(F.max(square)).first()[0]))
    chosen = np.array([r[0] for r in distinct.orderBy(F.xxhash64("vector"), "rep").limit(max(index.pivots, index.sample)).select("vector").collect()])
    extra = np.sqrt(np.maximum(longest**2 - (chosen * chosen).sum(1), 0))
    pivots = _spread(np.column_stack((chosen, extra)) / max(longest, 1e-300), index.pivots)
    stored = cut_lineage(_permuted(distinct.select("rep", "vector"), pivots, longest, True, index).withColumn("file", F.col("near")[0].cast("int")))
    homes, blocks = _layout({r["file"]: r["count"] for r in stored.groupBy("file").count().collect()}, index)  # a row a pivot
    home = F.array(*[F.array(*map(F.lit, h)) if h else F.array().cast("array<int>") for h in homes])
    queries = known.where(is_query)
    asked = queries.groupBy("vector").agg(F.min("vec_id").alias("query"))
    asked_near = _permuted(asked.select("query", "vector"), pivots, longest, False, index)
    opened = F.array_distinct(F.flatten(F.transform(F.slice("near", 1, index.probe), lambda p: F.element_at(home, p.cast("int") + 1))))
    n_queries = queries.count()
    parts = max(1, -(-n_queries * 5 // (4 * index.queries)))
    part = F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part")
    left = stored.withColumn("own", F.element_at(home, F.col("file") + 1)).select("rep", "vector", "near", F.expr("own[cast(pmod(xxhash64(rep), size(own)) as int)]").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = asked_near.select("query", "vector", "near", F.explode(opened).alias("block"), part)
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(lambda a, b: _best(a, b, k, index), "query long, rep long, score double")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    vectors = found.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    answer = F.array_sort(F.flatten(F.collect_list(F.expr("transform(ids, i -> struct(-score as down, i as vec_id, score as score))"))))
    lists = vectors.join(distinct.select("rep", "ids"), "rep").groupBy("query").agg(F.slice(answer, 1, k + 1).alias("found"))
    each = queries.join(asked, "vector").select(F.col("vec_id").alias("query_id"), "query").join(lists, "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("at", "one")).select("query_id", (F.col("at") + 1).alias("rank"), "one.vec_id", "one.score")
