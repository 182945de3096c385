"""Connected components by small steps that each halve what is left; neither links nor labels leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agendum.llm.common import Workspace


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the links (a, b), for all nodes but the least ones."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    below = root != np.arange(len(names))
    return names[below], names[root[below]]


def _local(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, u = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            v, u = joined(*(np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate((v, u))))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], ["v", "u"])

    return edges.mapInArrow(run, "v long, u long")


def components(links: DataFrame, work: Workspace, most_rounds: int = 64) -> DataFrame:
    """(id, component) of every end of `links` (a, b) that isn't the smallest id it can reach, which is its component.

    Edges lead from an id to a smaller one. A round lets each edge lead on to the least id that its target leads to (a
    plain join, whose hubs adaptive execution splits), then lays the edges of an id into one task, which joins up all it
    has: every id there leads to the least one of its part. Rounds end when the edges stay as they are: by then all lead
    to the smallest ids. (Otherwise some edge leads to an id u that leads on. It came out of a task where u was least,
    so u stood there only as the target of an edge from beyond an id t that leads to u; t's own edge came out likewise,
    from beyond a larger id, and so on without end.)
    """
    figures = {"check": F.bit_xor(F.xxhash64("v", "u"))}
    edges, was = work.put("edges", _local(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))), **figures)
    for _ in range(most_rounds):
        if not was["n"]:
            break
        beyond = edges.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("m"))
        onward = edges.join(beyond, "u", "left").select("v", F.coalesce("m", "u").alias("u"))
        edges, now = work.put("edges", _local(onward.repartition("v")), **figures)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"labels still change after {most_rounds} rounds")
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
