"""What the operators share: text columns, ids, deterministic samples, tables in the shared folder, byte-bounded batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Bytes of text that an Arrow function works on at a time.
BATCH_BYTES = 4 << 20
#: Bits of the largest bitmap that is broadcast: 8 MB.
MOST_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A column as text that is valid UTF-8: bytes that aren't are read as U+FFFD. Every operator reads its texts by this."""
    return F.make_valid_utf8((F.col(column) if isinstance(column, str) else column).cast("string"))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as decimal text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def unit_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on nothing but the columns' values."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 31)) / F.lit(float(1 << 31))


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by `spark.checkpoint.dir`.

    Where it is unset, local mode (tests) gets a temporary folder; on a cluster that is an error, as executors don't see
    each other's disks.
    """
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="shared-"))
    return _local[0]


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """Tables of one computation in the shared folder. A table cuts lineage, survives lost executors and is read by columns."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}", 0
        self.paths: dict[str, str] = {}

    def put(self, name: str, rows: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        """Writes rows; returns the table that was written and its figures, aggregates counted on the way: n, its rows,
        and those asked for. A name that is used again replaces its table, which must not be read any more."""
        self.n += 1
        path, seen = f"{self.at}/{self.n}-{name}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n"), *[f.alias(k) for k, f in figures.items()]).write.parquet(path)
        if name in self.paths:
            delete(self.spark, self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(rows.schema).parquet(path), seen.get

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and lets Spark delete the shuffle files of what is done: it does
        so for what the driver's garbage collection finds unused."""
        for name in names:
            delete(self.spark, self.paths.pop(name))
        gc.collect()
        self.spark._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A table of these rows in the shared folder, so that lost executors cost no recomputation."""
    return Workspace(df.sparkSession).put("rows", df)[0]


def sieved(rows: DataFrame, key: str, ids: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """rows with two more columns, and a condition on them: false only where `key` is none of the n `ids` (a column of
    that name); it may be true for others. So most rows can be told apart before a join, without a shuffle.

    The ids become a bitmap by one hash, 16 bits an id but at most MOST_BITS in all, which is broadcast.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    maps = ids.select(F.bitmap_bucket_number(at).alias("__bucket"), F.bitmap_bit_position(at).alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    joined = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(maps), "__bucket", "left")
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.col("__map").substr((F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return joined, F.col("__map").isNotNull() & (F.floor(byte / F.pow(F.lit(2.0), bit % 8)) % 2 == 1)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def by_bytes(texts: Iterable[bytes | str | None], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges of at most `most` bytes; a longer text is a range of its own."""
    yield from by_sizes((len(t or b"") for t in texts), most)


def by_sizes(sizes: Iterable[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """by_bytes() for what has these sizes."""
    start, size, n = 0, 0, 0
    for n, own in enumerate(sizes, 1):
        if size + own > most and start < n - 1:
            yield start, n - 1
            start, size = n - 1, 0
        size += own
    if start < n:
        yield start, n
