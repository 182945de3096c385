"""Speakers of transcript segments: by hash, or from the turns of a diarizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hashed_speaker(text: Column) -> Column:
    """One of three labels by the first byte of the text's SHA-1."""
    return F.format_string("SPEAKER_%02d", (F.conv(F.substring(F.sha1(text.cast("binary")), 1, 2), 16, 10).cast("int") % 3))


def renumbered(turns: DataFrame) -> DataFrame:
    """Adds `speaker`: labels of (job_id, turn, start, end, label) numbered by first appearance."""
    first = turns.groupBy("job_id", "label").agg(F.min(F.struct("start", "turn")).alias("first"))
    number = F.dense_rank().over(Window.partitionBy("job_id").orderBy("first")) - 1
    return turns.join(first.select("job_id", "label", F.format_string("SPEAKER_%02d", number).alias("speaker")), ["job_id", "label"])


def assign(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """(job_id, seg, speaker): the turn that overlaps most, else the nearest by middle, else SPEAKER_00.

    Ties go to the earlier turn. Time is cut into buckets as wide as the longer of the mean lengths of segments and
    turns, so that neither side has more than three rows for one in all, and a job's size doesn't show in a bucket's.
    """
    named = renumbered(turns).select("job_id", "turn", F.col("start").alias("t0"), F.col("end").alias("t1"), "speaker")
    pieces = segments.select("job_id", "seg", "start", "end")
    mean = lambda rows, x, y: rows.where(F.col(y) > F.col(x)).agg(F.avg(F.col(y) - F.col(x)).alias("width"))
    width = F.broadcast(mean(pieces, "start", "end").unionAll(mean(turns, "start", "end")).agg(F.coalesce(F.max("width"), F.lit(1.0)).alias("width")))
    best, near = _overlapping(pieces, named, width), _nearest(pieces, named, width)
    found = pieces.select("job_id", "seg").distinct().join(best, ["job_id", "seg"], "left").join(near, ["job_id", "seg"], "left")
    return found.select("job_id", "seg", F.coalesce("best.s", "near.s", F.lit("SPEAKER_00")).alias("speaker"))


def _overlapping(pieces: DataFrame, named: DataFrame, width: DataFrame) -> DataFrame:
    """(job_id, seg, best): the turn that overlaps most; pieces meet the turns of their buckets."""
    bucket = lambda x: F.floor(F.col(x) / F.col("width"))
    cut = lambda rows, x, y: rows.where(F.col(y) > F.col(x)).crossJoin(width).withColumn("bucket", F.explode(F.sequence(bucket(x), bucket(y)))).drop("width")
    overlap = F.least("end", "t1") - F.greatest("start", "t0")
    met = cut(pieces, "start", "end").join(cut(named, "t0", "t1"), ["job_id", "bucket"]).where(overlap > 0)
    return met.groupBy("job_id", "seg").agg(F.max(F.struct(overlap.alias("o"), (-F.col("turn")).alias("t"), F.col("speaker").alias("s"))).alias("best"))


def _nearest(pieces: DataFrame, named: DataFrame, width: DataFrame) -> DataFrame:
    """(job_id, seg, near): the turn with the end nearest the piece's middle, which is the last end before it or the
    first after it: in its own bucket, laid in order, or in the closest one that has any, by the ends of each bucket.
    """
    ends = named.select("job_id", "turn", "speaker", F.explode(F.array("t0", "t1")).alias("x"))
    ends = ends.groupBy("job_id", "x").agg(F.min(F.struct(F.col("turn").alias("t"), F.col("speaker").alias("s"))).alias("own"))
    middles = pieces.select("job_id", ((F.col("start") + F.col("end")) / 2).alias("x"), "seg")
    points = ends.withColumns({"seg": F.lit(None).cast(pieces.schema["seg"].dataType), "place": F.struct("x", "own")}).unionByName(middles, allowMissingColumns=True)
    points = points.crossJoin(width).withColumn("bucket", F.floor(F.col("x") / F.col("width")))
    # the frames run from the start, as Spark fills those that run to the end anew for every row
    each = points.groupBy("job_id", "bucket").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    by_bucket = Window.partitionBy("job_id")
    before = F.last("high", ignorenulls=True).over(by_bucket.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("low", ignorenulls=True).over(by_bucket.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("job_id", "bucket", before.alias("before"), after.alias("after"))
    in_bucket = Window.partitionBy("job_id", "bucket")
    upto = F.last("place", ignorenulls=True).over(in_bucket.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    since = F.last("place", ignorenulls=True).over(in_bucket.orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    sides = points.withColumns({"upto": upto, "since": since}).where(F.col("seg").isNotNull()).join(each, ["job_id", "bucket"])
    gap = lambda p: F.when(p.isNotNull(), F.struct(F.abs(F.col("x") - p["x"]).alias("g"), p["own"]["t"].alias("t"), p["own"]["s"].alias("s")))
    near = F.least(gap(F.coalesce("upto", "before")), gap(F.coalesce("since", "after")))
    return sides.groupBy("job_id", "seg").agg(F.min(near).alias("near"))


def windows(jobs: DataFrame, chunk: float = 600.0, overlap: float = 2.0) -> DataFrame:
    """(job_id, k, start, keep_from) of audio (job_id, seconds) cut into overlapping windows; none where there is no audio."""
    step = max(1.0, chunk - overlap)
    n = F.greatest(F.ceil(F.col("seconds") / step), F.lit(1)).cast("int")
    return jobs.where("seconds > 0").select("job_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select("job_id", "k", (F.col("k") * step).alias("start"), F.when(F.col("k") > 0, F.col("k") * step + overlap / 2).otherwise(0.0).alias("keep_from"))


def stitched(pieces: DataFrame, chunk: float = 600.0, overlap: float = 2.0) -> DataFrame:
    """Pieces (job_id, k, start, ...) without those that a window repeats from the one before it."""
    step = max(1.0, chunk - overlap)
    return pieces.where((F.col("k") == 0) | (F.col("start") >= F.col("k") * step + overlap / 2))
