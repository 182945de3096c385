"""From transcripts to agenda blocks, decisions and actions: the rule-based arm, one plan over all transcripts."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from agendum.functions import patterns as P, text as X

#: Sentences after which a block ends without a cue.
BLOCK_SENTENCES = 6


def sentences(texts: DataFrame, keys: Sequence[str] = ("job_id",), stops: str = X.TERMINATORS) -> DataFrame:
    """(keys..., i, sentence, start, end) from (keys..., text), offsets in code points.

    Pieces become rows, whose lengths a window adds up, so a text's length doesn't matter; what follows is laid out by
    the same keys.
    """
    each = texts.select(*keys, F.posexplode(X.pieces(F.col("text"), stops)).alias("k", "piece"))
    order = Window.partitionBy(*keys).orderBy("k")
    placed = each.withColumn("end", F.sum(F.length("piece")).over(order).cast("int")).where(X.is_run(F.col("piece"), stops))
    return placed.select(*keys, (F.row_number().over(order) - 1).alias("i"), X.strip(F.col("piece")).alias("sentence"), (F.col("end") - F.length("piece")).alias("start"), "end")


#: Runs up to a stop, with it, by the stops; lone stops and line feeds lie between them.
_RUNS = {stops: re.compile(f"[^{stops}\n]+[{stops}]?") for stops in (X.TERMINATORS, "," + X.TERMINATORS)}


def located(text: str, parts: Sequence[str | None]) -> list[tuple[str, int, int]]:
    """Where a text's segments are, if all that aren't blank are found one after the other; else empty."""
    out, at = [], 0
    for part in filter(None, ((p or "").strip() for p in parts)):
        start = text.find(part, at)
        if start < 0:
            return []
        at = start + len(part)
        out.append((part, start, at))
    return out


def runs(text: str, stops: str = X.TERMINATORS) -> list[tuple[str, int, int]]:
    """What sentences() gives for one text: (sentence, start, end)."""
    each = ((m.group().strip(), m.start(), m.end()) for m in _RUNS[stops].finditer(text))
    return [s for s in each if s[0]]


def tiered(text: str | None, parts: Sequence[str | None] | None = None) -> list[tuple[str, int, int]]:
    """runs() of a text by the first tier that fits: its own segments, where all are found in order; its terminators;
    clauses at commas, where those are too few (as X.by_clauses says)."""
    text = text or ""
    if found := located(text, parts or ()):
        return found
    found, stops = runs(text), sum(map(text.count, X.TERMINATORS))
    if found and (len(text) + 1) / 2 > 40 * stops:  # else there can't be enough words
        n = len(text.split())
        if n >= 12 and (stops == 0 or n / stops > 40) and len(clauses := runs(text, "," + X.TERMINATORS)) > len(found):
            return clauses
    return found


def with_parts(texts: DataFrame, keys: Sequence[str] = ("job_id",), segments: DataFrame | None = None) -> DataFrame:
    """(keys..., text, parts) of (keys..., text): the texts of a text's segments (keys..., seg, text) in order, null without.

    Texts are made valid UTF-8, as Arrow functions read them.
    """
    rows = texts.select(*keys, F.make_valid_utf8("text").alias("text"))
    if segments is None:
        return rows.withColumn("parts", F.lit(None).cast("array<string>"))
    lists = segments.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda s: F.make_valid_utf8(s["text"])).alias("parts"))
    return rows.join(lists, list(keys), "left")


@F.arrow_udf(T.ArrayType(T.StructType().add("sentence", "string").add("start", "integer").add("end", "integer")))
def _spans(texts: pa.Array, parts: pa.Array) -> pa.Array:
    keys = ("sentence", "start", "end")
    made = [[dict(zip(keys, s, strict=True)) for s in tiered(t, p)] for t, p in zip(texts.to_pylist(), parts.to_pylist(), strict=True)]
    return pa.array(made, pa.list_(pa.struct([("sentence", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))


def tiered_sentences(texts: DataFrame, keys: Sequence[str] = ("job_id",), segments: DataFrame | None = None) -> DataFrame:
    """(keys..., i, sentence, start, end): tiered() of (keys..., text), with the texts' own segments (keys..., seg, text)."""
    rows = with_parts(texts, keys, segments).withColumn("spans", _spans(F.col("text"), F.col("parts")))
    return rows.select(*keys, F.posexplode("spans").alias("i", "s")).select(*keys, "i", "s.sentence", "s.start", "s.end")


def timings(spoken: DataFrame) -> DataFrame:
    """Synthetic times of sentences (job_id, i, sentence): words at 2.5 a second, 1 s at least, laid end to end."""
    duration = F.greatest(F.lit(1.0), X.n_words(F.col("sentence")) / 2.5)
    before = Window.partitionBy("job_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("d").over(before), F.lit(0.0))
    return spoken.withColumn("d", duration).select("job_id", "i", "sentence", F.round(at, 2).alias("start"), F.round(at + F.col("d"), 2).alias("end"))


def blocks_of(rows: DataFrame, n: int = BLOCK_SENTENCES) -> DataFrame:
    """Adds `cue` and `position`, the agenda block of each sentence (job_id, i, sentence).

    A block starts at a topic cue or after n sentences. Sentences fall into islands, one a cue; within an island every
    n sentences are a block, so a running count replaces the loop.
    """
    cue = X.has(F.col("sentence"), P.TOPIC)
    run = Window.partitionBy("job_id").orderBy("i")
    rows = rows.withColumn("cue", cue).withColumn("island", F.sum((F.col("cue") & (F.row_number().over(run) > 1)).cast("int")).over(run))
    return _positions(rows, n)


def _positions(rows: DataFrame, n: int) -> DataFrame:
    inner = Window.partitionBy("job_id", "island").orderBy("i")
    part = F.floor((F.row_number().over(inner) - 1) / n)
    rows = rows.withColumn("part", part)
    order = Window.partitionBy("job_id").orderBy("island", "part")
    return rows.withColumn("position", F.dense_rank().over(order) - 1).drop("island", "part")


def block_title(sentence, position):
    cleaned = F.regexp_replace(F.regexp_replace(sentence, P.java(P.TOPIC), ""), r"^[ ,.:;—-]+|[ ,.:;—-]+$", "")
    title = F.array_join(F.slice(X.words(cleaned), 1, 8), " ")
    return F.when(title == "", F.format_string("Agenda item %d", position + 1)).otherwise(F.concat(F.upper(F.substring(title, 1, 1)), title.substr(F.lit(2), F.length(title))))


def agenda(rows: DataFrame) -> DataFrame:
    """(job_id, position, title, text, n_sentences, confidence) of sentences with their positions."""
    first = F.min(F.struct("i", "sentence", "cue"))
    made = rows.groupBy("job_id", "position").agg(first.alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda s: s["sentence"]), " ").alias("text"), F.count("*").alias("n_sentences"))
    return made.select("job_id", "position", block_title(F.col("first.sentence"), F.col("position").cast("int")).alias("title"), "text", "n_sentences", F.when(F.col("first.cue"), 0.75).otherwise(0.45).alias("confidence"))


def items(blocks: DataFrame) -> DataFrame:
    """(job_id, position, kind, text, evidence, owner, deadline, confidence): a sentence can be both kinds.

    Slots are columns before the kinds are told apart, so that each pattern is tried once a sentence, in compiled code.
    """
    each = blocks.select("job_id", "position", F.explode(X.extractor_sentences(F.col("text"))).alias("evidence"))
    s = F.col("evidence")
    each = each.withColumns({"is_decision": X.has(s, P.DECISION), "is_action": X.has(s, P.ACTION)}).where("is_decision or is_action")
    each = each.withColumns({"due": X.deadline(s), "who": F.when(F.col("is_action"), X.owner(s)), "text": X.normalised(s), "hedged": X.has(s, P.HEDGE), "n": X.n_words(s)})
    scores = {kind: X.confidence(base, F.col("hedged"), F.col("n"), F.col("due")) for kind, base in (("decision", 0.62), ("action", 0.58))}
    each = each.withColumns({f"as_{kind}": score for kind, score in scores.items()})
    none = F.lit(None).cast("string")
    item = lambda kind, owner, due: F.when(F.col(f"is_{kind}"), F.struct(F.lit(kind).alias("kind"), owner.alias("owner"), due.alias("deadline"), F.col(f"as_{kind}").alias("confidence")))
    found = F.array_compact(F.array(item("decision", none, none), item("action", F.col("who"), F.col("due"))))
    return each.select("job_id", "position", "text", "evidence", F.explode(found).alias("x")).select("job_id", "position", "x.kind", "text", "evidence", "x.owner", "x.deadline", "x.confidence")


def extract(transcripts: DataFrame) -> DataFrame:
    """Items of whole transcripts (job_id, text): sentences, blocks, extraction."""
    return items(agenda(blocks_of(sentences(transcripts))))
