"""Personal data and prompt injections in untrusted text."""

from __future__ import annotations

import bisect
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from agendum.functions import patterns as P

_PERSONAL = [(kind, re.compile(pattern)) for kind, pattern in P.PERSONAL]
_RULES = [(name, severity, re.compile(pattern, re.I)) for name, severity, pattern in P.INJECTION]


def checksum_ok(digits: str) -> bool:
    doubled = [int(d) * (1 + (i % 2 == len(digits) % 2)) for i, d in enumerate(digits)]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _plausible(kind: str, value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    if kind == "CARD":
        return 13 <= len(digits) <= 19 and checksum_ok(digits)
    if kind == "AADHAAR":
        return len(digits) == 12
    return kind != "IP" or all(int(part) <= 255 for part in value.split("."))


def personal_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order; kinds of higher priority claim their places first."""
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []  # in order, so that only neighbours can overlap a new one
    for kind, pattern in _PERSONAL:
        for m in pattern.finditer(text or ""):
            start, end = m.span()
            k = bisect.bisect_left(starts, start)
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end) and _plausible(kind, m.group()):
                starts.insert(k, start)
                taken.insert(k, (start, end, kind))
    return [(kind, s, e) for s, e, kind in taken]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by `[REDACTED:KIND]`."""
    out, at = [], 0
    for kind, start, end in spans:
        out += [text[at:start], f"[REDACTED:{kind}]"]
        at = end
    return "".join([*out, text[at:]])


_SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
_FOUND = T.StructType().add("found", _SPANS).add("scrubbed", "string")
#: Every kind of personal data holds a digit or an `@`.
CANDIDATE = r"[@\p{Nd}]"


@F.arrow_udf(_FOUND)
def _personal(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        spans = personal_spans(text)
        out.append(text if text is None else {"found": [{"kind": k, "start": s, "end": e} for k, s, e in spans], "scrubbed": redacted(text, spans)})
    return pa.array(out, pa.struct([("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("scrubbed", pa.string())]))


def scrub(rows: DataFrame, column: str = "text") -> DataFrame:
    """Adds `scrubbed`, `found` (the spans), `n_redacted` and `kinds` (kind to count). Texts that can't hold personal data
    aren't sent to Python."""
    text = F.col(column)
    looked = rows.withColumn("_p", _personal(F.when(text.rlike(CANDIDATE), text)))
    found = F.coalesce("_p.found", F.array().cast(_SPANS))
    counted = looked.withColumns({"scrubbed": F.coalesce("_p.scrubbed", column), "found": found}).drop("_p")
    kinds = F.array_distinct(F.transform("found", lambda s: s["kind"]))
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")))
    return counted.withColumns({"n_redacted": F.size("found"), "kinds": counts})


def scrub_transcripts(transcripts: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcripts (job_id, text) and their segments (job_id, seg, text), scrubbed each on their own. A transcript's
    `pii_total` is the number of findings in its text and in its segments, which repeat it: both count."""
    parts = scrub(segments)
    own = parts.groupBy("job_id").agg(F.sum("n_redacted").alias("__n"))
    whole = scrub(transcripts).join(own, "job_id", "left").withColumn("pii_total", F.col("n_redacted") + F.coalesce("__n", F.lit(0))).drop("__n")
    return whole, parts


@F.pandas_udf(T.ArrayType(T.StructType().add("rule", "string").add("severity", "string").add("start", "integer").add("end", "integer").add("excerpt", "string")))
def injections(texts: pd.Series) -> pd.Series:
    """All matches of all rules by place, then rule; excerpts reach 20 characters beyond."""
    def one(text: str | None) -> list[dict]:
        text = text or ""
        found = [{"rule": name, "severity": severity, "start": m.start(), "end": m.end(), "excerpt": text[max(0, m.start() - 20) : m.end() + 20].strip()} for name, severity, pattern in _RULES for m in pattern.finditer(text)]
        return sorted(found, key=lambda f: f["start"])

    return texts.map(one)


def injection_rules(text: Column) -> Column:
    """The names of the rules that match, sorted, without Python."""
    hits = [F.when(text.rlike(P.java(pattern)), F.lit(name)) for name, _, pattern in P.INJECTION]
    return F.array_sort(F.array_compact(F.array(*hits)))


def worst(rules: Column) -> Column:
    """The severity of the worst of these rules; null if there are none."""
    out = F.lit(None).cast("string")
    for level in P.SEVERITIES:
        out = F.when(F.arrays_overlap(rules, F.array(*[F.lit(n) for n, s, _ in P.INJECTION if s == level])), level).otherwise(out)
    return out
