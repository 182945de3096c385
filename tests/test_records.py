"""Operators over records against plain versions of the same rules."""

import json
import math
import os
import random
import re
import statistics

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from agendum.functions import patterns as P, text as X
from agendum.functions.numbers import rounded, rounded_sql
from agendum.operators import access, evaluate, exports, governance, lineage, minutes, modelarm, privacy, reports, stages, vectors
from agendum.plans import catalogue, records
from agendum.sources import readers, writers


def test_rounding_is_exact(spark, duck):
    rng = random.Random(1)
    values = [0.0625, 2.675, 0.1235, 1.005, -0.5, 0.5, 1.5, 2.5, 0.0, 1e-9, 12345.6785, *(rng.randrange(4000) / rng.choice((8, 16, 80, 2000, 7)) for _ in range(3000))]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3, 4):
        got = [r[0] for r in rows.select(rounded(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]
        assert [duck.execute(f"SELECT {rounded_sql(f'{v!r}::DOUBLE', digits)}").fetchone()[0] for v in values[:40]] == got[:40]


def test_latencies_are_nearest_ranks(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.choice((rng.randrange(20), rng.random() * 100))), rng.random() < 0.1) for k in "abc" for _ in range(rng.choice((1, 30, 3000)))] + [("d", 1.0, True), ("e", None, False)]
    got = {r["k"]: r for r in reports.latencies(spark.createDataFrame(rows, "k string, x double, bad boolean").repartition(5), "k", "x", F.col("bad")).collect()}
    for k in "abcde":
        own = sorted(x for a, x, bad in rows if a == k and not bad and x is not None)
        assert got[k]["n"] == len(own) and got[k]["errors"] == sum(bad for a, _, bad in rows if a == k)
        if own:
            ranks = [own[min(len(own) - 1, max(0, round(p / 100 * len(own) + 0.5) - 1))] for p in (50, 95, 99)]
            assert [got[k][c] for c in ("least", "p50", "p95", "p99", "most")] == [round(x, 1) for x in (own[0], *ranks, own[-1])]
            assert abs(got[k]["mean"] - round(statistics.fmean(own), 1)) < 1e-9
        else:
            assert got[k]["p50"] is None and got[k]["mean"] is None


def test_an_arm_without_runs_counts_nothing(spark):
    kinds = "job_id long, mode string, status string, tool_calls int, denied int, duration_ms double, steps int"
    rows = [(1, "agent", "awaiting_approval", 3, None, 10.0, 4), (1, "agent", "aborted", None, 1, 20.255, None), (2, "no_agent", "completed", 1, 0, 8.0, 0), (3, "agent", "completed", 1, 0, 9.0, 1), (3, "no_agent", "completed", 1, 0, 4.0, 1)]
    got = {r["job_id"]: r.asDict() for r in reports.run_comparison(spark.createDataFrame(rows, kinds)).collect()}
    assert [got[1][f"agent_{c}"] for c in ("runs", "completed", "failed", "suspended_at_gate", "aborted_by_human", "tool_calls", "denied", "mean_ms", "traced_steps")] == [2, 0, 0, 1, 1, 3, 1, round(30.255 / 2, 2), 4]
    assert [got[1][f"no_agent_{c}"] for c in ("runs", "completed", "tool_calls", "mean_ms", "traced_steps")] == [0, 0, 0, None, 0]
    assert (got[1]["human_gates_enforced"], got[2]["writes_without_human_review"], got[1]["overhead_ms"], got[3]["overhead_ms"]) == (2, 1, None, 5.0)


def test_limiter_equals_the_loop(spark):
    rng = random.Random(3)
    hits = [(k, i, float(rng.randrange(200)), rng.random() < 0.1) for k in range(8) for i in range(rng.choice((1, 20, 120)))]
    want = {}
    for k in range(8):
        recent, until = [], -1e9
        for _, i, now, good in sorted((h for h in hits if h[0] == k), key=lambda h: (h[2], h[1])):
            if now < until:
                want[k, i] = False
                continue
            recent = [x for x in recent if x > now - 15]
            want[k, i] = len(recent) < 3
            if len(recent) >= 3:
                until, recent = now + 30, []
            elif good:
                recent = []
            else:
                recent.append(now)
    rows = spark.createDataFrame(hits, "key long, seq long, ts double, success boolean").repartition(4)
    assert {(r["key"], r["seq"]): r["allowed"] for r in governance.limit_rate(rows, 3, 15.0, 30.0).collect()} == want


def test_calls_are_decided_as_one_by_one(spark):
    rng = random.Random(4)
    tools = [stages.Tool("a", max_calls_per_run=2), stages.Tool("b", "write", True, 3), stages.Tool("c", max_calls_per_run=1), stages.Tool("x", max_calls_per_run=9)]
    calls = [(r, i, rng.choice("aabbcxz"), rng.random() < 0.8, rng.random() < 0.6) for r in range(30) for i in range(rng.randint(1, 25))]
    limits, want = {x.name: x for x in tools}, []
    for r in range(30):
        used = {}
        for run, i, tool, valid, granted in calls:
            if run != r:
                continue
            spec, total = limits.get(tool), sum(used.values())
            checks = [(spec is None, "not_allowlisted"), (tool == "x", "not_in_run_allowlist"), (total >= 5, "run_quota_exhausted"), (spec and used.get(tool, 0) >= spec.max_calls_per_run, "tool_quota_exhausted"), (not valid, "invalid_arguments"), (spec and spec.requires_approval and not granted, "approval_required")]
            reason = next((why for fails, why in checks if fails), None)
            if reason is None:
                used[tool] = used.get(tool, 0) + 1
            want.append((r, i, tool, "allowed" if reason is None else "suspended" if reason == "approval_required" else "denied", reason))
    got = governance.decide_calls(spark.createDataFrame(calls, "run_id long, seq int, tool string, valid boolean, granted boolean"), tools, 5, ["a", "b", "c"])
    assert sorted(map(tuple, got.collect()), key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])


def test_redaction_and_shapes(spark):
    def plain(v, depth=0):
        if depth > 4:
            return "[TRUNCATED_DEPTH]"
        if isinstance(v, dict):
            return {k: "[REDACTED]" if k.lower() in governance.SECRET_KEYS else plain(x, depth + 1) for k, x in v.items()}
        return [plain(x, depth + 1) for x in v[:50]] if isinstance(v, list) else v

    rng = random.Random(5)
    made = lambda d: rng.choice((1, None, "s", True)) if d == 0 or rng.random() < 0.2 else [made(d - 1) for _ in range(rng.choice((2, 60)))] if rng.random() < 0.3 else {rng.choice(("a", "b", "Password", "TOKEN", "c")): made(d - 1) for _ in range(3)}
    for _ in range(100):
        value = made(6)
        assert json.loads(governance.redacted(json.dumps(value))) == plain(value)
    text = json.dumps({**{f"k{i}": i for i in range(18)}, "list": [1, 2], "deep": {"s": "abc", "l": []}, "gone": 1})
    assert json.loads(governance.result_shape(text)) == {**{f"k{i}": i for i in range(18)}, "list": {"type": "list", "length": 2}, "deep": {"s": {"type": "str", "length": 3}, "l": {"type": "list", "length": 0}}}
    assert governance.result_shape("[1]") == '{"type": "list", "length": 1}' and governance.result_shape("null") == "null"
    row = spark.createDataFrame([('{"secret": 1}',), (None,)], "t string").select(governance.sanitised_json("t").alias("a"), governance.result_shape_json("t").alias("b")).collect()
    assert row[0]["a"] == '{"secret": "[REDACTED]"}' and row[1]["a"] is None and row[1]["b"] is None


def test_boundaries_equal_the_loop(spark):
    rng = random.Random(6)
    rows = [(i, sorted(rng.sample(range(300), rng.randint(0, 8))), sorted(rng.sample(range(300), rng.randint(0, 8)))) for i in range(200)]

    def hits(predicted, reference):
        free, n = list(reference), 0
        for p in predicted:
            best = min(free, key=lambda r: (abs(r - p), r), default=None)
            if best is not None and abs(best - p) <= 40:
                free.remove(best)
                n += 1
        return n

    got = spark.createDataFrame(rows, "i int, p array<int>, r array<int>").select("i", evaluate.boundary_hits(F.col("p"), F.col("r")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: hits(p, r) for i, p, r in rows}
    sides = catalogue.lines(spark, SF).groupBy("job_id").agg(F.count("*").alias("n")).collect()
    want = {r["job_id"]: hits([i * 25 for i in range(0, r["n"], 2)], [i * 25 for i in range(0, r["n"], 3)]) for r in sides}
    assert {r["job_id"]: r["hits"] for r in catalogue.boundary_match(spark, SF).collect()} == want


def test_distances_of_many_words(spark):
    words = [f"w{i}" for i in range(60_000)]
    other = [*words[:30_000], "new", *words[30_000:50_000], *words[50_001:]]
    row = spark.createDataFrame([(" ".join(words[:300]), " ".join(other[:300])), (" ".join(words[35_000:35_400]), " ".join(words[35_000:35_399]))], "a string, b string")
    assert [r["distance"] for r in evaluate.word_distances(row, "a", "b").collect()] == [0, 1]
    # codes beyond the first plane: one pair with more different words than UTF-16 has characters left
    both = spark.createDataFrame([(" ".join(words), " ".join(words[:-1]))], "a string, b string")
    coded = evaluate.word_distances(both.selectExpr("a", "b"), "a", "b").select(F.size(F.split("a", " ")).alias("n"))
    assert coded.first()["n"] == 60_000


def test_injection_spans_and_personal_data_of_all_sentences(spark):
    texts = {(r["job_id"], r["i"]): r["sentence"] for r in catalogue.lines(spark, SF).collect()}
    want = {(j, i, name, m.start(), m.end()) for (j, i), s in texts.items() for name, _, p in P.INJECTION for m in re.finditer(p, s, re.I)}
    assert {(r["job_id"], r["i"], r["rule"], r["start"], r["end"]) for r in catalogue.injection_spans(spark, SF).collect()} == want
    rng = random.Random(7)
    bits = ["a@b.com ", "98765 43210 ", "4111 1111 1111 1111", "10.0.0.1", "ABCDE1234F", " and ", "https://u:p@h.io/x", "2345 6789 0123", "x"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        taken = []
        for kind, pattern in P.PERSONAL:
            for m in re.finditer(pattern, text):
                if all(m.end() <= s or e <= m.start() for s, e, _ in taken) and privacy._plausible(kind, m.group()):
                    taken.append((m.start(), m.end(), kind))
        assert privacy.personal_spans(text) == [(k, s, e) for s, e, k in sorted(taken)]
        assert re.search(r"[@\d]", text) or not taken
    whole, parts = privacy.scrub_transcripts(spark.createDataFrame([(1, "mail a@b.com now"), (2, None)], "job_id long, text string"), spark.createDataFrame([(1, 1, "mail a@b.com"), (1, 2, "now")], "job_id long, seg int, text string"))
    assert {(r["job_id"], r["scrubbed"], r["pii_total"]) for r in whole.collect()} == {(1, "mail [REDACTED:EMAIL] now", 2), (2, None, 0)}
    assert {r["scrubbed"] for r in parts.collect()} == {"mail [REDACTED:EMAIL]", "now"}


def test_every_document_is_scrubbed_as_plain_code_does(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["n_redacted"] for r in catalogue.pii_scrub(spark, SF).collect()}
    assert all(got[r["doc_id"]] == len(privacy.personal_spans(r["text"])) for r in rows) and sum(got.values()) > 0


def plain_sentences(text, stops=".!?।"):
    return [(m.group().strip(), m.start(), m.end()) for m in re.finditer(rf"[^{stops}\n]+[{stops}]?", text) if m.group().strip()]


def plain_tiers(text):
    found, clauses = plain_sentences(text), plain_sentences(text, ",.!?।")
    stops, n = len(re.findall("[.!?।]", text)), len(text.split())
    few = n >= 12 and (stops == 0 or n / stops > 40)
    return clauses if found and few and len(clauses) > len(found) else found


def test_sentences_by_tiers(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["word ", "b, ", "c. ", "\n", "é ", " "]) for _ in range(rng.choice((0, 5, 40, 200)))) for _ in range(60)] + ["word, " * 30, "a " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "job_id int, text string")
    got = {}
    for r in minutes.tiered_sentences(rows).collect():
        got.setdefault(r["job_id"], []).append((r["i"], r["sentence"], r["start"], r["end"]))
    assert {j: [(i, *s) for i, s in enumerate(plain_tiers(t))] for j, t in enumerate(texts) if plain_tiers(t)} == {j: sorted(v) for j, v in got.items()}
    parts = spark.createDataFrame([(1, 0, "one two"), (1, 1, " "), (1, 2, "three "), (2, 0, "absent"), (3, 0, None)], "job_id int, seg int, text string")
    rows = spark.createDataFrame([(1, "one two. three"), (2, "x. y."), (3, "z")], "job_id int, text string")
    got = sorted(map(tuple, minutes.tiered_sentences(rows, segments=parts).select("job_id", "i", "sentence", "start", "end").collect()))
    assert got == [(1, 0, "one two", 0, 7), (1, 1, "three", 9, 14), (2, 0, "x.", 0, 2), (2, 1, "y.", 2, 5), (3, 0, "z", 0, 1)]


def plain_segments(text, encode):
    sentences = plain_tiers(text)
    if not sentences:
        return [({"Empty transcript"}, 0.0, 0)]
    v = encode([s for s, _, _ in sentences])

    def titles(a, b):
        near = v[a:b] @ v[a:b].mean(0)
        words = [" ".join(sentences[a + int(i)][0].split()[:8]) for i in np.flatnonzero(near > near.max() - 1e-9)]
        return {w[:1].upper() + w[1:] for w in words}

    sims = [float(v[i] @ v[i + 1]) for i in range(len(v) - 1)]
    low = statistics.fmean(sims) - statistics.pstdev(sims) if len(sims) > 1 else sims[0] if sims else 0
    out, since, at = [], 1, 0
    for i, sim in enumerate(sims):
        since += 1
        if (dip := sim < low and since > 2) or since > 10:
            depth = max(((sims[i - 1] if i else sim) + (sims[i + 1] if i + 1 < len(sims) else sim)) / 2 - sim, 0)
            out.append((titles(at, i + 1), round(max(0.15, min(0.95, depth / (depth + 0.15))), 3) if dip else 0.3, i + 1 - at))
            at, since = i + 1, 0
    return [*out, (titles(at, len(v)), 0.5, len(v) - at)]


def test_similarity_arm_equals_the_loop(spark):
    encode = stages.hashed_words()()
    made = {r["job_id"]: r["text"] for r in catalogue.transcripts(spark, SF).collect()} | {-1: "", -2: "One sentence only here.", -3: "\n.\n"}
    rows = spark.createDataFrame(list(made.items()), "job_id long, text string")
    got = {}
    found = modelarm.segment(rows, stages.hashed_words()).cache()
    for r in found.collect():
        got.setdefault(r["job_id"], []).append((r["position"], r["title"], r["confidence"], r["n_sentences"]))
    for job, text in made.items():
        want = plain_segments(text, encode)
        own = sorted(got[job])
        assert len(own) == len(want) and all(a[1] in b[0] and a[3] == b[2] for a, b in zip(own, want, strict=True))
        assert all(math.isclose(a[2], b[1], abs_tol=1.1e-3) for a, b in zip(own, want, strict=True))
    decisions, actions = (encode(list(x)) for x in (P.DECISION_EXAMPLES, P.ACTION_EXAMPLES))
    want = set()
    for b in found.where("n_sentences > 0").collect():
        for s, _, _ in plain_tiers(b["text"]):
            if len(s.split()) < 4:
                continue
            v = encode([s])[0]
            d, a = float((decisions @ v).max()), float((actions @ v).max())
            hindi = bool(re.search("[ऀ-ॿ]", s) or re.search(P.ROMANISED_HINDI, s, re.I))
            cue = {k: any(re.search(P.LANGUAGE_CUES[c][k], s, re.I) for c in (["en", "hi"] if hindi else ["en"])) for k in ("decision", "action", "hedge")}
            passes = lambda x, c: x >= 0.55 or (x >= 0.2 and c)
            pd, pa = passes(d, cue["decision"]), passes(a, cue["action"])
            if not pd and not pa:
                continue
            kind = ("decision" if pd else "action") if pd != pa else "decision" if cue["decision"] and not cue["action"] else "action" if cue["action"] and not cue["decision"] else "decision" if d >= a else "action"
            want.add((b["job_id"], b["position"], kind, s))
    items = modelarm.extract(found.where("n_sentences > 0"), stages.hashed_words()).collect()
    assert {(r["job_id"], r["position"], r["kind"], r["text"]) for r in items} == want and want
    assert all((r["owner"] is None and r["deadline"] is None) or r["kind"] == "action" for r in items)


def test_one_hot_topics_make_four_blocks(spark):
    rows = spark.createDataFrame([(1, i, f"Sentence {i} here.", i * 10, i * 10 + 9, [1.0 if k == i // 3 else 0.0 for k in range(4)]) for i in range(12)], "job_id int, i int, sentence string, start int, end int, v array<double>")
    got = vectors.blocks(rows, vectors.cuts(vectors.valleys(vectors.adjacent(rows)))).orderBy("position").collect()
    assert len(got) == 4 and all(r["confidence"] > 0.8 for r in got[:3]) and got[3]["confidence"] == 0.5
    assert [(r["start"], r["end"]) for r in got] == [(0, 29), (30, 59), (60, 89), (90, 119)]


def test_model_slots(spark):
    rows = [("Priya will share it before Monday", "en", "Priya", "Monday"), ("PERSON will send it by friday", "en", None, "friday"), ("राहुल को रिपोर्ट कल तक भेजनी है", "hi", "राहुल", "कल तक"), ("finish it before the audit", "en", None, None)]
    got = spark.createDataFrame(rows, "t string, code string, o string, d string").select("o", "d", X.model_owner(F.col("t"), F.array("code")).alias("owner"), X.model_deadline(F.col("t"), F.array("code")).alias("deadline")).collect()
    assert [(r["owner"], r["deadline"]) for r in got] == [(r["o"], r["d"]) for r in got]


def test_tools_backends_and_trackers():
    with pytest.raises(ValueError):
        stages.Tools(stages.Tool("w", "write"))
    with pytest.raises(ValueError):
        stages.Tools(stages.Tool("a"), stages.Tool("a"))
    assert "export_actions" not in stages.TOOLS.read_only() and len(list(stages.TOOLS)) == 7
    made, back = [], stages.Backends("X")
    back.add("stt", "baseline", lambda: made.append(1) or "plain")
    back.add("stt", "heavy", lambda: __import__("no_such_module_here"))
    assert back.get("stt") == back.get("stt") == "plain" and made == [1]
    assert back.get("stt", "HEAVY") == "plain"
    with pytest.raises(ValueError):
        back.get("stt", "unknown")
    with stages.tracked("run", {"a": 1}) as log:
        log(f1=0.5)


def test_uploads_with_claims_and_empty_files(spark, tmp_path):
    for name, body in {"a.txt": b"hi", "z.txt": b"", "b.wav": b"RIFF0000", "c.txt": b"hi"}.items():
        (tmp_path / name).write_bytes(body)
    claims = spark.createDataFrame([("a.txt", "text/plain; charset=utf-8"), ("b.wav", "image/png"), ("c.txt", "audio/wav")], "name string, content_type string")
    got = {r["name"]: r["reason"] for r in readers.uploads(spark, str(tmp_path), claims).collect()}
    assert got == {"a.txt": None, "z.txt": "empty", "b.wav": "unsupported_media_type", "c.txt": "unsupported_media_type"}
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "scenarios": [{"slug": "s", "expected": {"decisions": 2}, "words": 7}]}))
    row = readers.scenarios(spark, str(tmp_path / "m.json")).first()
    assert (row["slug"], row["expected"]["decisions"], row["words"], row["title"]) == ("s", 2, 7, None)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "job_id int, x string")
    writers.replace_partitions(rows, str(tmp_path / "t"), "job_id")
    writers.replace_partitions(spark.createDataFrame([(2, "c")], "job_id int, x string"), str(tmp_path / "t"), "job_id")
    assert sorted((r["job_id"], r["x"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]
    events = spark.createDataFrame([(1, "denied"), (2, "ok"), (3, None)], "id int, outcome string")
    writers.append_audit(events, str(tmp_path / "log"))
    writers.append_audit(events, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    items = spark.createDataFrame([(1, s) for s in ("proposed", "approved", "edited", "rejected")], "id int, status string")
    assert {r["status"] for r in writers.exportable(items).collect()} == {"approved", "edited"} and writers.exportable(items, True).count() == 3


def test_exports_refuse_and_say_why(spark):
    job, acts, own = records.jobs(spark, SF), records.actions(spark, SF), records.blocks(spark, SF)
    with pytest.raises(ValueError):
        exports.export("xml", job, acts, own)
    with pytest.raises(ValueError):
        exports.export_minutes("pdf", None, None)
    none = exports.export("csv", job, acts.limit(0), own).collect()
    assert none and all(r["error"] == exports.NOTHING and r["content"] is None for r in none)
    document = json.loads(exports.export("json", job, acts, own, decisions=records.decisions(spark, SF), generated_at=F.expr(records.AT)).where("error is null").first()["content"])
    assert list(document) == ["schema_version", "generated_at", "meeting", "decisions", "action_items"] and set(document["action_items"][0]) == set(writers.ACTION_COLUMNS)


def test_iso_instants(spark):
    rows = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02 03:04:05.000120",), (None,)], "t string").select(X.iso(F.col("t").cast("timestamp")).alias("x"))
    assert [r["x"] for r in rows.collect()] == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000120+00:00", None]


def test_quarantine(spark):
    rows = spark.createDataFrame([("ok", 0.5, None, None, "proposed"), ("", 0.5, None, None, "proposed"), (" ", 0.5, None, None, "edited"), ("x", 1.5, "o" * 256, "d" * 65, "proposed"), (None, None, None, None, None)], "text string, confidence double, owner string, deadline string, status string")
    fine, bad = access.split(rows, access.item_rules())
    assert fine.count() == 1 and sorted(r["problems"] for r in bad.collect()) == [["confidence_range", "owner_length", "deadline_length"], ["edited_text"], ["text_length"], ["text_length", "confidence_range"]]
    owned = spark.createDataFrame([(1, 7), (2, 8)], "job_id int, owner_id int")
    assert access.visible(owned, owned, 7, "viewer").count() == 1 and access.visible(owned, owned, 7, "admin").count() == 2


def test_lineage_of_missing_blocks(spark):
    drafts = spark.createDataFrame([(1, 0, "a"), (1, 9, "b"), (2, 0, "c")], "job_id int, agenda_position int, text string")
    own = spark.createDataFrame([(1, 0, 10, "T")], "job_id int, position int, block_id int, title string")
    got = {(r["text"], r["block_id"], r["agenda_item"]) for r in lineage.with_agenda_item(lineage.in_blocks(drafts, own), own).collect()}
    assert got == {("a", 10, "T"), ("b", None, ""), ("c", None, "")}


def test_report_is_markdown(spark):
    lines = records.evaluation_report(spark, SF)
    text = evaluate.report_text(lines).first()["text"]
    assert text.startswith("\n## Decisions\n\n| language | scenarios |") and "## Errors" in text and "None." not in text
    empty = evaluate._table(0, "X", ("a",), spark.createDataFrame([], "a string"), ("a",))
    assert evaluate.report_text(empty).first()["text"] == "\n## X\n\nNone.\n"


@pytest.mark.skipif("AGENDUM_MEETINGS" not in os.environ, reason="no folder of meetings with gold annotations is named")
def test_published_scores(spark):
    """The rule-based arm on annotated meetings (AGENDUM_MEETINGS, a folder of texts; AGENDUM_GOLD; AGENDUM_WORDS)."""
    texts = readers.transcripts(spark, os.environ["AGENDUM_MEETINGS"]).where("origin = 'uploaded-transcript'").select(F.element_at(F.split("stem", "/"), -1).alias("job_id"), "text")
    gold = readers.gold(spark, os.environ["AGENDUM_GOLD"])
    texts = texts.join(gold.select(F.col("scenario").alias("job_id")), "job_id", "left_semi")
    found = minutes.extract(texts).withColumn("n", F.monotonically_increasing_id())
    totals = {}
    for kind, column in (("decision", "decisions"), ("action", "actions")):
        predicted = found.where(F.col("kind") == kind).select(F.col("job_id").alias("scenario"), F.col("n").cast("int").alias("p"), "text")
        wanted = gold.select("scenario", F.posexplode(column).alias("g", "x")).select("scenario", "g", "x.text")
        counts = evaluate.match_counts(predicted, wanted, evaluate.matched(predicted, wanted))
        totals[kind] = tuple(counts.agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first())
    assert totals == {"decision": (21, 0, 1), "action": (23, 0, 3)}
    pairs = readers.word_pairs(spark, os.environ["AGENDUM_WORDS"]).select("id", evaluate.word_errors(X.wer_text(F.col("reference")), X.wer_text(F.col("hypothesis"))).alias("e")).select("id", "e.*")
    assert tuple(evaluate.corpus_word_errors(pairs).first()) == (6, 60, 3, 2, 2, 0.1167)


def test_worker_code_of_the_similarity_arm_equals_its_columns(spark):
    rng = random.Random(11)
    rows = [(j, i, [rng.choice((-1.0, 0.0, 0.5, rng.random())) for _ in range(3)]) for j in range(25) for i in range(rng.choice((1, 2, 3, 30, 60)))]
    rows = [(j, i, f"s{j}-{i}", i, i + 1, v) for j, i, v in rows]
    made = spark.createDataFrame(rows, "job_id long, i long, sentence string, start int, end int, v array<double>")
    dips = vectors.valleys(vectors.adjacent(made)).cache()
    got = {}
    for r in vectors.cuts(dips).orderBy("job_id", "cut_after").collect():
        got.setdefault(r["job_id"], []).append((r["cut_after"], r["confidence"]))
    sims = {}
    for r in dips.orderBy("job_id", "i").collect():
        sims.setdefault(r["job_id"], []).append(r["sim"])
    assert {j: found for j, own in sims.items() if (found := vectors.cut_places(own))} == got and got
    titles = {(r["job_id"], r["start"]): r["title"] for r in vectors.blocks(made, vectors.cuts(dips)).collect()}
    columns, begins = np.array([r[5] for r in rows]).T, np.array([n for n, r in enumerate(rows) if (r[0], r[3]) in titles])
    assert [rows[n][2].upper() for n in vectors.nearest_in_blocks(columns, np.arange(len(rows)), begins)] == [titles[rows[n][0], rows[n][3]].upper() for n in begins]
    words = ["Priya", "राहुल", "को", "will", "send", "ko", "by", "Friday", "OWNER", "is", "approved", "शायद", "maybe", "करना है", "assigned to", "sam", "before", "Monday", "hai", "2026-01-02", "कल तक", "should", "é", ",", "it was decided"]
    texts = [*catalogue.TEMPLATES, *P.DECISION_EXAMPLES, *P.ACTION_EXAMPLES, *(" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300))]
    s, codes = F.col("t"), F.array(X.sentence_language(F.col("t")))
    want = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(X.cue_hit(s, k, codes) for k in ("decision", "action", "hedge")), X.model_owner(s, codes), X.model_deadline(s, codes)).collect()
    assert [tuple(r)[1:] for r in want] == [modelarm.read(r[0]) for r in want]


def test_similarity_arm_reads_its_transcripts_once(spark):
    """The plan of before read them for each tier of sentences, for blocks, and again for what had none."""
    plan = records.model_extract(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
