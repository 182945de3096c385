"""Queries over the records of meetings: lineage, exports, the governed run, metrics, and the similarity-based arm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from agendum.functions import patterns as P, text as X
from agendum.functions.numbers import rounded_sql
from agendum.operators import access as A, evaluate as E, exports, governance as G, lineage, minutes as M, modelarm, privacy as V, reports as R, speakers as S, stages, vectors as N
from agendum.plans import catalogue as C
from agendum.plans.catalogue import query, t
from agendum.sources import writers as W

AT = "TIMESTAMP '2024-02-01 12:00:00'"
#: Drafts point at the next block every third time, which their meeting may not have.
DRAFTS_SQL = f"""{C.ITEMS_SQL}, drafts AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY position, kind, text) AS n FROM items),
  {C.BLOCKS_SQL}, own AS (SELECT job_id * 1000 + position AS block_id, * FROM blocks),
  linked AS (SELECT d.*, o.block_id, coalesce(o.title, '') AS agenda_item, d.job_id * 10000 + n AS item_id, ['proposed', 'approved', 'edited', 'rejected'][1 + n % 4] AS status FROM drafts d LEFT JOIN own o ON o.job_id = d.job_id AND o.position = d.position + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END)"""


def blocks(spark, folder) -> DataFrame:
    return M.agenda(C.placed(spark, folder)).withColumn("block_id", F.col("job_id") * 1000 + F.col("position"))


def drafts(spark, folder) -> DataFrame:
    """Items of all meetings with their number in the meeting, a status and the block that they point at."""
    order = Window.partitionBy("job_id").orderBy("position", "kind", "text")
    rows = C.found_items(spark, folder).withColumn("n", F.row_number().over(order))
    n = F.col("n")
    status = F.element_at(F.array(*map(F.lit, ("proposed", "approved", "edited", "rejected"))), (n % 4 + 1).cast("int"))
    return rows.withColumns({"agenda_position": F.col("position") + F.when(n % 3 == 0, 1).otherwise(0), "item_id": F.col("job_id") * 10000 + n, "status": status})


def linked(spark, folder) -> DataFrame:
    own = blocks(spark, folder)
    return lineage.with_agenda_item(lineage.in_blocks(drafts(spark, folder), own), own)


@query(f"WITH {DRAFTS_SQL} SELECT item_id, block_id::BIGINT AS block_id, agenda_item FROM linked")
def item_lineage(spark, folder):
    """Each item's block by position, and the block's title."""
    return linked(spark, folder).select("item_id", F.col("block_id").cast("long").alias("block_id"), "agenda_item")


def jobs(spark, folder) -> DataFrame:
    return t(spark, folder, "part").select(F.col("p_partkey").alias("job_id"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("title"), F.concat(F.lit("m"), "p_partkey", F.lit(".txt")).alias("filename"), F.sha2(F.col("p_name"), 256).alias("sha256"), F.when(F.col("p_size") % 2 == 0, "hi").alias("language_hint"))


def _reviewed(n):
    return F.when(n % 2 == 0, F.expr("TIMESTAMP '2024-01-15 08:30:00'"))


def actions(spark, folder) -> DataFrame:
    rows = linked(spark, folder).where("kind = 'action'")
    return rows.select(F.col("item_id").alias("action_id"), "job_id", "block_id", "text", "owner", "deadline", "status", "confidence", F.lit("rules").alias("source_tool"), F.when(F.col("n") % 5 > 0, F.col("text")).alias("evidence"), _reviewed(F.col("n")).alias("reviewed_at"), (-F.col("n")).alias("created_at"))


def decisions(spark, folder) -> DataFrame:
    rows = linked(spark, folder).where("kind = 'decision'")
    return rows.select(F.col("item_id").alias("decision_id"), "job_id", "text", "status", "confidence", F.lit("rules").alias("source_tool"), F.col("text").alias("evidence"), _reviewed(F.col("n")).alias("reviewed_at"), (-F.col("n")).alias("created_at"))


FILES_SQL = f"""{DRAFTS_SQL}, job AS (SELECT p_partkey AS job_id, CASE WHEN p_partkey % 3 = 0 THEN 'm' || p_partkey || '.txt' ELSE p_name END AS title, p_name, p_size, 'm' || p_partkey || '.txt' AS filename FROM part),
  acts AS (SELECT job_id, n, item_id, text, coalesce(owner, '') AS owner, coalesce(deadline, '') AS deadline, status, confidence, agenda_item, CASE WHEN n % 5 > 0 THEN text ELSE '' END AS evidence, CASE WHEN n % 2 = 0 THEN '2024-01-15T08:30:00+00:00' ELSE '' END AS reviewed FROM linked WHERE kind = 'action' AND status IN ('approved', 'edited'))"""


def _cells(*columns: str) -> str:
    return " || ',' || ".join(f"'\"' || replace(CASE WHEN regexp_matches({c}, '^[=+\\-@\\t\\r]') THEN '''' || {c} ELSE {c} END, '\"', '\"\"') || '\"'" for c in columns)


_HEAD = ",".join(f'"{c}"' for c in W.ACTION_COLUMNS)
_CSV = _cells("item_id::VARCHAR", "job_id::VARCHAR", "title", "text", "owner", "deadline", "status", "confidence::VARCHAR", "'rules'", "agenda_item", "evidence", "reviewed")
_FILE = "job_id, '{fmt}' AS format, sha256(content) AS sha256, item_count, strlen(content)::BIGINT AS n_bytes, CASE WHEN content IS NULL THEN '{nothing}' END AS error"


def _file_sql(fmt: str, content: str, joins: str = "") -> str:
    columns = _FILE.format(fmt=fmt, nothing=exports.NOTHING)
    return f"WITH {FILES_SQL}, made AS (SELECT job_id, {content} AS content, count(*)::BIGINT AS item_count FROM acts JOIN job USING (job_id) {joins} GROUP BY job_id) SELECT {columns} FROM job LEFT JOIN made USING (job_id)"


@query(_file_sql("csv", f"chr(65279) || '{_HEAD}' || chr(13) || chr(10) || string_agg({_CSV}, chr(13) || chr(10) ORDER BY -n) || chr(13) || chr(10)"))
def export_csv(spark, folder):
    made = exports.export("csv", jobs(spark, folder), actions(spark, folder), blocks(spark, folder))
    return made.select("job_id", "format", "sha256", "item_count", "n_bytes", "error")


def _json(pairs: dict[str, str]) -> str:
    """JSON text with these keys of values that are JSON text; nulls are null."""
    return " || ',' || ".join(f"'\"{k}\":' || coalesce({v}, 'null')" for k, v in pairs.items())


def _text(value: str) -> str:
    return f"to_json({value})::VARCHAR"


_ROW = _json({"action_id": "item_id::VARCHAR", "job_id": "job_id::VARCHAR", "meeting_title": _text("title"), "task": _text("text"), "owner": _text("owner"), "deadline": _text("deadline"), "status": _text("status"), "confidence": "confidence::VARCHAR", "source_tool": "'\"rules\"'", "agenda_item": _text("agenda_item"), "evidence_quote": _text("evidence"), "reviewed_at": _text("reviewed")})
_DECISION = _json({"id": "item_id::VARCHAR", "text": _text("text"), "status": _text("status"), "confidence": "confidence::VARCHAR", "source_tool": "'\"rules\"'", "evidence_quote": _text("text"), "reviewed_at": "CASE WHEN n % 2 = 0 THEN '\"2024-01-15T08:30:00+00:00\"' END"})
_MEETING = _json({"job_id": "job_id::VARCHAR", "title": _text("any_value(title)"), "source_file": _text("any_value(filename)"), "source_sha256": _text("sha256(any_value(p_name))"), "language_hint": "CASE WHEN any_value(p_size) % 2 = 0 THEN '\"hi\"' END"})
_DECIDED = f"LEFT JOIN (SELECT job_id, string_agg('{{' || {_DECISION} || '}}', ',' ORDER BY -n) AS decided FROM linked WHERE kind = 'decision' AND status IN ('approved', 'edited') GROUP BY job_id) d USING (job_id)"


@query(_file_sql("json", f"'{{\"schema_version\":\"1.0\",\"generated_at\":\"2024-02-01T12:00:00+00:00\",\"meeting\":{{' || {_MEETING} || '}},\"decisions\":[' || coalesce(any_value(decided), '') || '],\"action_items\":[' || string_agg('{{' || {_ROW} || '}}', ',' ORDER BY -n) || ']}}'", _DECIDED))
def export_json(spark, folder):
    made = exports.export("json", jobs(spark, folder), actions(spark, folder), blocks(spark, folder), decisions=decisions(spark, folder), generated_at=F.expr(AT))
    return made.select("job_id", "format", "sha256", "item_count", "n_bytes", "error")


_ISSUE_TEXT = "'Source meeting: ' || title || chr(10) || 'Evidence: ' || CASE WHEN evidence = '' THEN 'n/a' ELSE evidence END || chr(10) || 'Extractor: rules (confidence ' || confidence || ')' || chr(10) || 'Reviewed: ' || CASE WHEN reviewed = '' THEN 'not reviewed' ELSE reviewed END"
_ISSUE = _json({"summary": _text("text[1:255]"), "description": _text(_ISSUE_TEXT), "assignee": "CASE WHEN owner <> '' THEN '{\"displayName\":' || to_json(owner)::VARCHAR || '}' END", "duedate": "CASE WHEN deadline <> '' THEN to_json(deadline)::VARCHAR END", "labels": "'[\"meeting-minutes\",\"job-' || (job_id::VARCHAR)[1:8] || '\"]'"})


@query(_file_sql("tracker", f"'{{\"issueUpdates\":[' || string_agg('{{\"fields\":{{' || {_ISSUE} || '}},\"externalId\":' || item_id || '}}', ',' ORDER BY -n) || '],\"_note\":\"mock tracker payload; not transmitted\"}}'"))
def export_tracker(spark, folder):
    made = exports.export("tracker", jobs(spark, folder), actions(spark, folder), blocks(spark, folder))
    return made.select("job_id", "format", "sha256", "item_count", "n_bytes", "error")


_SECTION_FILE = "SELECT job_id, sha256(content) AS sha256, item_count, strlen(content)::BIGINT AS n_bytes"


def _minutes_rows(spark, folder) -> DataFrame:
    return C._meetings(spark, folder).select("job_id", "title", "filename", "domain", F.lit("approved").alias("status"), F.expr(AT).alias("approved_at"))


def _minutes_file(spark, folder, fmt: str) -> DataFrame:
    return exports.export_minutes(fmt, C._minutes(spark, folder), _minutes_rows(spark, folder), F.expr(AT)).select("job_id", "sha256", "item_count", "n_bytes")


@query(f"WITH {C.SECTIONS_SQL}, made AS (SELECT job_id, chr(65279) || '\"section\",\"heading\",\"body\"' || chr(13) || chr(10) || string_agg({_cells('key', 'heading', 'body')}, chr(13) || chr(10) ORDER BY ord) || chr(13) || chr(10) AS content, count(*)::BIGINT AS item_count FROM section GROUP BY job_id) {_SECTION_FILE} FROM made")
def minutes_csv(spark, folder):
    return _minutes_file(spark, folder, "csv")


@query(f"""WITH {C.SECTIONS_SQL}, made AS (SELECT job_id, '{{"schema_version":"1.0","generated_at":"2024-02-01T12:00:00+00:00","meeting":{{"job_id":' || job_id || ',"title":' || to_json(any_value(title))::VARCHAR || '}},"domain":"' || any_value(domain) || '","status":"approved","approved_at":"2024-02-01T12:00:00+00:00","sections":[' || string_agg('{{"key":' || to_json(key)::VARCHAR || ',"heading":' || to_json(heading)::VARCHAR || ',"body":' || to_json(body)::VARCHAR || '}}', ',' ORDER BY ord) || ']}}' AS content, count(*)::BIGINT AS item_count FROM section GROUP BY job_id) {_SECTION_FILE} FROM made""")
def minutes_json(spark, folder):
    return _minutes_file(spark, folder, "json")


def audit_events(spark, folder) -> DataFrame:
    e = F.col("event_id")
    return t(spark, folder, "events").select(
        e.alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.when(e % 2 == 0, "human").otherwise("agent").alias("actor_type"), F.col("user_id").alias("actor_id"), F.col("event_type").alias("action"), F.when(e % 5 == 0, "denied").otherwise("ok").alias("outcome"),
        F.lit("job").alias("resource_type"), F.col("user_id").alias("resource_id"), F.col("user_id").alias("job_id"), F.when(e % 3 > 0, e).alias("run_id"), F.lit(None).cast("string").alias("trace_id"), (e % 100).alias("duration_ms"), F.lit(None).cast("string").alias("detail"),
    )


@query("""SELECT '{"id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","actor_type":"' || CASE WHEN event_id % 2 = 0 THEN 'human' ELSE 'agent' END || '","actor_id":' || user_id || ',"action":"' || event_type || '","outcome":"' || CASE WHEN event_id % 5 = 0 THEN 'denied' ELSE 'ok' END || '","resource":{"type":"job","id":' || user_id || '},"job_id":' || user_id || ',"run_id":' || CASE WHEN event_id % 3 > 0 THEN event_id::VARCHAR ELSE 'null' END || ',"trace_id":null,"duration_ms":' || event_id % 100 || ',"detail":null}' AS value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000""")
def audit_trail(spark, folder):
    """A trail of at most 10,000 lines, the newest first: the limit is the feature."""
    return W.audit_lines(audit_events(spark, folder))


@query(f"""WITH {DRAFTS_SQL}, by_job AS (SELECT job_id, count(*) FILTER (kind = 'decision') AS decisions, count(*) FILTER (kind = 'action') AS actions, arg_min(text, n) FILTER (kind = 'action') AS first_action FROM linked GROUP BY job_id),
  b AS (SELECT job_id, count(*) AS blocks, arg_max(title, position) AS last_title FROM blocks GROUP BY job_id), r AS (SELECT user_id AS job_id, arg_max(event_id, ROW(ts, event_id)) AS latest FROM events GROUP BY user_id), g AS (SELECT o_custkey AS job_id, count(*) AS pending FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
  SELECT p_partkey AS job_id, p_partkey % 5 > 0 AS has_transcript, coalesce(blocks, 0)::BIGINT AS blocks, last_title, coalesce(decisions, 0)::BIGINT AS decisions, coalesce(actions, 0)::BIGINT AS actions, first_action, coalesce(pending, 0)::BIGINT AS pending, latest, CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END::BIGINT AS minutes
  FROM part LEFT JOIN by_job ON by_job.job_id = p_partkey LEFT JOIN b ON b.job_id = p_partkey LEFT JOIN r ON r.job_id = p_partkey LEFT JOIN g ON g.job_id = p_partkey""")
def job_overview(spark, folder):
    """A row a job with all that belongs to it, here its sizes and ends."""
    items = linked(spark, folder).select("job_id", "kind", F.col("n").alias("created_at"), "item_id", "text", "status")
    transcript = jobs(spark, folder).where("job_id % 5 > 0").select("job_id", F.lit("t").alias("text"))
    gates = t(spark, folder, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("gate_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("status"), F.col("o_orderdate").alias("created_at"))
    runs = t(spark, folder, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))
    minutes = jobs(spark, folder).where("job_id % 7 = 0").select("job_id", F.explode(F.array(F.expr(AT), F.expr("TIMESTAMP '2024-03-01 00:00:00'"))).alias("created_at"))
    view = lineage.job_view(jobs(spark, folder), transcript, blocks(spark, folder).select("job_id", "position", "title"), items.where("kind = 'decision'").drop("kind"), items.where("kind = 'action'").drop("kind"), gates, runs, minutes)
    size = lambda c: F.size(c).cast("long").alias(c)
    return view.select("job_id", F.col("transcript").isNotNull().alias("has_transcript"), F.size("agenda_blocks").cast("long").alias("blocks"), F.try_element_at("agenda_blocks", F.lit(-1))["title"].alias("last_title"), size("decisions"), F.size("action_items").cast("long").alias("actions"), F.try_element_at("action_items", F.lit(1))["text"].alias("first_action"), F.size("pending_approvals").cast("long").alias("pending"), F.col("latest_run.run_id").alias("latest"), F.size("generated_minutes").cast("long").alias("minutes"))


STEPS = ("enqueued", "claimed", "suspended", "resumed", "finished", "crashed", "requeued", "abandoned", "unapproved", "claimed")
_EVENTS_SQL = f"list({C._quoted(STEPS)}[1 + event_id % 10] ORDER BY ts, event_id)"
_STEP_SQL = "map {" + ", ".join(f"'{a}>{b}': '{c}'" for (a, b), c in G.RUN_STEPS.items()) + "}"
_JOB_SQL = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in G.JOB_OF_RUN.items()) + "}"


@query(f"""WITH e AS (SELECT user_id AS run_id, list_prepend('enqueued', {_EVENTS_SQL}) AS e FROM events GROUP BY user_id),
  f AS (SELECT run_id, list_reduce(list_prepend('none|0', e), lambda s, x: coalesce({_STEP_SQL}[string_split(s, '|')[1] || '>' || x] || '|' || string_split(s, '|')[2], string_split(s, '|')[1] || '|' || (string_split(s, '|')[2]::INT + 1))) AS s FROM e)
  SELECT run_id, string_split(s, '|')[1] AS status, {_JOB_SQL}[string_split(s, '|')[1]] AS job_status, string_split(s, '|')[2]::BIGINT AS refused FROM f""")
def run_states(spark, folder):
    """Where each run's events lead."""
    e = t(spark, folder, "events")
    own = e.select(F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.element_at(F.array(*map(F.lit, STEPS)), (F.col("event_id") % 10 + 1).cast("int")).alias("event"))
    return G.run_states(own.unionAll(e.select(F.col("user_id").alias("run_id"), F.lit(0).alias("seq"), F.lit("enqueued").alias("event")).distinct()))


@query(f"WITH {C.ITEM_ROWS_SQL}, d AS (SELECT job_id, count(*) FILTER (status = 'proposed' AND review_seconds > 48) = 0 AS done FROM i GROUP BY job_id) SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 > 0 AND coalesce(done, false) THEN 'completed' WHEN c_custkey % 3 > 0 THEN 'ready_for_review' ELSE 'running' END AS status FROM customer LEFT JOIN d ON job_id = c_custkey")
def completed_jobs(spark, folder):
    items = C.item_rows(spark, folder).withColumn("status", F.when((F.col("status") == "proposed") & (F.coalesce("review_seconds", F.lit(0)) > 48), "proposed").otherwise("approved"))
    rows = t(spark, folder, "customer").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 3 > 0, "ready_for_review").otherwise("running").alias("status"))
    return G.completed_jobs(rows, items)


@query("""WITH g AS (SELECT user_id AS run_id, event_type AS action, arg_min(ROW(event_id, event_id % 3), event_id) AS first FROM events WHERE event_id % 2 = 0 GROUP BY user_id, event_type)
  SELECT e.event_id AS request_id, CASE WHEN first[2] = e.event_id % 3 THEN first[1] END AS gate_id FROM events e LEFT JOIN g ON g.run_id = e.user_id AND g.action = e.event_type""")
def reopened_gates(spark, folder):
    """Which pending gate a request for approval uses again."""
    e = t(spark, folder, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("action"), (F.col("event_id") % 3).cast("string").alias("payload"), "event_id")
    gates = e.select("run_id", "action", "payload", F.col("event_id").alias("gate_id"), F.when(F.col("event_id") % 2 == 0, "pending").otherwise("approved").alias("status"))
    return G.opened(e.withColumnRenamed("event_id", "request_id"), gates).select("request_id", "gate_id")


@query("""SELECT event_id AS token_event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AND event_id % 3 > 0 AND epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00') <= 864000 AS passed FROM events""")
def single_use_tokens(spark, folder):
    rows = t(spark, folder, "events").select("event_id", F.col("user_id").alias("token"), F.col("ts").cast("timestamp").alias("ts"), F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("issued"), (F.col("event_id") % 3 > 0).alias("ok"))
    return G.single_use(rows, 864000.0).select(F.col("event_id").alias("token_event"), "passed")


@query("SELECT event_id AS key FROM events WHERE epoch(ts) > epoch(TIMESTAMP '2024-01-15 00:00:00') - 86400 OR event_id % 4 = 0")
def live_limiter_keys(spark, folder):
    """Limiter states that a sweep keeps."""
    now = F.lit(1705276800.0)
    rows = t(spark, folder, "events").select(F.col("event_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("last"), F.when(F.col("event_id") % 4 == 0, now + 1).otherwise(F.lit(0.0)).alias("blocked_until"))
    return G.evicted(rows, now, 86400.0).select("key")


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'agent' ELSE 'no_agent' END AS mode, event_type AS status, count(*)::BIGINT AS value FROM events GROUP BY ALL")
def counter_runs(spark, folder):
    rows = t(spark, folder, "events").select(F.when(F.col("event_id") % 2 == 0, "agent").otherwise("no_agent").alias("mode"), F.col("event_type").alias("status"))
    return R.counter("agent_runs_total", rows)


_BOUNDS = ", ".join(f"count(*) FILTER (value <= {b})::BIGINT AS {f'le_{b:g}'.replace('.', '_')}" for b in R.HISTOGRAMS["queue_wait_seconds"][1])


@query(f"SELECT event_type AS mode, {_BOUNDS}, count(value)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def histogram_queue_wait(spark, folder):
    return R.histogram("queue_wait_seconds", t(spark, folder, "events").withColumnRenamed("event_type", "mode"), "value")


@query("SELECT (SELECT count(*) FROM events WHERE event_id % 3 = 0)::BIGINT AS queue_depth, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')::BIGINT AS pending_approvals")
def queue_gauges(spark, folder):
    gates = t(spark, folder, "orders").select(F.when(F.col("o_orderstatus") == "P", "pending").alias("status"))
    return R.gauges(C.queue(spark, folder), gates)


@query("SELECT c_custkey AS job_id, (SELECT count(DISTINCT nullif(CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END, '')) FROM events WHERE user_id = c_custkey)::BIGINT AS speakers FROM customer")
def speaker_counts(spark, folder):
    segments = t(spark, folder, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("speaker"))
    return R.speaker_counts(t(spark, folder, "customer").select(F.col("c_custkey").alias("job_id")), segments)


@query("""WITH w AS (SELECT c_custkey AS job_id, unnest(range(0, ceil((abs(c_acctbal) + 10) / 598.0)::BIGINT)) AS k FROM customer), p AS (SELECT job_id, k, unnest([k * 598.0 + 0.5, k * 598.0 + 1, k * 598.0 + 300]) AS start FROM w)
  SELECT job_id, k::BIGINT AS k, start::DOUBLE AS start FROM p WHERE k = 0 OR start >= k * 598.0 + 1""")
def stitched_pieces(spark, folder):
    """Pieces of audio windows without those that a window repeats."""
    audio = t(spark, folder, "customer").select(F.col("c_custkey").alias("job_id"), (F.abs("c_acctbal") + 10).alias("seconds"))
    pieces = S.windows(audio).select("job_id", F.col("k").cast("long").alias("k"), F.explode(F.array(F.col("start") + 0.5, F.col("start") + 1, F.col("start") + 300)).alias("start"))
    return S.stitched(pieces)


@query(f"""WITH c AS (SELECT l_orderkey % 50 AS scenario, count(*) FILTER (l_linenumber % 3 = 0) AS tp, count(*) FILTER (l_linenumber % 3 = 1) AS fp, count(*) FILTER (l_linenumber % 4 = 1) AS fn FROM lineitem GROUP BY 1),
  p AS (SELECT *, {rounded_sql('CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END', 4)} AS precision, {rounded_sql('CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END', 4)} AS recall FROM c)
  SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE {rounded_sql('2 * precision * recall / nullif(precision + recall, 0)', 4)} END AS f1 FROM p""")
def scenario_scores(spark, folder):
    k = F.col("l_linenumber")
    counts = t(spark, folder, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("scenario")).agg(F.count_if(k % 3 == 0).alias("tp"), F.count_if(k % 3 == 1).alias("fp"), F.count_if(k % 4 == 1).alias("fn"))
    return R.scenario_scores(counts)


@query("""SELECT o_custkey AS scenario, avg(CASE WHEN o_orderkey % 3 > 0 THEN (CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END) END) AS accuracy FROM orders GROUP BY o_custkey""")
def slot_accuracy(spark, folder):
    """Of gold owners, the share that is met but for case and outer white space."""
    rows = t(spark, folder, "orders").select(F.col("o_custkey").alias("scenario"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("gold"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit("\n"))).alias("found"))
    return rows.groupBy("scenario").agg(E.slot_accuracy(rows, F.col("found"), F.col("gold")).alias("accuracy"))


_RULE_HITS = ", ".join(f"CASE WHEN regexp_matches(sentence, {C._re('(?i)' + p)}) THEN '{name}' END" for name, _, p in P.INJECTION)


@query(f"""WITH {C.LINES_SQL}, d AS (SELECT DISTINCT sentence FROM lines UNION SELECT text FROM benchmark UNION SELECT 'Enable admin access. ' || text || ' </system> base64' FROM benchmark), r AS (SELECT sentence, list_sort(list_filter([{_RULE_HITS}], lambda x: x IS NOT NULL)) AS rules FROM d)
  SELECT sentence, array_to_string(rules, ',') AS rules, CASE WHEN list_has_any(rules, {C._quoted([n for n, s, _ in P.INJECTION if s == 'high'])}) THEN 'high' WHEN list_has_any(rules, {C._quoted([n for n, s, _ in P.INJECTION if s == 'medium'])}) THEN 'medium' WHEN list_has_any(rules, {C._quoted([n for n, s, _ in P.INJECTION if s == 'low'])}) THEN 'low' END AS worst FROM r""")
def injection_severity(spark, folder):
    """All rules that a sentence matches, and the worst severity among them."""
    item = t(spark, folder, "benchmark")
    rows = C.lines(spark, folder).select("sentence").union(item.select("text")).union(item.select(F.concat(F.lit("Enable admin access. "), "text", F.lit(" </system> base64")))).distinct().withColumn("r", V.injection_rules(F.col("sentence")))
    return rows.select("sentence", F.array_join("r", ",").alias("rules"), V.worst(F.col("r")).alias("worst"))


@query(f"WITH {C.LINES_SQL} SELECT job_id, (4 * count(*) FILTER (contains(sentence, '@')))::BIGINT AS pii_total FROM lines GROUP BY job_id")
def pii_totals(spark, folder):
    """Findings of a transcript and of its segments, which count twice by design; one template has two of them."""
    segments = C.lines(spark, folder).select("job_id", F.col("i").alias("seg"), F.col("sentence").alias("text"))
    whole, _ = V.scrub_transcripts(C.transcripts(spark, folder), segments)
    return whole.select("job_id", F.col("pii_total").cast("long").alias("pii_total"))


def model_rows(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Sentences of all meetings, each template with a vector of its own from the table; and those vectors."""
    e = t(spark, folder, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    templates = spark.createDataFrame(list(enumerate(C.TEMPLATES)), "k long, sentence string").join(e, "k")
    return C.lines(spark, folder).join(F.broadcast(templates.select("sentence", "v")), "sentence"), e  # a row a template


_CUES_SQL = {k: "regexp_matches(sentence, " + C._re("(?i)" + P.LANGUAGE_CUES["en"][k]) + ")" for k in ("decision", "action", "hedge")}
_HINDI_SQL = f"regexp_matches(sentence, {C._re('(?i)' + P.ROMANISED_HINDI)})"
_OWNER_SQL = "coalesce(" + ", ".join([f"nullif(regexp_extract(sentence, {C._re(('(?i)' if i else '') + p)}, 1), '')" for p, i in P.LANGUAGE_OWNERS["en"]] + [f"CASE WHEN {_HINDI_SQL} THEN nullif(regexp_extract(sentence, {C._re('(?i)' + P.LANGUAGE_OWNERS['hi'][0][0])}, 1), '') END"]) + ")"
_DUE_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(sentence, {C._re('(?i)' + p)}, 1), '')" for p in P.LANGUAGE_DEADLINES["en"]) + ")"


@query(f"""WITH {C.LINES_SQL}, k(k, sentence) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(C.TEMPLATES))}), {C.PROTOTYPES_SQL},
  s AS (SELECT sentence, max(list_dot_product(embedding::DOUBLE[], q)) FILTER (kind = 'd') AS d, max(list_dot_product(embedding::DOUBLE[], q)) FILTER (kind = 'a') AS a FROM k JOIN embeddings ON vec_id = k, p GROUP BY sentence),
  c AS (SELECT sentence, d, a, {_CUES_SQL['decision']} AS cd, {_CUES_SQL['action']} OR ({_HINDI_SQL} AND regexp_matches(sentence, {C._re('(?i)' + P.HI_ACTION)})) AS ca, {_CUES_SQL['hedge']} AS h FROM s WHERE len(string_split_regex(sentence, '\\s+')) >= 4),
  g AS (SELECT *, d >= 0.55 OR (d >= 0.20 AND cd) AS pd, a >= 0.55 OR (a >= 0.20 AND ca) AS pa FROM c),
  f AS (SELECT *, CASE WHEN pd AND pa THEN CASE WHEN cd AND NOT ca THEN 'decision' WHEN ca AND NOT cd THEN 'action' WHEN d >= a THEN 'decision' ELSE 'action' END WHEN pd THEN 'decision' WHEN pa THEN 'action' END AS kind FROM g),
  x AS (SELECT *, 1 / (1 + exp(-8 * (CASE WHEN kind = 'action' THEN a ELSE d END - 0.40))) AS base, CASE WHEN kind = 'action' THEN ca ELSE cd END AS cue FROM f WHERE kind IS NOT NULL),
  y AS (SELECT *, CASE WHEN cue THEN least(0.95, base + 0.08) ELSE base END AS up FROM x),
  z AS (SELECT sentence, kind, CASE WHEN kind = 'action' THEN {_OWNER_SQL} END AS owner, CASE WHEN kind = 'action' THEN {_DUE_SQL} END AS deadline, {rounded_sql("greatest(0.05, least(0.95, CASE WHEN h THEN greatest(0.05, up - 0.25) ELSE up END))", 3)} AS confidence FROM y)
  SELECT job_id, i, kind, owner, deadline, confidence FROM lines JOIN z USING (sentence)""")
def model_items(spark, folder):
    """Items by likeness to examples and cues; the table's vectors stand for an encoder's."""
    rows, e = model_rows(spark, folder)
    examples = [list(r["v"]) for r in e.where("k < 17").orderBy("k").collect()]  # 17 constant vectors
    found = modelarm.classified(rows.select("job_id", "i", "sentence", "v"), examples[:9], examples[9:])
    return found.select("job_id", "i", "kind", "owner", "deadline", "confidence")


@query()
def model_blocks(spark, folder):
    """Agenda blocks of all meetings by dips of likeness, with a stand-in encoder."""
    return modelarm.segment(C.transcripts(spark, folder), stages.hashed_words()).select("job_id", "position", "title", "start", "end", "confidence", "n_sentences")


@query()
def model_extract(spark, folder):
    """Items of those blocks."""
    found = modelarm.segment(C.transcripts(spark, folder), stages.hashed_words())
    return modelarm.extract(found.select("job_id", "position", "text"), stages.hashed_words()).select("job_id", "position", "kind", "text", "owner", "deadline", "confidence")


@query("""SELECT conv_id, turn, sha256(text[1:255]) AS summary, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'fr,en' ELSE 'fr' END AS languages FROM conversations WHERE text IS NOT NULL""")
def recogniser_languages(spark, folder):
    """The recogniser's language with those that the script shows, and a shortened text."""
    c = t(spark, folder, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.sha2(A.shortened(F.col("text"), "summary"), 256).alias("summary"), F.array_join(X.primary_languages(F.col("text"), F.lit("fr")), ",").alias("languages"))


@query("SELECT name, side_effect, requires_approval, max_calls_per_run::INT AS max_calls_per_run, risk FROM (VALUES " + ", ".join(f"('{x.name}', '{x.side_effect}', {str(x.requires_approval).lower()}, {x.max_calls_per_run}, '{x.risk}')" for x in stages.TOOLS) + ") v(name, side_effect, requires_approval, max_calls_per_run, risk)")
def tool_surface(spark, folder):
    return stages.TOOLS.table(spark).drop("description", "input_schema")


@query()
def evaluation_report(spark, folder):
    """The lines of a report on the matches of all meetings."""
    predicted, gold = C._sides(spark, folder)
    pairs = E.matched(predicted, gold)
    counts = E.match_counts(predicted, gold, pairs).withColumn("language", F.when(F.col("scenario").cast("long") % 4 == 0, "hi").otherwise("en"))
    scores = R.micro_scores(counts, "language")
    slots = counts.select("scenario", F.lit(1.0).alias("owner_accuracy"), F.lit(None).cast("double").alias("deadline_accuracy"))
    spread = blocks(spark, folder).groupBy(F.col("job_id").cast("string").alias("scenario")).agg(F.count("*").alias("blocks"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))
    words = C._word_pairs(spark, folder).withColumn("e", E.word_errors(F.col("ref"), F.col("hyp"))).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("inserted article").alias("error_type"), "e.*")
    words = words.withColumn("wer", E.word_error_rate(F.col("ref_words"), F.col("substitutions") + F.col("deletions") + F.col("insertions")))
    return E.report(scores, scores, slots, spread, words, E.errors(predicted, gold, pairs).withColumn("item", F.lit("decision")))
