"""Queues, leases, gates, grants and quotas as set operations; `as_of` stands for the clock."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from agendum.operators.stages import Tool

LEASE_MINUTES, MOST_ATTEMPTS, GATE_HOURS = 30, 3, 48
# fixed values: keys whose values never reach the audit trail
SECRET_KEYS = ("password", "hashed_password", "token", "access_token", "authorization", "secret", "api_key", "jwt_secret")
MOST_DETAIL = 4000


def requeue(runs: DataFrame, as_of: Column) -> DataFrame:
    """Runs (status, claimed_at, claimed_by, attempts, queued_at, error_message) after a sweep of expired leases: back in
    the queue with their claim cleared, or failed with a message once they were tried MOST_ATTEMPTS times."""
    dead = (F.col("status") == "running") & F.col("claimed_at").isNotNull() & (F.col("claimed_at") <= as_of - F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES"))
    poison = dead & (F.col("attempts") >= MOST_ATTEMPTS)
    again = dead & ~poison
    message = F.format_string("Abandoned by worker %s and retried %s times; giving up.", F.coalesce("claimed_by", F.lit("None")), F.col("attempts").cast("string"))
    return runs.withColumns({
        "status": F.when(poison, "failed").when(again, "queued").otherwise(F.col("status")), "queued_at": F.when(again, as_of).otherwise(F.col("queued_at")),
        "claimed_at": F.when(~again, F.col("claimed_at")), "claimed_by": F.when(~again, F.col("claimed_by")), "error_message": F.when(poison, message).otherwise(F.col("error_message")),
    })


def failed_jobs(jobs: DataFrame, swept: DataFrame) -> DataFrame:
    """jobs (job_id, status, error_message, ...) after requeue(): those of runs that were given up fail with its message."""
    lost = swept.where("status = 'failed' and error_message is not null").groupBy("job_id").agg(F.max_by("error_message", "run_id").alias("__why"))
    return jobs.join(lost, "job_id", "left").select(*[F.when(F.col("__why").isNotNull(), F.lit("failed")).otherwise(F.col(c)).alias(c) if c == "status" else F.coalesce("__why", c).alias(c) if c == "error_message" else F.col(c) for c in jobs.columns])


def expire_gates(gates: DataFrame, as_of: Column) -> DataFrame:
    old = (F.col("status") == "pending") & (F.col("created_at") <= as_of - F.expr(f"INTERVAL {GATE_HOURS} HOURS"))
    return gates.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The n oldest queued runs, for n workers."""
    return queue.where("status = 'queued'").orderBy("queued_at", "run_id").limit(n)


def claimed(runs: DataFrame, workers: Sequence[str], as_of: Column) -> DataFrame:
    """All runs (run_id, status, queued_at, claimed_at, claimed_by, attempts) after each worker took one: the oldest
    queued runs are running, one a worker, in the workers' order."""
    order = Window.orderBy("queued_at", "run_id")  # over at most a row a worker
    taken = claim(runs, len(workers)).select("run_id", F.row_number().over(order).alias("__k"))
    worker = F.element_at(F.array(*map(F.lit, workers)), F.col("__k"))
    mine = F.col("__k").isNotNull()
    moved = runs.join(F.broadcast(taken), "run_id", "left").withColumns({"status": F.when(mine, "running").otherwise(F.col("status")), "claimed_at": F.when(mine, as_of).otherwise(F.col("claimed_at")), "claimed_by": F.when(mine, worker).otherwise(F.col("claimed_by")), "attempts": F.col("attempts") + mine.cast("int")})
    return moved.select(*runs.columns)


def first_rulings(rulings: DataFrame) -> DataFrame:
    """(gate_id, ts, ruling, ...) with `effective`: the first ruling of a gate counts, later ones are refused."""
    order = Window.partitionBy("gate_id").orderBy("ts", "ruling_id")
    return rulings.withColumn("effective", F.row_number().over(order) == 1)


def opened(requests: DataFrame, gates: DataFrame) -> DataFrame:
    """requests (run_id, action, payload) with `gate_id`, the pending gate that is used again: the first (by gate_id) of
    the run and action, if its payload is equal; null where a new gate must be opened."""
    first = gates.where("status = 'pending'").groupBy("run_id", "action").agg(F.min_by(F.struct("gate_id", F.col("payload").alias("was")), "gate_id").alias("first"))
    return requests.join(first, ["run_id", "action"], "left").select(*requests.columns, F.when(F.col("first.was") == F.col("payload"), F.col("first.gate_id")).alias("gate_id"))


# fixed values: how a run moves by events, and the status that its job then has
RUN_STEPS = {
    ("none", "enqueued"): "queued", ("queued", "claimed"): "running", ("running", "suspended"): "awaiting_approval", ("awaiting_approval", "resumed"): "running", ("awaiting_approval", "unapproved"): "aborted",
    ("running", "finished"): "completed", ("running", "crashed"): "failed", ("running", "requeued"): "queued", ("running", "abandoned"): "failed",
}
JOB_OF_RUN = {"none": "uploaded", "queued": "queued", "running": "running", "awaiting_approval": "awaiting_approval", "completed": "ready_for_review", "aborted": "ready_for_review", "failed": "failed"}


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, status, job_status, refused): where each run's events (run_id, seq, event) lead, in order; an event that
    its state doesn't allow changes nothing and counts as refused. A run has a few events, laid into one row."""
    steps = F.create_map(*[F.lit(x) for (state, event), to in RUN_STEPS.items() for x in (f"{state}>{event}", to)])
    ordered = F.array_sort(F.collect_list(F.struct("seq", "event")))
    start = F.struct(F.lit("none").alias("state"), F.lit(0).alias("refused"))

    def step(s: Column, e: Column) -> Column:
        to = F.try_element_at(steps, F.concat(s["state"], F.lit(">"), e["event"]))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["refused"] + to.isNull().cast("int")).alias("refused"))

    folded = events.groupBy("run_id").agg(ordered.alias("e")).select("run_id", F.aggregate("e", start, step).alias("s"))
    of_job = F.create_map(*[F.lit(x) for pair in JOB_OF_RUN.items() for x in pair])
    return folded.select("run_id", F.col("s.state").alias("status"), F.element_at(of_job, F.col("s.state")).alias("job_status"), F.col("s.refused").cast("long").alias("refused"))


def completed_jobs(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """jobs (job_id, status, ...) in which those that are ready for review and have items, none of which is still
    proposed, are completed."""
    done = items.groupBy("job_id").agg((F.count_if(F.col("status") == "proposed") == 0).alias("__done"))
    status = F.when((F.col("status") == "ready_for_review") & F.coalesce("__done", F.lit(False)), "completed").otherwise(F.col("status"))
    return jobs.join(done, "job_id", "left").withColumn("status", status).select(*jobs.columns)


def untampered(gates: DataFrame, actual: Column) -> DataFrame:
    """Adds `trusted`: the stored fingerprint is blank or equals the actual one."""
    return gates.withColumn("trusted", (F.coalesce("fingerprint", F.lit("")) == "") | (F.col("fingerprint") == actual))


def granted(calls: DataFrame, gates: DataFrame) -> DataFrame:
    """calls (run_id, gate_key, ...) with `granted`: whether an approved gate (run_id, status, fingerprint, actual) of the
    same run has the key, and its payload still has the fingerprint that was approved."""
    keys = untampered(gates.where("status = 'approved'"), F.col("actual")).where("trusted").select("run_id", F.coalesce(F.nullif("fingerprint", F.lit("")), "actual").alias("gate_key"), F.lit(True).alias("__yes")).distinct()
    return calls.join(keys, ["run_id", "gate_key"], "left").select(*calls.columns, F.col("__yes").isNotNull().alias("granted"))


def decide_calls(calls: DataFrame, tools: Sequence[Tool], run_limit: int, run_tools: Sequence[str] | None = None) -> DataFrame:
    """Attempted calls (run_id, seq, tool, valid, granted) with `outcome` (allowed, denied or suspended) and `reason`.

    Checks are made in order: the tool is registered; the run may use it (`run_tools`; all if None); the run's and the
    tool's quota, which only allowed calls use up; its arguments; its gate. A call that passes all checks but the quotas
    is counted within its tool, then, up to the tool's limit, within the run. As nothing is allowed once a run's quota is
    used up, these running counts say what the quotas held before any call, and no fold is needed.
    """
    limits = F.create_map(*[F.lit(x) for t in tools for x in (t.name, t.max_calls_per_run)])
    gated = F.col("tool").isin([t.name for t in tools if t.requires_approval])
    listed = F.lit(True) if run_tools is None else F.col("tool").isin(list(run_tools))
    run, own = Window.partitionBy("run_id").orderBy("seq"), Window.partitionBy("run_id", "tool").orderBy("seq")
    upto, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    rows = calls.withColumns({"__limit": F.try_element_at(limits, F.col("tool")), "__listed": listed, "__open": ~gated | F.col("granted")})
    rows = rows.withColumn("__fits", F.col("__limit").isNotNull() & F.col("__listed") & F.col("valid") & F.col("__open"))
    rows = rows.withColumn("__fits", F.col("__fits") & (F.count_if("__fits").over(own.rowsBetween(*upto)) <= F.col("__limit")))
    rows = rows.withColumn("__fits", F.col("__fits") & (F.count_if("__fits").over(run.rowsBetween(*upto)) <= run_limit))
    spent, used = F.count_if("__fits").over(run.rowsBetween(*before)), F.count_if("__fits").over(own.rowsBetween(*before))
    rows = rows.withColumns({"__spent": F.coalesce(spent, F.lit(0)), "__used": F.coalesce(used, F.lit(0))})
    reason = F.when(F.col("__limit").isNull(), "not_allowlisted").when(~F.col("__listed"), "not_in_run_allowlist").when(F.col("__spent") >= run_limit, "run_quota_exhausted").when(F.col("__used") >= F.col("__limit"), "tool_quota_exhausted").when(~F.col("valid"), "invalid_arguments").when(~F.col("__open"), "approval_required")
    rows = rows.withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNull(), "allowed").when(F.col("reason") == "approval_required", "suspended").otherwise("denied")
    return rows.select("run_id", "seq", "tool", outcome.alias("outcome"), "reason")


def limit_rate(hits: DataFrame, most: int, window_s: float, block_s: float) -> DataFrame:
    """Hits (key, seq, ts in seconds, and perhaps `success`) with `allowed`: the hit after `most` in the window blocks the
    key and clears its history; a success that is allowed resets the key.

    Keys are laid out in order and read as a stream, so memory holds `most` times of one key, however many hits it has.
    """
    success = F.col("success") if "success" in hits.columns else F.lit(False)
    rows = hits.select("key", "seq", "ts", success.alias("success")).repartition("key").sortWithinPartitions("key", "ts", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, recent, until = None, deque(), float("-inf")
        for batch in batches:
            allowed = []
            for key, now, good in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if key != held:
                    held, until = key, float("-inf")
                    recent.clear()
                while recent and recent[0] <= now - window_s:
                    recent.popleft()
                fits = now >= until and len(recent) < most
                if now >= until and not fits:
                    until = now + block_s
                    recent.clear()
                elif fits:
                    recent.append(now)
                    if good:
                        recent.clear()
                allowed.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], ["key", "seq", "allowed"])

    return rows.select(F.col("key").cast("long"), F.col("seq").cast("long"), F.col("ts").cast("double"), "success").mapInArrow(run, "key long, seq long, allowed boolean")


def evicted(states: DataFrame, as_of: Column, window_s: float) -> DataFrame:
    """Limiter states (key, last, blocked_until; times in seconds) without the dead ones: no hit in the window, no block."""
    return states.where((F.col("last") > as_of - window_s) | (F.col("blocked_until") > as_of))


def recent_hits(hits: DataFrame, window_s: int) -> DataFrame:
    """Adds how many hits of the key fall into the window that ends at each: an upper bound of the limiter's count."""
    span = Window.partitionBy("key").orderBy(F.col("ts").cast("long")).rangeBetween(-window_s, 0)
    return hits.withColumn("in_window", F.count("*").over(span))


def single_use(events: DataFrame, ttl_s: float) -> DataFrame:
    """(token, ts, issued, ok): the first answer to a token counts, if it's right and in time."""
    order = Window.partitionBy("token").orderBy("ts", "event_id")
    return events.withColumn("passed", (F.row_number().over(order) == 1) & F.col("ok") & (F.col("ts").cast("double") - F.col("issued").cast("double") <= ttl_s))


DEEPEST, LONGEST = 4, 50


def redacted(text: str) -> str:
    """An audit detail (JSON) without secrets, at most DEEPEST deep, lists of LONGEST, strings of MOST_DETAIL.

    Places still to be looked at wait on a list, each with its depth, and are rewritten where they stand.
    """
    root = [json.loads(text)]
    waiting = [(root, 0, 0)]
    while waiting:
        holder, at, depth = waiting.pop()
        value = holder[at]
        if depth > DEEPEST:
            holder[at] = "[TRUNCATED_DEPTH]"
        elif isinstance(value, str):
            if len(value) > MOST_DETAIL:
                holder[at] = f"{value[:MOST_DETAIL]}...[+{len(value) - MOST_DETAIL} chars]"
        elif isinstance(value, dict):
            for key in value:
                if key.lower() in SECRET_KEYS:
                    value[key] = "[REDACTED]"
                else:
                    waiting.append((value, key, depth + 1))
        elif isinstance(value, list):
            del value[LONGEST:]
            waiting.extend((value, i, depth + 1) for i in range(len(value)))
    return json.dumps(root[0], ensure_ascii=False, sort_keys=True)


@F.arrow_udf(T.StringType())
def sanitised_json(details: pa.Array) -> pa.Array:
    return pa.array([None if t is None else redacted(t) for t in details.to_pylist()], pa.string())


def result_shape(text: str) -> str:
    """What an audit row says of a tool's result (JSON): of objects their first 20 keys, of lists and strings the type
    and length, other values as they are. Objects are shaped as the parser closes them."""
    def shaped(value):
        return {"type": "list" if isinstance(value, list) else "str", "length": len(value)} if isinstance(value, list | str) else value

    return json.dumps(shaped(json.loads(text, object_pairs_hook=lambda pairs: {k: shaped(v) for k, v in list(dict(pairs).items())[:20]})), ensure_ascii=False)


@F.arrow_udf(T.StringType())
def result_shape_json(results: pa.Array) -> pa.Array:
    return pa.array([None if t is None else result_shape(t) for t in results.to_pylist()], pa.string())
