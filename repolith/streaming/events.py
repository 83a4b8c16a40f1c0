"""Event-driven parts as Structured Streaming transformations.

Each function takes and returns a DataFrame, streaming or not, so the batch form is
the test of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repolith.functions.signing import signature_state
from repolith.sources import sinks

ENVELOPE = "delivery_id string, event string, action string, repo string, sha string, number int, draft boolean, branch string, default_branch string, received_at timestamp, ref string, deleted boolean"
ZERO_SHA = "0" * 40
PULL_ACTIONS = ("opened", "synchronize", "reopened", "ready_for_review")


def parsed(raw: DataFrame, payload: str = "value") -> DataFrame:
    """Envelopes from JSON text; rows that don't parse or have no delivery id are left out."""
    return raw.select(F.from_json(F.col(payload).cast("string"), ENVELOPE).alias("e")).select("e.*").where("delivery_id is not null")


def outcome() -> Column:
    """What a webhook leads to: scan, rerun, record or ignored."""
    push = (F.col("event") == "push") & (F.col("branch") == F.col("default_branch")) & (F.col("sha") != ZERO_SHA)
    pull = (F.col("event") == "pull_request") & F.col("action").isin(*PULL_ACTIONS) & ~F.coalesce("draft", F.lit(False))
    rerun = (F.col("event") == "check_run") & (F.col("action") == "rerequested")
    return F.when(push | pull, "scan").when(rerun, "rerun").when(F.col("event").isin("installation", "installation_repositories"), "record").otherwise("ignored")


def deliveries(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each delivery once, with its outcome; repeats later than ``late`` are past the state kept."""
    d = events.withWatermark("received_at", late)
    d = d.dropDuplicatesWithinWatermark(["delivery_id"]) if events.isStreaming else d.dropDuplicates(["delivery_id"])
    return d.withColumn("outcome", outcome())


def verified(raw: DataFrame, secret: str, body: str = "value", signature: str = "signature") -> DataFrame:
    """The rows whose signature fits their body; without a secret none does."""
    return raw.where(signature_state(F.col(body), F.col(signature), secret) == "valid")


#: What a repository's row says of its gates; a column that is null or absent is as here.
GATES = {"guardian_enabled": True, "scan_on_push": True, "scan_on_pull_request": True, "default_branch": "main"}


def gated(deliveries: DataFrame, repositories: DataFrame) -> DataFrame:
    """``deliveries`` with ``status`` (queued or ignored), ``reason``, ``trigger`` and ``priority``, by the repositories' policies.

    deliveries: envelopes, streaming or not; repositories: (repo, guardian_enabled, scan_on_push,
    scan_on_pull_request, default_branch), a table that each micro-batch reads anew.  The
    first reason that holds is given; a rerun that was asked for needs no policy.
    """
    r = repositories.dropDuplicates(["repo"])
    known = r.select("repo", F.lit(True).alias("_known"), *[F.coalesce(F.col(c), F.lit(v)).alias(f"_{c}") if c in r.columns else F.lit(v).alias(f"_{c}") for c, v in GATES.items()])
    d = deliveries.join(known, "repo", "left")
    ref = F.coalesce("ref", F.concat(F.lit("refs/heads/"), "branch"))
    missing, off = F.col("_known").isNull(), ~F.col("_guardian_enabled")
    push = F.when(ref.isNull() | F.col("sha").isNull(), "no-commit").when(F.col("deleted"), "branch-deleted").when(F.col("sha").rlike("^0+$"), "no-commit").when(missing, "not-connected").when(off, "disabled").when(~F.col("_scan_on_push"), "policy")
    push = push.when(~ref.startswith("refs/heads/"), "not-a-branch").when(F.substring(ref, 12, 1 << 20) != F.col("_default_branch"), "other-branch")
    pull = F.when(~F.coalesce(F.col("action").isin(*PULL_ACTIONS), F.lit(False)), "action").when(F.col("number").isNull() | (F.col("number") == 0) | (F.coalesce("sha", F.lit("")) == ""), "incomplete").when(F.col("draft") & (F.col("action") != "ready_for_review"), "draft")
    pull = pull.when(missing, "not-connected").when(off, "disabled").when(~F.col("_scan_on_pull_request"), "policy")
    rerun = F.when(missing, "not-connected").when(F.coalesce("sha", F.lit("")) == "", "no-commit")
    is_rerun = (F.col("event") == "check_run") & F.coalesce(F.col("action") == "rerequested", F.lit(False))
    reason = F.when(F.col("event") == "push", push).when(F.col("event") == "pull_request", pull).when(is_rerun, rerun).otherwise("event")
    d = d.withColumn("reason", reason)
    trigger = F.when(F.col("event") == "push", "push").when((F.col("event") == "pull_request") | F.col("number").isNotNull(), "pull_request").otherwise("manual")
    queued = F.col("reason").isNull()
    d = d.withColumns({"status": F.when(queued, "queued").otherwise("ignored"), "trigger": F.when(queued, trigger), "priority": F.when(queued, F.when(is_rerun, 100).otherwise(0))})
    return d.drop("_known", *[f"_{c}" for c in GATES])


def deduped_events(events: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """One event a repository and key; events without a key all stay."""
    return events.where(F.col(key).isNull()).unionByName(events.where(F.col(key).isNotNull()).dropDuplicates(["repo", key]))


def windowed(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts and sums by event type in tumbling windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


JOB_STATE = "status string, attempts int, locked_ms long, again boolean"
JOB_OUT = "repo string, sha string, number int, status string, attempts int"
LOCK_MS, MAX_ATTEMPTS = 15 * 60 * 1000, 3
#: How long the state of a job that is over is kept.
RETAIN_MS = 24 * 60 * 60 * 1000
NEW_JOB = ("none", 0, 0, False)


def _over(again: bool, status: str, attempts: int) -> tuple:
    """A job that ends, or starts over where it was asked for again meanwhile."""
    return ("queued", 0, 0, False) if again else (status, attempts, 0, False)


def _advance(state: tuple, action: str, at: int) -> tuple:
    """Next (status, attempts, locked, again) of a job; actions that don't apply change nothing."""
    status, attempts, locked, again = state
    if action == "enqueue":
        return (status, attempts, locked, True) if status == "running" else state if status == "queued" else ("queued", 0, 0, False)
    if action == "claim" and (status == "queued" or status == "running" and at - locked >= LOCK_MS):
        return ("running", attempts + 1, at, again) if attempts < MAX_ATTEMPTS else _over(again, "failed", attempts)
    if action == "complete" and status == "running":
        return _over(again, "done", attempts)
    if action == "fail" and status == "running":
        return ("queued", attempts, 0, again) if attempts < MAX_ATTEMPTS else _over(again, "failed", attempts)
    if action == "cancel" and status in ("queued", "running"):
        return "cancelled", attempts, 0, False
    return state


def _millis(at: pd.Timestamp) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


def job_states(actions: DataFrame, late: str = "1 hour") -> DataFrame:
    """Streaming (repo, sha, number, status, attempts) from rows (repo, sha, number, action, at): the queue as a state per job.

    Enqueuing a queued job changes nothing, a running one runs once more afterwards; a
    lock of 15 minutes can be claimed again; the third failure is final.  Actions count in
    the order they come in, part by part of a batch, so no key's rows are held together.
    The state of a job that is over is dropped after a day, by the times of actions;
    actions later than ``late`` are past the state kept.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, last = state.get if state.exists else NEW_JOB, state.getCurrentWatermarkMs()
        for rows in batches:
            last = max(last, _millis(rows["at"].max()))
            rows = rows.sort_values("at", kind="stable")
            for action, at in zip(rows["action"], rows["at"], strict=True):
                now = _advance(tuple(now), action, _millis(at))
        state.update(tuple(now))
        if now[0] not in ("queued", "running"):
            state.setTimeoutTimestamp(last + RETAIN_MS)
        yield pd.DataFrame({"repo": [key[0]], "sha": [key[1]], "number": [key[2]], "status": [now[0]], "attempts": [now[1]]}).astype({"number": "Int32"})

    return actions.withWatermark("at", late).groupBy("repo", "sha", "number").applyInPandasWithState(step, JOB_OUT, JOB_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def claims(jobs: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """What a worker takes up at ``now``: the first ``most`` jobs that wait or whose lock is stale, with one attempt more.

    jobs: (id, status, priority, created, locked, attempts).  A job without attempts left fails instead.
    """
    stale = (F.col("status") == "running") & (F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("locked").cast("timestamp")) >= LOCK_MS)
    d = jobs.where((F.col("status") == "queued") | stale).orderBy(F.desc("priority"), "created", "id").limit(most)
    left = F.col("attempts") < MAX_ATTEMPTS
    return d.withColumn("status", F.when(left, "running").otherwise("failed")).withColumn("attempts", F.when(left, F.col("attempts") + 1).otherwise(F.col("attempts")))


def rate_limited(requests: DataFrame, most: int, window_ms: int, late: str = "1 minute") -> DataFrame:
    """Streaming (key, request, ok, retry_ms) from rows (key, request, at): ``most`` requests a key and window.

    A key's window starts with its first request after the last window, not with the
    clock.  Requests count in the order they come in; those later than ``late`` are left
    out, and a key's state goes when its window has passed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ends, n = state.get if state.exists else (0, 0)
        for rows in batches:
            rows, out = rows.sort_values(["at", "request"], kind="stable"), []
            for at in map(_millis, rows["at"]):
                if at >= ends:
                    ends, n = at + window_ms, 0
                n += n < most + 1
                out.append((n <= most, 0 if n <= most else ends - at))
            ok, wait = zip(*out, strict=True) if out else ((), ())
            yield pd.DataFrame({"key": [key[0]] * len(rows), "request": rows["request"].to_numpy(), "ok": ok, "retry_ms": wait})
        state.update((ends, n))
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs()) + window_ms)

    kinds = dict(requests.dtypes)
    out = f"key {kinds['key']}, request {kinds['request']}, ok boolean, retry_ms long"
    return requests.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, out, "ends long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def record_scans(scans: DataFrame, snapshots: str, log: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of scans (repo, scan, finished, ...) as snapshots and as events of a log, until no more is there.

    Both tables are written by the number of the batch, so a batch that runs again
    after a failure takes the place of what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number))
        sinks.replace_snapshot(rows, snapshots, "batch")
        event = F.concat_ws(":", F.lit("scan"), "repo", "scan")
        sinks.replace_snapshot(rows.select("repo", F.lit("scan.completed").alias("kind"), event.alias("dedupe_key"), F.col("finished").alias("at"), "batch"), log, "batch")

    return scans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
