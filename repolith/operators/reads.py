"""Reads of stored tables: latest rows, histories, searches, scopes and what is still valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import paths as P
from repolith.functions import scalars as S

SEARCH_HITS = 30


def first_rows(d: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first ``most`` rows in an order: one top-k, no full sort."""
    return d.orderBy(*order).limit(most)


def history(d: DataFrame, key: str, time: str, most: int, tie: str) -> DataFrame:
    """The last ``most`` rows of each key with ``position`` from the oldest of them."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie)))
    kept = d.withColumn("_k", back).where(F.col("_k") <= most)
    return kept.withColumn("position", F.count(F.lit(1)).over(Window.partitionBy(key)) - F.col("_k") + 1).drop("_k")


def repositories(repos: DataFrame, owner: str, scanned: str, created: str) -> DataFrame:
    """``repos`` with ``position`` in its owner's list: never scanned ones first, then the latest scan, then the latest made."""
    return repos.withColumn("position", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc_nulls_first(scanned), F.desc(created))))


def next_job(jobs: DataFrame, queue: str) -> DataFrame:
    """The queued job (priority, created, id) of each queue that is due first."""
    rest = [c for c in jobs.columns if c != queue]
    return jobs.where("status = 'queued'").groupBy(queue).agg(F.min_by(F.struct(*rest), F.struct(-F.col("priority"), "created", "id")).alias("j")).select(queue, "j.*")


def cached(responses: DataFrame, requests: DataFrame, seconds: int) -> DataFrame:
    """(request, response): the newest response of a request's key that is at most ``seconds`` old by then.

    responses: (response, key, made); requests: (request, key, asked).  Both sides meet by key and hour.
    """
    hour = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    a = responses.withColumn("_h", F.explode(F.array(hour("made"), hour("made") + 1)))
    met = requests.withColumn("_h", hour("asked")).join(a, ["key", "_h"])
    age = F.unix_micros(F.col("asked").cast("timestamp")) - F.unix_micros(F.col("made").cast("timestamp"))
    return met.where((age >= 0) & (age <= seconds * 1_000_000)).groupBy("request").agg(F.max_by("response", F.struct("made", "response")).alias("response"))


def valid_memory(facts: DataFrame, as_of: str, path: str | None = None) -> DataFrame:
    """Facts (scopes, expires, ...) that have not expired and, given a path, whose scope it is in."""
    d = facts.where(F.col("expires").isNull() | (F.col("expires") > F.lit(as_of).cast("timestamp_ntz")))
    return d.where(P.in_scope(F.col("scopes"), F.lit(path))) if path else d


def search(tables: dict[str, DataFrame], query: str, most: int = SEARCH_HITS) -> DataFrame:
    """(kind, label, score) of the best hits in several tables (label, detail)."""
    out = None
    for kind, d in tables.items():
        rows = d.select(F.lit(kind).alias("kind"), "label", S.search_score(F.col("label"), F.col("detail"), query).alias("score")).where("score > 0")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("score"), "label", "kind").limit(most)


def latest_changed_paths(commits: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """(key, path) of the last commit of each key; commits: (key, time, tie, paths)."""
    last = commits.groupBy(key).agg(F.max_by("paths", F.struct(time, tie)).alias("paths"))
    return last.select(key, F.explode(F.array_distinct("paths")).alias("path"))


def findings_of_file(findings: DataFrame, most: int = 20) -> DataFrame:
    """The worst ``most`` open findings of each file, by severity, line and id."""
    k = F.row_number().over(Window.partitionBy("path").orderBy(S.severity_rank("severity"), "line", "event_id"))
    return findings.withColumn("k", k).where(F.col("k") <= most)


def ordered_gaps(gaps: DataFrame, most: int = 50) -> DataFrame:
    """Test gaps by severity, complexity downward, path and symbol."""
    return gaps.orderBy(S.severity_rank("severity"), F.desc("complexity"), "path", "symbol").limit(most)


def ordered_factors(factors: Column) -> Column:
    """An array of (name, points) by the size of the points, largest first, then by name."""
    keyed = F.transform(factors, lambda x: F.struct((-F.abs(x["points"])).alias("k"), x["name"].alias("name"), x["points"].alias("points")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["name"].alias("name"), x["points"].alias("points")))


def recent_requests(d: DataFrame, key: str, time: str, as_of: str, minutes: int = 60) -> DataFrame:
    """(key, n): how many requests of the last ``minutes``."""
    to = F.lit(as_of).cast("timestamp_ntz")
    return d.where((F.col(time) > to - F.expr(f"interval {minutes} minutes")) & (F.col(time) <= to)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def guardian_overview(repos: DataFrame, deliveries: DataFrame, jobs: DataFrame, pulls: DataFrame, as_of: str, days: int = 7, rows: int = 15, best: int = 10) -> DataFrame:
    """One row a repository (repo): the week's deliveries, its queue, and its riskiest pull requests.

    deliveries: (repo, delivery, status, at); jobs: (repo, job, status, at); pulls: (repo,
    pull, state, level, score, at).  delivery_ids, job_ids and pull_ids hold the latest ``rows`` and the
    riskiest ``best``, in that order; risky counts the open ones of high or critical level
    among the latter.
    """
    to = F.lit(as_of).cast("timestamp_ntz")
    week = deliveries.where(F.col("at") >= to - F.expr(f"interval {days} days"))
    a = week.groupBy("repo").agg(F.count(F.lit(1)).alias("deliveries"), F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"))
    b = jobs.groupBy("repo").agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))

    def first(d: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
        top = d.withColumn("_k", F.row_number().over(Window.partitionBy("repo").orderBy(*order, key))).where(F.col("_k") <= most)
        return top.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", key))), lambda x: x[key]).alias(key + "_ids"), *([F.count_if((F.col("state") == "open") & F.col("level").isin("critical", "high")).alias("risky")] if key == "pull" else []))

    d = repos.select("repo")
    parts = (a, b, first(deliveries, "delivery", rows, F.desc("at")), first(jobs, "job", rows, F.desc("at")), first(pulls, "pull", best, F.desc("score"), F.desc("at")))
    for x in parts:
        d = d.join(x, "repo", "left")
    return d.fillna(0, ["deliveries", "processed", "failed", "queued", "running", "risky"])


def latest(d: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``: one aggregate, whatever a key's number of rows."""
    rest = [c for c in d.columns if c != key]
    return d.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(key, "_x.*")


def by_id(d: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """(request, rows of ``d``): the row that each of (request, key) asks for; requests for none are left out."""
    return requests.join(d, key)


def rows_of(d: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """All rows of ``d`` that belong to ``owners`` (key), as the fixes of a finding do."""
    return d.join(owners.select(key).distinct(), key, "left_semi")


def deltas(d: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``d`` with ``delta``: the change of ``value`` since a key's row before."""
    return d.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(time)))


def counts(d: DataFrame, *keys: str) -> DataFrame:
    """(keys, n); keys without rows have none."""
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def since(d: DataFrame, key: str, time: str, as_of: str, **starts: str) -> DataFrame:
    """(key, a count for each name): rows up to ``as_of`` that are later than each start."""
    return d.where(F.col(time) <= as_of).groupBy(key).agg(*[F.count_if(F.col(time) > v).alias(k) for k, v in starts.items()])


def largest(d: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """(key, files, loc): the ``most`` keys of largest summed size, ties by key."""
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("loc")).orderBy(F.desc("loc"), key).limit(most)


def with_counts(d: DataFrame, other: DataFrame, on: str, name: str) -> DataFrame:
    """``d`` with how many rows of ``other`` share ``on``, 0 for none; ``other`` is counted before it is joined."""
    return d.join(other.groupBy(on).agg(F.count(F.lit(1)).alias(name)), on, "left").fillna(0, [name])


def with_parent(d: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """``d`` beside its parent's columns, as repositories beside their installation; null where there is none."""
    return d.join(parents, on, "left")
