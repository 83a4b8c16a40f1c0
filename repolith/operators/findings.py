"""Findings tables: merging, ordering, counting, comparing, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.functions.scalars import SEVERITIES, severity_at, severity_rank


def severity_counts(d: DataFrame, *keys: str) -> DataFrame:
    """A column for each severity, zero where a key has none."""
    return d.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def deduped(d: DataFrame, order: str) -> DataFrame:
    """One row a fingerprint: the worst finding (the first of equals), with merged confidence.

    Each duplicate adds five hundredths to the greatest confidence so far, up to 1.
    The running merge has a closed form over positions, so it is one window and one
    aggregate, with no list of a fingerprint's rows anywhere.
    """
    w = Window.partitionBy("fingerprint").orderBy(order)
    cents = F.floor(F.col("confidence") * 100 + 0.5)
    d = d.withColumn("_i", F.row_number().over(w)).withColumn("_c", cents - 5 * F.greatest("_i", F.lit(2)))
    rest = [c for c in d.columns if c not in ("fingerprint", "confidence", "_i", "_c")]
    out = d.groupBy("fingerprint").agg(F.min_by(F.struct(*rest), F.struct(severity_rank("severity"), "_i")).alias("w"), F.max("_c").alias("_m"), F.count(F.lit(1)).alias("occurrences"), F.first("confidence").alias("_one"))
    confidence = F.when(F.col("occurrences") == 1, F.col("_one")).otherwise(F.least(F.lit(100), F.col("_m") + 5 * (F.col("occurrences") + 1)) / 100)
    return out.select("fingerprint", "w.*", confidence.alias("confidence"), "occurrences")


def corroborated(d: DataFrame, order: str) -> DataFrame:
    """(fingerprint, corroborated_by): the other scanners that found what is kept of each fingerprint, by name.

    d: (fingerprint, severity, scanner, order).  Findings meet one after another: the worse of
    two stays (the first of equals) and notes the other's scanner, and what it noted before goes
    with it only.  So the kept one notes all after it, and of those before it the one that it replaced.
    """
    w = Window.partitionBy("fingerprint").orderBy(order)
    rank = F.struct(severity_rank("severity").alias("r"), F.col("_i").alias("i"))
    d = d.select("fingerprint", "severity", "scanner", F.row_number().over(w).alias("_i"), order).withColumn("_k", rank)
    before = F.min_by("scanner", "_k").over(w.rowsBetween(Window.unboundedPreceding, -1))
    best = F.min("_k").over(Window.partitionBy("fingerprint"))
    d = d.withColumn("_by", F.when(F.col("_i") > best["i"], F.col("scanner")).when(F.col("_i") == best["i"], before))
    return d.groupBy("fingerprint").agg(F.array_sort(F.collect_set("_by")).alias("corroborated_by"))


def ordered(d: DataFrame, most: int | None = None) -> DataFrame:
    """By severity, path and line; ``most`` rows of that order."""
    out = d.orderBy(severity_rank("severity"), F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), "fingerprint")
    return out.limit(most) if most else out


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(fingerprint, change): introduced, resolved or unchanged between two sets of findings."""
    a = before.select("fingerprint").distinct().withColumn("_a", F.lit(True))
    b = after.select("fingerprint").distinct().withColumn("_b", F.lit(True))
    return a.join(b, "fingerprint", "full_outer").select("fingerprint", F.when(F.col("_a").isNull(), "introduced").when(F.col("_b").isNull(), "resolved").otherwise("unchanged").alias("change"))


def verified_fix(original: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(fingerprint, outcome) of a fix: ``still_open`` originals and ``new`` findings."""
    still = after.join(original.select("fingerprint"), "fingerprint", "left_semi").select("fingerprint", F.lit("still_open").alias("outcome"))
    new = after.join(before.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", F.lit("new").alias("outcome"))
    return still.unionByName(new).distinct()


def first_seen(history: DataFrame) -> DataFrame:
    """Earliest and latest sighting of each fingerprint, and how many there were."""
    return history.groupBy("fingerprint").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("sightings"))


def episodes(sightings: DataFrame, scans: DataFrame) -> DataFrame:
    """(repo, fingerprint, episode, first_seen, last_seen, scans, resolved_at) over a whole history of scans.

    scans: (repo, scan, at), also those without findings; sightings: (repo, scan, fingerprint).
    A finding that a scan lacks is resolved by it; if it comes back a new episode starts, with
    that scan as its first.  ``resolved_at`` is null while the last scan has it.  Scans count by
    time and then name; equal rows count once, sightings of unknown scans not at all.
    """
    order = Window.partitionBy("repo").orderBy("at", "scan")
    s = scans.select("repo", "scan", "at").distinct()
    s = s.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("at").over(order))
    one = Window.partitionBy("repo", "fingerprint").orderBy("_n")
    d = sightings.select("repo", "scan", "fingerprint").distinct().join(s, ["repo", "scan"])
    island = F.col("_n") - F.row_number().over(one)
    d = d.withColumn("_island", island).groupBy("repo", "fingerprint", "_island").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("scans"), F.max_by("_next", "_n").alias("resolved_at"))
    episode = F.row_number().over(Window.partitionBy("repo", "fingerprint").orderBy("_island"))
    return d.select("repo", "fingerprint", episode.alias("episode"), "first_seen", "last_seen", "scans", "resolved_at")


# Areas that findings are grouped by, first match wins: name, title, pattern, columns it reads.
AREAS = (
    ("auth", "Authentication and authorization", r"(?i)auth|session|login|permission|csrf", ("path", "rule_id", "title")),
    ("secrets", "Committed credentials", "^secrets$", ("category",)),
    ("injection", "Injection and unsafe execution", r"(?i)inject|eval|exec|command|sql|xss", ("rule_id", "title")),
    ("dependencies", "Dependency risk", "^dependencies$", ("category",)),
    ("tests", "Testing gaps", "^testing$", ("category",)),
)
INFRASTRUCTURE = ("infra", "Infrastructure and CI", r"(?i)workflow|docker|cicd|config/")


def triage_area() -> Column:
    """The area of a finding (path, rule_id, title, category), null for none."""
    out = F.when(F.lit(False), F.lit(None))
    for name, _, pattern, cols in AREAS:
        out = out.when(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]).rlike(pattern), name)
    return out.when((F.col("category") == "infrastructure") | F.col("rule_id").rlike(INFRASTRUCTURE[2]), INFRASTRUCTURE[0])


def triage(d: DataFrame, key: str = "fingerprint") -> DataFrame:
    """(area, title, severity, n), most severe first, then largest; a finding of no area is a group of its own.

    d: (key, path, rule_id, title, category, severity).
    """
    titles = {n: t for n, t, *_ in (*AREAS, INFRASTRUCTURE)}
    area = triage_area()
    named = d.select(F.coalesce(area, F.concat(F.lit("solo:"), F.col(key).cast("string"))).alias("area"), F.coalesce(S.lookup(area, titles), F.col("title")).alias("title"), "severity")
    g = named.groupBy("area").agg(F.min("title").alias("title"), F.min(severity_rank("severity")).alias("r"), F.count(F.lit(1)).alias("n"))
    return g.select("area", "title", severity_at(F.col("r")).alias("severity"), "n").orderBy(severity_rank("severity"), F.desc("n"), "area")


def recurring(d: DataFrame, least: int = 3) -> DataFrame:
    """Rules with at least ``least`` findings."""
    return d.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# The rules of a repository without its own: name, trigger, least severity, risk, action.
DEFAULT_POLICIES = (
    ("Critical findings must request changes", "new_finding", "critical", None, "request_changes"),
    ("High findings warn", "new_finding", "high", None, "warn"),
    ("Secrets block", "secret_detected", None, None, "request_changes"),
    ("High dependency risk warns", "dependency_change", None, "high", "warn"),
)


def default_policies(spark: SparkSession) -> DataFrame:
    rows = [(name, True, trigger, least, risk, None, action) for name, trigger, least, risk, action in DEFAULT_POLICIES]
    return spark.createDataFrame(rows, "rule string, enabled boolean, trigger string, least_severity string, wanted_risk string, wanted_category string, action string")


def policy_matches(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Events beside the enabled rules whose trigger is equal and whose severity, risk and category hold.

    rules: as ``default_policies``, a small table; events: (trigger, severity, risk,
    category, ...).  A rule that asks for changes blocks the check.
    """
    on = (rules["trigger"] == events["trigger"]) & rules["enabled"]
    severe = rules["least_severity"].isNull() | F.coalesce(severity_rank(events["severity"]) <= severity_rank(rules["least_severity"]), F.lit(False))
    for want, has in (("wanted_risk", "risk"), ("wanted_category", "category")):
        severe &= rules[want].isNull() | (rules[want] == events[has])
    met = events.join(F.broadcast(rules), on & severe).drop(rules["trigger"])
    return met.withColumn("blocks", F.col("action") == "request_changes")
