"""Scores: points by factor, capped, added up, and put in bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import scalars as S

# Where categories count, and how much dimensions weigh.
DIMENSIONS = {"security": 0.35, "reliability": 0.25, "quality": 0.15, "testing": 0.15, "performance": 0.1}
CATEGORY_DIMENSION = {"security": "security", "secrets": "security", "infrastructure": "security", "bugs": "reliability", "reliability": "reliability", "quality": "quality", "architecture": "quality", "testing": "testing", "dependencies": "security", "performance": "performance"}


def log2_points(n: Column, factor: float, most: float) -> Column:
    return F.least(F.lit(float(most)), F.log2(n + 1.0) * factor)


def capped(x: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), x)


def dimension(category: str = "category") -> Column:
    return S.lookup(category, CATEGORY_DIMENSION)


def _half_cents(severity: str = "severity", confidence: str = "confidence") -> Column:
    """Weight times confidence in whole two-hundredths, so that sums don't depend on their order."""
    return (S.lookup(severity, {k: int(2 * v) for k, v in S.SEVERITY_WEIGHTS.items()}) * F.floor(F.col(confidence) * 100 + 0.5)).cast("long")


def health(findings: DataFrame, loc: DataFrame, key: str = "repo") -> DataFrame:
    """One row a repository: six scores, counts by severity and hours of debt.

    findings: (key, severity, category, confidence); loc: (key, total_loc).  A
    repository without findings scores 100 in everything.
    """
    sums = [F.sum(F.when(dimension() == d, _half_cents()).otherwise(0)).alias(f"_{d}") for d in DIMENSIONS]
    hours = (F.sum(S.lookup("severity", {k: int(100 * v) for k, v in S.DEBT_HOURS.items()})) / 100).alias("_hours")
    g = findings.groupBy(key).agg(*sums, hours, *[F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES])
    d = loc.join(g, key, "left").fillna(0)
    allowance = S.size_allowance(F.col("total_loc"))
    scores = {x: S.deduction_to_score(F.col(f"_{x}") / 200 / allowance) for x in DIMENSIONS}
    total = sum((v * F.lit(DIMENSIONS[x]) for x, v in scores.items()), F.lit(0.0))
    return d.select(key, S.round1(F.round(total, 6)).alias("health"), *[v.alias(k) for k, v in scores.items()], *S.SEVERITIES, S.round1(F.col("_hours")).alias("debt_hours"))


def top_rules(findings: DataFrame, most: int = 3) -> DataFrame:
    """The rules of most points in each dimension."""
    g = findings.withColumn("dimension", dimension()).groupBy("dimension", "rule_id").agg(F.count(F.lit(1)).alias("n"), (F.sum(_half_cents()) / 200).alias("points"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("points"), "rule_id"))).where(F.col("rank") <= most)


def component_risk(d: DataFrame) -> DataFrame:
    """``d`` with risk and level from counts: critical, high, medium, low, dependents, untested, files, churn, sensitive."""
    findings = capped(F.col("critical") * 10 + F.col("high") * 5 + F.col("medium") * 2 + F.col("low") * 0.5, 35)
    gap = F.when(F.col("files") == 0, 0.0).otherwise(capped(F.col("untested") / F.col("files") * 20, 20))
    churn = capped(F.log10(F.col("churn") + 1.0) * 8, 12)
    score = F.least(F.lit(100.0), findings + log2_points(F.col("dependents"), 7, 20) + gap + churn + F.when(F.col("sensitive"), 13.0).otherwise(0.0))
    return d.withColumn("risk", S.round1(score)).withColumn("level", S.component_band(score))


def impact(d: DataFrame) -> DataFrame:
    """``d`` with impact and level from direct, transitive, routes, areas, severity_points and tested."""
    score = log2_points(F.col("direct"), 10, 30) + log2_points(F.col("transitive"), 4, 15) + capped(F.col("routes") * 5.0, 15) + capped(F.col("areas") * 10.0, 20) + capped(F.col("severity_points"), 15)
    score = score + F.when(~F.col("tested") & (F.col("direct") > 0), 8.0).otherwise(0.0)
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)) + 0.5)
    return d.withColumn("impact", score).withColumn("level", S.impact_band(score))


def pull_request_risk(d: DataFrame) -> DataFrame:
    """``d`` with risk, level and should_block.

    Columns: counts of new findings by severity, area_points, changes, impacted,
    uncovered, truncated, resolved, fail_on.  The worst new finding is the least level.
    """
    found = sum((F.lit(w) * F.sqrt(F.col(s)) for s, w in S.NEW_FINDING_POINTS.items()), F.lit(0.0))
    size = F.least(F.lit(15.0), F.greatest(F.lit(0.0), F.log10(F.greatest(F.col("changes"), F.lit(1)) / 20) * 10))
    raw = S.round1(found) + F.col("area_points") + F.when(size >= 1, S.round1(size)).otherwise(0.0) + S.round1(log2_points(F.col("impacted"), 4, 12))
    raw = raw + S.round1(capped(F.col("uncovered") * 3.5, 14)) + F.when(F.col("truncated"), 10.0).otherwise(0.0) - F.least(F.lit(10), F.col("resolved") * 2)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), S.round1(raw)))
    worst = F.coalesce(*[F.when(F.col(s) > 0, F.lit(k)) for k, s in enumerate(S.SEVERITIES)])
    banded = S.severity_rank(S.risk_band(score))
    level = S.severity_at(F.least(F.coalesce(worst, banded), banded))
    return d.withColumn("risk", score).withColumn("level", level).withColumn("should_block", F.coalesce(worst <= S.severity_rank("fail_on"), F.lit(False)))


def repository_risk(d: DataFrame) -> DataFrame:
    """``d`` with risk and level from health, counts, secrets, files, untested, vulnerable, risky, sensitive, regressions."""
    r = S.round1
    parts = [
        r(capped(F.col("critical") * 10 + F.col("high") * 5 + F.col("medium") * 2 + F.col("low") * 0.5, 40)),
        r(capped(F.col("secrets") * 8.0, 20)),
        r(F.when(F.col("files") == 0, 0.0).otherwise(capped(F.col("untested") / F.col("files") * 15, 15))),
        r(capped(F.col("vulnerable") * 4.0, 15)),
        r(capped(F.col("risky") * 3.0, 12)),
        r(capped(F.col("sensitive") * 2.0, 10)),
        capped(F.col("regressions") * 6.0, 12),
        F.when(F.col("health") < 90, r(capped((100 - F.col("health")) / 100 * 15, 15))).otherwise(0.0),
    ]
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), r(sum(parts[1:], parts[0]))))
    return d.withColumn("risk", score).withColumn("level", S.risk_band(score))


def regression_risk(d: DataFrame) -> DataFrame:
    """``d`` with risk and level from severity_points, churn, paths, area_points, blast, tested, coverage, history, failures; rounded points are added."""
    r = S.round1
    paths = F.col("paths")
    parts = [
        r(capped(F.col("severity_points"), 40)),
        r(F.when(F.col("churn") > 0, capped(F.log10(F.col("churn") + 1.0) * 6, 15)).otherwise(0.0)),
        r(F.when(paths > 0, log2_points(paths, 3, 12)).otherwise(0.0)),
        r(capped(F.col("area_points") * 1.0, 20)),
        r(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("blast"))) / 100 * 15),
        r(F.when(paths > 0, capped(F.greatest(F.lit(0), paths - F.col("tested")) / paths * 12, 12)).otherwise(0.0)),
        F.when(F.col("coverage") < 0.3, 4.0).otherwise(0.0),
        r(F.when(F.col("history") > 0, log2_points(F.col("history"), 2, 8)).otherwise(0.0)),
        r(capped(F.col("failures") * 3.0, 10)),
    ]
    score = F.floor(F.least(F.lit(100.0), F.round(sum(parts[1:], parts[0]), 6)) + 0.5)
    return d.withColumn("risk", score).withColumn("level", S.component_band(score))


def test_relevance(d: DataFrame) -> DataFrame:
    """``d`` with relevance from depth, direct, total, cases and asserts: nearer tests first.

    Beyond three steps it is 0; without assertions at most 25.
    """
    near = F.when(F.col("depth") == 0, 55.0).when(F.col("depth") == 1, 35.0).when(F.col("depth") == 2, 20.0).otherwise(10.0)
    score = F.floor(near + log2_points(F.col("direct"), 10, 20) + log2_points(F.col("total"), 4, 10) + log2_points(F.col("cases"), 3, 10) + 0.5)
    score = F.when(F.col("asserts"), F.least(F.lit(100), score)).otherwise(F.least(F.lit(25), score))
    return d.withColumn("relevance", F.when(F.col("depth").between(0, 3), score).otherwise(0))


def prioritized_tests(d: DataFrame, key: str, test: str, most: int = 20) -> DataFrame:
    """``d`` with relevance and ``place``: the first ``most`` tests of each key, most relevant first, then by name."""
    d = test_relevance(d)
    return d.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("relevance"), test))).where(F.col("place") <= most)


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def gap_reason() -> Column:
    """Why an untested symbol (kind, path, complexity, dependents, route, database) is a gap; fixed values, as text."""
    n = F.col("dependents")
    parts = [
        _said("Exported ", F.col("kind"), " with no test file importing ", F.col("path")),
        F.when(F.col("complexity") >= 3, _said(F.col("complexity").cast("string"), " decision points")),
        F.when(n > 0, _said(n.cast("string"), " dependent file", F.when(n == 1, "").otherwise("s"))),
        F.when(F.col("route"), F.lit("reachable from an HTTP route")),
        F.when(F.col("database"), F.lit("touches the database")),
    ]
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), " · "), F.lit("."))


def gap_scenarios() -> Column:
    """What to test of a symbol (name, parameters, complexity, is_async, route, database, sensitive), as (description, priority); fixed values, as text."""
    name, n = F.col("name"), F.size("parameters")
    one = lambda when, text, priority: F.when(when, F.struct(text.alias("description"), (priority if isinstance(priority, Column) else F.lit(priority)).alias("priority")))
    taken = F.when(n == 1, _said("`", F.get("parameters", F.lit(0)), "`")).otherwise("arguments")
    rows = [
        one(F.lit(True), _said(name, " returns the expected result for a typical input"), "high"),
        one(n > 0, _said(name, " handles missing or invalid ", taken), "high"),
        one(F.col("complexity") >= 3, _said("Each branch of ", name, " is exercised"), F.when(F.col("complexity") >= 6, "high").otherwise("medium")),
        one(F.col("is_async"), _said(name, " propagates or handles a rejected promise"), "medium"),
        one(F.col("database"), _said(name, " behaves correctly when the database returns no rows"), "medium"),
        one(F.col("route"), F.lit("The endpoint rejects unauthenticated or malformed requests"), "high"),
        one(F.col("sensitive"), _said(name, " denies access when the caller is not permitted"), "high"),
    ]
    return F.array_compact(F.array(*rows))


def gap_severity(d: DataFrame) -> DataFrame:
    """``d`` with severity of a test gap from complexity, dependents, route, database and sensitive."""
    points = F.when(F.col("complexity") >= 6, 2).when(F.col("complexity") >= 3, 1).otherwise(0) + F.when(F.col("dependents") >= 3, 2).when(F.col("dependents") >= 1, 1).otherwise(0)
    points = points + F.when(F.col("route"), 2).otherwise(0) + F.when(F.col("database"), 1).otherwise(0) + F.when(F.col("sensitive"), 2).otherwise(0)
    return d.withColumn("severity", F.when(points >= 4, "high").when(points >= 2, "medium").otherwise("low"))


def debt(hours: dict[str, Column]) -> Column:
    """Sum of rounded hours by contributor."""
    return S.round1(sum((S.round1(v) for v in hours.values()), F.lit(0.0)))


# Hours of technical debt for each of a kind, and from which complexity and length a file counts.
DEBT_EACH = {"complexity": 1.5, "test-gaps": 0.75, "vulnerable-deps": 1.5, "stale-deps": 0.5}
COMPLEX_FROM, SOURCE_FROM = 25, 20


def debt_contributors(findings: DataFrame, files: DataFrame, tests: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repo, id, hours, count, place): what makes up a repository's technical debt, most hours first.

    findings: open ones (repo, severity); files: (repo, path, kind, loc, complexity); tests: (repo,
    path, covers); dependencies: (repo, version, latest, vulnerabilities).  A contributor without
    a case has no row.  The hours of a repository are their sum, see ``debt_totals``.
    """
    lists = lambda d, c: d.select("repo", F.explode(c).alias("path")).distinct()
    covered, own = lists(tests, "covers"), tests.select("repo", "path").distinct()
    source = files.where(~F.coalesce("kind", F.lit("")).isin("test", "config") & (F.col("loc") >= SOURCE_FROM)).join(own, ["repo", "path"], "left_anti")
    cases = {
        "complexity": files.where(F.coalesce("complexity", F.lit(0)) >= COMPLEX_FROM),
        "test-gaps": source.join(covered, ["repo", "path"], "left_anti"),
        "vulnerable-deps": dependencies.where(F.col("vulnerabilities") > 0),
        "stale-deps": dependencies.where(F.coalesce(S.major_behind(F.col("version"), F.col("latest")), F.lit(False))),
    }
    cents = F.sum(S.lookup("severity", {k: round(100 * v) for k, v in S.DEBT_HOURS.items()}))
    out = findings.groupBy("repo").agg(S.round1(cents / 100).alias("hours"), F.count(F.lit(1)).alias("count")).select("repo", F.lit("findings").alias("id"), "hours", "count")
    for name, d in cases.items():
        n = d.groupBy("repo").agg(F.count(F.lit(1)).alias("count"))
        out = out.unionByName(n.select("repo", F.lit(name).alias("id"), S.round1(F.col("count") * DEBT_EACH[name]).alias("hours"), "count"))
    order = Window.partitionBy("repo").orderBy(F.desc("hours"), "id")
    return out.withColumn("place", F.row_number().over(order))


def debt_totals(contributors: DataFrame) -> DataFrame:
    """(repo, hours) over a repository's contributors."""
    return contributors.groupBy("repo").agg(S.round1(F.sum("hours")).alias("hours"))


def debt_markers(findings: DataFrame) -> DataFrame:
    """(repo, markers): open findings (repo, rule_id) of rules about notes left in code."""
    return findings.where(F.col("rule_id").like("%todo%") | F.col("rule_id").like("%fixme%")).groupBy("repo").agg(F.count(F.lit(1)).alias("markers"))
