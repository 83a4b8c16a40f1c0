"""Registered reads over the driver's tables: customers are repositories, nations their owners, events requests and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.operators import reads as RD
from repolith.plans.queries import AS_OF, FINDINGS, findings, query, read
from repolith.plans.repository import FILES, files


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def recent_scans(spark, d):
    return RD.first_rows(read(spark, d, "orders"), 10, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def recent_events(spark, d):
    return RD.first_rows(read(spark, d, "events"), 40, F.desc("ts"), F.desc("event_id")).select("event_id", "event_type")


@query(
    """WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders QUALIFY k <= 5)
 SELECT o_custkey, o_orderkey, o_totalprice, count(*) OVER (PARTITION BY o_custkey) - k + 1 AS position FROM k"""
)
def snapshot_history(spark, d):
    return RD.history(read(spark, d, "orders"), "o_custkey", "o_orderdate", 5, "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice", "position")


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY scanned DESC NULLS FIRST, c_custkey DESC) AS position FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS scanned FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def repositories_of_users(spark, d):
    last = read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("scanned"))
    c = read(spark, d, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
    return RD.repositories(c, "c_nationkey", "scanned", "c_custkey").select("c_custkey", "c_nationkey", "position")


@query(
    "SELECT user_id, event_id AS id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END DESC, ts, event_id) AS k FROM events WHERE event_type <> 'view') WHERE k = 1"
)
def next_jobs(spark, d):
    e = read(spark, d, "events")
    status = F.when(F.col("event_type") == "view", "done").otherwise("queued")
    priority = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    jobs = e.select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created"), "event_type", status.alias("status"), priority.alias("priority"))
    return RD.next_job(jobs, "user_id").select("user_id", "id", "event_type")


@query(
    """SELECT q.event_id AS request, max_by(r.event_id, (r.ts, r.event_id)) AS response FROM events q JOIN events r ON r.user_id = q.user_id AND q.event_type = 'view' AND r.event_type = 'purchase' AND r.ts <= q.ts AND r.ts >= q.ts - INTERVAL 6 HOUR GROUP BY 1"""
)
def cached_responses(spark, d):
    e = read(spark, d, "events")
    made = e.where("event_type = 'purchase'").select(F.col("event_id").alias("response"), F.col("user_id").alias("key"), F.col("ts").alias("made"))
    return RD.cached(made, e.where("event_type = 'view'").select(F.col("event_id").alias("request"), F.col("user_id").alias("key"), F.col("ts").alias("asked")), 6 * 3600)


_SCOPES = ("src", "src/api/", "lib/auth", "db")


@query(
    """SELECT event_id FROM events WHERE (value < 20 OR ts > TIMESTAMP '2024-01-10') AND (event_id % 5 = 4 OR ['src', 'src/api', 'lib/auth', 'db'][1 + event_id % 5] IN ('src', 'src/api', 'src/api/users.ts'))"""
)
def valid_memory(spark, d):
    e = read(spark, d, "events")
    scope = F.get(F.array(*[F.lit(x) for x in _SCOPES]), (F.col("event_id") % 5).cast("int"))
    scopes = F.when(F.col("event_id") % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(scope))
    facts = e.select("event_id", scopes.alias("scopes"), F.when(F.col("value") >= 20, F.col("ts")).alias("expires"))
    return RD.valid_memory(facts, "2024-01-10 00:00:00", "src/api/users.ts").select("event_id")


@query(
    """WITH t AS (SELECT 'customer' AS kind, c_name AS label, c_mktsegment AS detail FROM customer UNION ALL SELECT 'part', p_name, p_type FROM part UNION ALL SELECT 'nation', n_name, '' FROM nation UNION ALL SELECT 'supplier', s_name, '' FROM supplier),
 s AS (SELECT kind, label, CASE WHEN lower(label) = 'auto' THEN 100 WHEN starts_with(lower(label), 'auto') THEN 80 WHEN contains(lower(label), 'auto') THEN 60 WHEN contains(lower(detail), 'auto') THEN 30 ELSE 0 END AS score FROM t)
 SELECT * FROM s WHERE score > 0 ORDER BY score DESC, label, kind LIMIT 30"""
)
def search_index(spark, d):
    of = lambda t, label, detail: read(spark, d, t).select(F.col(label).alias("label"), (F.col(detail) if detail else F.lit("")).alias("detail"))
    return RD.search({"customer": of("customer", "c_name", "c_mktsegment"), "part": of("part", "p_name", "p_type"), "nation": of("nation", "n_name", None), "supplier": of("supplier", "s_name", None)}, "AUTO")


@query(
    """WITH k AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1) SELECT DISTINCT o_custkey, l_partkey AS path FROM k JOIN lineitem ON l_orderkey = o"""
)
def latest_changed_paths(spark, d):
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("paths"))
    c = read(spark, d, "orders").join(per, F.col("l_orderkey") == F.col("o_orderkey"))
    return RD.latest_changed_paths(c, "o_custkey", "o_orderdate", "o_orderkey")


@query(FINDINGS + "SELECT path, event_id, severity, row_number() OVER (PARTITION BY path ORDER BY sr, line, event_id) AS k FROM f QUALIFY k <= 20")
def findings_of_files(spark, d):
    return RD.findings_of_file(findings(spark, d)).select("path", "event_id", "severity", "k")


@query(f"{FILES} SELECT id, path FROM files ORDER BY CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END, loc DESC, path, id LIMIT 50")
def ordered_gaps(spark, d):
    severity = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("id") % 3).cast("int"))
    return RD.ordered_gaps(files(spark, d).select("path", F.col("id").alias("symbol"), F.col("loc").alias("complexity"), severity.alias("severity"))).select(F.col("symbol").alias("id"), "path")


@query(
    """WITH f AS (SELECT c_custkey, unnest([{'n': 'balance', 'p': floor(c_acctbal / 100)}, {'n': 'nation', 'p': -c_nationkey * 3.0}, {'n': 'key', 'p': c_custkey % 50.0}]) AS x FROM customer)
 SELECT c_custkey, string_agg(x.n, ',' ORDER BY abs(x.p) DESC, x.n) AS factors FROM f GROUP BY 1"""
)
def ordered_factors(spark, d):
    one = lambda name, points: F.struct(F.lit(name).alias("name"), points.cast("double").alias("points"))
    f = F.array(one("balance", F.floor(F.col("c_acctbal") / 100)), one("nation", -F.col("c_nationkey") * 3), one("key", F.col("c_custkey") % 50))
    return read(spark, d, "customer").select("c_custkey", F.array_join(F.transform(RD.ordered_factors(f), lambda x: x["name"]), ",").alias("factors"))


@query("SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-15 11:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def recent_requests(spark, d):
    return RD.recent_requests(read(spark, d, "events"), "user_id", "ts", "2024-01-15 12:00:00")


@query(
    FINDINGS
    + """SELECT repo, count(*) FILTER (severity = 'critical' AND category = 'security') AS open_secrets, count(*) FILTER (rule_id LIKE '%signup%' OR rule_id LIKE '%click3%') AS markers FROM f GROUP BY repo"""
)
def scalar_counts(spark, d):
    marker = F.contains("rule_id", F.lit("signup")) | F.contains("rule_id", F.lit("click3"))
    return findings(spark, d).groupBy("repo").agg(F.count_if((F.col("severity") == "critical") & (F.col("category") == "security")).alias("open_secrets"), F.count_if(marker).alias("markers"))


@query("SELECT user_id, event_type AS status, count(*) AS n, CAST(sum(event_id % 1000) AS BIGINT) AS tokens, CAST(floor(median(event_id % 1000) + 0.5) AS BIGINT) AS middle FROM events GROUP BY 1, 2")
def usage_by_provider(spark, d):
    t = read(spark, d, "events").select("user_id", F.col("event_type").alias("status"), (F.col("event_id") % 1000).alias("t"))
    return t.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("tokens"), S.median_rounded("t").alias("middle"))


@query(
    FINDINGS
    + """, dl AS (SELECT repo, event_id AS delivery, ts AS sent, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('click', 'view') THEN 'processed' ELSE 'received' END AS status, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'running' ELSE 'done' END AS job FROM f),
 w AS (SELECT repo, count(*) FILTER (sent >= TIMESTAMP '2024-01-24') AS deliveries, count(*) FILTER (sent >= TIMESTAMP '2024-01-24' AND status = 'processed') AS processed, count(*) FILTER (sent >= TIMESTAMP '2024-01-24' AND status = 'failed') AS failed, count(*) FILTER (job = 'queued') AS queued, count(*) FILTER (job = 'running') AS running FROM dl GROUP BY 1),
 r AS (SELECT repo, string_agg(delivery, ',' ORDER BY sent DESC, delivery) AS latest FROM (SELECT * FROM dl QUALIFY row_number() OVER (PARTITION BY repo ORDER BY sent DESC, delivery) <= 15) GROUP BY 1),
 p AS (SELECT 'repo' || (c_custkey % 20) AS repo, c_custkey AS pull, floor(c_acctbal / 100) AS score, c_custkey % 3 <> 0 AS open FROM customer QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, c_nationkey DESC, pull) <= 10),
 q AS (SELECT repo, string_agg(pull, ',' ORDER BY score DESC, pull) AS pulls, count(*) FILTER (open AND score >= 45) AS risky FROM (SELECT * FROM p) GROUP BY 1)
 SELECT repo, deliveries, processed, failed, queued, running, latest, risky FROM w JOIN r USING (repo) LEFT JOIN q USING (repo)"""
)
def guardian_overviews(spark, d):
    f = findings(spark, d)
    kind = F.col("event_type")
    sent = f.select("repo", F.col("event_id").alias("delivery"), F.when(kind == "error", "failed").when(kind.isin("click", "view"), "processed").otherwise("received").alias("status"), F.col("ts").alias("at"))
    jobs = f.select("repo", F.col("event_id").alias("job"), F.when(kind == "signup", "queued").when(kind == "purchase", "running").otherwise("done").alias("status"), F.col("ts").alias("at"))
    score = F.floor(F.col("c_acctbal") / 100)
    pulls = read(spark, d, "customer").select(
        F.concat(F.lit("repo"), (F.col("c_custkey") % 20).cast("string")).alias("repo"), F.col("c_custkey").alias("pull"), F.when(F.col("c_custkey") % 3 == 0, "closed").otherwise("open").alias("state"), S.risk_band(score).alias("level"), score.alias("score"), F.col("c_nationkey").alias("at")
    )
    o = RD.guardian_overview(f.select("repo").distinct(), sent, jobs, pulls, AS_OF)
    return o.select("repo", "deliveries", "processed", "failed", "queued", "running", F.array_join("delivery_ids", ",").alias("latest"), "risky")
