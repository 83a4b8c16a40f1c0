"""Registered queries: the library's operators over the driver's tables, by analogy.

Events stand for findings, parts and suppliers for files and components, orders for
changes.  Each function is a DataFrame plan; the SQL beside it is written apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.operators import findings as FI
from repolith.operators import graph as G
from repolith.operators import reads as RD
from repolith.operators import scoring as SC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-31"
#: Orders from this date on are the later state of ``dependency_diff``.
SPLIT = "1998-04-16"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Events as findings."""
    e = read(spark, d, "events")
    severity = S.lookup("event_type", {"error": "critical", "purchase": "high", "click": "medium", "view": "low", "signup": "info"})
    category = S.lookup((F.col("user_id") % 5).cast("int"), {0: "security", 1: "reliability", 2: "quality", 3: "testing", 4: "performance"})
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    return e.select(
        "event_id", "ts", "user_id", "value", "event_type", text("repo", F.col("user_id") % 20).alias("repo"), severity.alias("severity"), category.alias("category"),
        F.concat(F.lit("rule/"), "event_type", (F.col("user_id") % 7).cast("string")).alias("rule_id"), F.concat(F.lit("src/m"), (F.col("user_id") % 40).cast("string"), F.lit(".py")).alias("path"),
        (F.col("event_id") % 100).alias("line"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), text("hit  ", F.col("event_id") % 50).alias("evidence"),
    )


FINDINGS = """WITH f AS (SELECT event_id, ts, user_id, value, event_type, 'repo' || (user_id % 20) AS repo,
 CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' WHEN 'signup' THEN 'info' END AS severity,
 CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 END AS sr,
 CASE user_id % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'reliability' WHEN 2 THEN 'quality' WHEN 3 THEN 'testing' ELSE 'performance' END AS category,
 'rule/' || event_type || (user_id % 7) AS rule_id, 'src/m' || (user_id % 40) || '.py' AS path, event_id % 100 AS line,
 (event_id % 100) / 100.0::DOUBLE AS confidence, 'hit  ' || (event_id % 50) AS evidence,
 left(sha256('rule/' || event_type || (user_id % 7) || chr(0) || 'src/m' || (user_id % 40) || '.py' || chr(0) || 'hit ' || (event_id % 50)), 32) AS fingerprint FROM events)
"""


def signed(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).withColumn("fingerprint", S.fingerprint(F.col("rule_id"), F.col("path"), F.col("evidence")))


_SCORE = "CASE WHEN {x} <= 0 THEN 100.0 ELSE greatest(0.1, floor((100 / (1 + {x} / 25)) * 10 + 0.5) / 10) END"
_W2 = "CASE severity WHEN 'critical' THEN 50 WHEN 'high' THEN 24 WHEN 'medium' THEN 10 WHEN 'low' THEN 4 ELSE 1 END"
_LOG2 = "least({m}, log2({n} + 1) * {k})"


@query(
    FINDINGS
    + f""", w AS (SELECT *, {_W2} * floor(confidence * 100 + 0.5) / 200 AS p, CASE severity WHEN 'critical' THEN 400 WHEN 'high' THEN 200 WHEN 'medium' THEN 100 WHEN 'low' THEN 50 ELSE 15 END AS h FROM f),
 s AS (SELECT repo, count(*) * 50 AS loc, {", ".join(f"sum(CASE WHEN category = '{c}' THEN p ELSE 0 END) AS d_{c}" for c in SC.DIMENSIONS)},
 {", ".join(f"CAST(sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s in S.SEVERITIES)}, sum(h) / 100.0 AS hours FROM w GROUP BY repo),
 a AS (SELECT *, greatest(1.0, least(3.0, log10(greatest(loc, 100) / 50.0))) AS al FROM s),
 r AS (SELECT *, {", ".join(_SCORE.format(x=f"(d_{c} / al)") + f" AS {c}" for c in SC.DIMENSIONS)} FROM a)
 SELECT repo, floor(round(security * 0.35 + reliability * 0.25 + quality * 0.15 + testing * 0.15 + performance * 0.1, 6) * 10 + 0.5) / 10 AS health,
 security, reliability, quality, testing, performance, critical, high, medium, low, info, CAST(floor(hours * 10 + 0.5) / 10 AS DOUBLE) AS debt_hours FROM r"""
)
def health_scorecard(spark, d):
    f = findings(spark, d)
    loc = f.groupBy("repo").agg((F.count(F.lit(1)) * 50).alias("total_loc"))
    return SC.health(f, loc)


@query(FINDINGS + f"SELECT repo, {', '.join(f'count(*) FILTER (severity = {chr(39)}{s}{chr(39)}) AS {s}' for s in S.SEVERITIES)} FROM f GROUP BY repo")
def severity_counts(spark, d):
    return FI.severity_counts(findings(spark, d), "repo")


@query(FINDINGS + "SELECT repo, category, count(*) AS n FROM f GROUP BY repo, category")
def category_counts(spark, d):
    return RD.counts(findings(spark, d), "repo", "category")


@query(
    FINDINGS
    + """, RECURSIVE_ROWS AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY event_id) AS i, CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS c FROM f)
 SELECT fingerprint, arg_min(severity, sr * 100000000 + i) AS severity, arg_min(event_id, sr * 100000000 + i) AS event_id, count(*) AS occurrences,
 list_reduce(list(c ORDER BY i), lambda x, y: least(100, greatest(x, y) + 5)) / 100.0::DOUBLE AS confidence FROM RECURSIVE_ROWS GROUP BY fingerprint"""
)
def deduped_findings(spark, d):
    out = FI.deduped(signed(spark, d).select("fingerprint", "severity", "event_id", "confidence"), "event_id")
    return out.select("fingerprint", "severity", "event_id", "occurrences", "confidence")


@query(FINDINGS + "SELECT event_id, severity, path, line FROM f ORDER BY sr, path, line, fingerprint, event_id LIMIT 100")
def open_findings(spark, d):
    f = signed(spark, d)
    return f.orderBy(S.severity_rank("severity"), "path", "line", "fingerprint", "event_id").limit(100).select("event_id", "severity", "path", "line")


@query(
    FINDINGS
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY rule_id, path ORDER BY event_id) AS k, count(*) OVER (PARTITION BY rule_id, path) AS n FROM f)
 SELECT rule_id, path, event_id, CASE WHEN k = 5 AND n > 5 THEN n - 5 ELSE 0 END AS additional FROM k WHERE k <= 5"""
)
def capped_hits(spark, d):
    from repolith.operators.rules import capped

    f = findings(spark, d).drop("line").withColumn("line", F.col("event_id"))
    return capped(f).select("rule_id", "path", "event_id", F.col("additional").cast("long").alias("additional"))


@query(
    FINDINGS
    + f""", g AS (SELECT category AS dimension, rule_id, count(*) AS n, sum(CAST({_W2} * floor(confidence * 100 + 0.5) AS BIGINT)) / 200 AS points FROM f GROUP BY 1, 2)
 SELECT dimension, rule_id, n, CAST(points AS DOUBLE) AS points FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY points DESC, rule_id) AS k FROM g) WHERE k <= 3"""
)
def top_rules(spark, d):
    return SC.top_rules(findings(spark, d)).drop("rank")


@query(
    FINDINGS
    + """, a AS (SELECT DISTINCT fingerprint FROM f WHERE ts < TIMESTAMP '2024-01-16'), b AS (SELECT DISTINCT fingerprint FROM f WHERE ts >= TIMESTAMP '2024-01-16')
 SELECT fingerprint, 'introduced' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT fingerprint, 'resolved' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
 UNION ALL SELECT fingerprint, 'unchanged' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)"""
)
def finding_delta(spark, d):
    f = signed(spark, d)
    return FI.delta(f.where("ts < '2024-01-16'"), f.where("ts >= '2024-01-16'"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, d):
    return RD.latest(read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(
    """WITH p AS (SELECT user_id, count(*) AS n, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events GROUP BY user_id)
 SELECT user_id, n, CASE WHEN n < 2 THEN 'unknown' WHEN b - a >= 3 THEN 'improving' WHEN b - a <= -3 THEN 'declining' ELSE 'stable' END AS trajectory FROM p"""
)
def trajectories(spark, d):
    at = F.struct("ts", "event_id")
    g = read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", at).alias("a"), F.max_by("value", at).alias("b"))
    return g.select("user_id", "n", S.trajectory(F.col("a"), F.col("b"), F.col("n")).alias("trajectory"))


@query(
    FINDINGS
    + """, s AS (SELECT repo, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM f GROUP BY 1, 2)
 SELECT repo, day, n, n - lag(n) OVER (PARTITION BY repo ORDER BY day) AS delta FROM s"""
)
def health_deltas(spark, d):
    s = RD.counts(findings(spark, d).withColumn("day", F.to_date("ts").cast("string")), "repo", "day")
    return RD.deltas(s, "repo", "day", "n")


@query(FINDINGS + "SELECT fingerprint, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_seen, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_seen, count(*) AS sightings FROM f GROUP BY fingerprint")
def first_seen(spark, d):
    return FI.first_seen(signed(spark, d)).withColumns({c: F.to_date(c).cast("string") for c in ("first_seen", "last_seen")})


def components(spark: SparkSession, d: str) -> DataFrame:
    """Brands as components: a row each with the inputs of component_risk."""
    p, li = read(spark, d, "part"), read(spark, d, "lineitem")
    per = li.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("touches"))
    j = p.join(per, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.groupBy(F.col("p_brand").alias("component")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("l_partkey").isNull()).alias("untested"), F.count_if(F.col("p_size") == 1).alias("critical"), F.count_if(F.col("p_size") == 2).alias("high"),
        F.count_if(F.col("p_size") == 3).alias("medium"), F.count_if(F.col("p_size") == 4).alias("low"), F.coalesce(F.max("suppliers"), F.lit(0)).alias("dependents"), F.coalesce(F.sum("touches"), F.lit(0)).alias("churn"),
        F.bool_or(F.col("p_size") > 49).alias("sensitive"),
    )


@query(
    """WITH per AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS s, count(*) AS t FROM lineitem GROUP BY 1),
 c AS (SELECT p_brand AS component, count(*) AS files, count(*) FILTER (l_partkey IS NULL) AS u, count(*) FILTER (p_size = 1) AS c1, count(*) FILTER (p_size = 2) AS c2, count(*) FILTER (p_size = 3) AS c3,
 count(*) FILTER (p_size = 4) AS c4, coalesce(max(s), 0) AS dep, coalesce(sum(t), 0) AS churn, bool_or(p_size > 49) AS sens FROM part LEFT JOIN per ON p_partkey = l_partkey GROUP BY 1),
 r AS (SELECT component, files, least(100.0, least(35.0, c1 * 10 + c2 * 5 + c3 * 2 + c4 * 0.5) + least(20.0, log2(dep + 1) * 7) + least(20.0, u / files * 20) + least(12.0, log10(churn + 1) * 8) + CASE WHEN sens THEN 13 ELSE 0 END) AS x FROM c)
 SELECT component, files, CAST(floor(x * 10 + 0.5) / 10 AS DOUBLE) AS risk, CASE WHEN x >= 65 THEN 'critical' WHEN x >= 40 THEN 'high' WHEN x >= 18 THEN 'medium' ELSE 'low' END AS level FROM r"""
)
def component_risk(spark, d):
    return SC.component_risk(components(spark, d)).select("component", "files", "risk", "level")


@query(
    """SELECT a, b, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), (SELECT s_suppkey, n_name AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 (SELECT p_partkey, p_brand AS b FROM part) WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey GROUP BY a, b"""
)
def component_edges(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("node"), F.col("n_name").alias("component"))
    return G.component_edges(e, s, read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("component")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def untested_files(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return G.untested(c, read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("node"))).withColumnRenamed("node", "c_custkey")


@query(
    f"""WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT}' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT}' GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v"""
)
def dependency_diff(spark, d):
    """``dependency_diff`` of all orders, before a date and from it on."""
    from repolith.sources.manifests import changed

    o = read(spark, d, "orders")
    side = lambda when: o.where(when).groupBy(F.lit("npm").alias("ecosystem"), F.col("o_custkey").alias("name")).agg(F.max("o_totalprice").alias("version"))
    return changed(side(F.col("o_orderdate") < SPLIT), side(F.col("o_orderdate") >= SPLIT)).select("name", "change")


@query(
    """WITH d AS (SELECT p_partkey, ['npm', 'PyPI'][1 + p_partkey % 2] AS eco, ['lodash', 'flask', 'axios', 'django'][1 + p_partkey % 4] AS name, p_size % 6 AS a, p_partkey % 30 AS b FROM part),
 k AS (SELECT * FROM (VALUES ('npm', 'lodash', 4, 17, 'high'), ('npm', 'axios', 0, 21, 'medium'), ('PyPI', 'flask', 2, 3, 'high'), ('PyPI', 'django', 3, 2, 'critical')) t(eco, name, x, y, severity))
 SELECT p_partkey, k.severity FROM d JOIN k ON d.eco = k.eco AND d.name = k.name WHERE d.a < k.x OR (d.a = k.x AND d.b < k.y)"""
)
def vulnerable_packages(spark, d):
    from repolith.sources.manifests import vulnerable

    k = spark.createDataFrame([("1", "lodash", "npm", "4.17", "high", None), ("2", "axios", "npm", "0.21", "medium", None), ("3", "flask", "PyPI", "2.3.0", "high", None), ("4", "django", "PyPI", "3.2", "critical", None)], "id string, package string, ecosystem string, fixed_in string, severity string, introduced string")
    pick = lambda names, c: F.get(F.array(*[F.lit(x) for x in names]), (c % len(names)).cast("int"))
    key = F.col("p_partkey")
    deps = read(spark, d, "part").select(pick(("npm", "PyPI"), key).alias("ecosystem"), pick(("lodash", "flask", "axios", "django"), key).alias("name"), F.concat_ws(".", (F.col("p_size") % 6).cast("string"), (key % 30).cast("string")).alias("version"), key.cast("string").alias("manifest_path"), F.lit(1).alias("line"))
    return vulnerable(deps, k).select(F.col("manifest_path").cast("long").alias("p_partkey"), "severity")


@query(
    FINDINGS
    + """, r AS (SELECT * FROM (VALUES ('errors', 'error', 0, NULL, NULL, 'request_changes'), ('clicks', 'click', 1, NULL, NULL, 'warn'), ('views', 'view', 4, NULL, 'security', 'warn'), ('all-views', 'view', NULL, NULL, NULL, 'comment'), ('risky', 'purchase', NULL, 'high', NULL, 'request_changes')) t(rule, trigger, rk, risk, cat, action))
 SELECT event_id, rule, action, action = 'request_changes' AS blocks FROM f JOIN r ON event_type = trigger AND (rk IS NULL OR sr <= rk) AND (cat IS NULL OR cat = category) AND (risk IS NULL OR risk = CASE WHEN value > 50 THEN 'high' ELSE 'low' END)"""
)
def policy_matches(spark, d):
    rows = [("errors", True, "error", "critical", None, None, "request_changes"), ("clicks", True, "click", "high", None, None, "warn"), ("views", True, "view", "info", None, "security", "warn"), ("all-views", True, "view", None, None, None, "comment"), ("risky", True, "purchase", None, "high", None, "request_changes"), ("off", False, "view", None, None, None, "warn")]
    e = findings(spark, d).withColumn("trigger", F.col("event_type")).withColumn("risk", F.when(F.col("value") > 50, "high").otherwise("low"))
    return FI.policy_matches(spark.createDataFrame(rows, FI.default_policies(spark).schema), e).select("event_id", "rule", "action", "blocks")


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Every customer to its orders, order to its parts, part to its suppliers, supplier to its nation; links may repeat."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    li, o, s = (read(spark, d, t) for t in ("lineitem", "orders", "supplier"))
    e = o.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"))
    for rows, src, dst in ((li, ("o", "l_orderkey"), ("p", "l_partkey")), (li, ("p", "l_partkey"), ("s", "l_suppkey")), (s, ("s", "s_suppkey"), ("n", "s_nationkey"))):
        e = e.unionByName(rows.select(key(*src).alias("src"), key(*dst).alias("dst")))
    return e


_EDGES = """e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
 UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


@query(
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 'n' || n_nationkey AS origin, 'n' || n_nationkey AS node, ['n' || n_nationkey] AS way FROM nation UNION ALL SELECT r.origin, e.src, list_append(r.way, e.src) FROM r JOIN e ON e.dst = r.node WHERE len(r.way) < 4),
 m AS (SELECT origin, node, min({{'n': len(way), 'way': way}}) AS m FROM r GROUP BY 1, 2), k AS (SELECT origin, node, CAST(m.n - 1 AS INTEGER) AS depth, m.way[m.n - 1] AS via, CAST(row_number() OVER (PARTITION BY origin ORDER BY m) AS INTEGER) AS place FROM m WHERE m.n > 1)
 SELECT * FROM k WHERE place <= 200"""
)
def reachable_dependents(spark, d):
    """What leads to each nation within three links."""
    o = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("origin"))
    return G.reachable(_links(spark, d).distinct(), o)


@query(
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node, 0 AS hops FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT r.start, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 4)
 SELECT start, node AS target, min(hops) AS hops FROM r WHERE node IN (SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 1000) GROUP BY start, node"""
)
def attack_paths(spark, d):
    """Over all links, from a market segment's customers to all nations and to suppliers of a low balance."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("node")
    starts = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(key("c", "c_custkey"))
    targets = read(spark, d, "nation").select(key("n", "n_nationkey")).unionByName(read(spark, d, "supplier").where("s_acctbal < 1000").select(key("s", "s_suppkey")))
    return G.paths(_links(spark, d), starts, targets)


@query(f"WITH {_EDGES} SELECT dst AS node, count(DISTINCT src) AS dependents FROM e GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 10")
def hotspots(spark, d):
    return G.hotspots(_links(spark, d).distinct())


@query(
    f"""WITH x AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS direct, count(*) AS tr, count(*) FILTER (l_returnflag = 'R') AS routes, count(DISTINCT l_linestatus) AS areas, count(*) FILTER (l_quantity > 45) * 1.5 AS sp, bool_or(l_discount = 0) AS tested FROM lineitem GROUP BY 1),
 y AS (SELECT l_partkey, floor(greatest(0, least(100, {_LOG2.format(n="direct", k=10, m=30)} + {_LOG2.format(n="tr", k=4, m=15)} + least(15, routes * 5) + least(20, areas * 10) + least(15, sp) + CASE WHEN NOT tested AND direct > 0 THEN 8 ELSE 0 END)) + 0.5) AS s FROM x)
 SELECT l_partkey, CAST(s AS BIGINT) AS impact, CASE WHEN s >= 70 THEN 'critical' WHEN s >= 45 THEN 'high' WHEN s >= 20 THEN 'medium' ELSE 'low' END AS level FROM y"""
)
def impact_scores(spark, d):
    x = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("direct"), F.count(F.lit(1)).alias("transitive"), F.count_if(F.col("l_returnflag") == "R").alias("routes"), F.countDistinct("l_linestatus").alias("areas"), (F.count_if(F.col("l_quantity") > 45) * 1.5).alias("severity_points"), F.bool_or(F.col("l_discount") == 0).alias("tested"))
    return SC.impact(x).select("l_partkey", F.col("impact").cast("long").alias("impact"), "level")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pull requests."""
    c = F.count_if
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        c((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48)).alias("critical"), c((F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 10)).alias("high"), c(F.col("l_returnflag") == "A").alias("medium"), c(F.col("l_returnflag") == "N").alias("low"), F.lit(0).alias("info"),
        F.max(F.when(F.col("l_linestatus") == "O", 12).otherwise(4)).alias("area_points"), F.sum(F.col("l_quantity").cast("long")).alias("changes"), F.countDistinct("l_suppkey").alias("impacted"), c(F.col("l_discount") > 0.05).alias("uncovered"),
        F.bool_or(F.col("l_linenumber") > 6).alias("truncated"), c(F.col("l_tax") == 0).alias("resolved"),
    )


_CHANGES = """c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 48) AS cr, count(*) FILTER (l_returnflag = 'R' AND l_quantity <= 10) AS hi, count(*) FILTER (l_returnflag = 'A') AS me, count(*) FILTER (l_returnflag = 'N') AS lo,
 max(CASE WHEN l_linestatus = 'O' THEN 12 ELSE 4 END) AS area, sum(CAST(trunc(l_quantity) AS BIGINT)) AS ch, count(DISTINCT l_suppkey) AS im, count(*) FILTER (l_discount > 0.05) AS un, bool_or(l_linenumber > 6) AS tr, count(*) FILTER (l_tax = 0) AS re FROM lineitem GROUP BY 1)"""
_R1 = "(floor(({x}) * 10 + 0.5) / 10)"


@query(
    f"""WITH {_CHANGES}, z AS (SELECT *, least(15.0, greatest(0.0, log10(greatest(ch, 1) / 20.0) * 10)) AS size FROM c),
 s AS (SELECT *, greatest(0.0, least(100.0, {_R1.format(x=f"{_R1.format(x='0.0 + 30 * sqrt(cr) + 15 * sqrt(hi) + 6 * sqrt(me) + 2 * sqrt(lo)')} + area + CASE WHEN size >= 1 THEN {_R1.format(x='size')} ELSE 0 END + {_R1.format(x='least(12.0, log2(im + 1) * 4)')} + {_R1.format(x='least(14.0, un * 3.5)')} + CASE WHEN tr THEN 10 ELSE 0 END - least(10, re * 2)")})) AS risk FROM z),
 b AS (SELECT *, CASE WHEN cr > 0 THEN 0 WHEN hi > 0 THEN 1 WHEN me > 0 THEN 2 WHEN lo > 0 THEN 3 END AS worst, CASE WHEN risk >= 70 THEN 0 WHEN risk >= 45 THEN 1 WHEN risk >= 22 THEN 2 WHEN risk >= 8 THEN 3 ELSE 4 END AS bd FROM s)
 SELECT l_orderkey, CAST(risk AS DOUBLE) AS risk, ['critical', 'high', 'medium', 'low', 'info'][1 + least(coalesce(worst, bd), bd)] AS level, coalesce(worst <= 1, false) AS should_block FROM b"""
)
def pull_request_risk(spark, d):
    return SC.pull_request_risk(_changes(spark, d).withColumn("fail_on", F.lit("high"))).select("l_orderkey", "risk", "level", "should_block")


@query(
    FINDINGS
    + f""", g AS (SELECT repo, count(*) FILTER (sr = 0) % 5 AS cr, count(*) FILTER (sr = 1) % 4 AS hi, count(*) FILTER (sr = 2) % 7 AS me, count(*) FILTER (sr = 3) % 9 AS lo, count(*) FILTER (line = 7) AS se, count(*) AS files, count(*) FILTER (value > 30) AS un,
 count(DISTINCT rule_id) % 3 AS vu, count(DISTINCT path) AS ri, count(DISTINCT category) AS sen, count(*) FILTER (line = 3) % 3 AS reg, 60 + count(*) % 40 AS health FROM f GROUP BY repo),
 s AS (SELECT repo, greatest(0.0, least(100.0, {_R1.format(x=" + ".join([_R1.format(x="least(40.0, cr * 10 + hi * 5 + me * 2 + lo * 0.5)"), _R1.format(x="least(20.0, se * 8)"), _R1.format(x="least(15.0, un / files * 15)"), _R1.format(x="least(15.0, vu * 4)"), _R1.format(x="least(12.0, ri * 3)"), _R1.format(x="least(10.0, sen * 2)"), "least(12.0, reg * 6)", "CASE WHEN health < 90 THEN " + _R1.format(x="least(15.0, (100 - health) / 100.0 * 15)") + " ELSE 0 END"]))})) AS x FROM g)
 SELECT repo, CAST(x AS DOUBLE) AS risk, CASE WHEN x >= 70 THEN 'critical' WHEN x >= 45 THEN 'high' WHEN x >= 22 THEN 'medium' WHEN x >= 8 THEN 'low' ELSE 'info' END AS level FROM s"""
)
def repository_risk(spark, d):
    c, rank = F.count_if, S.severity_rank("severity")
    g = findings(spark, d).groupBy("repo").agg(
        (c(rank == 0) % 5).alias("critical"), (c(rank == 1) % 4).alias("high"), (c(rank == 2) % 7).alias("medium"), (c(rank == 3) % 9).alias("low"), c(F.col("line") == 7).alias("secrets"), F.count(F.lit(1)).alias("files"), c(F.col("value") > 30).alias("untested"),
        (F.countDistinct("rule_id") % 3).alias("vulnerable"), F.countDistinct("path").alias("risky"), F.countDistinct("category").alias("sensitive"), (c(F.col("line") == 3) % 3).alias("regressions"), (60 + F.count(F.lit(1)) % 40).alias("health"),
    )
    return SC.repository_risk(g).select("repo", "risk", "level")


@query(
    f"""WITH {_CHANGES}, p AS (SELECT l_orderkey, 25.0 * cr + 12 * hi + 5 * me + 2 * lo AS sp, ch, im AS paths, area, least(ch, 120) AS blast, un AS tested, CASE WHEN re > 0 THEN 0.1 END AS cov, lo AS hist, re AS fails FROM c),
 s AS (SELECT l_orderkey, {" + ".join([_R1.format(x="least(40.0, sp)"), _R1.format(x="CASE WHEN ch > 0 THEN least(15.0, log10(ch + 1) * 6) ELSE 0 END"), _R1.format(x="least(12.0, log2(paths + 1) * 3)"), _R1.format(x="least(20.0, area)"), _R1.format(x="greatest(0.0, least(100.0, blast)) / 100 * 15"), _R1.format(x="least(12.0, greatest(0, paths - tested) / paths * 12)"), "CASE WHEN cov < 0.3 THEN 4 ELSE 0 END", _R1.format(x="CASE WHEN hist > 0 THEN least(8.0, log2(hist + 1) * 2) ELSE 0 END"), _R1.format(x="least(10.0, fails * 3)")])} AS x FROM p),
 r AS (SELECT l_orderkey, CAST(floor(least(100.0, round(x, 6)) + 0.5) AS BIGINT) AS risk FROM s)
 SELECT l_orderkey, risk, CASE WHEN risk >= 65 THEN 'critical' WHEN risk >= 40 THEN 'high' WHEN risk >= 18 THEN 'medium' ELSE 'low' END AS level FROM r"""
)
def regression_risk(spark, d):
    c = _changes(spark, d)
    points = sum((F.col(s) * w for s, w in S.SEVERITY_WEIGHTS.items()), F.lit(0.0))
    x = c.select("l_orderkey", points.alias("severity_points"), F.col("changes").alias("churn"), F.col("impacted").alias("paths"), "area_points", F.least(F.col("changes"), F.lit(120)).cast("double").alias("blast"), F.col("uncovered").alias("tested"), F.when(F.col("resolved") > 0, 0.1).alias("coverage"), F.col("low").alias("history"), F.col("resolved").alias("failures"))
    return SC.regression_risk(x).select("l_orderkey", F.col("risk").cast("long").alias("risk"), "level")


@query(
    FINDINGS
    + f""", g AS (SELECT repo, sum(CASE severity WHEN 'critical' THEN 400 WHEN 'high' THEN 200 WHEN 'medium' THEN 100 WHEN 'low' THEN 50 ELSE 15 END) / 100 AS h, count(*) FILTER (value >= 40) AS cx, count(*) FILTER (value < 2) AS un, count(*) FILTER (line = 5) AS vu FROM f GROUP BY repo)
 SELECT repo, CAST({_R1.format(x=" + ".join([_R1.format(x="h"), _R1.format(x="cx * 1.5"), _R1.format(x="un * 0.75"), _R1.format(x="vu * 1.5")]))} AS DOUBLE) AS hours FROM g"""
)
def technical_debt(spark, d):
    hours = F.sum(S.lookup("severity", {k: int(100 * v) for k, v in S.DEBT_HOURS.items()})) / 100
    g = findings(spark, d).groupBy("repo").agg(hours.alias("h"), F.count_if(F.col("value") >= 40).alias("cx"), F.count_if(F.col("value") < 2).alias("un"), F.count_if(F.col("line") == 5).alias("vu"))
    return g.select("repo", SC.debt({"findings": F.col("h"), "complexity": F.col("cx") * 1.5, "test-gaps": F.col("un") * 0.75, "vulnerable": F.col("vu") * 1.5}).alias("hours"))


@query(
    """SELECT event_type, count(*) AS requests, count(*) FILTER (value < 5) AS failed, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, CAST(floor(median(value) + 0.5) AS BIGINT) AS median_value FROM events GROUP BY event_type"""
)
def ai_usage(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("value") < 5).alias("failed"), F.sum(k).alias("tokens"), S.median_rounded("value").alias("median_value"))


@query("SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS loc FROM documents GROUP BY lang ORDER BY loc DESC, lang LIMIT 6")
def top_languages(spark, d):
    return RD.largest(read(spark, d, "documents"), "lang", "n_chars", 6)


@query(
    """SELECT p_partkey, s AS score FROM (SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#1' THEN 100 WHEN starts_with(lower(p_brand), 'brand#1') THEN 80 WHEN contains(lower(p_brand), 'brand#1') THEN 60 WHEN contains(lower(p_type), 'brand#1') THEN 30 ELSE 0 END AS s FROM part) WHERE s > 0"""
)
def search_scores(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", S.search_score(F.col("p_brand"), F.col("p_type"), "Brand#1").alias("score")).where("score > 0")


@query(
    f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_/.\\-\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 3 AND NOT list_contains([{", ".join(repr(x) for x in S.STOPWORDS)}], x)) AS l FROM conversations),
 e AS (SELECT conv_id, turn, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM w), k AS (SELECT conv_id, turn, x, min(i) AS i FROM e GROUP BY 1, 2, 3)
 SELECT conv_id, turn, string_agg(x, ' ' ORDER BY i) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM k) WHERE k <= 12 GROUP BY 1, 2"""
)
def keywords(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.array_join(S.keywords(F.col("text")), " ").alias("keywords"))
    return c.where("keywords <> ''")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), n AS (SELECT doc_id, trim(regexp_replace(t, '[ \\t\\x0B\\f\\r]+', ' ', 'g')) AS s FROM l)
 SELECT left(sha256('line/repeat' || chr(0) || '' || chr(0) || s), 32) AS fingerprint, count(*) AS n, count(DISTINCT doc_id) AS docs FROM n WHERE s <> '' GROUP BY s HAVING count(*) > 1"""
)
def repeated_lines(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t")).select("doc_id", S.normalize_snippet(F.col("t")).alias("s")).where("s <> ''")
    # a row a line and document before the groups meet, so a very common line stays small
    g = lines.groupBy("s", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs")).where("n > 1")
    return g.select(S.fingerprint(F.lit("line/repeat"), F.lit(None).cast("string"), F.col("s")).alias("fingerprint"), "n", "docs")


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('•', 8) ELSE left(c_name, 4) || repeat('•', greatest(4, least(12, length(c_name) - 8))::INTEGER) || right(c_name, 4) END AS masked FROM customer")
def masked_secrets(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.mask_secret(F.col("c_name")).alias("masked"))


@query(FINDINGS + "SELECT count(*) AS events, count(DISTINCT CASE WHEN line % 2 = 0 THEN repo || '/' || line END) + count(*) FILTER (line % 2 = 1) AS kept FROM f")
def deduped_events(spark, d):
    from repolith.streaming.events import deduped_events as dedupe

    f = findings(spark, d).withColumn("dedupe_key", F.when(F.col("line") % 2 == 0, F.col("line")))
    return dedupe(f).agg(F.count(F.lit(1)).alias("kept")).crossJoin(f.agg(F.count(F.lit(1)).alias("events"))).select("events", "kept")


@query(
    FINDINGS
    + """, t AS (SELECT event_id, severity, sr, ['src/login/a.py', 'src/m.py', 'docker/x'][1 + event_id % 3] AS path, ['security/sql-injection', 'quality/x', 'cicd/y', 'bugs/z'][1 + event_id % 4] AS rule_id,
 ['secrets', 'dependencies', 'testing', 'quality', 'infrastructure'][1 + user_id % 5] AS category, 'Finding of ' || event_type AS title FROM f),
 a AS (SELECT *, CASE WHEN path LIKE '%login%' THEN 'auth' WHEN category = 'secrets' THEN 'secrets' WHEN rule_id LIKE '%inject%' THEN 'injection' WHEN category = 'dependencies' THEN 'dependencies' WHEN category = 'testing' THEN 'tests'
 WHEN category = 'infrastructure' OR rule_id LIKE 'cicd%' THEN 'infra' ELSE 'solo:' || event_id END AS area FROM t), g AS (SELECT area, min(sr) AS r, count(*) AS n, min(title) AS title FROM a GROUP BY area)
 SELECT area, CASE area WHEN 'auth' THEN 'Authentication and authorization' WHEN 'secrets' THEN 'Committed credentials' WHEN 'injection' THEN 'Injection and unsafe execution' WHEN 'dependencies' THEN 'Dependency risk' WHEN 'tests' THEN 'Testing gaps'
 WHEN 'infra' THEN 'Infrastructure and CI' ELSE title END AS title, ['critical', 'high', 'medium', 'low', 'info'][1 + r] AS severity, n FROM g"""
)
def triage_groups(spark, d):
    pick = lambda c, *x: F.get(F.array(*[F.lit(v) for v in x]), (c % len(x)).cast("int"))
    f = findings(spark, d).select("event_id", "severity", pick(F.col("event_id"), "src/login/a.py", "src/m.py", "docker/x").alias("path"), pick(F.col("event_id"), "security/sql-injection", "quality/x", "cicd/y", "bugs/z").alias("rule_id"), pick(F.col("user_id"), "secrets", "dependencies", "testing", "quality", "infrastructure").alias("category"), F.concat(F.lit("Finding of "), "event_type").alias("title"))
    return FI.triage(f, "event_id")


@query(
    """WITH u AS (SELECT user_id, bool_or(ts >= TIMESTAMP '2024-01-25') AS now, bool_or(ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-25') AS before, min(ts) FILTER (ts < TIMESTAMP '2024-01-15') AS first, max(ts) FILTER (event_type = 'signup' AND ts < TIMESTAMP '2024-01-20') AS resolved FROM events GROUP BY 1)
 SELECT user_id, CASE WHEN now AND resolved IS NOT NULL THEN 'regressed' WHEN now AND before THEN 'known' WHEN now AND first IS NOT NULL THEN 'reopened' WHEN now THEN 'new' ELSE 'resolved' END AS state FROM u"""
)
def lifecycle(spark, d):
    ts = F.col("ts")
    u = read(spark, d, "events").groupBy("user_id").agg(F.bool_or(ts >= "2024-01-25").alias("now"), F.bool_or((ts >= "2024-01-15") & (ts < "2024-01-25")).alias("before"), F.min(F.when(ts < "2024-01-15", ts)).alias("first"), F.max(F.when((F.col("event_type") == "signup") & (ts < "2024-01-20"), ts)).alias("resolved"))
    return u.select("user_id", S.lifecycle(F.col("now"), F.col("before"), F.col("first"), F.col("resolved")).alias("state"))


@query(FINDINGS + "SELECT repo, count(*) FILTER (ts > TIMESTAMP '2024-01-24') AS week, count(*) FILTER (ts > TIMESTAMP '2024-01-01 12:00:00') AS month FROM f WHERE ts <= TIMESTAMP '2024-01-31' GROUP BY repo")
def rolling_counts(spark, d):
    return RD.since(findings(spark, d), "repo", "ts", AS_OF, week="2024-01-24", month="2024-01-01 12:00:00")


@query("SELECT o_orderkey, o_orderpriority, coalesce(n, 0) AS findings FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 100")
def ranked_changes(spark, d):
    li = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    o = RD.first_rows(read(spark, d, "orders"), 100, F.desc_nulls_first("o_totalprice"), "o_orderkey")
    return RD.with_counts(o, li, "o_orderkey", "findings").select("o_orderkey", "o_orderpriority", "findings")


@query("SELECT CAST(CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS VARCHAR)[1:13] AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_windows(spark, d):
    from repolith.streaming.events import windowed

    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(e).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def repository_installations(spark, d):
    return RD.with_parent(read(spark, d, "nation"), read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_name", "r_name")


@query(
    """WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS depth, count(*) FILTER (event_type = 'error') AS direct, count(DISTINCT event_type) AS total, count(*) AS cases, bool_or(event_type = 'error') AS asserts FROM events GROUP BY 1),
 r AS (SELECT *, floor(CASE depth WHEN 0 THEN 55 WHEN 1 THEN 35 WHEN 2 THEN 20 ELSE 10 END + least(20, log2(direct + 1) * 10) + least(10, log2(total + 1) * 4) + least(10, log2(cases + 1) * 3) + 0.5) AS x FROM s)
 SELECT user_id, CAST(CASE WHEN depth > 3 THEN 0 WHEN asserts THEN least(100, x) ELSE least(25, x) END AS BIGINT) AS relevance FROM r"""
)
def relevant_tests(spark, d):
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    s = read(spark, d, "events").groupBy("user_id").agg(of("signup").alias("depth"), of("error").alias("direct"), F.countDistinct("event_type").alias("total"), F.count(F.lit(1)).alias("cases"), F.bool_or(F.col("event_type") == "error").alias("asserts"))
    return SC.test_relevance(s).select("user_id", F.col("relevance").cast("long").alias("relevance"))


@query(
    """WITH c AS (SELECT p_partkey, p_size > 40 AS sens, p_size % 7 = 0 AS route, p_size % 5 = 0 AS db, coalesce(n, 0) AS dep, p_size % 10 AS cx FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) % 5 AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
 p AS (SELECT p_partkey, CASE WHEN cx >= 6 THEN 2 WHEN cx >= 3 THEN 1 ELSE 0 END + CASE WHEN dep >= 3 THEN 2 WHEN dep >= 1 THEN 1 ELSE 0 END + CASE WHEN route THEN 2 ELSE 0 END + CASE WHEN db THEN 1 ELSE 0 END + CASE WHEN sens THEN 2 ELSE 0 END AS x FROM c)
 SELECT p_partkey, CASE WHEN x >= 4 THEN 'high' WHEN x >= 2 THEN 'medium' ELSE 'low' END AS severity FROM p"""
)
def gap_severities(spark, d):
    n = read(spark, d, "lineitem").groupBy("l_partkey").agg((F.countDistinct("l_suppkey") % 5).alias("dependents"))
    p = read(spark, d, "part").join(n, F.col("l_partkey") == F.col("p_partkey"), "left").fillna(0, ["dependents"])
    size = F.col("p_size")
    return SC.gap_severity(p.withColumns({"sensitive": size > 40, "complexity": size % 10, "route": size % 7 == 0, "database": size % 5 == 0})).select("p_partkey", "severity")
