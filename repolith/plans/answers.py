"""Registered queries of what questions are answered from, of usage, debt and tests to write, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.operators import findings as FI
from repolith.operators import intelligence as I
from repolith.operators import retrieval as R
from repolith.operators import scoring as SC
from repolith.plans.code import CODE, code
from repolith.plans.queries import FINDINGS, findings, query, read

# orders of a customer are its scans, their lines files and dependencies, customers repositories
_CONTEXT = """WITH last AS (SELECT o_custkey AS repo, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS scan FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
 f AS (SELECT repo, l_linenumber, CASE l_partkey % 9 WHEN 0 THEN '' ELSE 'lang' || (l_partkey % 9) END AS language, CAST(l_quantity AS BIGINT) AS loc, l_suppkey, l_returnflag FROM last JOIN lineitem ON l_orderkey = scan)"""
NAMES = ("react", "Next", "lodash", "Django", "pytest", "drizzle-orm", "drizzle_orm", "left-pad", "Koa", "@nestjs/core")


@query(
    f"""{_CONTEXT}, l AS (SELECT repo, language, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, language) AS k FROM f WHERE language <> '' GROUP BY repo, language QUALIFY k <= 6), ll AS (SELECT repo, string_agg(language, ',' ORDER BY k) AS languages FROM l GROUP BY 1),
 h AS (SELECT o_custkey AS repo, arg_max(CAST(floor(o_totalprice) AS BIGINT), (o_orderdate, CAST(floor(o_totalprice) AS BIGINT))) AS health FROM orders GROUP BY 1), n AS (SELECT DISTINCT repo, {list(NAMES)}[1 + l_suppkey % 10] AS name FROM f WHERE l_returnflag <> 'R'),
 w AS (SELECT repo, string_agg(DISTINCT hint, ',' ORDER BY hint) AS frameworks FROM n JOIN (VALUES ('react', 'React'), ('next', 'Next.js'), ('django', 'Django'), ('pytest', 'Pytest'), ('drizzle-orm', 'Drizzle ORM'), ('drizzle_orm', 'Drizzle ORM'), ('koa', 'Koa'), ('@nestjs/core', 'NestJS')) t(package, hint) ON lower(name) = package GROUP BY 1),
 s AS (SELECT repo, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM f GROUP BY 1)
 SELECT c_custkey AS repo, scan, coalesce(files, 0) AS files, coalesce(loc, 0) AS loc, health, coalesce(languages, '') AS languages, coalesce(frameworks, '') AS frameworks FROM customer LEFT JOIN last ON last.repo = c_custkey LEFT JOIN s ON s.repo = c_custkey LEFT JOIN h ON h.repo = c_custkey LEFT JOIN ll ON ll.repo = c_custkey LEFT JOIN w ON w.repo = c_custkey"""
)
def repository_contexts(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    scans = o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("scan"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.col("o_orderdate").alias("created"))
    kind = F.col("l_partkey") % 9
    f = li.select(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("path"), F.when(kind == 0, "").otherwise(F.concat(F.lit("lang"), kind)).alias("language"), F.col("l_quantity").cast("long").alias("loc"))
    health = o.select(F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("created"), F.floor("o_totalprice").alias("health"))
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("l_suppkey") % 10).cast("int"))
    deps = li.select(F.col("l_orderkey").alias("scan"), name.alias("name"), (F.col("l_returnflag") != "R").alias("is_direct"))
    r = R.repository_context(read(spark, d, "customer").select(F.col("c_custkey").alias("repo")), scans, f, health, deps)
    return r.select("repo", "scan", "files", "loc", "health", F.array_join("languages", ",").alias("languages"), F.array_join("frameworks", ",").alias("frameworks"))


_WORDS = f"""q AS (SELECT conv_id * 1000 + turn AS question, conv_id, turn, text FROM conversations WHERE role = 'user'), w AS (SELECT question, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_/.\\-\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 3 AND NOT list_contains([{", ".join(repr(x) for x in S.STOPWORDS)}], x)) AS l FROM q),
 e AS (SELECT question, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM w), k AS (SELECT question, x AS word, row_number() OVER (PARTITION BY question ORDER BY min(i)) AS k FROM e GROUP BY question, x QUALIFY k <= 12)"""


@query(
    f"""WITH {_WORDS}, f AS (SELECT conv_id * 1000 + turn AS id, left(coalesce(text, ''), 60) AS title, role || '/r' || (turn % 3) AS rule_id, ['critical', 'high', 'medium', 'low', 'info'][1 + (conv_id + turn) % 5] AS severity, 'c' || (conv_id % 40) AS path FROM conversations WHERE role <> 'user' AND turn % 7 <> 6),
 a AS (SELECT DISTINCT question, id FROM k JOIN f ON contains(lower(title), word) OR contains(lower(rule_id), word) UNION SELECT question, id FROM q JOIN f ON q.conv_id % 3 = 0 AND f.path = 'c' || (q.conv_id % 40)
 UNION SELECT question, id FROM q, f WHERE q.conv_id % 3 <> 0 AND question NOT IN (SELECT question FROM k)),
 r AS (SELECT question, id, CAST(row_number() OVER (PARTITION BY question ORDER BY list_position(['critical', 'high', 'medium', 'low', 'info'], severity), path, id) AS INTEGER) AS place FROM a JOIN f USING (id) QUALIFY place <= 12) SELECT * FROM r"""
)
def relevant_findings(spark, d):
    """Users' turns as questions, a third of them with a file, to the other turns as findings."""
    c = read(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")).withColumn("path", F.concat(F.lit("c"), F.col("conv_id") % 40))
    q = c.where("role = 'user'")
    severity = F.get(F.array(*[F.lit(x) for x in S.SEVERITIES]), ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    status = F.when(F.col("turn") % 7 == 6, "resolved").when(F.col("turn") % 2 == 0, "proposed").otherwise("open")
    f = c.where("role <> 'user'").select("id", F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("title"), F.concat("role", F.lit("/r"), F.col("turn") % 3).alias("rule_id"), severity.alias("severity"), "path", status.alias("status"))
    return R.relevant_findings(q.select(F.col("id").alias("question"), "text"), q.where("conv_id % 3 = 0").select(F.col("id").alias("question"), "path"), f)


@query(
    f"""{CODE}, r AS (SELECT id // 7 AS question, path, content, (id * 13) % 5 AS score FROM code WHERE content <> ''), p AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, path) AS place FROM r QUALIFY place <= 4),
 b AS (SELECT *, left(content, 120) AS one FROM p), c AS (SELECT *, 300 - coalesce(sum(length(one)) OVER (PARTITION BY question ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b)
 SELECT question, path, CAST(place AS INTEGER) AS place, left(one, CAST(room AS BIGINT)) AS body, length(left(one, CAST(room AS BIGINT))) < length(content) AS truncated FROM c WHERE room > 0"""
)
def packed_sources(spark, d):
    """Seven files compete for each question's room of 300 characters."""
    c = code(spark, d)
    ranked = c.select(F.floor(F.col("id") / 7).alias("question"), "path", (F.col("id") * 13 % 5).alias("score"))
    return R.packed_sources(ranked, c.select("path", "content"), chars=120, budget=300)


@query(
    """WITH c AS (SELECT o_custkey AS repo, o_orderkey AS sha, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders QUALIFY k <= 6), t AS (SELECT DISTINCT repo, sha, k, l_suppkey % 6 AS path FROM c JOIN lineitem ON l_orderkey = sha),
 f AS (SELECT DISTINCT o_custkey AS repo, p AS path FROM orders, (SELECT unnest(range(7)) AS p)), h AS (SELECT repo, path, sha, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY k) AS INTEGER) AS place FROM t JOIN f USING (repo, path) QUALIFY place <= 3)
 SELECT repo, path, sha, place, true AS touches FROM h UNION ALL SELECT repo, path, sha, CAST(k AS INTEGER), false FROM f JOIN c USING (repo) WHERE k <= 3 AND (repo, path) NOT IN (SELECT (repo, path) FROM h)"""
)
def file_commits(spark, d):
    """Customers as repositories, their orders as commits of the lines' suppliers as files."""
    paths = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey") % 6).alias("paths"))
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("authored"))
    commits = o.join(paths, F.col("sha") == F.col("l_orderkey"), "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<bigint>")))
    f = o.select("repo").distinct().select("repo", F.explode(F.sequence(F.lit(0), F.lit(6)).cast("array<bigint>")).alias("path"))
    return R.file_commits(commits, f, 3, 6).select("repo", "path", "sha", "place", "touches")


_USAGE = """WITH r AS (SELECT user_id % 20 AS repo, CASE WHEN value < 5 THEN 'failed' WHEN event_type = 'signup' THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN value >= 5 THEN 'p' || (user_id % 3) END AS provider, CASE WHEN event_id % 10 > 0 THEN value * 100 END AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, list_transform(range(event_id % 4 - 1), lambda i: 'p' || ((event_id + i) % 3)) AS attempts FROM events)"""


@query(
    f"""{_USAGE} SELECT repo, count(*) AS requests, count(*) FILTER (status = 'ok') AS successful, count(*) FILTER (status = 'failed') AS failed, CAST(floor(median(ms) + 0.5) AS BIGINT) AS median_ms, CAST(coalesce(sum(k), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(k * 2), 0) AS BIGINT) AS completion_tokens, count(*) FILTER (status = 'ok' AND len(attempts) > 0) AS fallbacks FROM r GROUP BY repo"""
)
def usage_totals(spark, d):
    return R.usage_totals(_requests(spark, d), "repo")


def _requests(spark, d):
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    attempt = lambda j: F.struct(F.concat(F.lit("p"), (i + j) % 3).alias("provider"))
    tried = F.slice(F.array(attempt(0), attempt(1)), F.lit(1), F.greatest(i % 4 - 1, F.lit(0)).cast("int"))
    status = F.when(F.col("value") < 5, "failed").when(F.col("event_type") == "signup", "skipped").otherwise("ok")
    return read(spark, d, "events").select((F.col("user_id") % 20).alias("repo"), status.alias("status"), F.when(F.col("value") >= 5, F.concat(F.lit("p"), F.col("user_id") % 3)).alias("provider"), F.when(i % 10 > 0, F.col("value") * 100).alias("duration_ms"), k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"), tried.alias("attempts"))


@query(
    f"""{_USAGE}, u AS (SELECT repo, provider, 1 AS n, 0 AS f FROM r WHERE provider IS NOT NULL UNION ALL SELECT repo, unnest(attempts), 0, 1 FROM r) SELECT repo, provider, CAST(sum(n) AS BIGINT) AS count, CAST(sum(f) AS BIGINT) AS failures FROM u GROUP BY repo, provider"""
)
def provider_usage(spark, d):
    return R.usage_by_provider(_requests(spark, d), "repo")


@query(
    FINDINGS
    + """, w AS (SELECT repo, list(CASE severity WHEN 'critical' THEN 400 WHEN 'high' THEN 200 WHEN 'medium' THEN 100 WHEN 'low' THEN 50 ELSE 15 END) AS h FROM f GROUP BY 1),
 p AS (SELECT 'repo' || (p_partkey % 20) AS repo, p_partkey AS path, ['test', 'config', 'source', 'route'][1 + p_partkey % 4] AS kind, p_size AS loc, p_size % 37 AS cx FROM part), t AS (SELECT repo, path FROM p WHERE path % 5 = 0), cov AS (SELECT repo, path + 20 AS path FROM t),
 d AS (SELECT 'repo' || (l_suppkey % 20) AS repo, (l_linenumber % 4) || '.2.0' AS version, CASE WHEN l_partkey % 3 > 0 THEN (l_partkey % 5) || '.0' END AS latest, l_partkey % 7 - 5 AS vul FROM lineitem WHERE l_quantity < 3),
 c AS (SELECT repo, 'findings' AS id, list_sum(h) / 100 AS hours, len(h) AS count FROM w UNION ALL SELECT repo, 'complexity', count(*) * 1.5, count(*) FROM p WHERE cx >= 25 GROUP BY 1
 UNION ALL SELECT repo, 'test-gaps', count(*) * 0.75, count(*) FROM p WHERE kind NOT IN ('test', 'config') AND loc >= 20 AND (repo, path) NOT IN (SELECT (repo, path) FROM t) AND (repo, path) NOT IN (SELECT (repo, path) FROM cov) GROUP BY 1
 UNION ALL SELECT repo, 'vulnerable-deps', count(*) * 1.5, count(*) FROM d WHERE vul > 0 GROUP BY 1 UNION ALL SELECT repo, 'stale-deps', count(*) * 0.5, count(*) FROM d WHERE CAST(latest[1] AS INTEGER) > CAST(version[1] AS INTEGER) GROUP BY 1),
 r AS (SELECT repo, id, CAST(floor(hours * 10 + 0.5) / 10 AS DOUBLE) AS hours, count FROM c) SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY hours DESC, id) AS INTEGER) AS place FROM r"""
)
def debt_contributors(spark, d):
    k = F.col("p_partkey")
    repo = lambda c: F.concat(F.lit("repo"), c % 20).alias("repo")
    kind = F.get(F.array(*[F.lit(x) for x in ("test", "config", "source", "route")]), (k % 4).cast("int"))
    p = read(spark, d, "part").select(repo(k), k.alias("path"), kind.alias("kind"), F.col("p_size").alias("loc"), (F.col("p_size") % 37).alias("complexity"))
    tests = p.where("path % 5 = 0").select("repo", "path", F.array(F.col("path") + 20, F.col("path") + 20).alias("covers"))
    n = F.col("l_partkey")
    deps = read(spark, d, "lineitem").where("l_quantity < 3").select(repo(F.col("l_suppkey")), F.concat(F.col("l_linenumber") % 4, F.lit(".2.0")).alias("version"), F.when(n % 3 > 0, F.concat(n % 5, F.lit(".0"))).alias("latest"), (n % 7 - 5).alias("vulnerabilities"))
    return SC.debt_contributors(findings(spark, d).select("repo", "severity"), p, tests, deps)


@query(
    FINDINGS
    + """, s AS (SELECT rule_id || (user_id % 2) AS fp, ['alpha', 'beta', 'gamma', 'delta'][1 + event_id % 4] AS scanner, least(4, sr + CAST(floor(value) AS INTEGER) % 3) AS sr2, event_id FROM f), i AS (SELECT fp, list({'s': scanner, 'r': sr2} ORDER BY event_id) AS l FROM s WHERE event_id % 9 = 0 OR sr2 = 4 GROUP BY fp),
 m AS (SELECT fp, l, list_position(list_transform(l, lambda x: x.r), list_min(list_transform(l, lambda x: x.r))) AS w FROM i), b AS (SELECT fp, l, w, l[1:w - 1] AS before FROM m),
 c AS (SELECT fp, list_concat(list_transform(l[w + 1:], lambda x: x.s), CASE WHEN w > 1 THEN [before[list_position(list_transform(before, lambda x: x.r), list_min(list_transform(before, lambda x: x.r)))].s] ELSE [] END) AS others FROM b)
 SELECT fp AS fingerprint, array_to_string(list_sort(list_distinct(others)), ',') AS corroborated_by FROM c"""
)
def corroborations(spark, d):
    """Four scanners find the same rules, some as worse than others."""
    f = findings(spark, d).withColumn("_r", F.least(F.lit(4), S.severity_rank("severity") + F.floor("value").cast("int") % 3))
    f = f.where("event_id % 9 = 0 or _r = 4").withColumn("scanner", F.get(F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma", "delta")]), (F.col("event_id") % 4).cast("int")))
    f = f.select(F.concat("rule_id", F.col("user_id") % 2).alias("fingerprint"), S.severity_at(F.col("_r")).alias("severity"), "scanner", "event_id")
    return FI.corroborated(f, "event_id").select("fingerprint", F.array_join("corroborated_by", ",").alias("corroborated_by"))


@query(
    """WITH s AS (SELECT p_partkey, p_name AS name, ['function', 'class'][1 + p_partkey % 2] AS kind, 'src/' || p_partkey || '.ts' AS path, p_size % 10 AS cx, p_partkey % 4 AS dep, p_size % 7 = 0 AS route, p_size % 5 = 0 AS db, p_size > 40 AS sens, p_partkey % 3 = 0 AS asy, ['a', 'b'][1:p_partkey % 3] AS ps FROM part)
 SELECT p_partkey, array_to_string(list_filter(['Exported ' || kind || ' with no test file importing ' || path, CASE WHEN cx >= 3 THEN cx || ' decision points' END, CASE WHEN dep > 0 THEN dep || ' dependent file' || CASE WHEN dep = 1 THEN '' ELSE 's' END END, CASE WHEN route THEN 'reachable from an HTTP route' END, CASE WHEN db THEN 'touches the database' END], lambda x: x IS NOT NULL), ' · ') || '.' AS reason,
 array_to_string(list_filter(['high:' || name || ' returns the expected result for a typical input', CASE WHEN len(ps) > 0 THEN 'high:' || name || ' handles missing or invalid ' || CASE WHEN len(ps) = 1 THEN '`' || ps[1] || '`' ELSE 'arguments' END END, CASE WHEN cx >= 3 THEN CASE WHEN cx >= 6 THEN 'high' ELSE 'medium' END || ':Each branch of ' || name || ' is exercised' END,
 CASE WHEN asy THEN 'medium:' || name || ' propagates or handles a rejected promise' END, CASE WHEN db THEN 'medium:' || name || ' behaves correctly when the database returns no rows' END, CASE WHEN route THEN 'high:The endpoint rejects unauthenticated or malformed requests' END, CASE WHEN sens THEN 'high:' || name || ' denies access when the caller is not permitted' END], lambda x: x IS NOT NULL), '|') AS scenarios FROM s"""
)
def gap_scenarios(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    p = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(k % 2 == 0, "function").otherwise("class").alias("kind"), F.concat(F.lit("src/"), k, F.lit(".ts")).alias("path"), (size % 10).alias("complexity"), (k % 4).alias("dependents"), (size % 7 == 0).alias("route"), (size % 5 == 0).alias("database"), (size > 40).alias("sensitive"), (k % 3 == 0).alias("is_async"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (k % 3).cast("int")).alias("parameters"))
    return p.select("p_partkey", SC.gap_reason().alias("reason"), F.array_join(F.transform(SC.gap_scenarios(), lambda x: F.concat(x["priority"], F.lit(":"), x["description"])), "|").alias("scenarios"))


@query(
    """WITH s AS (SELECT user_id % 10 AS change, user_id AS test, count(*) FILTER (event_type = 'signup') % 5 AS depth, count(*) FILTER (event_type = 'error') AS direct, count(DISTINCT event_type) AS total, count(*) AS cases, bool_or(event_type = 'error') AS asserts FROM events GROUP BY 2, 1),
 r AS (SELECT *, floor(CASE depth WHEN 0 THEN 55 WHEN 1 THEN 35 WHEN 2 THEN 20 ELSE 10 END + least(20, log2(direct + 1) * 10) + least(10, log2(total + 1) * 4) + least(10, log2(cases + 1) * 3) + 0.5) AS x FROM s), v AS (SELECT change, test, CAST(CASE WHEN depth > 3 THEN 0 WHEN asserts THEN least(100, x) ELSE least(25, x) END AS BIGINT) AS relevance FROM r)
 SELECT change, test, relevance, CAST(row_number() OVER (PARTITION BY change ORDER BY relevance DESC, test) AS INTEGER) AS place FROM v QUALIFY place <= 20"""
)
def prioritized_tests(spark, d):
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    s = read(spark, d, "events").groupBy((F.col("user_id") % 10).alias("change"), F.col("user_id").alias("test")).agg((of("signup") % 5).alias("depth"), of("error").alias("direct"), F.countDistinct("event_type").alias("total"), F.count(F.lit(1)).alias("cases"), F.bool_or(F.col("event_type") == "error").alias("asserts"))
    return SC.prioritized_tests(s, "change", "test").select("change", "test", F.col("relevance").cast("long").alias("relevance"), "place")


def _r1(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5) / 10"


@query(
    FINDINGS
    + f""", day AS (SELECT repo, CAST(ts AS DATE) AS created, 50 + count(*) % 50 AS health, count(*) FILTER (sr = 0) AS cr, count(*) FILTER (sr = 1) AS hi, count(*) FILTER (sr = 2) AS me, count(*) FILTER (sr = 3) AS lo FROM f GROUP BY 1, 2), snap AS (SELECT * FROM day QUALIFY row_number() OVER (PARTITION BY repo ORDER BY created DESC) = 1),
 sec AS (SELECT repo, count(*) AS se FROM f WHERE user_id % 50 = 1 AND line = 7 GROUP BY 1), p AS (SELECT 'repo' || (p_partkey % 23) AS repo, count(*) AS n, count(*) FILTER (p_partkey % 4 <> 0) AS un FROM part GROUP BY 1), dep AS (SELECT 'repo' || (l_suppkey % 20) AS repo, count(*) AS vu FROM lineitem WHERE l_quantity = 1 AND l_partkey % 40 = 3 GROUP BY 1),
 com AS (SELECT 'repo' || (s_suppkey % 20) AS repo, count(*) FILTER (s_acctbal > 6000) AS ri, count(*) FILTER (s_suppkey % 3 = 0) AS sen FROM supplier GROUP BY 1), reg AS (SELECT 'repo' || (c_custkey % 20) AS repo, count(*) AS re FROM customer WHERE c_acctbal < -950 GROUP BY 1),
 i AS (SELECT repo, health, coalesce(cr, 0) AS cr, coalesce(hi, 0) AS hi, coalesce(me, 0) AS me, coalesce(lo, 0) AS lo, coalesce(se, 0) AS se, coalesce(n, 0) AS n, coalesce(un, 0) AS un, coalesce(vu, 0) AS vu, coalesce(ri, 0) AS ri, coalesce(sen, 0) AS sen, coalesce(re, 0) AS re FROM (SELECT DISTINCT repo FROM p) LEFT JOIN snap USING (repo) LEFT JOIN sec USING (repo) LEFT JOIN p USING (repo) LEFT JOIN dep USING (repo) LEFT JOIN com USING (repo) LEFT JOIN reg USING (repo)),
 r AS (SELECT *, CAST(greatest(0, least(100, {_r1(" + ".join([_r1("least(40.0, cr * 10 + hi * 5 + me * 2 + lo * 0.5)"), _r1("least(20.0, se * 8)"), "CASE WHEN n = 0 THEN 0 ELSE " + _r1("least(15.0, un / n * 15)") + " END", _r1("least(15.0, vu * 4)"), _r1("least(12.0, ri * 3)"), _r1("least(10.0, sen * 2)"), "least(12.0, re * 6)", "CASE WHEN health < 90 THEN " + _r1("least(15.0, (100 - health) / 100.0 * 15)") + " ELSE 0 END"]))})) AS DOUBLE) AS risk FROM i),
 ev AS (SELECT repo, string_agg(event_id, ',' ORDER BY ts DESC, event_id DESC) AS events FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC, event_id DESC) <= 25) GROUP BY 1), sc AS (SELECT 'repo' || (o_custkey % 20) AS repo, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS scan FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
 SELECT repo, risk, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 45 THEN 'high' WHEN risk >= 22 THEN 'medium' WHEN risk >= 8 THEN 'low' ELSE 'info' END AS level, coalesce(events, '') AS events, scan,
 concat_ws(',', CASE WHEN vu > 0 THEN 'deps' END, CASE WHEN re > 0 THEN 'regressions' END, CASE WHEN se > 0 THEN 'rotate-secrets' END, CASE WHEN n > 0 AND un >= 0.4 * n AND un >= 3 THEN 'tests' END) AS recommendations FROM r LEFT JOIN ev USING (repo) LEFT JOIN sc USING (repo)"""
)
def guardian_signals(spark, d):
    """Risk, recommendations, latest events and scan of 23 repositories, three of them without events."""
    repo = lambda c, n=20: F.concat(F.lit("repo"), c % n).alias("repo")
    f = findings(spark, d)
    rank = S.severity_rank("severity")
    day = f.groupBy("repo", F.to_date("ts").alias("created")).agg((50 + F.count(F.lit(1)) % 50).alias("health"), *[F.count_if(rank == k).alias(n) for k, n in enumerate(S.SEVERITIES[:4])])
    category = F.when((F.col("user_id") % 50 == 1) & (F.col("line") == 7), "secrets").otherwise(F.col("category"))
    p, k = read(spark, d, "part"), F.col("p_partkey")
    parts = p.select(repo(k, 23), k.alias("path"))
    deps = read(spark, d, "lineitem").where("l_quantity = 1").select(repo(F.col("l_suppkey")), (F.col("l_partkey") % 40 == 3).cast("int").alias("vulnerabilities"))
    comps = read(spark, d, "supplier").select(repo(F.col("s_suppkey")), F.when(F.col("s_acctbal") > 6000, "high").otherwise("low").alias("level"), (F.col("s_suppkey") % 3 == 0).alias("sensitive"))
    bad = read(spark, d, "customer").where("c_acctbal < -950").select(repo(F.col("c_custkey")))
    i = R.signal_inputs(parts.select("repo").distinct(), day, f.select("repo", category.alias("category")), parts, parts.where("path % 4 = 0"), deps, comps, bad)
    scans = read(spark, d, "orders").select(repo(F.col("o_custkey")), F.col("o_orderkey").alias("scan"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), F.col("o_orderdate").alias("created"))
    ways = f.select(F.col("repo").alias("repository"), F.lit("likely").alias("confidence"))
    r = R.signals(SC.repository_risk(i), I.recommendations(i), f.select("repo", F.col("event_id").alias("event"), F.col("ts").alias("at")), ways, scans)
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")).alias(c)
    return r.select("repo", "risk", "level", text("events"), "scan", text("recommendations"))
