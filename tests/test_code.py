"""Detectors, manifests, files, graph and streams on small made-up inputs."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.operators import findings as FI
from repolith.operators import graph as G
from repolith.operators import resolution, rules, scoring
from repolith.sources import files, manifests
from repolith.streaming import events

SOURCES = {
    "src/admin.js": "const { exec } = require('child_process');\n// eval('comment')\nexec('tar ' + req.body.name);\nconst q = 'SELECT * FROM t WHERE id = ' + \n  userId;\nconst h = createHash('md5');\n",
    "src/ok.js": "execFile('tar', ['-czf', target]);\nconst h = createHash('sha256');\njwt.verify(token, key);\n",
    "tests/admin.test.js": "exec('rm ' + req.body.x);\n",
    "src/load.py": "import yaml\nyaml.load(f)\nyaml.load(f, Loader=SafeLoader)\n",
    "src/many.js": "\n".join("eval(x)" for _ in range(8)),
    "Dockerfile": "FROM node:14\nENV API_TOKEN=ghp_0123456789abcdef\nRUN npm install --unsafe-perm\nUSER root\n",
    "ok/Dockerfile": "FROM node:22-slim\nUSER app\nHEALTHCHECK CMD true\n",
    ".github/workflows/ci.yml": "on: pull_request_target\njobs:\n  a:\n    run: curl http://x | sh\n",
    ".env": "DB_PASSWORD=correcthorsebattery\nDEBUG=1\nAPI_KEY=changeme-now\n",
    "package.json": '{"dependencies": {"lodash": "^4.17.15", "left-pad": "1.3.0"},\n "devDependencies": {"minimist": "0.2.1"}}',
    "requirements-dev.txt": "# tools\nrequests==2.25.0\nflask>=2.0\n-r other.txt\n",
    "pyproject.toml": "[project]\nname = 'x'\ndependencies = [\n  'django==3.1.0',\n]\n[tool.poetry.dependencies]\npython = '^3.11'\npyyaml = '5.3'\n",
    "node_modules/x/index.js": "eval(x)",
    "logo.png": "binary",
    "package-lock.json": "{}",
}


@pytest.fixture(scope="module")
def code(spark):
    raw = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in SOURCES.items()] + [("nul.txt", bytearray(b"a\0b")), ("hex.txt", bytearray(b"\x10\x01"))], "path string, content binary")
    return files.text_files(raw).cache()


def test_discovery(spark, code, tmp_path):
    got = {r["path"]: r for r in code.collect()}
    assert set(got) == set(SOURCES) - {"node_modules/x/index.js", "logo.png", "package-lock.json"} | {"hex.txt"}
    assert got["Dockerfile"]["language"] == "dockerfile" and got[".env"]["language"] == "dotenv" and got["src/load.py"]["language"] == "python"
    assert got["tests/admin.test.js"]["is_test"] and not got["src/admin.js"]["is_test"]
    for k, v in SOURCES.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    assert {r["path"] for r in files.discover(spark, str(tmp_path), hidden=(".github",)).collect()} == set(got) - {"hex.txt", ".env"}
    stats = {r["language"]: r["files"] for r in files.repository_stats(code).collect()}
    assert stats["javascript"] == 4 and stats["dockerfile"] == 2


def test_security(code):
    got = {(r["path"], r["rule_id"], r["line"]): r for r in rules.security(code).collect()}
    keys = {k for k in got if k[0] != "src/many.js"}
    assert ("src/admin.js", "security/command-injection", 3) in keys and ("src/admin.js", "security/weak-hash", 6) in keys
    assert ("src/load.py", "security/unsafe-deserialization", 2) in keys and ("src/load.py", "security/unsafe-deserialization", 3) not in keys
    assert not any(p in ("src/ok.js", "tests/admin.test.js") for p, _, _ in keys)
    assert got["src/admin.js", "security/command-injection", 3]["confidence"] == 0.95
    many = sorted((k[2], r["additional"]) for k, r in got.items() if k[0] == "src/many.js")
    assert many == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 3)]


def test_infrastructure(code):
    docker = {(r["path"], r["rule_id"]) for r in rules.dockerfiles(code).collect()}
    assert docker == {("Dockerfile", f"infra/docker-{x}") for x in ("eol-base-image", "secret-in-env", "unsafe-perm", "runs-as-root", "no-healthcheck")}
    ci = {r["rule_id"] for r in rules.workflows(code).collect()}
    assert ci == {"cicd/pull-request-target", "cicd/remote-script", "cicd/missing-permissions"}
    assert {(r["rule_id"], r["line"]) for r in rules.configuration(code).collect()} == {("config/dotenv-secret", 1)}
    merged = FI.deduped(rules.all_findings(code).withColumn("pos", F.monotonically_increasing_id()), "pos")
    assert merged.count() == merged.select("fingerprint").distinct().count() > 10


def test_manifests(spark, code):
    deps = manifests.dependencies(code)
    got = {(r["name"], r["version"], r["is_dev"]) for r in deps.collect()}
    assert got == {("lodash", "4.17.15", False), ("left-pad", "1.3.0", False), ("minimist", "0.2.1", True), ("requests", "2.25.0", True), ("flask", None, True), ("django", "3.1.0", False), ("pyyaml", "5.3", False)}
    v = {r["name"]: (r["severity"], r["advisories"], r["fixed_in"]) for r in manifests.vulnerable(deps, manifests.advisories(spark)).collect()}
    assert v == {"lodash": ("high", 2, "4.17.21"), "minimist": ("critical", 1, "1.2.6"), "requests": ("medium", 1, "2.31.0"), "django": ("high", 1, "3.2.15"), "pyyaml": ("critical", 1, "5.4")}


def test_scalars(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert ask(S.round1(lit(-0.25))) == -0.2 and ask(S.round_confidence(lit(1.7))) == 1.0
    assert [ask(S.version_less(lit(a), lit(b))) for a, b in (("4.17.9", "4.17.21"), ("v10", "9.0.0"), ("1.2", "1.2.0"), ("3rc.1", "3.2"))] == [True, False, False, True]
    assert ask(S.unresolved_version(lit("latest"))) and ask(S.unresolved_version(lit(None).cast("string")))
    assert [ask(S.component_band(lit(x))) for x in (17.9, 18.0, 40.0, 65.0)] == ["low", "medium", "high", "critical"]
    assert ask(S.deduction_to_score(lit(0.0))) == 100 and ask(S.size_allowance(lit(100))) == 1
    assert ask(S.normalize_snippet(lit(" a \u00a0 b\n"))) == "a b"
    assert ask(S.mask_secret(lit("short"))) == "•" * 8 and ask(S.mask_secret(lit("abcdefghijkl"))) == "abcd••••ijkl"
    assert ask(S.keywords(lit("Where is the Token token parser_2?"))) == ["token", "parser_2"]
    assert ask(S.major_behind(lit("^1.2"), lit("v2.0"))) and not ask(S.major_behind(lit("x"), lit("2")))


def test_health_of_nothing(spark):
    none = spark.createDataFrame([], "repo string, severity string, category string, confidence double")
    loc = spark.createDataFrame([("a", 100)], "repo string, total_loc long")
    (r,) = scoring.health(none, loc).collect()
    assert (r["health"], r["security"], r["debt_hours"], r["critical"]) == (100.0, 100.0, 0.0, 0)


def test_graph(spark):
    e = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "b"), ("d", "c"), ("e", "d")], "src string, dst string")
    got = {(r["node"], r["depth"], r["via"]) for r in G.reachable(e, spark.createDataFrame([("a",)], "origin string")).collect()}
    assert got == {("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c")}
    specs = spark.createDataFrame([("src/a/x.js", "../lib/y"), ("src/a/x.js", "./z"), ("src/a/x.js", "./none")], "path string, specifier string")
    known = spark.createDataFrame([("src/lib/y.js",), ("src/a/z.ts",), ("src/a/z.js",)], "path string")
    assert {(r["specifier"], r["target"]) for r in resolution.resolved(specs.withColumn("language", F.lit("javascript")), known).collect()} == {("../lib/y", "src/lib/y.js"), ("./z", "src/a/z.ts")}


def test_webhooks(spark, tmp_path):
    rows = [
        '{"delivery_id": "1", "event": "push", "branch": "main", "default_branch": "main", "sha": "abc", "received_at": "2024-01-01T00:00:00Z"}',
        '{"delivery_id": "1", "event": "push", "branch": "main", "default_branch": "main", "sha": "abc", "received_at": "2024-01-01T00:00:05Z"}',
        '{"delivery_id": "2", "event": "pull_request", "action": "opened", "draft": true, "received_at": "2024-01-01T00:01:00Z"}',
        '{"delivery_id": "3", "event": "check_run", "action": "rerequested", "received_at": "2024-01-01T00:02:00Z"}',
        "not json",
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(rows))
    stream = events.deliveries(events.parsed(spark.readStream.text(str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("hooks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["delivery_id"], r["outcome"]) for r in spark.table("hooks").collect())
    assert got == [("1", "scan"), ("2", "ignored"), ("3", "rerun")]


def test_jobs():
    s = events.NEW_JOB
    late = 2 + events.LOCK_MS
    for action, at, want in (("enqueue", 0, "queued"), ("enqueue", 1, "queued"), ("claim", 2, "running"), ("claim", 3, "running"), ("claim", late, "running"), ("fail", 9, "queued"), ("claim", 10, "running"), ("fail", 11, "failed"), ("enqueue", 12, "queued"), ("cancel", 13, "cancelled")):
        s = events._advance(s, action, at)
        assert s[0] == want
    # asked for again while it runs
    for action, want in (("enqueue", "queued"), ("claim", "running"), ("enqueue", "running"), ("complete", "queued"), ("claim", "running"), ("complete", "done")):
        s = events._advance(s, action, 20)
        assert s[0] == want


def streamed(spark, out, tmp_path, name, mode):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return spark.table(name).collect()


def source(spark, tmp_path, name, batches, schema):
    """A stream that gives each list of rows as a micro-batch."""
    folder = tmp_path / name
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files come by their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_job_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    one = [("r", "s", 1, "enqueue", at(0)), ("r", "s", 1, "enqueue", at(1)), ("r", "t", None, "enqueue", at(2)), ("r", "t", None, "cancel", at(3))]
    two = [("r", "s", 1, "claim", at(4)), ("r", "s", 1, "fail", at(5)), ("r", "s", 1, "claim", at(6))]
    stream = source(spark, tmp_path, "actions", [one, two], "repo string, sha string, number int, action string, at timestamp")
    rows = streamed(spark, events.job_states(stream), tmp_path, "jobs", "update")
    assert sorted((r["sha"], r["number"] or 0, r["status"], r["attempts"]) for r in rows) == [("s", 1, "queued", 0), ("s", 1, "running", 2), ("t", 0, "cancelled", 0)]


def test_rate_limit_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    one = [("a", 1, at(50)), ("a", 2, at(51)), ("a", 3, at(52)), ("b", 4, at(50))]
    two = [("a", 5, at(59)), ("a", 6, at(59) + dt.timedelta(seconds=1))]
    stream = source(spark, tmp_path, "requests", [one, two], "key string, request long, at timestamp")
    rows = streamed(spark, events.rate_limited(stream, 2, 10_000), tmp_path, "limits", "append")
    assert sorted((r["request"], r["ok"], r["retry_ms"]) for r in rows) == [(1, True, 0), (2, True, 0), (3, False, 8000), (4, True, 0), (5, False, 1000), (6, True, 0)]


def test_recorded_scans(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    stream = source(spark, tmp_path, "scans", [[("r", 1, at)], [("r", 2, at), ("q", 3, at)]], "repo string, scan long, finished timestamp")
    for _ in range(2):  # nothing is written twice
        q = events.record_scans(stream, str(tmp_path / "snapshots"), str(tmp_path / "log"), str(tmp_path / "c"))
        assert q.awaitTermination(60)
    assert {r["scan"] for r in spark.read.parquet(str(tmp_path / "snapshots")).collect()} == {1, 2, 3}
    assert sorted(r["dedupe_key"] for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["scan:q:3", "scan:r:1", "scan:r:2"]


def test_claims(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    jobs = [(1, "queued", 0, at(1), None, 0), (2, "queued", 5, at(2), None, 1), (3, "running", 0, at(0), at(10), 1), (4, "running", 0, at(0), at(20), 1), (5, "done", 9, at(0), None, 1), (6, "running", 0, at(0), at(10), 3)]
    d = spark.createDataFrame(jobs, "id long, status string, priority int, created timestamp, locked timestamp, attempts int")
    got = events.claims(d, F.lit(at(25)), 4).collect()
    assert [(r["id"], r["status"], r["attempts"]) for r in got] == [(2, "running", 2), (3, "running", 2), (6, "failed", 3), (1, "running", 1)]


def test_nesting(spark):
    texts = [
        ("function f() {\n  if (a) {\n    for (;;) {\n      x = {b: {}};\n    }\n  }\n}\n", 2, 3),
        ("/* if {\n while { */ if (a) {\n// for {\n}\nx = 'if {';\n", 1, 2),
        ("if (a) { /* x */ if (b) {\n}\n}}} else {\n", 1, 1),
        ("", 0, 0),
        (None, 0, 0),
        ("'" + "\\\\" * 5000 + "\nif (a) {" * 3000, 3000, 3001),
    ]
    d = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)], "k int, t string")
    got = {r["k"]: (r["n"]["depth"], r["n"]["line"]) for r in d.select("k", files.nesting_depth(F.col("t")).alias("n")).collect()}
    assert got == {k: (a, b) for k, (_, a, b) in enumerate(texts)}
    py = spark.createDataFrame([("def f():\n    if a:\n        b\n            # deep\n        c\n",), ("",)], "t string").select(files.indent_nesting(F.col("t")).alias("n")).collect()
    assert [(r["n"]["depth"], r["n"]["line"]) for r in py] == [(2, 3), (0, 0)]


def test_built_edges(spark):
    known = spark.createDataFrame([("src/a.ts", "typescript", False), ("src/lib/b.ts", "typescript", False), ("tests/a.test.ts", "typescript", True), ("m.py", "python", False)], "path string, language string, is_test boolean")
    imports = [("src/a.ts", "./lib/b", 1, ["go", "Box"]), ("src/a.ts", "@scope/pkg/sub", 2, []), ("src/a.ts", "lodash/fp", 4, []), ("src/a.ts", "lodash", 3, []), ("tests/a.test.ts", "../src/a", 1, ["a"]), ("m.py", "os.path", 1, []), ("m.py", "./none", 2, [])]
    calls = [("src/a.ts", "run", None, "go", 7), ("src/a.ts", "run", None, "go", 6), ("src/a.ts", None, "Box", "open", 8), ("src/a.ts", None, None, "own", 9), ("src/a.ts", None, "x", "own", 10)]
    got = G.built_edges(
        known, spark.createDataFrame(imports, "path string, specifier string, line int, names array<string>"), spark.createDataFrame([("src/a.ts", "GET", "/x", 5)], "path string, method string, route string, line int"),
        spark.createDataFrame([("src/a.ts", "users", "client", 6)], "path string, target string, via string, line int"), spark.createDataFrame(calls, "path string, enclosing string, receiver string, callee string, line int"), spark.createDataFrame([("src/a.ts", "own")], "path string, name string"),
    ).collect()
    assert {tuple(r) for r in got} == {
        ("imports", "src/a.ts", "src/lib/b.ts", "certain", 1), ("depends_on", "src/a.ts", "pkg:@scope/pkg", "certain", 2), ("depends_on", "src/a.ts", "pkg:lodash", "certain", 3), ("depends_on", "m.py", "pkg:os", "certain", 1),
        ("imports", "tests/a.test.ts", "src/a.ts", "certain", 1), ("tests", "tests/a.test.ts", "src/a.ts", "certain", 1), ("exposes_api", "src/a.ts", "api:GET /x", "certain", 5), ("uses_database", "src/a.ts", "db:users", "probable", 6),
        ("calls", "src/a.ts#run", "src/lib/b.ts#go", "certain", 6), ("calls", "src/a.ts", "src/lib/b.ts#open", "probable", 8), ("calls", "src/a.ts", "src/a.ts#own", "certain", 9),
    }
