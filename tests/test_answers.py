"""Signatures, JSON in answers, gates, resolvers, manifests, retrieval: odd rows and published vectors."""

import datetime as dt
import hashlib
import hmac

from pyspark.sql import functions as F

from repolith.functions import answers, signing
from repolith.functions import paths as P
from repolith.functions import scalars as S
from repolith.operators import findings as FI
from repolith.operators import resolution, rules, scoring
from repolith.operators import reads as RD
from repolith.operators import retrieval as R
from repolith.sources import files, manifests
from repolith.streaming import events

from .test_code import source, streamed

# RFC 4231, cases 1 to 4, 6 and 7: key, data, HMAC-SHA-256
VECTORS = (
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (bytes(range(1, 26)), b"\xcd" * 50, "82558a389a443c0ea4cc819899f2083a85f0faa3e578f8077a2e3ff46729665b"),
    (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.", "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
)


def test_published_vectors(spark):
    more = [(bytes([k % 256]) * n, bytes(range(256)) * (n % 5)) for k, n in enumerate((1, 63, 64, 65, 127, 128, 200))]
    rows = [*VECTORS, *((k, m, hmac.new(k, m, hashlib.sha256).hexdigest()) for k, m in more), (None, b"x", None), (b"k", None, None)]
    binary = lambda x: None if x is None else bytearray(x)
    d = spark.createDataFrame([(binary(k), binary(m), w) for k, m, w in rows], "k binary, m binary, w string")
    got = d.select("w", signing.hmac_sha256(F.col("k"), F.col("m")).alias("h")).collect()
    assert [r["h"] for r in got] == [r["w"] for r in got]


def test_signed_stream(spark, tmp_path):
    sign = lambda body, key="s3cret": "sha256=" + hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()
    body = '{"delivery_id": "%s", "event": "push", "repo": "r"}'
    one = [(body % "é", sign(body % "é")), (body % "b", sign(body % "c")), (body % "d", None)]
    two = [(body % "e", sign(body % "e", "other")), (body % "f", "sha1=abc"), (body % "g", sign(body % "g") + "0"), (body % "h", sign(body % "h")), ("", sign(""))]
    stream = source(spark, tmp_path, "signed", [one, two], "value string, signature string")
    rows = streamed(spark, events.parsed(events.verified(stream, "s3cret")), tmp_path, "signed_rows", "append")
    assert sorted(r["delivery_id"] for r in rows) == ["h", "é"]
    d = spark.createDataFrame([*one, *two, (None, sign("")), ("x", "")], "b string, s string").select(signing.signature_state(F.col("b"), F.col("s"), "s3cret").alias("s"))
    assert [r["s"] for r in d.collect()] == ["valid", "mismatch", "missing-signature", "mismatch", "bad-format", "mismatch", "valid", "valid", "valid", "missing-signature"]
    assert spark.range(1).select(signing.signature_state(F.lit("x"), F.lit("y"), "").alias("s")).first()["s"] == "missing-secret"


def test_gated_stream(spark, tmp_path):
    """Two batches against a table of policies: the first reason that holds is given."""
    repos = spark.createDataFrame([("r", True, None, True, "main"), ("off", False, True, True, "main"), ("nopush", True, False, False, "trunk")], "repo string, guardian_enabled boolean, scan_on_push boolean, scan_on_pull_request boolean, default_branch string")
    kind = "delivery_id string, event string, action string, repo string, sha string, number int, draft boolean, branch string, ref string, deleted boolean"
    push = lambda i, repo, ref="refs/heads/main", sha="abc", gone=False: (i, "push", None, repo, sha, None, None, None, ref, gone)
    pull = lambda i, repo, action="opened", number=1, draft=False, sha="abc": (i, "pull_request", action, repo, sha, number, draft, None, None, None)
    one = [push("1", "r"), push("2", "r", "refs/heads/x"), push("3", "r", "refs/tags/v"), push("4", "r", sha="000"), push("5", "r", gone=True), push("6", "none"), push("7", "off"), push("8", "nopush", "refs/heads/trunk"), push("9", None), push("10", "r", None), push("11", "r", sha=None)]
    two = [pull("12", "r"), pull("13", "r", "closed"), pull("14", "r", None), pull("15", "r", number=0), pull("16", "r", sha=""), pull("17", "r", draft=True), pull("18", "r", "ready_for_review", draft=True), pull("19", "nopush"), ("20", "check_run", "rerequested", "off", "abc", None, None, None, None, None), ("21", "check_run", "rerequested", "r", "abc", 4, None, None, None, None), ("22", "check_run", "created", "r", "abc", 4, None, None, None, None), ("23", "ping", None, None, None, None, None, None, None, None), ("24", "push", None, "r", "abc", None, None, "main", None, None)]
    stream = source(spark, tmp_path, "gates", [one, two], kind)
    got = {r["delivery_id"]: (r["reason"], r["trigger"], r["priority"]) for r in streamed(spark, events.gated(stream, repos), tmp_path, "gated_rows", "append")}
    ok = lambda t, p=0: (None, t, p)
    no = lambda r: (r, None, None)
    want = [ok("push"), no("other-branch"), no("not-a-branch"), no("no-commit"), no("branch-deleted"), no("not-connected"), no("disabled"), no("policy"), no("not-connected"), no("no-commit"), no("no-commit")]
    want += [ok("pull_request"), no("action"), no("action"), no("incomplete"), no("incomplete"), no("draft"), ok("pull_request"), no("policy"), ok("manual", 100), ok("pull_request", 100), no("event"), no("event"), ok("push")]
    assert got == {str(k): w for k, w in enumerate(want, 1)}


def test_json_of_answers(spark):
    cases = {
        '{"a":1}': '{"a":1}', " \u00a0[1, 2]\n": "[1, 2]", "null": "null", "nul": None, "": None, None: None, '{"a":1,}': None, "{'a':1}": None, '{"a":01}': None, "NaN": None, "1 2": None, "} {": None,
        'x ```json\n{"a":2}\n``` y {"b":3}': '{"a":2}', 'x ``` [3] ``` {"b":3}': "[3]", "``` ```\n{}": "{}", 'pre {"a":{"b":5}} post': '{"a":{"b":5}}', '{"a":1} {"b":2}': None, '{"a":1}x': '{"a":1}', '\ufeff{"a":1}': '{"a":1}', '1],[2': None, '{"a": "\\u00e9 }"} }': None,
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", answers.json_part(F.col("t")).alias("j"), F.to_json(answers.loose_json(F.col("t"))).alias("v"))
    got = {r["t"]: r for r in d.collect()}
    assert {k: r["j"] for k, r in got.items()} == cases
    assert got["null"]["v"] == "null" and got[" \u00a0[1, 2]\n"]["v"] == "[1,2]" and got["nul"]["v"] is None


def test_resolvers(spark):
    known = spark.createDataFrame([(p,) for p in ("src/a.ts", "a.ts", "src/lib/index.tsx", "lib/b.mjs", "src/pkg/mod.py", "pkg/__init__.py", "pkg/sub.py", "src/x.py", "top.py", "lib/index.js")], "path string")
    cases = [
        ("src/m.ts", "@/a", "typescript", "src/a.ts"), ("src/m.ts", "@/lib/b", "typescript", "lib/b.mjs"), ("src/m.ts", "~/a", "javascript", "a.ts"), ("src/m.ts", "./lib", "typescript", "src/lib/index.tsx"), ("src/m.ts", "../../../a", "typescript", "a.ts"), ("src/m.ts", "react", "typescript", None), ("src/m.ts", "", "typescript", None),
        ("src/a.ts", "./a", "typescript", None), ("src/m.ts", "./a.ts", "typescript", "src/a.ts"), ("m.py", "pkg.mod", "python", "src/pkg/mod.py"), ("m.py", "pkg.sub.Name", "python", "pkg/sub.py"), ("pkg/sub.py", ".", "python", "pkg/__init__.py"), ("pkg/deep/x.py", "..sub", "python", "pkg/sub.py"), ("src/y.py", "...top", "python", "top.py"), ("src/y.py", ".x.Thing", "python", "src/x.py"), ("m.py", "os", "python", None),
    ]
    specs = spark.createDataFrame([c[:3] for c in cases], "path string, specifier string, language string")
    got = {(r["path"], r["specifier"]): r["target"] for r in resolution.resolved(specs, known).collect()}
    assert got == {c[:2]: c[3] for c in cases if c[3]}
    of = lambda rows, name: {(r["path"], r["specifier"]): r["target"] for r in resolution.resolved(spark.createDataFrame(rows, specs.schema), known, name).collect()}
    tests = [("tests/t.js", "../src/a", ""), ("t.js", "./lib/", ""), ("t.js", "./lib", ""), ("t.js", "../a", ""), ("src/a.ts", "./a", ""), ("tests/t.js", "../pkg", "")]
    assert of(tests, "tests") == {("tests/t.js", "../src/a"): "src/a.ts", ("t.js", "./lib/"): "lib/index.js", ("t.js", "./lib"): "lib/index.js", ("src/a.ts", "./a"): "src/a.ts", ("tests/t.js", "../pkg"): "pkg/__init__.py"}
    assert of([("src/m.ts", "../a", ""), ("src/m.ts", "@/a", ""), ("t.js", "../../a", "")], "history") == {("src/m.ts", "../a"): "a.ts", ("t.js", "../../a"): "a.ts"}
    assert resolution.resolved(specs.limit(0), known).count() == 0
    d = spark.createDataFrame([(p,) for p in ("/a/../../b", "a/../../b", "../x/./y//z", "a/b/", "", ".", "/")], "p string")
    assert [r["p"] for r in d.select(resolution.posix(F.col("p")).alias("p")).collect()] == ["/b", "../b", "../x/y/z", "a/b/", "", "", "/"]


def test_facts_of_texts(spark):
    text = "import { it } from 'vitest'\nconst a = require('./pay'), b = require('../x')\nit.each([1])('a', f); test(`b`, () => expect(1))\nexport async function go() {}\nexport const _hidden = 1\nmodule.exports = { one, _two: 2, 'no' : 3, one }\n"
    d = spark.createDataFrame([(text,), (None,), ("",), ("from .m import x\ndef test_a():\n  assert x\nclass K:\n  def inner(self): pass\ndef _no(): pass",)], "content string")
    got = [tuple(r)[1:] for r in files.test_facts(d).collect()]
    assert got[0] == ("vitest", 2, True, ["./pay", "../x"], ["go", "one", "_two"], 1)
    assert got[1] == got[2] == (None, 0, False, [], [], 1)
    assert got[3] == (None, 1, True, [".m"], ["test_a", "K"], 1)
    roles = spark.createDataFrame([("x/A.TSX",), ("x/a.tsx",), ("x/Components/a.TSX",)], "p string").select(P.role(F.col("p")).alias("r")).collect()
    assert [r["r"] for r in roles] == ["source", "component", "component"]


def test_workflow_rules(spark):
    path = ".github/workflows/a.yml"
    rows = [(path, "permissions: x\nprerun: ${{ github.event.issue.title }}\necho ${{ secrets.KEY }} secrets.B\n"), (path.replace("a.", "b."), "permissions: x\nrun : ${{ github.event.issue.title }}\n")]
    d = spark.createDataFrame([(p, "yaml", c) for p, c in rows], "path string, language string, content string")
    got = {(r["path"], r["rule_id"]): r["evidence"] for r in rules.workflows(d).collect()}
    assert set(got) == {(path, "cicd/untrusted-context-interpolation"), (path, "cicd/secret-in-log")}
    assert got[path, "cicd/secret-in-log"] == "echo ${{ secrets.[redacted] }} secrets.[redacted]"


def test_pyproject_lists(spark):
    text = """[project]
name = "x[y]"  # 'none'
dependencies = ["a==1.2.3", 'b[x,y]>=2; python_version > "3"', "c"]  # "d"
keywords = ["not", "these"]
[project.optional-dependencies]
extra = [
  "e ~= 1.0", "f",  # "g"
  'h[all] == 4.5', # ]
]
dev-only = ["i"]
[tool.poetry.dependencies]
python = "^3.11"
j = "^1.2"  # x
k = { version = "==2.3", extras = ["l"] }
m = { git = "https://x" }
[tool.poetry.group.dev.dependencies]
n = "1.0.0"
[tool.other]
dependencies = ["no"]
"""
    d = spark.createDataFrame([("p/pyproject.toml", text), ("pyproject.toml", "dependencies = ['no']"), ("q/pyproject.toml", "")], "path string, content string")
    got = {r["name"]: (r["version_spec"], r["version"], r["is_dev"], r["line"]) for r in manifests.pyproject(d).collect()}
    assert got == {
        "a": ("==1.2.3", "1.2.3", False, 3), "b": ('>=2; python_version > "3"', None, False, 3), "c": ("*", None, False, 3), "e": ("~= 1.0", None, False, 7), "f": ("*", None, False, 7), "h": ("== 4.5", "4.5", False, 8), "i": ("*", None, False, 10),
        "j": ("^1.2", "1.2", False, 13), "k": ("==2.3", "2.3", False, 14), "m": ("*", None, False, 15), "n": ("1.0.0", "1.0.0", True, 17),
    }


def test_retrieval_of_nothing(spark):
    q = spark.createDataFrame([(1, "the payment of it"), (2, ""), (3, None)], "question long, text string")
    f = spark.createDataFrame([(1, "Payment is open", "r/1", "low", "a", "open"), (2, None, "r/payment", "high", None, "proposed"), (3, "payment", "r", "critical", "a", "resolved"), (4, "x", None, "info", "b", "open")], "id long, title string, rule_id string, severity string, path string, status string")
    paths = spark.createDataFrame([(1, "b"), (1, "b")], "question long, path string")
    got = sorted(tuple(r) for r in R.relevant_findings(q, paths, f).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (1, 4, 3), (2, 1, 2), (2, 2, 1), (2, 4, 3), (3, 1, 2), (3, 2, 1), (3, 4, 3)]
    assert R.relevant_findings(q, paths, f.limit(0)).count() == 0
    c = spark.createDataFrame([("a", "x" * 10), ("b", ""), ("c", None), ("d", "yz")], "path string, content string")
    ranked = spark.createDataFrame([(1, p, s) for p, s in (("a", 1), ("b", 9), ("c", 8), ("d", 5))], "question long, path string, score int")
    rows = lambda **k: [(r["path"], r["body"], r["truncated"]) for r in R.packed_sources(ranked, c, **k).orderBy("place").collect()]
    assert rows(chars=6) == [("d", "yz", False), ("a", "xxxxxx", True)] and rows(most=1) == [("d", "yz", False)]
    assert rows(budget=5) == [("d", "yz", False), ("a", "xxx", True)] and rows(budget=2) == [("d", "yz", False)]
    o = spark.createDataFrame([("ok.ts", "token ghp_" + "a" * 36), ("../x", "a"), ("/abs", "a"), ("n.ts", None), ("long.ts", "b" * 30)], "path string, content string")
    shown = {r["path"]: (r["content"], r["truncated"]) for r in R.opened_files(o, 60).collect()}
    assert set(shown) == {"ok.ts", "long.ts"} and "a" * 36 not in shown["ok.ts"][0] and R.opened_files(o, 20).where("truncated").count() == 2


def test_small_reads(spark):
    t = spark.createDataFrame([("r", "jest"), ("r", "vitest"), ("r", "jest"), ("s", None), ("s", None), ("s", "b"), ("t", "b"), ("t", "a")], "repo string, framework string")
    assert {tuple(r) for r in R.main_frameworks(t).collect()} == {("r", "jest"), ("s", None), ("t", "a")}
    repos = spark.createDataFrame([("u", "a", 2), ("u", "b", 1), ("v", "c", 1)], "user string, repo string, position int")
    asked = spark.createDataFrame([(1, "u", "a"), (2, "u", "zz"), (3, "u", None), (4, "v", "a"), (5, "w", "a")], "request long, user string, asked string")
    assert {tuple(r) for r in R.active_repositories(repos, asked).collect()} == {(1, "a"), (2, "b"), (3, "b"), (4, "c")}
    marks = spark.createDataFrame([("r", "quality/todo-left"), ("r", "x/fixme"), ("r", "x"), ("s", "y")], "repo string, rule_id string")
    assert [tuple(r) for r in scoring.debt_markers(marks).collect()] == [("r", 2)]
    d = spark.createDataFrame([(3, 10, True), (5, 7, False)], "loc long, bytes long, is_test boolean")
    assert tuple(files.repository_totals(d).first()) == (2, 8, 17, 1) and tuple(files.repository_totals(d.limit(0)).first()) == (0, 0, 0, 0)
    scans = spark.createDataFrame([("r", k, dt.datetime(2024, 1, k)) for k in (1, 2, 3, 4, 5)], "repo string, scan long, at timestamp")
    seen = spark.createDataFrame([("r", 1, "f"), ("r", 2, "f"), ("r", 4, "f"), ("r", 4, "f"), ("r", 5, "g"), ("r", 9, "g")], "repo string, scan long, fingerprint string")
    got = [(r["fingerprint"], r["episode"], r["first_seen"].day, r["last_seen"].day, r["scans"], r["resolved_at"] and r["resolved_at"].day) for r in FI.episodes(seen, scans).orderBy("fingerprint", "episode").collect()]
    assert got == [("f", 1, 1, 2, 2, 3), ("f", 2, 4, 4, 1, 5), ("g", 1, 5, 5, 1, None)]
    known = manifests.advisories(spark)
    deps = spark.createDataFrame([("npm", "lodash", "4.17.0", "p", 1), ("npm", "none", "1.0.0", "p", 2)], "ecosystem string, name string, version string, manifest_path string, line int")
    (r,) = manifests.vulnerable(deps, known).collect()
    assert [x["id"] for x in r["records"]] == ["GHSA-29mw-wpgm-hmr9", "GHSA-p6mc-m468-83gg"] and r["advisories"] == 2


def test_fixes_and_grades(spark):
    f = lambda *k: spark.createDataFrame([(x,) for x in k], "fingerprint string")
    got = {tuple(r) for r in FI.verified_fix(f("a", "b"), f("a", "b", "c"), f("b", "c", "d", "d")).collect()}
    assert got == {("b", "still_open"), ("d", "new")}
    assert FI.verified_fix(f("a"), f("a"), f("x").limit(0)).count() == 0
    d = spark.createDataFrame([(95.0, 0, 0), (95.0, 0, 1), (95.0, 2, 0), (80.0, 0, 0), (60.0, 0, 0), (40.0, 0, 1), (10.0, 0, 0)], "s double, c int, h int")
    assert [r["g"] for r in d.select(S.score_grade(F.col("s"), F.col("c"), F.col("h")).alias("g")).collect()] == ["Excellent", "Needs attention", "At risk", "Good", "Needs attention", "At risk", "At risk"]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, at int, v string")
    assert {tuple(r) for r in RD.latest(rows, "k", "at").collect()} == {("a", 3, "y"), ("b", 2, "z")}
    asked = spark.createDataFrame([(1, "b"), (2, "none")], "request int, k string")
    assert [r["v"] for r in RD.by_id(rows, asked, "k").collect()] == ["z"] and RD.rows_of(rows, asked, "k").count() == 1


def test_signals_of_nothing(spark):
    none = lambda kind: spark.createDataFrame([], kind)
    repos = spark.createDataFrame([("r",)], "repo string")
    i = R.signal_inputs(repos, none("repo string, created date, health int, critical int, high int, medium int, low int"), none("repo string, category string"), none("repo string, path string"), none("repo string, path string"), none("repo string, vulnerabilities int"), none("repo string, level string, sensitive boolean"), none("repo string"))
    assert i.first().asDict() == {"repo": "r", "health": None, **dict.fromkeys(("critical", "high", "medium", "low", "secrets", "files", "untested", "vulnerable", "risky", "sensitive", "regressions"), 0)}
    risks = spark.createDataFrame([("r", 1.0, "info")], "repo string, risk double, level string")
    r = R.signals(risks, none("repo string, id string, weight string"), none("repo string, event long, at timestamp"), none("repository string, confidence string"), none("repo string, scan long, status string, created date")).first()
    assert (r["recommendations"], r["events"], r["confirmed"], r["scan"]) == (None, None, 0, None)
    told = spark.createDataFrame([("r", "b", "medium"), ("r", "c", "high"), ("r", "a", "high")], "repo string, id string, weight string")
    ways = spark.createDataFrame([("r", "likely"), ("r", "likely"), ("r", "confirmed")], "repository string, confidence string")
    events_ = spark.createDataFrame([("r", k, dt.datetime(2024, 1, 1 + k % 28)) for k in range(40)], "repo string, event long, at timestamp")
    r = R.signals(risks, told, events_, ways, none("repo string, scan long, status string, created date"), 3).first()
    assert (r["recommendations"], r["events"], r["confirmed"], r["likely"], r["potential"]) == (["a", "c", "b"], [27, 26, 25], 1, 2, 0)
