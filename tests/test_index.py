"""The incremental index against an index built from nothing; detectors that fail or take too long."""

import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from repolith.operators import graph
from repolith.operators import orchestration as O
from repolith.sources import index

PARSED = []


def parse(files):
    """Facts of lines like ``import x from './y'``, ``route GET /a``, ``uses t``, ``call f`` and ``def f``."""
    PARSED.append(sorted(r["path"] for r in files.select("path").collect()))
    d = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "t"))
    word = lambda k: F.regexp_extract("t", r"^\S+ (\S+)(?: (\S+))?", k)
    of = lambda head: d.where(F.col("t").startswith(head + " "))
    none = F.lit(None).cast("string")
    return {
        "imports": of("import").select("path", word(2).alias("specifier"), "line", F.array(word(1)).alias("names")),
        "routes": of("route").select("path", word(1).alias("method"), word(2).alias("route"), "line"),
        "uses": of("uses").select("path", word(1).alias("target"), F.lit("client").alias("via"), "line"),
        "calls": of("call").select("path", none.alias("enclosing"), none.alias("receiver"), word(1).alias("callee"), "line"),
        "symbols": of("def").select("path", word(1).alias("name")),
    }


def table(spark, sources):
    rows = [(p, "python" if p.endswith(".py") else "typescript", "test" in p, str(hash(c)), c) for p, c in sources.items()]
    return spark.createDataFrame(rows, index.FILES + ", content string")


def edges(spark, root):
    return {tuple(r) for r in index.current(spark, root)[1]["edges"].collect()}


def test_index_follows_changes(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    assert index.current(spark, root)[0] == 0 and edges(spark, root) == set()
    a = {"src/a.ts": "import b ./b\ncall b\nroute GET /x", "src/b.ts": "def b\nuses t", "src/c.ts": "import b @/b\nimport q ./q\nimport z lodash", "test/a.test.ts": "import a ../src/a", "m.py": "import x pkg.x\nimport y .late"}
    steps = [
        (a, set(a)),
        (a, set()),
        (a | {"src/b.ts": "def b\nimport a ./a\ncall a"}, {"src/b.ts"}),  # an edit
        (a | {"src/q.ts": "def q", "late.py": "def y"}, {"src/b.ts", "src/q.ts", "late.py"}),  # new targets, and an edit taken back
        (a | {"src/q.ts": "def q", "src/q": "def q", "src/b/index.ts": ""}, {"src/q", "src/b/index.ts"}),  # a target that comes before another
        ({k: v for k, v in a.items() if k != "src/b.ts"} | {"b.ts": "def b"}, {"b.ts"}),  # deletions: the alias leads elsewhere
        ({}, set()),
        (a, set(a)),
    ]
    for k, (sources, parsed) in enumerate(steps):
        counts = index.update(spark, root, table(spark, sources), parse).first()
        assert PARSED[-1] == sorted(parsed) and (counts["version"], counts["files"], counts["parsed"]) == (k + 1, len(sources), len(parsed))
        fresh = f"file://{tmp_path}/fresh{k}"
        index.update(spark, fresh, table(spark, sources), parse)
        assert edges(spark, root) == edges(spark, fresh) and (edges(spark, root) or not sources)
        for name in index.TABLES:
            pair = [sorted(map(str, index.current(spark, r)[1][name].collect())) for r in (root, fresh)]
            assert pair[0] == pair[1]
    kinds = {e[0] for e in edges(spark, root)}
    assert kinds == {"imports", "calls", "depends_on", "tests", "exposes_api", "uses_database"}
    assert ("imports", "src/c.ts", "src/b.ts", "certain", 0) in edges(spark, root)


def test_readers_see_a_whole_index(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    index.update(spark, root, table(spark, {"a.ts": "import b ./b", "b.ts": ""}), parse)
    version, held = index.current(spark, root)
    want = edges(spark, root)

    def broken(files):
        return {k: v.withColumn("line", F.raise_error(F.lit("no"))) if k == "calls" else v for k, v in parse(files).items()}

    with pytest.raises(Exception, match="no"):
        index.update(spark, root, table(spark, {"a.ts": "", "c.ts": "call x"}), broken)
    assert index.current(spark, root)[0] == version and edges(spark, root) == want
    index.update(spark, root, table(spark, {"a.ts": ""}), parse)
    assert edges(spark, root) == set() and {tuple(r) for r in held["edges"].collect()} == want  # who read before still can
    assert len(index.prune(spark, root, 1)) == 1 and edges(spark, root) == set()


FOUND = StructType().add("path", StringType()).add("line", LongType())


def test_detectors_apart(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    found = lambda n: lambda f: f.select("path", F.lit(n).alias("line"))

    def slow(f):
        return f.mapInPandas(lambda batches: (time.sleep(60) or b for b in batches), "path string").withColumn("line", F.lit(1))

    detectors = [
        O.Detector("good", found(1)),
        O.Detector("raises", lambda f: 1 / 0),
        O.Detector("fails", lambda f: f.select("path", F.raise_error(F.lit("broken rule")).cast("long").alias("line"))),
        O.Detector("lacks", lambda f: f.select("path")),
        O.Detector("slow", slow),
        O.Detector("away", found(2), lambda f: False),
        O.Detector("last", found(3)),
    ]
    began = time.monotonic()
    out, runs = O.run_detectors(files, detectors, FOUND, deadline=25)
    assert time.monotonic() - began < 50
    assert O.statuses(runs) == {"good": "ok", "raises": "error", "fails": "error", "lacks": "error", "slow": "error", "away": "skipped", "last": "ok"}
    assert {tuple(r) for r in out.collect()} == {(p, n, i) for p in "ab" for n, i in ((1, "good"), (3, "last"))}
    said = {r["id"]: (r["message"], r["findings"]) for r in runs.collect()}
    assert said["slow"] == ("slow exceeded 25000ms", 0) and re.search("broken rule", said["fails"][0]) and "zero" in said["raises"][0] and said["good"] == (None, 2) and said["away"][0] == O.UNAVAILABLE
    time.sleep(1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    out, runs = O.run_detectors(files, [], FOUND)
    assert out.count() == 0 and runs.count() == 0 and graph.CLASSES
