"""Quality, testing and dependency detectors and the path depth on small made-up inputs."""

from repolith.operators import graph, rules
from repolith.sources import files

SOURCES = {
    "src/payment.js": "const used = 1;\n  var\n  idle = used;\nlet $a = 2; let _b = 3; const y = 4;\ntry { y } catch (e) {\n  // later\n}\ntry { y } catch (e) {\n  log(e);\n}\nreturn user.profile.name;\nreturn this.a.b;\nconst cents = price * 100; cents\nMath.round(price * 100)\nconst p = discount / 100; p\nmodule.exports = y;\n",
    "src/ok.js": "if (percent > 100) fail();\npercent / 100\nreturn a?.b.c.d;\n",
    "src/load.py": "def f():\n  try:\n    g()\n  except ValueError:\n    pass\n  try:\n    g()\n  except OSError:\n    log()\n" + "\n" * 40,
    "src/done.py": "def f():\n" + "  x\n" * 50,
    "src/busy.go": "if a && b {\n" * 13,
    "src/lib.js": "export const z = 1; z\n" + "z\n" * 50,
    "tests/lib.test.js": "import { z } from '../src/lib';\nit('works', () => { z });\n",
    "tests/a.test.js": "it('works', () => { expect(1); });\n",
    "package.json": '{"dependencies": {"lodash": "^4.17.15"}}',
}


def rows(spark, sources):
    raw = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in sources.items()], "path string, content binary")
    return files.text_files(raw)


def test_quality_testing_and_dependencies(spark):
    got = rules.all_findings(rows(spark, SOURCES)).where("scanner in ('quality', 'testing', 'dependencies')").collect()
    assert {(r["rule_id"], r["path"], r["line"], r["severity"]) for r in got} == {
        ("reliability/swallowed-error", "src/payment.js", 5, "medium"),
        ("reliability/swallowed-error", "src/load.py", 4, "medium"),
        ("bugs/unchecked-property-access", "src/payment.js", 11, "medium"),
        ("bugs/float-currency-arithmetic", "src/payment.js", 13, "medium"),
        ("bugs/missing-bounds-check", "src/payment.js", 15, "low"),
        ("quality/unused-variable", "src/payment.js", 2, "info"),
        ("quality/unused-variable", "src/payment.js", 4, "info"),
        ("quality/high-complexity", "src/busy.go", 1, "low"),
        ("quality/deep-nesting", "src/busy.go", 13, "medium"),
        ("testing/test-without-assertions", "tests/lib.test.js", 1, "medium"),
        ("testing/untested-module", "src/payment.js", 1, "high"),
        ("testing/untested-module", "src/load.py", 1, "low"),
        ("testing/untested-module", "src/done.py", 1, "low"),
        ("dependency/vulnerable-package", "package.json", 1, "high"),
    }
    assert len({r["fingerprint"] for r in got}) == len(got) == 14
    assert {r["evidence"] for r in got if r["rule_id"] == "quality/unused-variable"} == {"var", "let $a = 2; let _b = 3; const y = 4;"}


def test_no_tests_at_all(spark):
    got = rules.testing(rows(spark, {k: v for k, v in SOURCES.items() if "test" not in k})).collect()
    assert [(r["rule_id"], r["path"], r["severity"]) for r in got] == [("testing/no-tests", None, "high")]
    assert rules.testing(rows(spark, {"a.py": "x"}).where("false")).count() == 0


def test_paths_of_four_edges(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long")
    node = lambda *k: spark.createDataFrame([(x,) for x in k], "node long")
    assert {tuple(r) for r in graph.paths(e, node(0), node(4, 5)).collect()} == {(0, 4, 4)}
