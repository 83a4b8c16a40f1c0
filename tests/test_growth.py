"""What operators keep and how they deal it out, where inputs have words, names and nodes that very many rows share."""

import random
import re

from repolith.operators import graph as G
from repolith.operators import intelligence as I
from repolith.operators import retrieval as R


def counted(monkeypatch, module):
    """Rows of the tables that a module cuts, as they are cut."""
    seen, cut = [], module.cut

    def count(df):
        out = cut(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(module, "cut", count)
    return seen


def test_files_and_tests_of_one_name_are_paired_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 8)
    paths, tests = [f"src/p{k}/main.ts" for k in range(60)] + ["lib/a.ts", "lib/b.ts"], [f"tests/p{k}/main.test.ts" for k in range(50)] + ["tests/a.spec.ts", "tests/x.test.ts"]
    imports = [(tests[0], paths[0]), (tests[0], "lib/b.ts"), ("tests/x.test.ts", "lib/b.ts"), ("tests/x.test.ts", "lib/b.ts"), ("src/p1/main.ts", "lib/a.ts")]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    d = I.covering_tests(table([(p,) for p in [*paths, paths[0]]], "path string"), table([(t,) for t in [*tests, tests[1]]], "test string"), table(imports, "src string, dst string"))
    got = [tuple(r) for r in d.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(p, t) for p in paths[:60] for t in tests[:50]} | {("lib/a.ts", "tests/a.spec.ts"), ("lib/b.ts", tests[0]), ("lib/b.ts", "tests/x.test.ts")}
    shares = d.where("path like '%main.ts'").groupBy(spark_partition()).count().collect()
    assert len(shares) > 3 and max(r["count"] for r in shares) < 0.6 * 3000


def test_blocks_of_tests_are_not_broadcast(spark):
    import __spark_entry__ as entry

    d = entry.queries()["covering_tests"](spark, "/root/testdata/sf0.01")
    assert "BroadcastExchange" not in d._jdf.queryExecution().executedPlan().toString()


def spark_partition():
    from pyspark.sql import functions as F

    return F.spark_partition_id().alias("task")


def test_a_word_that_all_titles_have_brings_few_findings(spark, monkeypatch):
    seen = counted(monkeypatch, R)
    r = random.Random(3)
    words = ["login", "log", "order_items", "a/b.ts", "zebra", "path-way", "x"]
    f = [(k, "common " + r.choice([" ", "-", "("]).join(r.sample(words, 2)).upper(), r.choice(["rule/one", "rule/common", None]), r.choice(["critical", "low", "info"]), r.choice(["p1", "p2", None]), r.choice(["open", "proposed", "resolved"])) for k in range(400)]
    q = [(k, " ".join(r.sample([*words, "common", "ommo", "rule", "none"], 2))) for k in range(40)] + [(90, ""), (91, None)]
    p = [(k, r.choice(["p1", "p2", "p3"])) for k in range(0, 40, 3)]
    got = R.relevant_findings(spark.createDataFrame(q, "question int, text string"), spark.createDataFrame(p, "question int, path string"), spark.createDataFrame(f, "id int, title string, rule_id string, severity string, path string, status string"))
    want = set()
    for k, text in q:
        said, own = [w for w in (text or "").split() if len(w) > 2], {x for n, x in p if n == k}
        fits = [x for x in f if x[5] != "resolved" and (x[4] in own or any(w in (t or "").lower() for w in said for t in x[1:3]) or not said and not own)]
        fits.sort(key=lambda x: (["critical", "high", "medium", "low", "info"].index(x[3]), x[4] or "", x[0]))
        want |= {(k, x[0], place) for place, x in enumerate(fits[:12], 1)}
    assert {tuple(x) for x in got.collect()} == want
    assert sum(seen) < 12 * 45


def test_nodes_that_many_starts_share_are_walked_once(spark, monkeypatch):
    seen = counted(monkeypatch, G)
    edges = [(f"s{k}", f"a{k % 3}") for k in range(40)] + [(f"a{k}", "hub") for k in range(3)] + [("hub", f"m{k}") for k in range(300)] + [(f"m{k}", f"t{k % 2}") for k in range(300)]
    edges += [("s1", "t0"), ("t0", "s1"), ("s2", "s1"), ("s1", "t0")]
    starts, targets = [f"s{k}" for k in range(40)], ["t0", "t1", "s1", "none"]
    table = lambda rows, name="node string": spark.createDataFrame([(x,) for x in rows], name)
    for hops in (4, 3, 1):
        del seen[:]
        got = [tuple(r) for r in G.paths(spark.createDataFrame(edges, "src string, dst string"), table(starts), table(targets), hops).collect()]
        want = set()
        for s in starts:
            far, front = {s: 0}, [s]
            for k in range(1, hops + 1):
                front = sorted({b for a, b in edges if a in front} - set(far))
                far |= dict.fromkeys(front, k)
            want |= {(s, t, far[t]) for t in targets if far.get(t)}
        assert set(got) == want and len(got) == len(want)
        assert hops < 4 or sum(seen) < 40 * 300 / 4


def test_paths_made_of_small_keys_are_not_broadcast(spark):
    from repolith.plans import repository as P

    tables = "/root/testdata/sf0.01"
    for d in (P.imports(spark, tables), P.covers(spark, tables), P.hits(spark, tables), *P.branded(spark, tables)):
        assert "BroadcastExchange" not in d._jdf.queryExecution().executedPlan().toString()


def shared_links():
    """(files, imports) with a node that all depend on, and a plain walk back from a file."""
    from .test_whole import ordered_walk

    e = {(f"src/f{k}.ts", f"src/f{(k * 3 + j) % 60}.ts") for k in range(60) for j in (1, 7)} | {(f"src/f{k}.ts", "lib/hub.ts") for k in range(60)}
    e = {(a, b) for a, b in e if a != b}
    return [f"src/f{k}.ts" for k in range(60)] + ["lib/hub.ts", "tests/alone.test.ts"], sorted(e), lambda o: ordered_walk(o, lambda n: sorted(a for a, b in e if b == n), 3, I.BLAST_NODES)


def test_a_walk_keeps_a_row_for_each_origin(spark, monkeypatch):
    seen = counted(monkeypatch, G)
    files, e, walk = shared_links()
    got = G.walks(spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame([(f,) for f in files], "origin string"), 3, I.BLAST_NODES)
    assert {r["origin"]: [(x["node"], x["depth"], x["via"], x["place"]) for x in r["reached"]] for r in got.collect()} == {f: walk(f) for f in files}
    assert max(seen) == len(files) and sum(len(walk(f)) for f in files) > 10 * len(files)


def test_previews_move_each_walk_once_a_change(spark):
    files, e, walk = shared_links()
    r = random.Random(5)
    changes = [(k, r.sample([*files, "gone.ts"], r.randrange(1, 6))) for k in range(80)] + [(90, []), (91, None), (92, ["gone.ts"]), (93, [files[3], files[3]]), (94, [*reversed(files)])]
    d = I.change_preview(spark.createDataFrame(changes, "change int, paths array<string>"), spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(e, "src string, dst string"))
    want = set()
    for c, paths in changes:
        paths, met = list(dict.fromkeys(paths or [])), {}
        for f in (f for f in paths[:50] if f in files):
            for node, depth, *_ in walk(f):
                met.setdefault(node, []).append(depth)
        want |= {(c, n, min(x), len(x)) for n, x in met.items() if n not in paths}
    got = [tuple(x) for x in d.collect()]
    assert set(got) == want and len(got) == len(want) and max(x[3] for x in want) > 1
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("hashpartitioning(change") == 1 and "LeftAnti" not in plan


def shuffled(spark):
    """Bytes that all stages of the session have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_previews_do_not_move_names_to_each_change(spark):
    r = random.Random(6)
    name = lambda: f"{r.getrandbits(1200):x}/f.ts"
    names, hubs = [name() for _ in range(100)], [name(), name()]
    e = [(n, h) for n, h in zip(names, hubs * 50)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    before = shuffled(spark)
    d = I.change_preview(table([(k, [hubs[k % 2]]) for k in range(400)], "change int, paths array<string>"), table([(n,) for n in [*names, *hubs]], "path string"), table(e, "src string, dst string"))
    assert {tuple(x) for x in d.collect()} == {(k, n, 1, 1) for k in range(400) for n in names[k % 2 :: 2]}
    assert shuffled(spark) - before < 400 * 50 * 300 / 4


def test_reached_files_meet_what_they_have_in_one_join(spark, tmp_path):
    files, e, walk = shared_links()
    reached = [(f, n, k, via, place) for f in files for n, k, via, place in walk(f)]
    spark.createDataFrame(reached, "origin string, node string, depth int, via string, place int").write.parquet(str(tmp_path / "reached"))
    typed = [("exposes_api", files[k], f"api:GET /x{k % 4}") for k in range(0, 60, 3)] + [("exposes_api", files[0], "api:POST /y"), ("uses_database", files[5], "db:t"), ("uses_database", files[6], "db:t"), ("tests", files[-1], files[1])]
    typed += [("tests", "tests/alone.test.ts", f) for f in files[:9]] + [("tests", f"tests/t{k}.test.ts", "lib/hub.ts") for k in range(3)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    d = I.affected(spark.read.parquet(str(tmp_path / "reached")), table([(f,) for f in [*files, files[0]]], "origin string"), table(typed, "type string, from_key string, to_key string"), table([(f,) for f in files], "path string"))
    want, least = set(), {}
    for o in files:
        for n in [o, *(x[0] for x in walk(o))]:
            own = n == o
            want |= {(o, "route", b[4:], n, own) for k, a, b in typed if k == "exposes_api" and a == n} | {(o, "database", b[3:], n, own) for k, a, b in typed if k == "uses_database" and a == n}
            several = [("test", a) for k, a, b in set(typed) if k == "tests" and b == n] + [("component", "root" if n.startswith("src") else {"lib/hub.ts": "root", "tests/alone.test.ts": "tests"}[n])]
            for part, label in several:
                least.setdefault((o, part, label), []).append((n, own))
            if not n.startswith("tests/") and not any(k == "tests" and b == n for k, a, b in typed):
                want.add((o, "untested", n, n, own))
    want |= {(*key, min(n for n, _ in x), any(own for _, own in x)) for key, x in least.items()}
    got = [tuple(r) for r in d.collect()]
    assert set(got) == want and len(got) == len(want) and {x[1] for x in want} == {"route", "database", "test", "component", "untested"}
    assert len(re.findall(r"Relation \[[^\]]*place", d._jdf.queryExecution().optimizedPlan().toString())) == 1
