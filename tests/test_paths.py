"""Ordered reach and attack paths against plain walks."""

import random

from repolith.operators import graph as G

from .test_whole import ordered_walk


def test_reach_equals_a_walk_by_levels(spark):
    r = random.Random(8)
    e = {(f"f{r.randrange(120)}", f"f{int(r.triangular(0, 119, 0))}") for _ in range(700)} | {(f"f{k}", "f7") for k in range(100)} | {("f3", "f3")}
    origins = [f"f{k}" for k in range(0, 120, 5)]
    edges, starts = spark.createDataFrame(sorted(e), "src string, dst string"), spark.createDataFrame([(o,) for o in origins], "origin string")
    for depth, most in ((3, 200), (3, 20), (2, 7), (4, 1)):
        want = {(o, *x) for o in origins for x in ordered_walk(o, lambda n: sorted(a for a, b in e if b == n and a != b), depth, most)}
        assert {tuple(x) for x in G.reachable(edges, starts, depth, most).collect()} == want and want
    assert G.reachable(edges.limit(0), starts).count() == 0 and G.reachable(edges, starts.limit(0)).count() == 0


def plain_paths(edges, findings, limit):
    links, routes, sensitive = {}, [], set()
    for _, kind, a, b in edges:
        if kind == "exposes_api":
            routes.append(a)
        elif kind == "uses_database":
            sensitive.add(a)
        elif kind in ("imports", "calls") and not b.startswith("pkg:"):
            a, b = a.split("#")[0], b.split("#")[0]
            links.setdefault(a, set()).add(b)
    found = []
    for start in sorted(set(routes)):
        queue, seen = [[start]], {start}
        while queue and len(found) < limit:
            way = queue.pop(0)
            if len(way) > 5:
                continue
            if len(way) > 1 and (way[-1] in sensitive or any(x.lower().startswith(w) for x in way[-1].split("/") for w in ("auth", "session", "login", "permission", "token", "admin"))):
                found.append(way)
            for n in sorted(links.get(way[-1], ())):
                if n not in seen and n != way[-1]:
                    seen.add(n)
                    queue.append([*way, n])
    out = []
    for way in found:
        ids = [i for h in way for _, i, p in sorted(findings, key=str) if p == h]
        near = any(p and p != h and p.startswith(h.split("/")[0]) for h in way for _, _, p in findings)
        out.append((0 if ids else 1 if near else 2, way, ids))
    out.sort(key=lambda x: x[0])
    return [(k, tuple(w), ("confirmed", "likely", "potential")[c], tuple(i)) for k, (c, w, i) in enumerate(out, 1)]


def test_attack_paths_equal_a_plain_walk(spark):
    r = random.Random(4)
    edges, findings = [], []
    for repo in ("a", "b", "c", "none"):
        names = [f"{r.choice(['src', 'srv', 'lib', 'web/auth', 'deep/x'])}/f{k}.ts" for k in range(40)] + ["top.ts", "srcs/only.ts"]
        for _ in range(90):
            a, b = r.choice(names), r.choice(names)
            edges.append((repo, r.choice(["imports", "calls"]), a + r.choice(["", "#g"]), b + r.choice(["", "#h"])))
        edges += [(repo, "exposes_api", n, "api:GET /" + n) for n in r.sample(names, 9)] + [(repo, "uses_database", n, "db:t") for n in r.sample(names, 4)]
        edges += [(repo, "depends_on", names[0], "pkg:x"), (repo, "imports", names[0], "pkg:auth"), (repo, "tests", names[1], names[2])]
        at = {"a": names[:12:3], "b": ["srcs/only.ts", "zzz/y.ts"], "c": ["sr", None], "none": []}[repo]
        findings += [(repo, k, p) for k, p in enumerate(at)] + [(repo, 90 + k, p) for k, p in enumerate(at[:2])]
    e = spark.createDataFrame(edges, "repository string, type string, from_key string, to_key string")
    f = spark.createDataFrame(findings, "repository string, id long, path string")
    kinds = set()
    for limit in (20, 3, 1000):
        got = {}
        for x in sorted(G.attack_paths(e, f, limit).collect(), key=lambda x: x["place"]):
            got.setdefault(x["repository"], []).append((x["place"], tuple(x["hops"]), x["confidence"], tuple(x["finding_ids"])))
        for repo in ("a", "b", "c", "none"):
            want = plain_paths([x for x in edges if x[0] == repo], [x for x in findings if x[0] == repo], limit)
            assert got.get(repo, []) == want
            kinds |= {x[2] for x in want}
    assert kinds == set(G.CLASSES)
    assert G.attack_paths(e.limit(0), f).count() == 0


def test_all_ways_of_a_repository_are_given(spark):
    names = [f"src/r{k:02}.ts" for k in range(30)]
    edges = [("a", "exposes_api", n, "api:GET /x") for n in names] + [("a", "imports", n, "src/db.ts") for n in names] + [("a", "imports", "src/db.ts", "lib/login.ts"), ("a", "uses_database", "src/db.ts", "db:t")]
    findings = [("a", k, n) for k, n in enumerate(names[::3])]
    got = [(x["place"], tuple(x["hops"]), x["confidence"], tuple(x["finding_ids"])) for x in G.attack_paths(spark.createDataFrame(edges, "repository string, type string, from_key string, to_key string"), spark.createDataFrame(findings, "repository string, id long, path string")).collect()]
    assert sorted(got) == plain_paths(edges, findings, 1000) and len(got) == 60


def test_the_query_leaves_no_way_out(spark):
    import __spark_entry__ as entry

    r = entry.queries()["attack_path_classes"](spark, "/root/testdata/sf0.01")
    assert max(x["count"] for x in r.groupBy("repository").count().collect()) > 20
