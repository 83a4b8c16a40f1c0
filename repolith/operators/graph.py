"""The code graph as an edge table: neighbours, bounded reachability, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.operators.resolution import resolved
from repolith.shared import cut


def key_kind(key: Column) -> Column:
    """package, route, table, symbol or file of an edge key."""
    return F.when(key.startswith("pkg:"), "package").when(key.startswith("api:"), "route").when(key.startswith("db:"), "table").when(key.contains("#"), "symbol").otherwise("file")


def file_of(key: Column) -> Column:
    """The file of a file or symbol key; null for other kinds."""
    return F.when(key_kind(key).isin("file", "symbol"), F.substring_index(key, "#", 1))


def file_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) between files from imports and calls, no self links."""
    d = edges.where(F.col("type").isin("imports", "calls")).select(file_of(F.col("from_key")).alias("src"), file_of(F.col("to_key")).alias("dst"))
    return d.where("src <> dst").distinct()


def dependents(edges: DataFrame) -> DataFrame:
    """(node, dependents): how many distinct sources point at each node."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("dependents"))


def hotspots(edges: DataFrame, most: int = 10) -> DataFrame:
    return dependents(edges).orderBy(F.desc("dependents"), "node").limit(most)


def reachable(edges: DataFrame, origins: DataFrame, depth: int = 3, most: int = 200) -> DataFrame:
    """(origin, node, depth, via, place): what depends on each origin, as a walk by levels finds it.

    edges: (src, dst), src depends on dst; origins: (origin).  Nodes come in the order of the
    node they were found from and then by name; ``via`` is the first that leads to them and
    ``place`` their number; the walk of an origin ends after ``depth`` steps or ``most`` nodes.
    """
    return walks(edges, origins, depth, most).select("origin", F.inline("reached")).select("origin", "node", "depth", "via", "place")


def walks(edges: DataFrame, origins: DataFrame, depth: int = 3, most: int = 200, tell_via: bool = True) -> DataFrame:
    """(origin, reached): ``reachable`` with one row an origin, its nodes as an array of (place, depth, via, node) in order of place.

    A step asks for the dependents of the nodes that the last one found, and an origin's row takes
    the answers in: of a node that was met before, or from several nodes, the first meeting counts.
    So a step moves a row for each node of the last, not one for each node and what it leads to.

    An origin that has its nodes takes no further part, and of a node's dependents the first
    2 * most + 1 suffice: all but ``most`` + 1 of them are new.  So rows are bounded, for a node
    that everything depends on too.  Without ``tell_via`` the names in ``via`` are left null, and not moved.
    """
    by_name = F.row_number().over(Window.partitionBy("via").orderBy("node"))
    back = edges.select(F.col("dst").alias("via"), F.col("src").alias("node")).distinct().withColumn("_k", by_name).where(F.col("_k") <= 2 * most + 1)
    back = cut(back.groupBy("via").agg(F.collect_list("node").alias("nodes")))
    kind = origins.schema["origin"].dataType.simpleString()
    reached = f"array<struct<place:int,depth:int,via:{kind},node:{kind}>>"
    state = origins.select("origin").distinct().withColumn("reached", F.array().cast(reached))
    for k in range(1, depth + 1):
        if k == 1:
            front = state.select("origin", F.lit(0).alias("place"), F.col("origin").alias("via"))
        else:
            front = state.where(F.size("reached") < most).select("origin", F.inline(F.filter("reached", lambda x: x["depth"] == k - 1))).select("origin", "place", F.col("node").alias("via"))
        told = F.col("via") if tell_via else F.lit(None).cast(kind)
        found = front.join(back, "via").groupBy("origin").agg(F.collect_list(F.struct("place", told.alias("via"), "nodes")).alias("_found"))
        d = state.join(found.hint("merge"), "origin", "left")
        meeting = lambda node, place, via: F.struct(node.alias("node"), place.alias("place"), via.cast(kind).alias("via"))
        known = F.transform(F.concat(F.array("origin"), F.transform("reached", lambda x: x["node"])), lambda n: meeting(n, F.lit(-1), F.lit(None)))
        fresh = F.flatten(F.transform("_found", lambda x: F.transform(x["nodes"], lambda n: meeting(n, x["place"], x["via"]))))
        # by name and then place, so that the first of a node's meetings is the one that counts
        d = d.withColumn("_met", F.when(F.col("_found").isNotNull(), F.sort_array(F.concat(known, fresh))))
        first = F.filter("_met", lambda x, i: (x["place"] >= 0) & ((i == 0) | ~F.get("_met", i - 1)["node"].eqNullSafe(x["node"])))
        new = F.slice(F.sort_array(F.transform(first, lambda x: F.struct(x["place"].alias("_from"), x["node"].alias("node"), x["via"].alias("via")))), F.lit(1), F.greatest(F.lit(most) - F.size("reached"), F.lit(0)))
        added = F.transform(new, lambda x, i: F.struct((F.size("reached") + i + 1).alias("place"), F.lit(k).alias("depth"), x["via"].alias("via"), x["node"].alias("node")))  # noqa: B023
        state = cut(d.select("origin", F.coalesce(F.concat("reached", added), "reached").cast(reached).alias("reached")))
    return state


def merged_impact(reached: DataFrame) -> DataFrame:
    """(node, depth, origins) over several origins: least depth, how many reach it."""
    return reached.groupBy("node").agg(F.min("depth").alias("depth"), F.countDistinct("origin").alias("origins"))


def paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, hops: int = 4) -> DataFrame:
    """(start, target, hops): least number of steps from each start to each target, up to ``hops``.

    Half of the steps are walked from the starts and half back from the targets, and both meet in one
    join: a longer way has a node at which its first half ends and the rest is left.  So what many
    starts share is walked once, and no pair of a start and a node that is no target is kept
    beyond half of the steps.
    """
    edges = cut(edges.select("src", "dst"))  # each step leaves out what is met twice, so links may repeat
    targets = targets.select("node").distinct()
    there = _steps(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")), starts.select(F.col("node").alias("start"), "node").distinct(), "start", hops - hops // 2)
    middle = there[-1].select("node").distinct()
    back = _steps(edges.select(F.col("dst").alias("node"), F.col("src").alias("to")), targets.select(F.col("node").alias("target"), "node"), "target", hops // 2, middle)
    near = there[0]
    for x in there[1:]:
        near = near.unionByName(x)
    met = near.join(targets, "node", "left_semi").where("hops > 0").select("start", F.col("node").alias("target"), "hops")
    for x in back[1:]:
        met = met.unionByName(there[-1].join(x.withColumnRenamed("hops", "_more"), "node").select("start", "target", (F.col("hops") + F.col("_more")).alias("hops")))
    # a start that is a target is at no distance from itself
    return met.where("start <> target").groupBy("start", "target").agg(F.min("hops").alias("hops"))


def _steps(edges: DataFrame, front: DataFrame, key: str, most: int, last: DataFrame | None = None) -> list[DataFrame]:
    """(key, node, hops) of the nodes that are first met after 0, 1 ... ``most`` steps along edges (node, to).

    last: the nodes (node) that count at the last step, if not all do.
    """
    out = [front.withColumn("hops", F.lit(0))]
    for k in range(1, most + 1):
        if last is not None and k == most:
            edges = edges.join(last.withColumnRenamed("node", "to"), "to", "left_semi")
        new = out[-1].join(edges, "node").select(key, F.col("to").alias("node")).distinct()
        for x in out:
            new = new.join(x.select(key, "node"), [key, "node"], "left_anti")
        out.append(cut(new.withColumn("hops", F.lit(k))))
    return out


#: Files that stand for access rights, by their path; fixed values.
AUTH_PATH = r"(?i)(^|/)(auth|session|login|permission|token|admin)"
CLASSES = ("confirmed", "likely", "potential")


def shortest_paths(links: DataFrame, starts: DataFrame, targets: DataFrame, nodes: int = 5) -> DataFrame:
    """(repository, start, node, hops): the way of a walk by levels from each start to each target that it comes to.

    links: (repository, src, dst); starts, targets: (repository, node).  A start visits a node once,
    by the first shortest way (neighbours in order of name); ``hops`` are its nodes, two to ``nodes``.
    """
    links = cut(links.where("src <> dst").select("repository", F.col("src").alias("node"), "dst").distinct())
    targets = cut(targets.select("repository", "node").distinct())
    front = starts.select("repository", F.col("node").alias("start"), "node").distinct().withColumn("hops", F.array("node"))
    seen, found = front.select("repository", "start", "node"), None
    key = ["repository", "start", "node"]
    for k in range(1, nodes):
        if k == nodes - 1:  # nothing goes on from here
            links = links.join(targets.withColumnRenamed("node", "dst"), ["repository", "dst"], "left_semi")
        step = front.join(links, ["repository", "node"]).groupBy("repository", "start", F.col("dst").alias("node")).agg(F.min("hops").alias("hops"))
        step = step.join(seen.hint("merge"), key, "left_anti").select(*key, F.concat("hops", F.array("node")).alias("hops"))
        front = cut(step)
        hits = front.join(targets, ["repository", "node"], "left_semi").select(*key, "hops")
        seen, found = seen.unionByName(front.select(*key)), hits if found is None else found.unionByName(hits)
    return found


def attack_paths(edges: DataFrame, findings: DataFrame, most: int | None = None, nodes: int = 5) -> DataFrame:
    """(repository, place, hops, confidence, finding_ids): ways from files with routes to sensitive files.

    edges: (repository, type, from_key, to_key); findings: (repository, id, path).  Sensitive are
    files that use a database or whose path speaks of access.  A way is confirmed where findings
    are in its files (their ids by hop and id), likely where some are in a file whose path starts
    with the first folder of a hop, else potential; ``place`` orders by that, then by start, length
    and names.  All ways are given, or of a repository the first ``most`` as found.
    """
    file = lambda key: file_of(F.col(key))
    of = lambda kind, target: edges.where((F.col("type") == kind) & (key_kind(F.col("to_key")) == target)).select("repository", file("from_key").alias("node")).where("node is not null")
    links = edges.where(F.col("type").isin("imports", "calls")).select("repository", file("from_key").alias("src"), file("to_key").alias("dst")).where("src is not null and dst is not null")
    named = links.select("repository", F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").rlike(AUTH_PATH))
    ways = shortest_paths(links, of("exposes_api", "route"), of("uses_database", "table").unionByName(named), nodes)
    as_found = (F.size("hops"), F.col("hops"))
    if most is not None:
        ways = ways.withColumn("_k", F.row_number().over(Window.partitionBy("repository").orderBy("start", *as_found))).where(F.col("_k") <= most).drop("_k")
    ways, key = cut(ways), ["repository", "start", "node"]
    f = findings.where("path is not null").select("repository", "path", F.col("id"))
    of_file = f.groupBy("repository", "path").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    met = ways.select(*key, F.posexplode("hops").alias("_at", "path")).join(of_file, ["repository", "path"])
    on = met.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_ids"))), lambda x: x["_ids"])).alias("finding_ids"))
    # folders that some finding's path starts with, letter by letter: an equi-join in place of a prefix join
    first = lambda path: F.substring_index(path, "/", 1)
    begun = f.select("repository", first("path").alias("_first")).distinct().select("repository", F.explode(F.transform(F.sequence(F.lit(0), F.length("_first")), lambda n: F.substring(F.col("_first"), F.lit(1), n))).alias("_start")).distinct()
    beside = ways.select(*key, F.explode(F.array_distinct(F.transform("hops", first))).alias("_start")).join(begun, ["repository", "_start"], "left_semi").select(*key).distinct().withColumn("_beside", F.lit(True))
    d = ways.join(on, key, "left").join(beside.hint("merge"), key, "left")
    d = cut(d.select("repository", "start", "hops", "finding_ids", F.when(F.col("finding_ids").isNotNull(), 0).when(F.col("_beside"), 1).otherwise(2).alias("_rank")))
    # a way's place is its number among those of its start and class, behind all of those before them: no task sorts a whole repository
    group = ["repository", "_rank", "start"]
    before = F.sum("_n").over(Window.partitionBy("repository").orderBy("_rank", "start").rowsBetween(Window.unboundedPreceding, -1))
    sizes = d.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).select(*group, F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*group).orderBy(*as_found))
    none = F.array().cast(on.schema["finding_ids"].dataType)
    return d.join(sizes, group).select("repository", place.cast("int").alias("place"), "hops", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("_rank") + 1).alias("confidence"), F.coalesce("finding_ids", none).alias("finding_ids"))


def component_edges(edges: DataFrame, members: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(a, b, n): links between components; both ends must belong to one, not the same.

    ``targets``: members that links point at, where they are a table of their own.
    """
    s = members.select(F.col("node").alias("src"), F.col("component").alias("a"))
    d = (members if targets is None else targets).select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return edges.join(s, "src").join(d, "dst").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def untested(files: DataFrame, covered: DataFrame) -> DataFrame:
    """Files that no test covers."""
    return files.join(covered.select("node").distinct(), "node", "left_anti")


def package_of(specifier: Column, language: Column) -> Column:
    """The package of an import from outside, null for one from within (``.``, ``@/`` and ``~/``)."""
    scoped = F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))
    inner = specifier.rlike(r"^(?:\.|[@~]/)") | (specifier == "")
    return F.when(~inner, F.when(language == "python", F.substring_index(specifier, ".", 1)).otherwise(scoped))


def built_edges(files: DataFrame, imports: DataFrame, routes: DataFrame, uses: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (type, from_key, to_key, confidence, line) from what parsers found; of equal ones the first by line.

    files: (path, language, is_test); imports: (path, specifier, line, names); routes:
    (path, method, route, line); uses: (path, target, via, line); calls: (path, enclosing,
    receiver, callee, line); symbols: (path, name).  A call goes to an imported name, or to
    an imported receiver's member (probable), or to a symbol of its own file; else it is no
    edge.  Of several imports that bring one name the first by target counts.  Imports by the
    aliases ``@/`` and ``~/`` are resolved as ``resolution.graph_candidates`` says.
    """
    own = imports.join(files.select("path", "language"), "path").withColumn("package", package_of(F.col("specifier"), F.col("language")))
    edge = lambda d, kind, source, target, confidence="certain": d.select(F.lit(kind).alias("type"), source.alias("from_key"), target.alias("to_key"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"), "line")
    path = F.col("path")
    out = edge(own.where("package is not null"), "depends_on", path, F.concat(F.lit("pkg:"), "package"))
    inner = own.where("package is null")
    found = inner.join(resolved(inner.select("path", "specifier", "language"), files), ["path", "specifier"])
    out = out.unionByName(edge(found, "imports", path, F.col("target")))
    plain = files.where("not is_test").select(F.col("path").alias("target"))
    tests = found.join(files.where("is_test").select("path"), "path", "left_semi").join(plain, "target", "left_semi")
    out = out.unionByName(edge(tests, "tests", path, F.col("target")))
    out = out.unionByName(edge(routes, "exposes_api", path, F.concat(F.lit("api:"), "method", F.lit(" "), "route")))
    out = out.unionByName(edge(uses, "uses_database", path, F.concat(F.lit("db:"), "target"), F.when(F.col("via") == "client", "probable").otherwise("certain")))
    brought = found.select("path", "target", F.explode("names").alias("name")).groupBy("path", "name").agg(F.min("target").alias("target"))
    by = lambda name, target: brought.select("path", F.col("name").alias(name), F.col("target").alias(target))
    local = symbols.select("path", F.col("name").alias("callee"), F.lit(True).alias("_local")).distinct()
    c = calls.join(by("receiver", "_member"), ["path", "receiver"], "left").join(by("callee", "_called"), ["path", "callee"], "left").join(local, ["path", "callee"], "left")
    at = F.coalesce("_member", "_called", F.when(F.col("receiver").isNull() & F.col("_local"), F.col("path")))
    source = F.when(F.col("enclosing").isNotNull(), F.concat("path", F.lit("#"), "enclosing")).otherwise(F.col("path"))
    c = c.withColumn("_at", at).where("_at is not null")
    out = out.unionByName(edge(c, "calls", source, F.concat("_at", F.lit("#"), "callee"), F.when(F.col("_member").isNotNull(), "probable").otherwise("certain")))
    first = F.min_by(F.struct("confidence", "line"), F.struct("line", "confidence"))
    return out.groupBy("type", "from_key", "to_key").agg(first.alias("_f")).select("type", "from_key", "to_key", "_f.*")
