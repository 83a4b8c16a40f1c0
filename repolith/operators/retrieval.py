"""What a question about a repository is answered from: facts, findings, sources within a budget, commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import paths as P
from repolith.functions import scalars as S
from repolith.shared import cut

# Packages that tell a framework.
FRAMEWORKS = {
    "next": "Next.js", "react": "React", "vue": "Vue", "svelte": "Svelte", "express": "Express", "fastify": "Fastify", "koa": "Koa", "@nestjs/core": "NestJS", "vitest": "Vitest", "jest": "Jest", "mocha": "Mocha",
    "drizzle_orm": "Drizzle ORM", "drizzle-orm": "Drizzle ORM", "prisma": "Prisma", "typeorm": "TypeORM", "sequelize": "Sequelize", "mongoose": "Mongoose", "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "pytest": "Pytest",
}
LANGUAGES, DIRECT, FINDINGS, COMMITS, SOURCES = 6, 40, 12, 200, 4
SOURCE_CHARS, FILE_CHARS = 6000, 512 * 1024
OPEN = ("open", "proposed")
#: Fixed value: the characters that words of a question are made of, as ``scalars.keywords`` gives them.
RUN = r"[a-z0-9_/.\-]"


def _first(d: DataFrame, by: str | list[str], most: int, *order: Column | str, name: str = "place") -> DataFrame:
    return d.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= most)


def latest_scans(scans: DataFrame) -> DataFrame:
    """(repo, scan): the newest completed scan of each repository; scans: (repo, scan, status, created)."""
    return scans.where("status = 'completed'").groupBy("repo").agg(F.max_by("scan", F.struct("created", "scan")).alias("scan"))


def repository_context(repos: DataFrame, scans: DataFrame, files: DataFrame, snapshots: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row a repository: (repo, scan, files, loc, health, languages, frameworks).

    repos: (repo); scans: (repo, scan, status, created); files: (scan, path, language, loc);
    snapshots: (repo, created, health); dependencies: (scan, name, is_direct).  Facts are those of
    the newest completed scan; without one there are no files.  Languages are the six of most
    files (ties by name), frameworks are told by the first forty direct dependencies by name.
    """
    last = latest_scans(scans)
    own = last.join(files, "scan")
    sizes = own.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))
    most = _first(own.where("language <> ''").groupBy("repo", "language").agg(F.count(F.lit(1)).alias("_n")), "repo", LANGUAGES, F.desc("_n"), "language")
    spoken = most.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "language"))), lambda x: x["language"]).alias("languages"))
    health = snapshots.groupBy("repo").agg(F.max_by("health", F.struct("created", "health")).alias("health"))
    direct = _first(last.join(dependencies.where("is_direct"), "scan"), "repo", DIRECT, "name")
    told = direct.groupBy("repo").agg(F.array_sort(F.array_compact(F.collect_set(S.lookup(F.lower("name"), FRAMEWORKS)))).alias("frameworks"))
    d = repos.select("repo").join(last, "repo", "left")
    for x in (sizes, health, spoken, told):
        d = d.join(x, "repo", "left")
    none = F.array().cast("array<string>")
    return d.select("repo", "scan", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("loc", F.lit(0)).alias("loc"), "health", F.coalesce("languages", none).alias("languages"), F.coalesce("frameworks", none).alias("frameworks"))


def relevant_findings(questions: DataFrame, paths: DataFrame, findings: DataFrame, most: int = FINDINGS) -> DataFrame:
    """(question, id, place): the open findings that fit each question, worst first.

    questions: (question, text); paths: (question, path), files found for it; findings: (id,
    title, rule_id, severity, path, status).  A finding fits if it is in one of the files, or if
    one of the question's words is in its title or its rule; to a question without either all fit.

    Words hold no character outside ``RUN``, so they meet the distinct runs of such characters, by
    their first three letters, and not titles.  Of a run, a word and a file only the first ``most``
    findings go on, as no later one can be among the first of a question: a word that many titles
    have costs no more than another.
    """
    order = (S.severity_rank("severity"), F.coalesce("path", F.lit("")), F.col("id"))
    f = findings.where(F.col("status").isin(*OPEN)).select("id", "title", "rule_id", "path", F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)]).alias("_order"))
    words = questions.select("question", F.explode(S.keywords(F.col("text"))).alias("word"))
    said = F.lower(F.concat_ws(" ", "title", "rule_id"))
    of_run = cut(_first(f.select("id", "_order", F.explode(F.array_distinct(F.regexp_extract_all(said, F.lit(f"({RUN}{{3,}})"))))).withColumnRenamed("col", "run"), "run", most, "_order").drop("place"))
    spots = of_run.select("run").distinct()
    spots = spots.select("run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 2), lambda k: F.substring(F.col("run"), k, F.lit(3))))).alias("_start"))
    met = words.select("word").distinct().withColumn("_start", F.substring("word", 1, 3)).join(spots, "_start").where(F.contains("run", F.col("word"))).select("word", "run")
    # a finding that has a word in several runs counts once
    of_word = _first(met.join(of_run, "run").select("word", "id", "_order").distinct(), "word", most, "_order").drop("place")
    by_word = words.join(of_word, "word").select("question", "id", "_order")
    of_path = _first(f.where("path is not null").select("path", "id", "_order"), "path", most, "_order").drop("place")
    by_path = paths.join(of_path, "path").select("question", "id", "_order")
    bare = questions.select("question").join(words.select("question").unionByName(paths.select("question")).distinct(), "question", "left_anti")
    first = f.orderBy("_order").limit(most).select("id", "_order")  # the same rows for every question without words
    fits = by_word.unionByName(by_path).distinct().unionByName(bare.join(F.broadcast(first), F.lit(True)).select("question", "id", "_order"))
    return _first(fits, "question", most, "_order").select("question", "id", "place")


def packed_sources(ranked: DataFrame, contents: DataFrame, most: int = SOURCES, chars: int = SOURCE_CHARS, budget: int | None = None) -> DataFrame:
    """(question, path, place, body, truncated): sources for each question, best first.

    ranked: (question, path, score); contents: (path, content).  Files without content are passed
    over; of each of the first ``most`` others the first ``chars`` characters count.  With a
    ``budget`` of characters a question's bodies end where their running length reaches it.
    """
    d = _first(ranked.join(contents.where("content <> ''"), "path"), "question", most, F.desc("score"), "path")
    d = d.withColumn("body", F.substring("content", 1, chars))
    if budget is not None:
        before = F.coalesce(F.sum(F.length("body")).over(Window.partitionBy("question").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        d = d.withColumn("_left", F.lit(budget) - before).where("_left > 0").withColumn("body", F.substring(F.col("body"), F.lit(1), F.col("_left").cast("int")))
    return d.select("question", "path", "place", "body", (F.length("body") < F.length("content")).alias("truncated"))


def opened_files(files: DataFrame, most: int = FILE_CHARS) -> DataFrame:
    """(path, content, truncated): files (path, content) as they may be shown: no unsafe path, the first ``most`` characters, credentials masked."""
    text = F.substring("content", 1, most)
    return files.where(P.safe(F.col("path")) & F.col("content").isNotNull()).select("path", S.redact_secrets(text).alias("content"), (F.length("content") > most).alias("truncated"))


def file_commits(commits: DataFrame, files: DataFrame, most: int = 20, last: int = COMMITS) -> DataFrame:
    """(path, sha, place, touches): the newest commits of each file (repo, path).

    commits: (repo, sha, authored, paths).  Of a repository the last 200 count; a file that none
    of them touches gets the newest of all.
    """
    recent = _first(commits, "repo", last, F.desc("authored"), F.desc("sha"), name="_k").select("repo", "sha", "_k", "paths")
    touched = recent.select("repo", "sha", "_k", F.explode(F.array_distinct("paths")).alias("path")).join(files, ["repo", "path"])
    touched = _first(touched, ["repo", "path"], most, "_k").withColumn("touches", F.lit(True))
    other = files.join(touched.select("repo", "path").distinct(), ["repo", "path"], "left_anti").join(recent.where(F.col("_k") <= most), "repo").withColumn("place", F.col("_k")).withColumn("touches", F.lit(False))
    cols = ("repo", "path", "sha", "place", "touches")
    return touched.select(*cols).unionByName(other.select(*cols))


def main_frameworks(tests: DataFrame) -> DataFrame:
    """(repo, framework): the framework of most test files (repo, framework), ties by name; rows without one count as one."""
    n = tests.groupBy("repo", "framework").agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy("repo").agg(F.min_by(F.struct("framework"), F.struct(-F.col("_n"), "framework")).alias("_f")).select("repo", "_f.framework")


def active_repositories(repos: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, repo): the repository asked for where the user has it, or else the first of theirs; none if they have none.

    repos: (user, repo, position); requests: (request, user, asked).
    """
    d = requests.join(repos, "user")
    return d.groupBy("request").agg(F.min_by("repo", F.struct((F.col("repo") != F.coalesce("asked", F.lit(""))).alias("other"), "position")).alias("repo"))


def usage_totals(requests: DataFrame, *keys: str) -> DataFrame:
    """One row a key: requests, successful, failed, median_ms, prompt_tokens, completion_tokens and fallbacks.

    requests: (status, duration_ms, prompt_tokens, completion_tokens, attempts), attempts an array
    of (provider, ...) that failed before.  A fallback is a request that succeeded after one.
    """
    ok = F.col("status") == "ok"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), S.median_rounded("duration_ms").alias("median_ms"), total("prompt_tokens"), total("completion_tokens"), F.count_if(ok & (F.size("attempts") > 0)).alias("fallbacks"))


def usage_by_provider(requests: DataFrame, *keys: str) -> DataFrame:
    """(keys, provider, count, failures): requests by the provider that answered, and the attempts that failed at each."""
    one = requests.where("provider is not null").select(*keys, "provider", F.lit(1).alias("_n"), F.lit(0).alias("_f"))
    bad = requests.select(*keys, F.explode("attempts").alias("_a")).select(*keys, F.col("_a.provider").alias("provider"), F.lit(0).alias("_n"), F.lit(1).alias("_f"))
    return one.unionByName(bad).groupBy(*keys, "provider").agg(F.sum("_n").alias("count"), F.sum("_f").alias("failures"))


def signal_inputs(repos: DataFrame, snapshots: DataFrame, findings: DataFrame, files: DataFrame, tested: DataFrame, dependencies: DataFrame, components: DataFrame, regressions: DataFrame) -> DataFrame:
    """What a repository's risk is told by, one row a repository, as ``scoring.repository_risk`` reads it.

    snapshots: (repo, created, health, critical, high, medium, low), the newest counts; findings:
    open ones (repo, category); files: testable ones (repo, path); tested: (repo, path);
    dependencies: (repo, vulnerabilities); components: (repo, level, sensitive); regressions: (repo).
    What a repository lacks is 0, its health null.
    """
    n = F.count(F.lit(1))
    newest = snapshots.groupBy("repo").agg(F.max_by(F.struct("health", "critical", "high", "medium", "low"), "created").alias("_s")).select("repo", "_s.*")
    covered = files.join(tested.distinct().withColumn("_tested", F.lit(True)), ["repo", "path"], "left")
    parts = (
        newest,
        findings.where("category = 'secrets'").groupBy("repo").agg(n.alias("secrets")),
        covered.groupBy("repo").agg(n.alias("files"), F.count_if(F.col("_tested").isNull()).alias("untested")),
        dependencies.where("vulnerabilities > 0").groupBy("repo").agg(n.alias("vulnerable")),
        components.groupBy("repo").agg(F.count_if(F.col("level").isin("high", "critical")).alias("risky"), F.count_if("sensitive").alias("sensitive")),
        regressions.groupBy("repo").agg(n.alias("regressions")),
    )
    d = repos.select("repo")
    for x in parts:
        d = d.join(x, "repo", "left")
    return d.fillna(0, ["critical", "high", "medium", "low", "secrets", "files", "untested", "vulnerable", "risky", "sensitive", "regressions"])


def signals(risks: DataFrame, recommended: DataFrame, events: DataFrame, ways: DataFrame, scans: DataFrame, most: int = 25) -> DataFrame:
    """(repo, risk, level, recommendations, events, confirmed, likely, potential, scan): what a guardian shows of each repository.

    risks: (repo, risk, level); recommended: (repo, id, weight), heavier ones first and then by id;
    events: (repo, event, at), the newest ``most``; ways: attack paths (repository, confidence);
    scans: (repo, scan, status, created).
    """
    weight = S.lookup("weight", {"high": 0, "medium": 1, "low": 2})
    listed = lambda d, order, value: d.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("_l"))
    told = listed(recommended.select("repo", weight.alias("_w"), "id"), "_w", "id").withColumnRenamed("_l", "recommendations")
    recent = listed(_first(events, "repo", most, F.desc("at"), F.desc("event")), "place", "event").withColumnRenamed("_l", "events")
    kinds = ways.groupBy(F.col("repository").alias("repo")).agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in ("confirmed", "likely", "potential")])
    d = risks.select("repo", "risk", "level")
    for x in (told, recent, kinds, latest_scans(scans)):
        d = d.join(x, "repo", "left")
    return d.fillna(0, ["confirmed", "likely", "potential"])
