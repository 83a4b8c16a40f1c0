"""Registered queries of discovery, detectors, manifests and the index, over files made of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from repolith.operators import orchestration, rules
from repolith.plans.code import CODE, code
from repolith.plans.queries import query, read
from repolith.plans.repository import LANGUAGE, TEST
from repolith.shared import cut, shared_folder
from repolith.sources import files as SF
from repolith.sources import index, manifests

# every document is a file; a line that depends on its number is put after its text
_ENDS = (
    "'key AKIA' || upper(left(m, 16))", "'use ghp_' || m", "'x xoxb-' || left(m, 12)", "'sk_live_' || left(m, 24) || ' and npm_' || m", "'AIza' || m || 'abc'", "'sk-proj-' || m", "'SG.' || left(m, 20) || '.' || right(m, 20)",
    "'npm_' || m", "'eyJ' || left(m, 10) || '.eyJ' || left(m, 12) || '.' || m", "'see postgres://u:' || m || '@h/db'", "'password = changeme, password = ' || m", "'-----BEGIN PRIVATE KEY-----' || chr(10) || m || chr(10) || '-----END PRIVATE KEY-----'", "'secret: ${NAME}'", "'password: ghp_' || m",
)
_PICK = "CASE doc_id % 14 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_ENDS)) + " END"
_WORD = r"\b(?:password|passwd|pwd|secret|api[_-]?key|apikey|access[_-]?token|auth[_-]?token|client[_-]?secret|private[_-]?key|encryption[_-]?key|session[_-]?secret|webhook[_-]?secret|credential)s?\b\s*[:=]\s*[\"'`]?([^\s\"'`,;)}\]]{6,})[\"'`]?"
_MARKS = (
    ("aws-access-key", r"\b((?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16})\b"), ("github-token", r"\b((?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{16,})\b"), ("slack-token", r"\b(xox[abposr]-[A-Za-z0-9-]{10,})\b"), ("stripe-key", r"\b((?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,})\b"),
    ("google-api-key", r"\b(AIza[0-9A-Za-z_-]{35})\b"), ("openai-key", r"\b(sk-(?:proj-)?[A-Za-z0-9_-]{20,})\b"), ("sendgrid-key", r"\b(SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})\b"), ("npm-token", r"\b(npm_[A-Za-z0-9]{30,})\b"), ("jwt", r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})\b"),
    ("basic-auth-url", r"(?i)(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@]+:([^\s@/]{4,})@"), ("assigned-secret", "(?i)" + _WORD.replace("'", "''")),
)
_NONE = r"^(?:x{3,}|\*{3,}|\.{3,}|<[^>]*>?|\$\{[^}]*\}?|%[a-z_]+%|null|none|undefined|true|false|changeme|change[_-]?me|examples?|sample|placeholder|redacted|dummy|test|testing|fake|foo|bar|baz|your[_-].*|my[_-]?secret|todo|tbd|abc123|123456\d*)$"
_FOUND = "[" + ", ".join(f"{{'r': '{n}', 'v': list_filter(regexp_extract_all(s, '{p}', 1), lambda v: v <> '' AND NOT regexp_matches(lower(trim(v)), '{_NONE}'))}}" for n, p in _MARKS) + "]"


@query(
    f"""WITH d AS (SELECT doc_id, text, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents), t AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\btoken\\b', 'access_token', 'g') || chr(10) || {_PICK}, chr(10)) AS l FROM d),
 x AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS line FROM t), f AS (SELECT doc_id, line, s, list_filter({_FOUND}, lambda h: len(h.v) > 0) AS h FROM x),
 g AS (SELECT doc_id, line, unnest(CASE WHEN len(h) > 1 THEN list_filter(h, lambda y: y.r <> 'assigned-secret') ELSE h END).r AS name FROM f UNION ALL SELECT doc_id, line, 'private-key-block' FROM f WHERE s = '-----BEGIN PRIVATE KEY-----')
 SELECT doc_id, 'secret/' || name AS rule_id, CAST(line AS INTEGER) AS line FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY line) <= 5"""
)
def committed_secrets(spark, d):
    """Credentials in every document, the first five of a kind; a last line of each has one of fourteen forms."""
    t = read(spark, d, "documents").withColumn("m", F.md5(F.col("doc_id").cast("string").cast("binary")))
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"\btoken\b", "access_token"), F.lit("\n"), F.expr(_PICK))
    found = rules.secrets(t.select(F.col("doc_id").cast("string").alias("path"), text.alias("content")))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), "rule_id", F.col("line").cast("int").alias("line"))


_JOBS = (
    "on: pull_request_target", "    run: echo ${{ github.event.issue.title }}", "    - name: ${{ github.event.pull_request.body }}", "permissions: write-all", "permissions : read", "  contents:  write", "    run: curl https://x | sudo bash", "    script: wget -q x | sh",
    "    run: echo ${{ secrets.KEY }}", "    env: ${{ secrets.KEY }}", "prerun: make", "run : make", "# nothing",
)
_JOB_LINES = "[" + ", ".join("'" + x + "'" for x in _JOBS) + "]"


@query(
    f"""WITH w AS (SELECT p_partkey AS id, list_transform(range(4), lambda k: {_JOB_LINES}[1 + (p_partkey * (2 * k + 1) + k * k) % {len(_JOBS)}]) AS l FROM part WHERE p_partkey % 3 <> 0), c AS (SELECT id, l, array_to_string(l, chr(10)) AS text FROM w), x AS (SELECT id, text, unnest(l) AS s, generate_subscripts(l, 1) AS line FROM c),
 r AS (SELECT id, line, text, s, unnest(list_filter([CASE WHEN contains(s, 'pull_request_target') THEN 'pull-request-target' END, CASE WHEN regexp_matches(s, '\\$\\{{\\{{\\s*github\\.event\\.(comment|issue|pull_request|review)\\.(body|title)') AND (contains(text, 'run:') OR contains(text, 'script:')) THEN 'untrusted-context-interpolation' END,
 CASE WHEN regexp_matches(lower(s), 'permissions:\\s*write-all|contents:\\s*write') THEN 'excessive-permissions' END, CASE WHEN regexp_matches(s, 'curl.*\\|\\s*(sudo\\s+)?(ba)?sh|wget.*\\|\\s*(ba)?sh') THEN 'remote-script' END, CASE WHEN regexp_matches(s, 'secrets\\.\\w+') AND regexp_matches(s, 'echo |printenv|console\\.log') THEN 'secret-in-log' END], lambda v: v IS NOT NULL)) AS name FROM x WHERE NOT starts_with(trim(s), '#'))
 SELECT id, 'cicd/' || name AS rule_id, CAST(line AS INTEGER) AS line, CASE WHEN name = 'secret-in-log' THEN replace(trim(s), 'secrets.KEY', 'secrets.[redacted]') ELSE trim(s) END AS evidence FROM r UNION ALL SELECT id, 'cicd/missing-permissions', 1, '' FROM c WHERE NOT regexp_matches(text, 'permissions\\s*:')"""
)
def workflow_findings(spark, d):
    """Two of three parts as workflows of four lines."""
    id_ = F.col("p_partkey")
    all_ = F.array(*[F.lit(x) for x in _JOBS])
    text = F.array_join(F.array(*[F.get(all_, ((id_ * (2 * k + 1) + k * k) % len(_JOBS)).cast("int")) for k in range(4)]), "\n")
    path = F.concat(F.when(id_ % 3 == 0, "docs/").otherwise(".github/workflows/"), id_, F.lit(".yml"))
    f = read(spark, d, "part").select(path.alias("path"), F.lit("yaml").alias("language"), text.alias("content"))
    return rules.workflows(f).select(F.regexp_extract("path", r"([0-9]+)\.yml$", 1).cast("bigint").alias("id"), "rule_id", F.col("line").cast("int").alias("line"), F.trim("evidence").alias("evidence"))


@query(
    """WITH p AS (SELECT p_partkey AS id, 'k' || (p_partkey % 50) AS a, 'j' || (p_partkey % 7) AS b, '1.' || (p_partkey % 9) || '.' || (p_partkey % 4) AS v FROM part)
 SELECT id, 'npm' AS ecosystem, a AS name, '^' || v AS version_spec, v AS version, false AS is_dev, 3 AS line FROM p WHERE id % 3 = 0 UNION ALL SELECT id, 'npm', b, v, v, true, 5 FROM p WHERE id % 3 = 0
 UNION ALL SELECT id, 'PyPI', a, '==' || v, v, false, 2 FROM p WHERE id % 3 = 1 UNION ALL SELECT id, 'PyPI', b, '>=' || v, NULL, false, 4 FROM p WHERE id % 3 = 1
 UNION ALL SELECT id, 'PyPI', a, '==' || v, v, false, 3 FROM p WHERE id % 3 = 2 UNION ALL SELECT id, 'PyPI', b, '>=' || v, NULL, false, 3 FROM p WHERE id % 3 = 2 UNION ALL SELECT id, 'PyPI', 'm', '*', NULL, false, 4 FROM p WHERE id % 3 = 2
 UNION ALL SELECT id, 'PyPI', 'g', '^' || v, v, true, 8 FROM p WHERE id % 3 = 2"""
)
def manifest_dependencies(spark, d):
    """Every part as a manifest of one of three kinds."""
    id_ = F.col("p_partkey")
    p = read(spark, d, "part").select(id_.alias("id"), F.concat(F.lit("k"), id_ % 50).alias("a"), F.concat(F.lit("j"), id_ % 7).alias("b"), F.concat(F.lit("1."), id_ % 9, F.lit("."), id_ % 4).alias("v"))
    npm = F.format_string('{\n"dependencies": {\n"%s": "^%s"},\n"devDependencies": {\n"%s": "%s"}}', "a", "v", "b", "v")
    pip = F.format_string("# tools\n%s==%s  # x\n-r other.txt\n%s>=%s\n", "a", "v", "b", "v")
    toml = F.format_string('[project]\ndependencies = [  # "none"\n"%s==%s", \'%s[x]>=%s\',\n"m"]\nname = "no"\n[tool.poetry.group.dev.dependencies]\npython = "^3"\ng = "^%s"\n', "a", "v", "b", "v", "v")
    kind = F.col("id") % 3
    path = F.concat(F.lit("p"), "id", F.when(kind == 0, "/package.json").when(kind == 1, "/requirements.txt").otherwise("/pyproject.toml"))
    out = manifests.dependencies(p.select(path.alias("path"), F.when(kind == 0, npm).when(kind == 1, pip).otherwise(toml).alias("content")))
    return out.select(F.regexp_extract("manifest_path", "^p([0-9]+)", 1).cast("bigint").alias("id"), "ecosystem", "name", "version_spec", "version", "is_dev", F.col("line").cast("int").alias("line"))


_TOPS = ("", "node_modules/x/", "a/dist/", "dist.d/", ".venv/", "x/target", "b/coverage/c/")
_LASTS = ("", ".png", "/yarn.lock", ".min.JS", ".Wasm", "/go.sum.txt")


@query(
    f"""{CODE}, r AS (SELECT id, {list(_TOPS)}[1 + id % 7] || path || {list(_LASTS)}[1 + id % 6] AS path, content || CASE WHEN id % 11 = 0 THEN chr(1) || 'x' ELSE '' END AS content, id % 13 = 0 AS nul FROM code)
 SELECT id, path, {LANGUAGE} AS language, {TEST} AS is_test, CAST(octet_length(encode(content)) AS INTEGER) AS bytes, CAST(len(string_split(content, chr(10))) AS INTEGER) AS loc, left(sha256(content), 16) AS hash FROM r
 WHERE NOT nul AND octet_length(encode(content)) <= 260 AND NOT regexp_matches('/' || path, '/(node_modules|dist|\\.venv|target|coverage|build|vendor|out)/') AND regexp_extract(path, '[^/]*$') NOT IN ('yarn.lock', 'go.sum') AND NOT regexp_matches(lower(path), '\\.(png|wasm)$')"""
)
def discovered_files(spark, d):
    """Every part as a file, some in folders or with endings that discovery leaves out, some with a NUL or too long."""
    id_ = F.col("id")
    pick = lambda items, n: F.get(F.array(*[F.lit(x) for x in items]), (id_ % n).cast("int"))
    text = F.concat("content", F.when(id_ % 11 == 0, "\x01x").otherwise(""))
    raw = F.concat(F.encode(text, "UTF-8"), F.when(id_ % 13 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")))
    c = code(spark, d).select("id", F.concat(pick(_TOPS, 7), "path", pick(_LASTS, 6)).alias("path"), raw.alias("content"))
    f = SF.text_files(c.select("path", "content"), 260)
    return f.join(c.select("id", "path"), "path").select("id", "path", "language", "is_test", F.col("bytes").cast("int").alias("bytes"), F.col("loc").cast("int").alias("loc"), F.substring("content_hash", 1, 16).alias("hash"))


FOUND = StructType().add("path", StringType()).add("rule_id", StringType()).add("line", IntegerType()).add("confidence", DoubleType())


@query()
def detector_runs(spark, d):
    """All detectors of source code as jobs of their own over every part's code: status and findings of each."""
    f = code(spark, d).select("path", SF.language(F.col("path")).alias("language"), SF.is_test(F.col("path")).alias("is_test"), F.size(F.split("content", "\n")).alias("loc"), "content")
    # a small file of keys becomes many lines and words, which one task would hold if it were not dealt out
    f = f.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    of = {"secrets": rules.secrets, "security": rules.security, "quality": rules.quality, "testing": rules.testing, "workflows": rules.workflows}
    found, runs = orchestration.run_detectors(f, [orchestration.Detector(k, v) for k, v in of.items()], FOUND, deadline=600)
    n = found.groupBy(F.col("detector").alias("id")).agg(F.countDistinct("path").alias("files"))
    return runs.join(n, "id", "left").select("id", "status", "findings", F.coalesce("files", F.lit(0)).alias("files"), "message")


def _facts(f):
    """Imports of files by their own text; other tables are empty."""
    spark = f.sparkSession
    none = {k: spark.createDataFrame([], v) for k, v in index.FACTS.items()}
    i = f.select("path", F.explode(SF.relative_imports(F.col("content"))).alias("specifier")).select("path", "specifier", F.lit(1).alias("line"), F.array().cast("array<string>").alias("names"))
    return none | {"imports": i, "symbols": f.select("path", F.explode(SF.exports(F.col("content"))).alias("name"))}


_NEAR = "ltrim(list_reduce(string_split(dir || '/' || s, '/'), lambda a, x: CASE WHEN x IN ('.', '') THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END, ''), '/')"


@query(
    f"""{CODE}, named AS (SELECT id, 'm' || (id % 41) || '/' || ['lib/pay.ts', 'api/route.ts', 'late/index.js', 'x.tsx', 'a/b.ts'][1 + id % 5] AS place, content FROM code), f AS (SELECT id, place AS path, content FROM named QUALIFY row_number() OVER (PARTITION BY place ORDER BY id DESC) = 1), t AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, unnest(list_distinct(list_concat(regexp_extract_all(content, 'require\\(\\s*[''"](\\.[^''"]+)[''"]\\s*\\)', 1),
 list_concat(regexp_extract_all(content, 'import\\s+[^''"]*from\\s+[''"](\\.[^''"]+)[''"]', 1), regexp_extract_all(content, 'import\\s*\\(\\s*[''"](\\.[^''"]+)[''"]\\s*\\)', 1))))) AS s FROM f),
 c AS (SELECT path, s, {_NEAR} AS near FROM t), h AS (SELECT c.path, c.s, f.path AS target, list_position(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.mts', '.cts', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs'], substr(f.path, length(near) + 1)) AS pos FROM c JOIN f ON starts_with(f.path, near)),
 r AS (SELECT path, s, arg_min(target, pos) AS target FROM h WHERE pos > 0 GROUP BY 1, 2) SELECT DISTINCT 'imports' AS type, path AS from_key, target AS to_key FROM r WHERE target <> path"""
)
def indexed_edges(spark, d):
    """An index of part of the files, brought up to all of them and to their last contents: its edges are those of a new index."""
    path = F.concat(F.lit("m"), F.col("id") % 41, F.lit("/"), F.get(F.array(*[F.lit(x) for x in ("lib/pay.ts", "api/route.ts", "late/index.js", "x.tsx", "a/b.ts")]), (F.col("id") % 5).cast("int")))
    c = code(spark, d).select("id", path.alias("path"), "content")
    last = cut(c.groupBy("path").agg(F.max_by("content", "id").alias("content"), F.max("id").alias("id"), F.min_by("content", "id").alias("_old")))
    rows = lambda content: last.select("path", SF.language(F.col("path")).alias("language"), SF.is_test(F.col("path")).alias("is_test"), F.sha2(content, 256).alias("content_hash"), content.alias("content"), "id")
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.update(spark, root, rows(F.col("_old")).where("id % 4 <> 0"), _facts)
    index.update(spark, root, rows(F.col("content")), _facts)
    return index.current(spark, root)[1]["edges"].select("type", "from_key", "to_key")
