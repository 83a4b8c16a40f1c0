"""Registered queries over source code made of the driver's tables: a part is a file, its numbers pick its lines.

The SQL beside each query spells its patterns out from the rules as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions import answers, signing
from repolith.operators import findings as FI
from repolith.operators import resolution
from repolith.plans.queries import FINDINGS, findings, query, read
from repolith.plans.repository import FILES, files
from repolith.sources import files as SF
from repolith.streaming import events

SNIPPETS = (
    "import { it } from 'vitest';", "const a = require('./lib/pay');", "import b, { c } from '../api/route'", "const d = await import('./late')", "from .models import User", "import pytest", "class Case(unittest.TestCase):", "jest.mock('./x')",
    "it('adds', () => { expect(a).toBe(1) })", "test.each([1, 2])('t', f)", "def test_money():", "  assert total == 3", "func TestSum(t *testing.T) {", "export async function pay(x) {", "export const rate = 3", "export interface _Hidden {}", "module.exports.go = 1",
    "module.exports = { one, two: 2, _three, 'four': 4 }", "def run(a):", "class Store:", "if (a && b || c) { x = y ? 1 : z ?? 2 }", "else if (q) { for (;;) {} }", "while True: pass", "switch (k) { case 1: break }", "try { f() } catch (e) {}", "elif x:", "// nothing", "",
)
PICKS = 9


def _texts(column: str) -> str:
    picks = ", ".join(f"s[1 + ({column} * {3 + 2 * k} + {k * k}) % {len(SNIPPETS)}]" for k in range(PICKS))
    lines = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in SNIPPETS) + "]"
    return f"(SELECT array_to_string([{picks}], chr(10)) FROM (SELECT {lines} AS s))"


CODE = f"{FILES}, code AS (SELECT id, path, {_texts('id')} AS content FROM files)"


def code(spark: SparkSession, d: str) -> DataFrame:
    """(id, path, content) of every part."""
    all_ = F.array(*[F.lit(x) for x in SNIPPETS])
    picks = [F.get(all_, ((F.col("id") * (3 + 2 * k) + k * k) % len(SNIPPETS)).cast("int")) for k in range(PICKS)]
    return files(spark, d).select("id", "path", F.array_join(F.array(*picks), "\n").alias("content"))


def _all_matches(patterns: tuple[str, ...]) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all(content, '{p}', 1)" for p in patterns) + "])"


_Q = "['\"]"
_IMPORTED = _all_matches((rf"require\(\s*{_Q}(\.[^'\"]+){_Q}\s*\)".replace("'", "''"), rf"import\s+[^'\"]*from\s+{_Q}(\.[^'\"]+){_Q}".replace("'", "''"), rf"import\s*\(\s*{_Q}(\.[^'\"]+){_Q}\s*\)".replace("'", "''"), r"from\s+(\.[\w.]+)\s+import"))
_GIVEN = _all_matches((r"export\s+(?:async\s+)?function\s+(\w+)", r"export\s+(?:const|let|var|class|interface|type|enum)\s+(\w+)", r"module\.exports\.(\w+)\s*=", r"exports\.(\w+)\s*=", r"(?m)^def\s+(\w+)\s*\(", r"(?m)^class\s+(\w+)"))


def _in_order(list_: str) -> str:
    return f"list_filter({list_}, lambda x, i: list_position({list_}, x) = i)"


@query(
    f"""{CODE}, m AS (SELECT *, {_IMPORTED} AS im, list_concat(list_filter({_GIVEN}, lambda x: NOT starts_with(x, '_')), list_filter(list_transform(string_split(regexp_extract(content, 'module\\.exports\\s*=\\s*\\{{([^}}]*)\\}}', 1), ','), lambda x: trim(string_split(x, ':')[1])), lambda x: regexp_matches(x, '^\\w+$'))) AS ex FROM code)
 SELECT id, CASE WHEN regexp_matches(content, 'from\\s+[''"]vitest[''"]|require\\([''"]vitest[''"]\\)') THEN 'vitest' WHEN regexp_matches(content, '@jest/globals|jest\\.(?:mock|fn|spyOn)\\s*\\(') THEN 'jest' WHEN regexp_matches(content, 'require\\([''"]mocha[''"]\\)|from\\s+[''"]mocha[''"]') THEN 'mocha'
 WHEN regexp_matches(content, 'import\\s+pytest|from\\s+pytest\\s+import') THEN 'pytest' WHEN regexp_matches(content, 'import\\s+unittest|unittest\\.TestCase') THEN 'unittest' WHEN regexp_matches(content, 'func\\s+Test\\w+\\s*\\(\\s*t\\s+\\*testing\\.T') THEN 'go test' END AS framework,
 len(regexp_extract_all(content, '\\b(?:it|test)\\s*(?:\\.\\w+)*\\s*(?:\\([^()]*\\)|`[^`]*`)?\\s*\\(\\s*[''"`]|\\bdef\\s+test_\\w+\\s*\\(|\\bfunc\\s+Test\\w+\\s*\\(')) AS cases, regexp_matches(content, '\\bexpect\\s*\\(|\\bassert\\b|\\bshould\\b|\\bt\\.(?:Error|Fatal)\\b') AS asserts,
 array_to_string({_in_order('im')}, ' ') AS imports, array_to_string({_in_order('ex')}, ' ') AS exports, 1 + len(regexp_extract_all(content, '\\b(?:if|else\\s+if|elif|for|while|case|catch|except)\\b|&&|\\|\\||\\?\\?|\\?[^.:]')) AS complexity FROM m"""
)
def test_facts(spark, d):
    """What the text of each file tells of tests, imports, exports and branches."""
    r = SF.test_facts(code(spark, d))
    return r.select("id", "framework", F.col("cases").cast("long").alias("cases"), "asserts", F.array_join("imports", " ").alias("imports"), F.array_join("exports", " ").alias("exports"), F.col("complexity").cast("long").alias("complexity"))


_PLAIN = "ltrim(list_reduce(string_split({x}, '/'), lambda a, x: CASE WHEN x IN ('.', '') THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END, ''), '/')"
_POSIX = """(CASE WHEN starts_with({x}, '/') THEN list_reduce(string_split({x}, '/'), lambda a, x: CASE WHEN x IN ('.', '') THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END, '')
 ELSE ltrim(list_reduce(string_split({x}, '/'), lambda a, x: CASE WHEN x IN ('.', '') THEN a WHEN x = '..' AND a <> '' AND NOT ends_with(a, '/..') THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END, ''), '/') END)"""
_SPECS = f"""{FILES}, pair AS (SELECT a.id, a.path, b.path AS to_, regexp_replace(b.path, '\\.[^./]*$', '') AS bare, len(string_split(a.path, '/')) - 1 AS deep, regexp_replace(a.path, '/?[^/]*$', '') AS dir FROM files a, n, files b WHERE b.id = 1 + (a.id * 3 + a.loc) % n),
 spec AS (SELECT path, dir, CASE id % 7 WHEN 0 THEN '@/' || regexp_replace(bare, '^src/', '') WHEN 1 THEN '~/' || bare WHEN 2 THEN './' || repeat('../', deep) || bare WHEN 3 THEN repeat('../', deep) || './' || to_ WHEN 4 THEN replace(bare, '/', '.') WHEN 5 THEN repeat('.', deep + 1) || replace(bare, '/', '.') ELSE './' || string_split(bare, '/')[-1] END AS s, CASE WHEN id % 7 IN (4, 5) THEN 'python' ELSE 'typescript' END AS language FROM pair)"""
_SCRIPT = "['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.mts', '.cts', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs']"


def _named(bases: str, endings: str) -> str:
    return f"flatten(list_transform({bases}, lambda b: list_transform({endings}, lambda e: b || e)))"


@query(
    f"""{_SPECS}, own AS (SELECT *, CASE WHEN dir = '' THEN s ELSE dir || '/' || s END AS rel, length(regexp_extract(s, '^\\.*')) AS dots, replace(regexp_replace(s, '^\\.+', ''), '.', '/') AS module FROM spec),
 bases AS (SELECT *, {_PLAIN.format(x="rel")} AS near, array_to_string(list_slice(string_split(dir, '/'), 1, len(string_split(dir, '/')) - dots + 1), '/') AS up FROM own),
 python AS (SELECT *, CASE WHEN dots > 0 THEN [{_PLAIN.format(x="up || '/' || module")}] ELSE [module, 'src/' || module, 'app/' || module, 'lib/' || module] END AS p FROM bases),
 cand AS (SELECT 'graph' AS resolver, path, s, CASE WHEN language = 'python' THEN flatten(list_transform(list_filter(p, lambda b: b <> ''), lambda b: list_filter([b || '.py', b || '/__init__.py', b, CASE WHEN contains(b, '/') THEN regexp_replace(b, '/[^/]*$', '') || '.py' END], lambda x: x IS NOT NULL)))
 WHEN starts_with(s, '.') THEN {_named('[near]', _SCRIPT)} WHEN starts_with(s, '@/') THEN {_named("['src/' || substr(s, 3), substr(s, 3)]", _SCRIPT)} WHEN starts_with(s, '~/') THEN {_named('[substr(s, 3)]', _SCRIPT)} ELSE [] END AS c FROM python
 UNION ALL SELECT 'history', path, s, CASE WHEN starts_with(s, '.') THEN {_named('[near]', "['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.js']")} ELSE [] END FROM bases
 UNION ALL SELECT 'tests', path, s, {_named(f"[{_POSIX.format(x='rel')}]", "['', '.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx', '.py', '/index.js', '/index.ts', '/__init__.py']")} FROM own),
 each_ AS (SELECT resolver, path, s, unnest(c) AS target, generate_subscripts(c, 1) AS pos FROM cand), hit AS (SELECT e.resolver, e.path, s, arg_min(target, pos) AS target FROM each_ e JOIN files f ON f.path = target GROUP BY 1, 2, 3)
 SELECT resolver, path, s AS specifier, target FROM hit WHERE resolver <> 'graph' OR target <> path"""
)
def import_targets(spark, d):
    """Imports of every file by name, alias and module, as each of the three resolvers takes them."""
    f = files(spark, d)
    other = f.select(F.col("id").alias("_b"), F.col("path").alias("to"))
    deep = F.size(F.split("path", "/")) - 1
    p = f.withColumn("_b", 1 + (F.col("id") * 3 + F.col("loc")) % f.count()).join(other, "_b").withColumns({"bare": F.regexp_replace("to", r"\.[^./]*$", ""), "deep": deep})
    up, dotted, kind = F.expr("repeat('../', deep)"), F.regexp_replace("bare", "/", "."), F.col("id") % 7
    spec = F.when(kind == 0, F.concat(F.lit("@/"), F.regexp_replace("bare", "^src/", ""))).when(kind == 1, F.concat(F.lit("~/"), "bare")).when(kind == 2, F.concat(F.lit("./"), up, "bare")).when(kind == 3, F.concat(up, F.lit("./"), "to"))
    spec = spec.when(kind == 4, dotted).when(kind == 5, F.concat(F.expr("repeat('.', deep + 1)"), dotted)).otherwise(F.concat(F.lit("./"), F.element_at(F.split("bare", "/"), -1)))
    specs = p.select("path", spec.alias("specifier"), F.when(kind.isin(4, 5), "python").otherwise("typescript").alias("language"))
    out = [resolution.resolved(specs, f, r).select(F.lit(r).alias("resolver"), "path", "specifier", "target") for r in resolution.RESOLVERS]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    FINDINGS
    + """, s AS (SELECT DISTINCT repo, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY day) AS n, lead(day) OVER (PARTITION BY repo ORDER BY day) AS next FROM s), d AS (SELECT DISTINCT repo, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, rule_id || ' ' || (user_id % 3) AS fingerprint FROM f),
 p AS (SELECT d.*, n, next, lag(n) OVER (PARTITION BY d.repo, fingerprint ORDER BY n) AS before FROM d JOIN o USING (repo, day)), e AS (SELECT *, sum(CASE WHEN before = n - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY repo, fingerprint ORDER BY n) AS episode FROM p)
 SELECT repo, fingerprint, CAST(episode AS INTEGER) AS episode, min(day) AS first_seen, max(day) AS last_seen, count(*) AS scans, arg_max(coalesce(next, ''), n) AS resolved_at FROM e GROUP BY repo, fingerprint, episode"""
)
def finding_episodes(spark, d):
    """Every day of a repository's events is a scan; a finding that a day lacks and a later one has starts over."""
    f = findings(spark, d).withColumn("at", F.to_date("ts").cast("string")).withColumn("fingerprint", F.concat("rule_id", F.lit(" "), F.col("user_id") % 3))
    r = FI.episodes(f.select("repo", F.col("at").alias("scan"), "fingerprint"), f.select("repo", F.col("at").alias("scan"), "at"))
    return r.withColumn("resolved_at", F.coalesce("resolved_at", F.lit("")))


_ANSWER = """SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN '  {"turn": ' || turn || ', "ok": true}' || chr(10) WHEN 1 THEN 'Sure.' || chr(10) || '```json' || chr(10) || '{"turn": ' || turn || '}' || chr(10) || '```' || chr(10) || '{no}' WHEN 2 THEN 'The answer {"turn": ' || turn || ', "n": {"k": [1]}} follows.' WHEN 3 THEN '{"turn": ' || turn || '} and {"turn": 0}' WHEN 4 THEN '[' || turn || ', null]' ELSE coalesce(text, '') END AS answer FROM conversations"""


@query(
    f"""WITH a AS ({_ANSWER}), t AS (SELECT *, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS whole FROM a), c AS (SELECT *, trim(regexp_extract(whole, '(?s)```(?:json)?\\s*(.*?)```', 1), ' ' || chr(10) || chr(13) || chr(9)) AS fenced, CASE WHEN contains(whole, '{{') AND length(whole) - strpos(reverse(whole), '}}') + 1 > strpos(whole, '{{') AND contains(whole, '}}') THEN substr(whole, strpos(whole, '{{'), length(whole) - strpos(reverse(whole), '}}') + 2 - strpos(whole, '{{')) END AS braced FROM t),
 p AS (SELECT *, CASE WHEN json_valid(whole) THEN whole WHEN fenced <> '' AND json_valid(fenced) THEN fenced WHEN json_valid(braced) THEN braced END AS part FROM c) SELECT conv_id, turn, part, CASE WHEN part LIKE '{{%' THEN json_extract_string(part, '$.turn') END AS said FROM p"""
)
def loose_answers(spark, d):
    """JSON in answers made of the turns: bare, fenced, in prose, doubled, as a list, and the turns themselves."""
    t = F.col("turn").cast("string")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    a = F.when(kind == 0, F.concat(F.lit('  {"turn": '), t, F.lit(', "ok": true}\n'))).when(kind == 1, F.concat(F.lit('Sure.\n```json\n{"turn": '), t, F.lit("}\n```\n{no}"))).when(kind == 2, F.concat(F.lit('The answer {"turn": '), t, F.lit(', "n": {"k": [1]}} follows.')))
    a = a.when(kind == 3, F.concat(F.lit('{"turn": '), t, F.lit('} and {"turn": 0}'))).when(kind == 4, F.concat(F.lit("["), t, F.lit(", null]"))).otherwise(F.coalesce("text", F.lit("")))
    r = read(spark, d, "conversations").withColumn("answer", a)
    return r.select("conv_id", "turn", answers.json_part(F.col("answer")).alias("part"), F.try_variant_get(answers.loose_json(F.col("answer")), "$.turn", "string").alias("said"))


_GATES = """r AS (SELECT 'r' || s_suppkey AS repo, s_suppkey % 7 <> 0 AS enabled, s_suppkey % 5 <> 0 AS on_push, s_suppkey % 3 <> 0 AS on_pull, CASE WHEN s_suppkey % 2 = 0 THEN 'main' ELSE 'trunk' END AS branch FROM supplier)"""


@query(
    f"""WITH {_GATES}, e AS (SELECT event_id AS id, user_id, ['push', 'pull_request', 'check_run', 'push', 'ping'][1 + event_id % 5] AS event, 'r' || (1 + user_id % (SELECT max(s_suppkey) + 3 FROM supplier)) AS repo,
 CASE WHEN event_id % 11 = 0 THEN repeat('0', 40) ELSE 'c' || event_id END AS sha, CASE event_id % 4 WHEN 0 THEN 'refs/tags/v1' WHEN 1 THEN 'refs/heads/trunk' ELSE 'refs/heads/main' END AS ref, event_id % 13 = 0 AS deleted, ['opened', 'closed', 'ready_for_review', 'rerequested'][1 + (event_id // 5) % 4] AS action, event_id % 6 = 0 AS draft, CASE WHEN event_id % 9 <> 0 THEN event_id END AS number FROM events),
 j AS (SELECT e.*, r.repo IS NULL AS missing, coalesce(enabled, true) AS enabled, coalesce(on_push, true) AS on_push, coalesce(on_pull, true) AS on_pull, coalesce(branch, 'main') AS branch FROM e LEFT JOIN r USING (repo)),
 k AS (SELECT *, CASE WHEN event = 'push' THEN CASE WHEN deleted THEN 'branch-deleted' WHEN regexp_matches(sha, '^0+$') THEN 'no-commit' WHEN missing THEN 'not-connected' WHEN NOT enabled THEN 'disabled' WHEN NOT on_push THEN 'policy' WHEN NOT starts_with(ref, 'refs/heads/') THEN 'not-a-branch' WHEN substr(ref, 12) <> branch THEN 'other-branch' END
 WHEN event = 'pull_request' THEN CASE WHEN action NOT IN ('opened', 'synchronize', 'reopened', 'ready_for_review') THEN 'action' WHEN number IS NULL OR number = 0 THEN 'incomplete' WHEN draft AND action <> 'ready_for_review' THEN 'draft' WHEN missing THEN 'not-connected' WHEN NOT enabled THEN 'disabled' WHEN NOT on_pull THEN 'policy' END
 WHEN event = 'check_run' AND action = 'rerequested' THEN CASE WHEN missing THEN 'not-connected' END ELSE 'event' END AS reason FROM j)
 SELECT id, CASE WHEN reason IS NULL THEN 'queued' ELSE 'ignored' END AS status, reason, CASE WHEN reason IS NULL THEN CASE WHEN event = 'push' THEN 'push' WHEN event = 'pull_request' OR number IS NOT NULL THEN 'pull_request' ELSE 'manual' END END AS trigger, CASE WHEN reason IS NULL THEN CASE WHEN event = 'check_run' THEN 100 ELSE 0 END END AS priority FROM k"""
)
def gated_deliveries(spark, d):
    """Events as deliveries to suppliers as repositories, each with its policy."""
    s = F.col("s_suppkey")
    repos = read(spark, d, "supplier").select(F.concat(F.lit("r"), s).alias("repo"), (s % 7 != 0).alias("guardian_enabled"), (s % 5 != 0).alias("scan_on_push"), (s % 3 != 0).alias("scan_on_pull_request"), F.when(s % 2 == 0, "main").otherwise("trunk").alias("default_branch"))
    top = F.broadcast(read(spark, d, "supplier").agg(F.max("s_suppkey").alias("_top")))
    i = F.col("event_id")
    pick = lambda items, k: F.get(F.array(*[F.lit(x) for x in items]), k.cast("int"))
    e = read(spark, d, "events").crossJoin(top).select(
        i.alias("id"), pick(("push", "pull_request", "check_run", "push", "ping"), i % 5).alias("event"), F.concat(F.lit("r"), 1 + F.col("user_id") % (F.col("_top") + 3)).alias("repo"), F.when(i % 11 == 0, events.ZERO_SHA).otherwise(F.concat(F.lit("c"), i)).alias("sha"),
        F.when(i % 4 == 0, "refs/tags/v1").when(i % 4 == 1, "refs/heads/trunk").otherwise("refs/heads/main").alias("ref"), F.lit(None).cast("string").alias("branch"), (i % 13 == 0).alias("deleted"),
        pick(("opened", "closed", "ready_for_review", "rerequested"), F.floor(i / 5) % 4).alias("action"), (i % 6 == 0).alias("draft"), F.when(i % 9 != 0, i).alias("number"),
    )
    return events.gated(e, repos).select("id", "status", "reason", "trigger", "priority")


def _pad(key: str, byte: int) -> str:
    return f"unhex(array_to_string(list_transform(range(64), lambda i: printf('%02x', xor(CASE WHEN i < length({key}) THEN ascii({key}[i + 1]) ELSE 0 END, {byte}))), ''))"


@query(
    f"""WITH c AS (SELECT conv_id, turn, encode(coalesce(text, '')) AS body, CAST(conv_id AS VARCHAR) AS k FROM conversations)
 SELECT conv_id, turn, sha256({_pad('k', 0x5C)} || unhex(sha256({_pad('k', 0x36)} || body))) AS hmac, CASE turn % 3 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'valid' ELSE 'missing-signature' END AS state FROM c"""
)
def signed_deliveries(spark, d):
    """HMAC-SHA256 of every turn's text under its conversation's number as the key, and the state of a signature that every third turn spoils."""
    c = read(spark, d, "conversations").withColumn("body", F.coalesce("text", F.lit("")))
    c = c.withColumn("hmac", signing.hmac_sha256(F.encode(F.col("conv_id").cast("string"), "UTF-8"), F.encode("body", "UTF-8")))
    own = F.concat(F.lit("sha256="), signing.hmac_sha256(F.lit(b"secret"), F.encode("body", "UTF-8")))
    sent = F.when(F.col("turn") % 3 == 0, F.concat(F.substring(own, 1, 70), F.lit("!"))).when(F.col("turn") % 3 == 1, own)
    return c.select("conv_id", "turn", "hmac", signing.signature_state(F.col("body"), sent, "secret").alias("state"))
