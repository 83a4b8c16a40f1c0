"""Line rules: every line is read once, rules stand side by side in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import paths as P
from repolith.functions.scalars import CREDENTIAL_NAMES, CREDENTIALS, PLACEHOLDER, fingerprint, redact_evidence, redact_secrets, round_confidence
from repolith.operators.resolution import resolved
from repolith.sources import manifests
from repolith.sources.files import basename, estimate_complexity, has_assertions, indent_nesting, lines, lines_around, nesting_depth, relative_imports, test_cases

HITS = 5
#: How sure a credential is by its own form, and by the name that it is assigned to.
SURE, ASSIGNED_SURE = 0.95, 0.85
EVIDENCE = 240
# Patterns of user input, of strings built from values, and the rules.
USER_INPUT = r"\breq(?:uest)?\.(?:body|query|params|headers|cookies)\b|\bctx\.request\b|\bevent\.(?:body|queryStringParameters)\b|\bprocess\.argv\b|\binput\(\)|\brequest\.(?:GET|POST|form|args|json)\b"
DYNAMIC = r"\+\s*[A-Za-z_$][\w$.\[\]]*|\$\{[^}]+\}|%s|\.format\(|f[\"']"
JS, PY = ("javascript", "typescript"), ("python",)
# Fixed value: what joins values to a string.
JOINS = r"['\"`]\s*\+|\$\{|%s|\.format\("
CODE = (*JS, *PY, "ruby", "go", "php", "java")


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    confidence: float
    match: str
    languages: tuple[str, ...] = CODE
    requires: str | None = None
    unless: str | None = None
    two_lines: bool = False
    #: Group 1 is a value that evidence must not show.
    secret: str | None = None


SECURITY = (
    Rule("security/command-injection", "critical", 0.85, r"\b(?:child_process\.)?(?:exec|execSync|spawnSync|spawn)\s*\(", JS, DYNAMIC),
    Rule("security/python-shell-injection", "critical", 0.85, r"\bsubprocess\.(?:run|call|Popen|check_output)\s*\(|\bos\.(?:system|popen)\s*\(", PY, r"shell\s*=\s*True|\+|\.format\(|f[\"']|%\s"),
    Rule("security/code-injection-eval", "critical", 0.9, r"\beval\s*\(|\bnew\s+Function\s*\(|\bexec\s*\(\s*(?:input|request)", unless=r"//.*eval|[\"'`][^\"'`]*\beval\b[^\"'`]*[\"'`]"),
    Rule("security/sql-injection", "critical", 0.8, r"(?i)\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|DROP\s+TABLE)\b[\s\S]{0,200}?(?:['\"]\s*\+|\$\{|%s|\.format\()", two_lines=True),
    Rule("security/path-traversal", "high", 0.7, r"\b(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|unlink|open)\s*\(", (*JS, *PY), DYNAMIC, r"path\.resolve|path\.normalize|sanitize|basename"),
    Rule("security/unsafe-deserialization", "high", 0.85, r"\bpickle\.loads?\s*\(|\byaml\.load\s*\((?![^)]*SafeLoader)|\bunserialize\s*\(|\bnode-serialize"),
    Rule("security/xss-innerhtml", "high", 0.7, r"\.innerHTML\s*=|dangerouslySetInnerHTML|document\.write\s*\(", JS, DYNAMIC, r"(?i)DOMPurify|sanitize"),
    Rule("security/weak-hash", "high", 0.8, r"(?i)createHash\s*\(\s*['\"](?:md5|sha1)['\"]|hashlib\.(?:md5|sha1)\s*\(|MessageDigest\.getInstance\s*\(\s*\"(?:MD5|SHA-?1)\""),
    Rule("security/jwt-unverified", "critical", 0.9, r"\bjwt\.decode\s*\(|\bjsonwebtoken\.decode\s*\(|verify\s*:\s*false|\bdecode\s*\([^)]*\{\s*complete", JS),
    Rule("security/jwt-alg-none", "critical", 0.95, r"(?i)algorithm['\"]?\s*:\s*['\"]none['\"]|alg['\"]?\s*:\s*['\"]none['\"]"),
    Rule("security/timing-unsafe-comparison", "medium", 0.55, r"(?i)\b(?:\w*(?:password|passwd|hash|token|secret|signature|hmac|apikey|api_key)\w*)\s*(?:===?|!==?)\s*\w+|\w+\s*(?:===?|!==?)\s*\w*(?:passwordHash|hashed|signature|hmac)\w*", (*JS, *PY), None, r"timingSafeEqual|compare_digest|safeEqual|bcrypt\.compare|===\s*(?:null|undefined|''|\"\")"),
    Rule("security/prototype-pollution", "high", 0.6, r"_\.merge\s*\(|_\.mergeWith\s*\(|\$\.extend\s*\(\s*true|Object\.assign\s*\(\s*\w+\.prototype", JS, None, r"Object\.create\(null\)|hasOwnProperty|structuredClone"),
    Rule("security/insecure-random", "medium", 0.65, r"Math\.random\s*\(\)|\brandom\.random\s*\(\)", CODE, r"(?i)token|secret|password|key|nonce|salt|otp|session|reset"),
    Rule("security/tls-verification-disabled", "high", 0.85, r"rejectUnauthorized\s*:\s*false|verify\s*=\s*False|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0|InsecureSkipVerify\s*:\s*true"),
)
WORKFLOW = (
    Rule("cicd/pull-request-target", "high", 0.8, "pull_request_target", ("yaml",)),
    Rule("cicd/untrusted-context-interpolation", "high", 0.8, r"\$\{\{\s*github\.event\.(?:comment|issue|pull_request|review)\.(?:body|title)", ("yaml",)),
    Rule("cicd/excessive-permissions", "medium", 0.8, r"(?i)permissions:\s*write-all|contents:\s*write", ("yaml",)),
    Rule("cicd/remote-script", "high", 0.8, r"curl[^\n]*\|\s*(?:sudo\s+)?(?:ba)?sh|wget[^\n]*\|\s*(?:ba)?sh", ("yaml",)),
    Rule("cicd/secret-in-log", "critical", 0.8, r"secrets\.\w+.*(?:echo |printenv|console\.log)|(?:echo |printenv|console\.log).*secrets\.\w+", ("yaml",)),
)
EOL_IMAGES = r"(?i)^FROM\s+(?:node:(?:[0-9]|1[0-7])(?:[.\-\s]|$)|python:(?:2(?:\.\d+)?|3\.[0-7])(?:[.\-\s]|$)|ubuntu:(?:1[0-8])\.\d+|debian:(?:[0-9]|10)(?:[.\-\s]|$)|alpine:(?:2|3\.[0-9](?:[.\-\s]|$)|3\.1[0-5]))"
DOCKER = (
    Rule("infra/docker-unpinned-base-image", "low", 0.9, r"(?i)^FROM\s+(?:\S+:latest|[^\s:]+)(?:\s|$)", ("dockerfile",)),
    Rule("infra/docker-eol-base-image", "high", 0.95, EOL_IMAGES, ("dockerfile",)),
    Rule("infra/docker-secret-in-env", "critical", 0.9, r"(?i)^(?:ENV|ARG)\s+\w*(?:password|passwd|secret|token|api[_-]?key|apikey|access[_-]?key|credential|private[_-]?key)\w*[\s=]+[\"']?(?!\$\{?\w+\}?[\"']?$|changeme|example|placeholder|<)[^\s\"']{8,}", ("dockerfile",), secret=r"(?i)^(?:ENV|ARG)\s+\w+[\s=]+[\"']?([^\s\"']{8,})"),
    Rule("infra/docker-remote-script-execution", "high", 0.85, r"(?i)^RUN\b.*(?:curl|wget)[^|]*\|\s*(?:ba)?sh", ("dockerfile",)),
    Rule("infra/docker-unsafe-perm", "medium", 0.85, r"(?i)--unsafe-perm", ("dockerfile",)),
)
CONFIG = (
    Rule("config/dotenv-secret", "critical", 0.9, r"^[A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|PRIVATE|API_KEY|ACCESS_KEY|CREDENTIAL)[A-Z0-9_]*\s*=\s*[\"']?(?!(?i)change-?me|example|placeholder|your[_-]|xxx|<|\$\{)[^\"'\s]{8,}", ("dotenv",), secret=r"=\s*[\"']?([^\"'\s]{8,})"),
    Rule("config/privileged-container", "high", 0.85, r"(?i)privileged:\s*true|hostNetwork:\s*true", ("yaml",)),
)


def _comment(text: Column, language: Column) -> Column:
    t = F.ltrim(text)
    return F.when(language.isin("python", "shell", "yaml", "dockerfile", "dotenv"), t.startswith("#")).otherwise(t.startswith("//") | t.startswith("*") | t.startswith("/*"))


def hits(code: DataFrame, rules: tuple[Rule, ...], key: str = "path") -> DataFrame:
    """One row for each line and rule that meet: (key, rule_id, severity, line, evidence, confidence).

    code: (key, language, line, text) and, where rules look at neighbours, (next,
    around).  Input from users waives ``requires`` and, in the lines around a hit,
    raises its confidence.  Credentials in evidence are masked.  The rules are one array per line.
    """
    for name in {"next", "around"} - set(code.columns):
        code = code.withColumn(name, F.lit(None).cast("string"))
    both = F.concat_ws("\n", "text", "next")

    def one(r: Rule) -> Column:
        hay = both if r.two_lines else F.col("text")
        ok = F.col("language").isin(*r.languages) & hay.rlike(r.match)
        if r.requires:
            ok &= hay.rlike(r.requires) | hay.rlike(USER_INPUT)
        if r.unless:
            ok &= ~hay.rlike(r.unless)
        sure = F.least(F.lit(0.98), F.lit(r.confidence) + F.when(F.col("around").rlike(USER_INPUT), 0.1).otherwise(0.0))
        later = F.lit(False)
        if r.two_lines:  # the line that joins values, whole if it can be, else the first that does
            joins = [F.coalesce(x.rlike(JOINS), F.lit(False)) for x in (F.col("text"), F.col("next"))]
            whole = [j & x.rlike(r.match) for j, x in zip(joins, (F.col("text"), F.col("next")), strict=True)]
            later = F.when(whole[0], False).when(whole[1], True).otherwise(~joins[0] & joins[1])
        return F.when(ok, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), round_confidence(sure).alias("confidence"), F.lit(r.two_lines).alias("two"), later.alias("later"), (F.regexp_extract("text", r.secret, 1) if r.secret else F.lit("")).alias("value")))

    live = code.where((F.trim("text") != "") & ~_comment(F.col("text"), F.col("language")))
    found = live.select(key, "line", "text", "next", F.explode(F.filter(F.array(*[one(r) for r in rules]), lambda x: x.isNotNull())).alias("h"))
    if any(r.two_lines for r in rules):
        # a statement over two lines is found from both: of lines in a run, every second is left out
        side = Window.partitionBy(key, "h.rule_id").orderBy("line")
        found = found.withColumn("_run", F.col("line") - F.row_number().over(side))
        found = found.withColumn("_at", F.row_number().over(Window.partitionBy(key, "h.rule_id", "_run").orderBy("line"))).where(~F.col("h.two") | (F.col("_at") % 2 == 1))
    text = F.when(F.col("h.later"), F.col("next")).otherwise(F.col("text"))
    line = F.col("line") + F.col("h.later").cast("int")
    return found.select(key, "h.rule_id", "h.severity", line.alias("line"), _cut(redact_secrets(redact_evidence(text, F.col("h.value")))).alias("evidence"), "h.confidence")


def capped(found: DataFrame, key: str = "path", most: int = HITS) -> DataFrame:
    """The first ``most`` hits of a rule in a file; the last one kept carries how many more there were."""
    w = Window.partitionBy("rule_id", key)
    d = found.withColumn("_k", F.row_number().over(w.orderBy("line"))).withColumn("_n", F.count(F.lit(1)).over(w))
    more = F.when((F.col("_k") == most) & (F.col("_n") > most), F.col("_n") - most).otherwise(0)
    return d.where(F.col("_k") <= most).withColumn("additional", more).drop("_k", "_n")


def _sign(d: DataFrame) -> DataFrame:
    return d.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("path"), F.col("evidence")))


def security(files: DataFrame) -> DataFrame:
    """Security findings of source files that are not tests."""
    return _sign(capped(hits(lines_around(files.where("not is_test")), SECURITY)))


def secrets(files: DataFrame) -> DataFrame:
    """Committed credentials in any line of any file, comments too, by the marks that redaction knows; the ids are ours.

    Placeholders are none.  A line has one finding for each mark, by its first value; one that is
    only assigned to a telling name gives way to the others.  A private key's block counts at
    its first line.
    """
    block = CREDENTIAL_NAMES.index("private-key-block")
    t = F.col("text")

    def one(name: str, pattern: str) -> Column:
        value = F.get(F.filter(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda v: (v != "") & ~F.trim(v).rlike(PLACEHOLDER)), F.lit(0))
        return F.when(value.isNotNull(), F.struct(F.lit(f"secret/{name}").alias("rule_id"), F.lit(ASSIGNED_SURE if name == "assigned-secret" else SURE).alias("confidence")))

    marks = F.array_compact(F.array(*[one(n, p) for k, (n, p) in enumerate(zip(CREDENTIAL_NAMES, CREDENTIALS, strict=True)) if k != block]))
    d = lines(files).withColumn("_m", marks)
    kept = F.when(F.size("_m") > 1, F.filter("_m", lambda m: m["rule_id"] != "secret/assigned-secret")).otherwise(F.col("_m"))
    rows = d.select("path", "line", "text", F.inline(kept)).select("path", "rule_id", F.lit("critical").alias("severity"), "line", _cut(redact_secrets(t)).alias("evidence"), "confidence")
    whole = files.select("path", "content", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(CREDENTIALS[block]), F.lit(1)))).alias("_b"))
    line = F.size(F.split(F.substring("content", F.lit(1), F.instr(F.col("content"), F.col("_b")) - 1), "\n"))
    keys = whole.select("path", F.lit("secret/private-key-block").alias("rule_id"), F.lit("critical").alias("severity"), line.alias("line"), F.regexp_extract("_b", r"^-----BEGIN[ A-Z]*PRIVATE KEY-----", 0).alias("evidence"), F.lit(SURE).alias("confidence"))
    return _sign(capped(rows.unionByName(keys)))


def workflows(files: DataFrame) -> DataFrame:
    """Findings of CI workflow files; a file without any ``permissions`` gives one more."""
    d = files.where(F.col("path").rlike(r"(?i)(^|/)\.github/workflows/.+\.ya?ml$"))
    runs = F.col("content").rlike(r"run:|script:")
    rows = hits(lines(d), WORKFLOW)
    masked = F.regexp_replace("evidence", r"secrets\.\w+", "secrets.[redacted]")
    rows = rows.withColumn("evidence", F.when(F.col("rule_id") == "cicd/secret-in-log", masked).otherwise(F.col("evidence")))
    rows = rows.join(d.where(~runs).select("path", F.lit("cicd/untrusted-context-interpolation").alias("rule_id")), ["path", "rule_id"], "left_anti")
    return _sign(rows.unionByName(d.where(~F.col("content").rlike(r"permissions\s*:")).select("path", F.lit("cicd/missing-permissions").alias("rule_id"), F.lit("low").alias("severity"), F.lit(1).alias("line"), F.lit("").alias("evidence"), F.lit(0.8).alias("confidence"))))


def dockerfiles(files: DataFrame) -> DataFrame:
    """Findings of container files, at most one a rule and file; the last USER counts."""
    d = files.where("language = 'dockerfile'")
    code = lines(d).withColumn("text", F.trim("text"))
    first = Window.partitionBy("path", "rule_id").orderBy("line")
    rows = hits(code, DOCKER).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    whole = code.groupBy("path").agg(
        F.max_by(F.regexp_extract("text", r"(?i)^USER\s+(\S+)", 1), F.when(F.col("text").rlike(r"(?i)^USER\s+\S+"), F.col("line"))).alias("user"),
        F.bool_or(F.col("text").rlike("(?i)^HEALTHCHECK")).alias("healthy"),
    )
    add = lambda when, rule, severity: whole.where(when).select("path", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(1).alias("line"), F.lit("").alias("evidence"), F.lit(0.9).alias("confidence"))
    root = add(F.coalesce(F.lower("user"), F.lit("root")).isin("root", "0"), "infra/docker-runs-as-root", "high")
    return _sign(rows.unionByName(root).unionByName(add(~F.col("healthy"), "infra/docker-no-healthcheck", "info")))


def configuration(files: DataFrame) -> DataFrame:
    """Findings of environment and configuration files."""
    d = files.where(~F.col("path").endswith(".example"))
    debug = lines(d.where(F.lower("path").contains("prod"))).where(F.col("text").rlike(r"(?i)DEBUG\s*[:=]\s*(true|1|yes)"))
    debug = debug.select("path", F.lit("config/debug-in-production").alias("rule_id"), F.lit("medium").alias("severity"), "line", _cut(redact_secrets(F.col("text"))).alias("evidence"), F.lit(0.75).alias("confidence"))
    return _sign(hits(lines(d), CONFIG).unionByName(debug))


def _cut(text: Column) -> Column:
    t = F.btrim(text, F.lit(" \t\r\n\x0b\x0c"))
    return F.when(F.length(t) > EVIDENCE, F.concat(F.left(t, F.lit(EVIDENCE)), F.lit("…"))).otherwise(t)


def _row(rows: DataFrame, rule: str, severity: Column | str, confidence: Column | float, seed: Column, path: Column | str = "path", line: Column | str | int = 1, text: Column | str = "") -> DataFrame:
    """Findings of one rule, signed by ``seed`` instead of by their evidence."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    path = F.col(path) if isinstance(path, str) else path
    line = F.col(line) if isinstance(line, str) else of(line)
    out = rows.select(path.alias("path"), F.lit(rule).alias("rule_id"), of(severity).alias("severity"), line.alias("line"), _cut(redact_secrets(of(text))).alias("evidence"), of(confidence).alias("confidence"), seed.alias("_seed"))
    return out.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("path"), F.col("_seed"))).drop("_seed")


# Patterns of the quality and testing detectors.
MONEY = r"(?i)(?:amount|price|total|cost|balance|refund|fee|salary)\w*\s*[*/]\s*\d|\*\s*100\b"
DECLARED = r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*="
BRANCHES_MOST, LINES_LEAST = 25, 40
NESTING, NESTING_MEDIUM = 5, 7


def error_handling(files: DataFrame) -> DataFrame:
    """Swallowed errors, unchecked chains, float currency and unbounded percentages, by line, in source files that are not tests.

    An ``except`` counts as swallowed unless its very next line does something, as in the behaviour studied.
    """
    d = files.where(F.col("language").isin(*CODE) & ~F.col("is_test"))
    guard = F.contains("content", F.lit("Math.min")) | F.contains("content", F.lit("Math.max")) | F.col("content").rlike(r"(?i)if\s*\([^)]*(?:percent|discount)[^)]*[<>]")
    t = F.btrim("text", F.lit(" \t\r\n\x0b\x0c"))
    after = Window.partitionBy("path").orderBy("line").rowsBetween(1, 5)
    code = lines(d.withColumn("_guard", guard)).withColumn("t", t).withColumn("_after", F.collect_list("t").over(after))
    end = F.array_position("_after", "}").cast("int")
    body = F.when(end > 0, F.slice("_after", F.lit(1), end - 1)).otherwise(F.col("_after"))
    body = F.when(F.col("language") == "python", F.slice(body, 1, 1)).otherwise(body)
    does = F.exists(body, lambda x: (x != "") & ~x.rlike(r"^(?://|#|/\*|\*)") & ~x.rlike("^(?:pass|;)$"))
    caught = F.col("t").rlike(r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*$") | F.col("text").rlike(r"^\s*except[^:]*:\s*$")
    chain = F.col("t").rlike(r"\breturn\s+\w+\.\w+\.\w+") & ~F.contains("t", F.lit("?.")) & ~F.col("t").rlike(r"\bthis\b|\bwindow\b|\bprocess\b|\bJSON\b|\bMath\b")
    money = F.col("t").rlike(MONEY) & F.col("t").rlike("(?i)amount|price|total|cost|balance|refund|fee|cents|usd") & ~F.col("t").rlike(r"toFixed|Math\.round|Decimal|BigInt|Number\.isInteger")
    share = F.col("t").rlike(r"(?i)function\s+\w*(?:discount|percent|rate|ratio)|(?:discount|percent)\w*\s*/\s*100") & ~F.col("_guard") & F.col("t").rlike(r"/\s*100")
    one = lambda when, rule, severity, sure, seed: F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"), seed.alias("seed")))
    met = F.array(
        one(caught & ~does, "reliability/swallowed-error", "medium", 0.85, F.concat(F.lit("swallowed-error:"), "t", F.lit(":"), (F.col("line") - 1).cast("string"))),
        one(chain, "bugs/unchecked-property-access", "medium", 0.6, _cut(F.col("t"))),
        one(money, "bugs/float-currency-arithmetic", "medium", 0.55, _cut(F.col("t"))),
        one(share, "bugs/missing-bounds-check", "low", 0.5, _cut(F.col("t"))),
    )
    found = code.select("path", "line", "t", F.explode(F.filter(met, lambda x: x.isNotNull())).alias("h"))
    return found.select("path", "h.rule_id", "h.severity", "line", _cut(redact_secrets(F.col("t"))).alias("evidence"), "h.confidence", fingerprint(F.col("h.rule_id"), F.col("path"), F.col("h.seed")).alias("fingerprint"))


def structure(files: DataFrame) -> DataFrame:
    """Files of many branches, and variables of JavaScript and TypeScript that their file names once, and deep nesting: of blanks in Python, of braces elsewhere."""
    d = files.where(F.col("language").isin(*CODE) & ~F.col("is_test"))
    branchy = d.where(estimate_complexity(F.col("content")) > BRANCHES_MOST)
    rows = _row(branchy, "quality/high-complexity", "low", 0.7, F.concat(F.lit("high-complexity:"), "path"))
    py = F.col("language").isin(*PY)
    sized = d.where(py).withColumn("_n", indent_nesting(F.col("content"))).unionByName(d.where(~py).withColumn("_n", nesting_depth(F.col("content"))))
    deep = sized.where(F.col("_n.depth") >= NESTING).withColumn("line", F.col("_n.line"))
    at = F.get(F.split("content", "\r?\n"), F.col("line") - 1)
    rows = rows.unionByName(_row(deep, "quality/deep-nesting", F.when(F.col("_n.depth") >= NESTING_MEDIUM, "medium").otherwise("low"), 0.9, F.concat(F.lit("deep-nesting:"), "path"), line="line", text=at))
    js = d.where(F.col("language").isin(*JS))
    # a piece from each declaration to the next; the lines before it are those of the pieces before
    pieces = js.select("path", F.posexplode(F.split("content", rf"(?=\b{DECLARED})")).alias("pos", "piece"))
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    named = F.regexp_extract("piece", f"^{DECLARED}", 1).alias("name")
    line = (F.coalesce(F.sum(F.regexp_count("piece", F.lit("\n"))).over(before), F.lit(0)) + 1).cast("int").alias("line")
    names = pieces.select("path", named, line).where((F.col("name") != "") & ~F.col("name").startswith("_"))
    words = js.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0))).alias("name")).groupBy("path", "name").agg(F.count(F.lit(1)).alias("uses"))
    plain = names.where(~F.contains("name", F.lit("$"))).join(words.where("uses <= 1").drop("uses"), ["path", "name"], "left_semi")
    # a name with a dollar sign is no run of word characters: its file is searched for it
    use = F.regexp_count("content", F.concat(F.lit(r"\b"), F.replace("name", F.lit("$"), F.lit(r"\$")), F.lit(r"\b")))
    other = names.where(F.contains("name", F.lit("$"))).join(js.select("path", "content"), "path").where(use <= 1).select("path", "name", "line")
    unused = plain.select("path", "name", "line").unionByName(other).join(lines(js).select("path", "line", "text"), ["path", "line"])
    return rows.unionByName(_row(unused, "quality/unused-variable", "info", 0.75, F.concat(F.lit("unused-variable:"), "path", F.lit(":"), "name"), line="line", text=F.col("text")))


def quality(files: DataFrame) -> DataFrame:
    """Findings of error handling and of structure."""
    return error_handling(files).unionByName(structure(files))


def testing(files: DataFrame) -> DataFrame:
    """Tests without assertions; one finding if there is no test at all, or else the modules that no test imports."""
    tests, sources = files.where("is_test"), files.where("not is_test")
    vain = tests.where((test_cases(F.col("content")) > 0) & ~has_assertions(F.col("content")))
    rows = _row(vain, "testing/test-without-assertions", "medium", 0.8, F.concat(F.lit("test-without-assertions:"), "path"))
    totals = F.broadcast(files.agg(F.count_if("is_test").alias("_tests"), F.count_if(~F.col("is_test")).alias("_sources")))
    rows = rows.unionByName(_row(totals.where("_tests = 0 and _sources > 0"), "testing/no-tests", "high", 0.9, F.lit("no-tests"), path=F.lit(None).cast("string")))
    specs = tests.select("path", F.explode(relative_imports(F.col("content"))).alias("specifier"), "language")
    covered = resolved(specs, files, "tests").select(F.col("target").alias("path")).distinct()
    trivial = (F.col("loc") < 10) | F.lower(basename(F.col("path"))).rlike(r"^(?:index|types?|constants?|config)\.[jt]sx?$") | ~F.col("language").isin(*JS, *PY)
    risky = F.col("path").rlike(P.HIGH_RISK)
    exports = F.col("content").rlike(r"(?m)module\.exports|export\s+(?:default|const|function|class)|^def\s")
    alone = sources.where(~trivial & exports & (risky | (F.col("loc") >= LINES_LEAST))).join(covered, "path", "left_anti").crossJoin(totals.where("_tests > 0"))
    return rows.unionByName(_row(alone, "testing/untested-module", F.when(risky, "high").otherwise("low"), F.when(risky, 0.85).otherwise(0.7), F.concat(F.lit("untested-module:"), "path")))


def vulnerabilities(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A finding for each dependency of a manifest to which advisories apply; the built-in ones unless ``known`` is given."""
    deps = manifests.dependencies(files)
    met = manifests.vulnerable(deps, manifests.advisories(files.sparkSession) if known is None else known)
    keys = ("ecosystem", "name", "version", "manifest_path", "line")
    said = deps.groupBy(*keys).agg(F.min("version_spec").alias("_spec")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_spec")
    rows = met.join(said, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    evidence = F.concat(F.lit('"'), "name", F.lit('": "'), F.coalesce("_spec", F.lit("")), F.lit('"'))
    return _row(rows, "dependency/vulnerable-package", F.col("severity"), 0.95, F.concat(F.lit("vulnerable-package:"), "ecosystem", F.lit(":"), "name"), path="manifest_path", line="line", text=evidence)


def all_findings(files: DataFrame) -> DataFrame:
    """Findings of every detector of this module, before duplicates are merged; no-tests has a null path."""
    out = security(files).drop("additional").withColumn("scanner", F.lit("security"))
    rest = {"secrets": secrets(files).drop("additional"), "cicd": workflows(files), "infrastructure": dockerfiles(files), "config": configuration(files)}
    rest |= {"quality": quality(files), "testing": testing(files), "dependencies": vulnerabilities(files)}
    for name, rows in rest.items():
        out = out.unionByName(rows.withColumn("scanner", F.lit(name)))
    return out


# Which changed paths call for which detectors.
SCANNERS = ("security", "secrets", "dependencies", "testing", "quality", "infrastructure", "cicd", "config")
SCAN_RULES = (
    (r"(?i)(^|/)(\.env|secrets?|credentials?)", None, ("secrets", "config", "security")),
    (r"(?i)(^|/)(auth|session|login|permission|token)", None, ("security", "secrets", "testing", "quality")),
    (r"package\.json$|requirements.*\.txt$|pyproject\.toml$", None, ("dependencies", "security")),
    (r"(^|/)\.github/workflows/", None, ("cicd", "secrets", "config")),
    (r"(?i)dockerfile|docker-compose", None, ("infrastructure", "secrets", "config")),
    (r"(?i)\.(ya?ml|toml|ini|json)$", r"package\.json$", ("config", "cicd", "secrets")),
    (r"\.(test|spec)\.|(^|/)tests?/", None, ("testing", "quality")),
    (r"\.(ts|tsx|js|jsx|mjs|cjs|py)$", None, ("security", "quality", "testing", "secrets")),
)


def scanners_for(changed: DataFrame, *keys: str, path: str = "path") -> DataFrame:
    """(keys, scanner): the detectors to run for changed paths; all if any path matches no rule.

    Without keys and without rows no detector is named: a scan of unknown changes runs them all.
    """
    calls = F.flatten(F.array(*[F.when(F.col(path).rlike(p) & (~F.col(path).rlike(no) if no else F.lit(True)), F.array(*[F.lit(x) for x in ids])).otherwise(F.array().cast("array<string>")) for p, no, ids in SCAN_RULES]))
    every = F.array(*[F.lit(x) for x in SCANNERS])
    return changed.select(*keys, F.explode(F.when(F.size(calls) == 0, every).otherwise(F.array_distinct(calls))).alias("scanner")).distinct()
