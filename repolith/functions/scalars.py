"""Scalar functions as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from worst to mildest and their weights.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_WEIGHTS = {"critical": 25.0, "high": 12.0, "medium": 5.0, "low": 2.0, "info": 0.5}
DEBT_HOURS = {"critical": 4.0, "high": 2.0, "medium": 1.0, "low": 0.5, "info": 0.15}
NEW_FINDING_POINTS = {"critical": 30.0, "high": 15.0, "medium": 6.0, "low": 2.0, "info": 0.5}
IMPACT_POINTS = {"critical": 6.0, "high": 3.0, "medium": 1.5, "low": 0.5, "info": 0.0}


def lookup(col: Column | str, values: dict[str, object]) -> Column:
    """The value of a key, null for any other; one CASE expression."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.when(F.lit(False), F.lit(None))
    for k, v in values.items():
        out = out.when(c == k, F.lit(v))
    return out


def severity_rank(col: Column | str) -> Column:
    """0 for critical to 4 for info."""
    return lookup(col, {s: k for k, s in enumerate(SEVERITIES)})


def severity_at(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank)


def at_least(actual: str, least: str) -> Column:
    """Whether a severity reaches a threshold; a missing threshold passes, a missing severity fails."""
    return F.when(F.col(least).isNull(), True).when(F.col(actual).isNull(), False).otherwise(severity_rank(actual) <= severity_rank(least))


def round1(x: Column) -> Column:
    """One decimal, halves upward (also below zero)."""
    return F.floor(x * 10 + 0.5) / 10


def round_confidence(x: Column) -> Column:
    """Two decimals within 0 and 1."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 100 + 0.5) / 100


def normalize_snippet(col: Column) -> Column:
    """White space of any kind collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def fingerprint(rule: Column, path: Column, snippet: Column) -> Column:
    """First 32 hex digits of SHA-256 over rule, path and normalised snippet, NUL between them."""
    zero = F.lit("\0")
    return F.left(F.sha2(F.concat(rule, zero, F.coalesce(path, F.lit("")), zero, normalize_snippet(snippet)), 256), F.lit(32))


def content_hash(col: Column) -> Column:
    return F.left(F.sha2(col, 256), F.lit(32))


def mask_secret(col: Column) -> Column:
    """Eight bullets for up to 8 characters, else the first and last four around 4 to 12 bullets."""
    n = F.length(col)
    inner = F.expr("repeat('•', 1)")
    middle = F.array_join(F.array_repeat(inner, F.greatest(F.lit(4), F.least(F.lit(12), n - 8))), "")
    return F.when(n <= 8, F.lit("•" * 8)).otherwise(F.concat(F.left(col, F.lit(4)), middle, F.right(col, F.lit(4))))


def redact_evidence(evidence: Column, secret: Column) -> Column:
    """Evidence with a secret of four or more characters masked."""
    return F.when(F.length(secret) >= 4, F.replace(evidence, secret, mask_secret(secret))).otherwise(evidence)


# What marks a credential (its value is group 1), the names of these marks, and values that are none.
CREDENTIAL_NAMES = ("aws-access-key", "github-token", "slack-token", "stripe-key", "google-api-key", "openai-key", "sendgrid-key", "npm-token", "jwt", "private-key-block", "basic-auth-url", "assigned-secret")
CREDENTIALS = (
    r"\b((?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16})\b",
    r"\b((?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{16,})\b",
    r"\b(xox[abposr]-[A-Za-z0-9-]{10,})\b",
    r"\b((?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,})\b",
    r"\b(AIza[0-9A-Za-z_-]{35})\b",
    r"\b(sk-(?:proj-)?[A-Za-z0-9_-]{20,})\b",
    r"\b(SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})\b",
    r"\b(npm_[A-Za-z0-9]{30,})\b",
    r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})\b",
    r"(-----BEGIN[ A-Z]*PRIVATE KEY-----[\s\S]*?-----END[ A-Z]*PRIVATE KEY-----)",
    r"(?i)(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@]+:([^\s@/]{4,})@",
    r"(?i)\b(?:password|passwd|pwd|secret|api[_-]?key|apikey|access[_-]?token|auth[_-]?token|client[_-]?secret|private[_-]?key|encryption[_-]?key|session[_-]?secret|webhook[_-]?secret|credential)s?\b\s*[:=]\s*[\"'`]?([^\s\"'`,;)}\]]{6,})[\"'`]?",
)
PLACEHOLDER = (
    r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|<[^>]*>?|\$\{[^}]*\}?|%[a-z_]+%|process\.env\.[a-z_0-9.\[\]'\"]+|null|none|undefined|true|false|changeme|change[_-]?me|example|examples?|sample|placeholder"
    r"|redacted|dummy|test|testing|fake|foo|bar|baz|your[_-].*|my[_-]?secret|todo|tbd|abc123|123456\d*)$"
)


def _masked(pattern: str):
    """A function of a text that masks what ``pattern`` finds in it."""
    block = F.lit("-----BEGIN PRIVATE KEY-----\n[redacted]\n-----END PRIVATE KEY-----")
    mask = (lambda v: block) if "BEGIN" in pattern else mask_secret

    def one(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        return F.aggregate(found, text, lambda a, v: F.when(F.trim(v).rlike(PLACEHOLDER), a).otherwise(F.replace(a, v, mask(v))))

    return one


def redact_secrets(text: Column) -> Column:
    """``text`` with credentials masked, rule by rule; a value is masked wherever it stands.

    Placeholders stay.  Of a private key's block nothing but its two end lines is kept.
    """
    for pattern in CREDENTIALS:
        text = F.transform(F.array(text), _masked(pattern))[0]  # evaluated once, used twice
    return text


def neutralize_injection(text: Column) -> Column:
    """Role markers, attempts to override instructions and prompt tags replaced by what they were."""
    t = F.regexp_replace(text, r"(?im)^\s*(?:system|assistant|developer)\s*:", "[role-marker]:")
    t = F.regexp_replace(t, r"(?i)\b(?:ignore|disregard|forget|override)\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|earlier|above|system)\s+(?:instructions?|prompts?|rules?|directions?)", "[instruction-override-attempt-removed]")
    return F.regexp_replace(t, r"(?i)</?(?:system|instructions?|prompt)>", "[tag-removed]")


#: Fixed value: what ends a cut text.
CUT_NOTE = "\n\n[... evidence truncated to fit the context budget ...]"


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters and a note, cut at the last line break if that is in the second half."""
    head = F.left(text, F.lit(most))
    back = F.instr(F.reverse(head), "\n")
    at = F.length(head) - back
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when((back > 0) & (at > most * 0.5), F.left(head, at)).otherwise(head), F.lit(CUT_NOTE)))


def excerpt(text: Column, line: Column, radius: int = 25) -> Column:
    """(text, first_line, last_line): numbered lines around a line, or around the first one for a null line."""
    all_, centre = F.split(text, "\n"), F.coalesce(line, F.lit(1))
    first, last = F.greatest(F.lit(1), centre - radius), F.least(F.size(all_), centre + radius)
    number = lambda n: F.when(F.length(n) >= 5, n).otherwise(F.lpad(n, 5, " "))
    rows = F.transform(F.slice(all_, first, F.greatest(last - first + 1, F.lit(0))), lambda x, i: F.concat(number((first + i).cast("string")), F.lit(" | "), x))
    return F.struct(F.array_join(rows, "\n").alias("text"), first.alias("first_line"), last.alias("last_line"))


def complexity_of(text: Column) -> Column:
    """One more than the branch words of a file; an operator counts only between word characters."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return 1 + F.regexp_count(text, F.lit(edge + r"(?:if|else\s+if|for|while|case|catch|elif|and|or|&&|\|\||\?\.|\?)" + edge + r"|\?\?"))


def file_risk(complexity: Column, loc: Column, findings: Column, is_test: Column, covered: Column) -> Column:
    """0 to 1 from branch density, findings and the lack of a test."""
    density = F.least(F.lit(1.0), complexity / F.greatest(loc, F.lit(20)))
    score = density * 0.35 + F.least(F.lit(1.0), findings / 5) * 0.4 + F.when(is_test | covered, 0.0).otherwise(0.25)
    return F.floor(F.least(F.lit(1.0), score) * 100 + 0.5) / 100


def size_allowance(loc: Column) -> Column:
    """1 to 3: larger code bases are allowed more findings."""
    return F.when(loc <= 0, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(3.0), F.log10(F.greatest(loc, F.lit(100)) / 50))))


def deduction_to_score(x: Column) -> Column:
    return F.when(x <= 0, 100.0).otherwise(F.greatest(F.lit(0.1), round1(100 / (1 + x / 25))))


def band(score: Column, steps: Iterable[tuple[float, str]], rest: str) -> Column:
    """The label of the first step that the score reaches."""
    out = F.when(F.lit(False), F.lit(None))
    for least, label in steps:
        out = out.when(score >= least, label)
    return out.otherwise(rest)


def impact_band(s: Column) -> Column:
    return band(s, ((70, "critical"), (45, "high"), (20, "medium")), "low")


def component_band(s: Column) -> Column:
    return band(s, ((65, "critical"), (40, "high"), (18, "medium")), "low")


def risk_band(s: Column) -> Column:
    return band(s, ((70, "critical"), (45, "high"), (22, "medium"), (8, "low")), "info")


def score_grade(score: Column, critical: Column, high: Column) -> Column:
    """Label of a score; open critical or high findings pin it."""
    plain = band(score, ((90, "Excellent"), (75, "Good"), (50, "Needs attention")), "At risk")
    return F.when(critical > 0, "At risk").when(high > 0, F.when(score >= 50, "Needs attention").otherwise("At risk")).otherwise(plain)


def version_parts(col: Column) -> Column:
    """Numbers of a version as an array; a part without leading digits counts 0."""
    core = F.split(F.regexp_replace(F.trim(col), r"^[\^~>=<v\s]+", ""), "[-+]")[0]
    return F.transform(F.split(core, r"\."), lambda p: F.coalesce(F.try_to_number(F.regexp_extract(p, r"^\s*(\d{1,9})", 1), F.lit("999999999")).cast("long"), F.lit(0).cast("long")))


def version_less(a: Column, b: Column) -> Column:
    """Whether version a is below b, compared part by part with zeros at the end."""
    x, y = version_parts(a), version_parts(b)
    n = F.greatest(F.size(x), F.size(y))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0).cast("long"), n - F.size(v)))
    return pad(x) < pad(y)


def unresolved_version(col: Column) -> Column:
    """Versions that name no release: ranges of everything, tags, links; also null and blank."""
    c = F.regexp_replace(F.trim(col), r"^[\^~>=<v\s]+", "")
    return F.coalesce((c == "") | c.rlike(r"(?i)^(?:\*|x|latest|next|link:|file:|workspace:|npm:|git\+|https?:)") | ~c.rlike(r"^\d"), F.lit(True))


def version_vulnerable(version: Column, introduced: Column, fixed: Column) -> Column:
    return ~unresolved_version(version) & F.coalesce(~version_less(version, introduced), F.lit(True)) & version_less(version, fixed)


def concrete_version(spec: Column) -> Column:
    """First d.d or d.d.d in a specification; null if there is none."""
    v = F.regexp_extract(spec, r"(\d+\.\d+(?:\.\d+)?)", 1)
    return F.when(v != "", v)


def major_behind(current: Column, latest: Column) -> Column:
    major = lambda c: F.regexp_extract(c, r"^[^\d]*(\d{1,9})", 1).try_cast("int")
    return F.coalesce(major(latest) > major(current), F.lit(False))


def lifecycle(open_now: Column, open_before: Column, first_seen: Column, resolved: Column) -> Column:
    """new, known, regressed, resolved or reopened."""
    return (
        F.when(open_now & resolved.isNotNull(), "regressed").when(open_now & open_before, "known").when(open_now & first_seen.isNotNull(), "reopened").when(open_now, "new").otherwise("resolved")
    )


def median_rounded(col: str) -> Column:
    """Median, halves upward to a whole number."""
    return F.floor(F.median(col) + 0.5)


# Fixed value: words that don't count as keywords.
STOPWORDS = (
    "the a an is are was were do does did how what why where when which who this that these those and or but for with from into about in on at to of it its "
    "my our we i you can could should would there here any all not have has had been being code codebase repo repository project app application"
).split()


def keywords(col: Column, most: int = 12) -> Column:
    """The first ``most`` distinct words of three or more characters (letters, digits and ``_ / . -``)."""
    words = F.split(F.regexp_replace(F.lower(col), r"[^a-z0-9_/.\-\s]", " "), r"\s+")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def search_score(label: Column, detail: Column, query: str) -> Column:
    """100 for an equal label, 80 for a prefix, 60 within it, 30 within the detail, else 0."""
    q = query.lower()
    low = F.lower(label)
    return F.when(low == q, 100).when(low.startswith(q), 80).when(low.contains(q), 60).when(F.lower(detail).contains(q), 30).otherwise(0)


def trajectory(first: Column, last: Column, points: Column) -> Column:
    """improving or declining from 3 up, unknown for fewer than two points."""
    return F.when(points < 2, "unknown").when(last - first >= 3, "improving").when(last - first <= -3, "declining").otherwise("stable")


# Areas of a path that make a change risky, with points.
PR_AREAS = (
    (r"(^|/)(auth|authn|authz|session|login|permission|role)", "authentication/authorization", 12),
    (r"(^|/)(payment|billing|charge|invoice|checkout)", "payment handling", 12),
    (r"(^|/)(crypto|secret|token|credential|password)", "cryptography/secrets", 10),
    (r"(^|/)(migration|migrations|schema)\b", "database schema", 8),
    (r"\.(ya?ml|tf|tfvars)$|dockerfile|docker-compose|\.github/workflows", "infrastructure/CI", 8),
    (r"(^|/)(middleware|gateway|proxy|router|routes?)\b", "request routing", 6),
    (r"package\.json$|requirements\.txt$|go\.mod$|pyproject\.toml$", "dependency manifest", 5),
    (r"\.env|config|settings", "configuration", 4),
)
REGRESSION_AREAS = (
    (r"(^|/)(auth|session|login|oauth|permission|rbac)", "authentication or access control", 12),
    (r"(^|/)(payment|billing|checkout|stripe)", "payments", 12),
    (r"(^|/)(migration|migrations)/", "database migrations", 10),
    (r"(^|/)(crypto|secret|credential)", "cryptography or credentials", 10),
    (r"\.(sql)$|(^|/)schema\.(ts|js|prisma|sql)$", "database schema", 8),
    (r"(^|/)(\.github|Dockerfile|docker-compose|terraform|k8s)", "infrastructure or CI", 8),
)


def area_hits(path: Column, areas: Iterable[tuple[str, str, int]]) -> Column:
    """Array of (label, points) of the areas that a path touches."""
    one = [F.when(path.rlike("(?i)" + p), F.struct(F.lit(label).alias("label"), F.lit(points).alias("points"))) for p, label, points in areas]
    return F.filter(F.array(*one), lambda x: x.isNotNull())
