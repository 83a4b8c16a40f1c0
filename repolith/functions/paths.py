"""What a path or an edge key tells, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolith.sources import manifests
from repolith.sources.files import basename, is_test, language

# Layers of a code base, first match wins.
LAYERS = (
    ("Tests", r"(^|/)(tests?|__tests__|spec|e2e)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$|_test\.py$"),
    ("Infrastructure", r"(^|/)(\.github|infra|deploy|terraform|k8s|helm|ansible)/|^(Dockerfile|docker-compose|Makefile)"),
    ("Config", r"(^|/)(config|settings)/|^[^/]*\.(config|conf)\.[cm]?[jt]s$|^(package\.json|tsconfig\.json|requirements\.txt|pyproject\.toml)$"),
    ("Frontend", r"\.(tsx|jsx|vue|svelte)$|(^|/)(components?|views?|pages|ui|frontend|client|screens)/"),
    ("API", r"(^|/)(api|routes?|controllers?|handlers?|endpoints?|resolvers?)/"),
    ("Data", r"(^|/)(db|database|models?|repositories|entities|migrations?|dal|store|persistence)/|schema\.(ts|js|sql|prisma|py)$"),
    ("Services", r"(^|/)(services?|lib|domain|core|usecases?|business|auth|utils?|helpers?|workers?|jobs)/"),
)
# Roles of files that are not tests, first match wins.
ROLES = (
    ("infra", r"^(?:docker-compose|\.github/|k8s/|terraform/)"),
    ("config", r"(?i)\.(?:json|ya?ml|toml|ini|env)$"),
    ("route", r"(?i)(?:^|/)(?:routes?|api|controllers?|handlers?|pages)/"),
    ("component", r"(?i:(?:^|/)components?/)|\.(?:tsx|jsx)$"),
    ("service", r"(?i)(?:^|/)(?:services?|lib|utils?|helpers?|models?)/"),
)
# Sensitive areas of a path; each use has a list of its own.
_SENSITIVE = (
    ("authentication", r"(?i)(^|/)(auth|authentication|authorization|session|login|oauth)"),
    ("payments", r"(?i)(^|/)(payment|billing|checkout|stripe|invoice)"),
    ("secrets and cryptography", r"(?i)(^|/)(crypto|secret|token|credential|password)"),
    ("database schema", r"(?i)(^|/)(migration|migrations|schema)"),
    ("access control", r"(?i)(^|/)(middleware|guard|permission|rbac|acl)"),
)
BLAST_AREAS = (*_SENSITIVE, ("external interfaces", r"(?i)(^|/)(webhook|api)/"))
IMPACT_AREAS = (*_SENSITIVE, ("external interfaces", r"(?i)(^|/)(webhook|api|routes?)/"))
COMPONENT_SENSITIVE = r"(?i)(^|/)(auth|authentication|authorization|login|session|password|crypto|payment|billing|checkout|token|secret|permission|admin)"
GAP_SENSITIVE = r"(?i)(^|/)(auth|session|login|token|payment|billing|crypto|permission|admin)"
HIGH_RISK = r"(?i)payment|billing|charge|invoice|auth|login|session|token|password|crypto|permission|access|admin|security|migration|order|checkout|transaction"
SUPPORT = manifests.SUPPORT
TRIVIAL = r"^(?:index|types?|constants?|config)\.[jt]sx?$"
ROUTE_FILE = r"(^|/)(route|page|api)\.(t|j)sx?$"
PARSED = ("javascript", "typescript", "python")
ROOT = "(root)"


def _first(path: Column, steps: tuple[tuple[str, str], ...], rest: str) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for name, pattern in steps:
        out = out.when(path.rlike(pattern), name)
    return out.otherwise(rest)


def role(path: Column) -> Column:
    """test, infra, config, route, component, service or source."""
    return F.when(is_test(path), "test").when(language(path) == "dockerfile", "infra").otherwise(_first(path, ROLES, "source"))


def layer(path: Column) -> Column:
    return _first(path, LAYERS, "Other")


def component_root(path: Column) -> Column:
    """The first two folders below a source root, ``(root)`` for files above them."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    source = F.get(parts, F.lit(0)).rlike("(?i)^(src|lib|app|packages|source)$")
    skip = F.when(source & (n > 2), 1).otherwise(0)
    dirs = F.slice(parts, skip + 1, F.greatest(n - 1 - skip, F.lit(0)))
    return F.when((n <= 1) | (F.size(dirs) == 0) | (source & (n == 2)), ROOT).otherwise(F.array_join(F.slice(dirs, 1, 2), "/"))


def component_key(root: Column) -> Column:
    return F.when(root == ROOT, "root").otherwise(F.lower(F.regexp_replace(root, "[^a-zA-Z0-9]+", "-")))


def human_name(root: Column) -> Column:
    """Folders in title case, a capital after every character that is no letter, digit or underscore."""
    word = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 10_000))
    title = lambda s: F.array_join(F.transform(F.regexp_extract_all(F.regexp_replace(s, "[-_]", " "), F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1)), word), "")
    return F.when(root == ROOT, "Root").otherwise(F.array_join(F.transform(F.split(root, "/"), title), " / "))


def sensitive(path: Column, areas: tuple[tuple[str, str], ...]) -> Column:
    """Labels of the areas that a path touches, in the order of the list."""
    return F.filter(F.array(*[F.when(path.rlike(p), F.lit(label)) for label, p in areas]), lambda x: x.isNotNull())


def testable(kind: Column, lang: Column) -> Column:
    return ~F.coalesce(kind.isin("test", "config", "infra", "documentation", "asset"), F.lit(False)) & F.coalesce(lang.isin(*PARSED), F.lit(False))


def trivial(path: Column, loc: Column) -> Column:
    """Files that need no test of their own."""
    return (loc < 10) | F.lower(basename(path)).rlike(TRIVIAL) | ~language(path).isin(*PARSED)


def in_scope(scopes: Column, path: Column) -> Column:
    """Whether a path is one of the scopes or below one; no scope means all paths."""
    bare = F.transform(scopes, lambda s: F.regexp_replace(s, "/+$", ""))
    return (F.size(scopes) == 0) | F.exists(bare, lambda s: (path == s) | F.startswith(path, F.concat(s, F.lit("/"))))


def safe(path: Column) -> Column:
    """Whether a path stays below its root: relative, no ``..``, no NUL, at most 400 characters."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce((F.length(p).between(1, 400)) & ~p.rlike(r"^(?:/|[A-Za-z]:)|\x00|(?:^|/)\.\.(?:/|$)"), F.lit(False))


def symbol_of(key: Column) -> Column:
    return F.when(~key.rlike("^(?:pkg|api|db):") & key.contains("#"), F.regexp_extract(key, "^[^#]*#(?s:(.*))$", 1))


def route_of(key: Column) -> Column:
    """(method, path) of a route's key, null for other keys; ANY where no method is given."""
    rest = F.substring(key, 5, 100_000)
    at = F.instr(rest, " ")
    one = lambda method, path: F.struct(method.alias("method"), path.alias("path"))
    return F.when(key.startswith("api:"), F.when(at == 0, one(F.lit("ANY"), rest)).otherwise(one(F.substring_index(rest, " ", 1), F.regexp_replace(rest, "^[^ ]* ", ""))))


def label_of(key: Column) -> Column:
    route = route_of(key)
    return F.when(key.startswith("pkg:"), F.substring(key, 5, 100_000)).when(key.startswith("db:"), F.substring(key, 4, 100_000)).when(key.startswith("api:"), F.concat(route["method"], F.lit(" "), route["path"])).otherwise(key)
