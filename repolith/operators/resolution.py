"""Import specifiers to files of a repository: ordered candidates, of which the first that exists counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings and index files that an import may leave out, by who asks, and roots of Python modules.
GRAPH_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs")
TEST_ENDINGS = ("", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".py", "/index.js", "/index.ts", "/__init__.py")
HISTORY_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js")
PYTHON_ROOTS = ("src", "app", "lib")


def folder(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def plain(path: Column) -> Column:
    """``path`` without ``.``, ``..`` and empty parts; a ``..`` at the top is dropped."""
    step = lambda a, x: F.when(x.isin(".", ""), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def posix(path: Column) -> Column:
    """``path`` as POSIX rules shorten it: a ``..`` that leads out stays, as do a first and a last slash."""
    rooted = path.startswith("/")
    out = lambda a: (F.size(a) == 0) | (F.element_at(F.concat(F.array(F.lit("..")), a), -1) == "..")
    step = lambda a, x: F.when(x.isin(".", ""), a).when((x == "..") & out(a), F.when(rooted, a).otherwise(F.concat(a, F.array(x)))).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    short = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.concat(F.when(rooted, "/").otherwise(""), short, F.when(path.endswith("/") & (short != ""), "/").otherwise(""))


def _all(base: Column, endings: tuple[str, ...]) -> Column:
    return F.transform(F.array(*[F.lit(e) for e in endings]), lambda e: F.concat(base, e))


def _under(at: Column, rest: Column) -> Column:
    return F.concat(at, F.when(at == "", "").otherwise("/"), rest)


def _python(path: Column, specifier: Column) -> Column:
    dots = F.length(F.regexp_extract(specifier, r"^\.*", 0))
    module = F.array_join(F.filter(F.split(F.regexp_replace(specifier, r"^\.+", ""), r"\."), lambda x: x != ""), "/")
    own = F.split(folder(path), "/")
    up = F.array_join(F.slice(own, F.lit(1), F.greatest(F.size(own) - dots + 1, F.lit(0))), "/")
    bases = F.when(dots > 0, F.array(plain(_under(up, module)))).otherwise(F.concat(F.array(module), *[F.array(F.concat(F.lit(f"{r}/"), module)) for r in PYTHON_ROOTS]))
    parent = lambda b: F.regexp_replace(b, r"/?[^/]*$", "")
    each = lambda b: F.filter(F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")), b, F.when(parent(b) != "", F.concat(parent(b), F.lit(".py")))), lambda x: x.isNotNull())
    return F.flatten(F.transform(F.filter(bases, lambda b: b != ""), each))


def graph_candidates(path: Column, specifier: Column, language: Column) -> Column:
    """For the code graph: relative imports, the aliases ``@/`` (under src, then the top) and ``~/``, and Python modules."""
    rest = F.substring(specifier, 3, 1 << 30)
    script = F.when(specifier.startswith("."), _all(plain(_under(folder(path), specifier)), GRAPH_ENDINGS)).when(specifier.startswith("@/"), F.concat(_all(F.concat(F.lit("src/"), rest), GRAPH_ENDINGS), _all(rest, GRAPH_ENDINGS))).when(specifier.startswith("~/"), _all(rest, GRAPH_ENDINGS))
    return F.when(specifier == "", None).when(language == "python", _python(path, specifier)).otherwise(script)


def test_candidates(path: Column, specifier: Column, language: Column) -> Column:
    """For the modules that tests import: paths shortened by POSIX rules after the ending is put on."""
    at = folder(path)
    base = F.concat(F.when(at == "", F.when(path.startswith("/"), "/").otherwise("")).otherwise(F.concat(at, F.lit("/"))), specifier)
    return F.transform(_all(F.regexp_replace(posix(base), "^$", "."), TEST_ENDINGS), posix)


def history_candidates(path: Column, specifier: Column, language: Column) -> Column:
    """For changed files: relative imports only."""
    return F.when(specifier.startswith("."), _all(plain(_under(folder(path), specifier)), HISTORY_ENDINGS))


#: Name of a resolver to (path, specifier, language) -> ordered candidates, and whether a file may be its own target.
RESOLVERS: dict[str, tuple[Callable[[Column, Column, Column], Column], bool]] = {"graph": (graph_candidates, False), "tests": (test_candidates, True), "history": (history_candidates, True)}


def candidates(specs: DataFrame, resolver: str = "graph") -> DataFrame:
    """(path, specifier, pos, target): the candidates of (path, specifier, language), in order."""
    of, _ = RESOLVERS[resolver]
    return specs.select("path", "specifier", F.posexplode(of(F.col("path"), F.col("specifier"), F.col("language"))).alias("pos", "target"))


def resolved(specs: DataFrame, known: DataFrame, resolver: str = "graph") -> DataFrame:
    """(path, specifier, target): the first candidate among ``known`` (path) of each import (path, specifier, language).

    Imports without one are left out; so is, in the graph, an import whose first candidate is its own file.
    """
    met = candidates(specs.distinct(), resolver).join(known.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    out = met.groupBy("path", "specifier").agg(F.min_by("target", "pos").alias("target"))
    return out if RESOLVERS[resolver][1] else out.where("target <> path")
