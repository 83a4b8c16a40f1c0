"""Source files as a DataFrame: discovery, language, tests, lines, statistics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions.scalars import content_hash, lookup

# What discovery leaves out and how it names languages.
IGNORED_DIRECTORIES = (".git .hg .svn node_modules vendor dist build out coverage .next .nuxt .turbo .cache __pycache__ .venv venv .tox .mypy_cache .pytest_cache target .idea .vscode .data").split()
IGNORED_FILES = "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock Pipfile.lock composer.lock go.sum".split()
BINARY_EXTENSIONS = "png jpg jpeg gif webp bmp ico svg pdf zip gz tar tgz bz2 7z rar mp3 mp4 mov avi webm wav ogg woff woff2 ttf eot otf so dll dylib exe bin wasm class jar pyc pyo db sqlite sqlite3".split()
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "py": "python", "rb": "ruby", "go": "go", "java": "java", "php": "php", "cs": "csharp", "rs": "rust", "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql",
    "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "md": "markdown", "html": "html", "css": "css", "scss": "css", "env": "dotenv",
}
MAX_BYTES, MAX_FILES = 1_000_000, 5000


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """Language by file name, then by extension; ``other`` for the rest."""
    base = F.lower(basename(path))
    ext = F.regexp_extract(base, r"[^.]\.([^.]+)$", 1)
    return F.when(base.startswith("dockerfile"), "dockerfile").when(base == "makefile", "makefile").when(base.startswith(".env"), "dotenv").otherwise(F.coalesce(lookup(ext, LANGUAGES), F.lit("other")))


def is_test(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    b = basename(p)
    return b.rlike(r"(^|[./-])(test|spec)[./-]") | b.rlike(r"\.(test|spec)\.[a-z]+$") | b.rlike(r"^test_.*\.py$") | b.rlike(r"_test\.(py|go|rb)$") | p.rlike(r"(^|/)(tests?|__tests__|spec|e2e)(/|$)")


def discover(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES, hidden: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, is_test, bytes, loc, content_hash, content) of the text files below ``root``.

    Ignored folders, lock files, binaries, files with a NUL in their first 8192
    bytes and files over ``max_bytes`` are left out; the first ``max_files`` by path stay.
    Spark's readers skip names that begin with a dot: ``hidden`` names folders below
    the root to read anyway.
    """
    top = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([top, *(f"{top}/{h}" for h in hidden)])
    base = root.rstrip("/").removeprefix("file:")
    d = raw.withColumn("path", F.regexp_replace("path", "^(file:)?/*", "/")).withColumn("path", F.expr(f"substring(path, {len(base) + 2})"))
    kept = text_files(d.select("path", "content"), max_bytes)
    # the first paths are picked without their contents
    return kept.join(kept.select("path").orderBy("path").limit(max_files), "path", "left_semi")


def text_files(d: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``discover`` over rows (path, content as bytes)."""
    folders = F.split("path", "/")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    keep = ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in IGNORED_DIRECTORIES])) & ~basename(F.col("path")).isin(*IGNORED_FILES) & ~ext.isin(*BINARY_EXTENSIONS)
    d = d.where(keep & (F.length("content") <= max_bytes) & ~F.hex(F.substring("content", 1, 8192)).rlike("^(?:..)*?00"))
    text = F.decode("content", "UTF-8")
    return d.select("path", language(F.col("path")).alias("language"), is_test(F.col("path")).alias("is_test"), F.length("content").alias("bytes"), F.size(F.split(text, "\r?\n")).alias("loc"), content_hash(F.col("content")).alias("content_hash"), text.alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """One row a line: the columns of ``files`` but content, and (line, text), lines from 1."""
    rest = [c for c in files.columns if c != "content"]
    return files.select(*rest, F.posexplode(F.split("content", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def lines_around(files: DataFrame) -> DataFrame:
    """``lines`` with the ``next`` line and the five lines ``around`` it, taken within a file's own row."""
    rest = [c for c in files.columns if c != "content"]
    d = files.select(*rest, F.split("content", "\r?\n").alias("_all"))
    one = lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), F.get("_all", i + 1).alias("next"), F.array_join(F.slice("_all", F.greatest(i - 3, F.lit(0)) + 1, F.lit(5)), "\n").alias("around"))
    return d.select(*rest, F.inline(F.transform("_all", one)))


def repository_stats(files: DataFrame) -> DataFrame:
    """(language, files, loc) with totals on each row, largest language first."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.count_if("is_test").alias("tests")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("loc"), "language")))


def repository_totals(files: DataFrame) -> DataFrame:
    """One row: files, loc, bytes and tests of all ``files`` (loc, bytes, is_test); zeros for none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return files.agg(F.count(F.lit(1)).alias("files"), total("loc"), total("bytes"), F.count_if("is_test").alias("tests"))


# Branches that count as complexity; test frameworks, cases, assertions, imports and exports of a text.
BRANCHES = r"\b(?:if|else\s+if|elif|for|while|case|catch|except)\b|&&|\|\||\?\?|\?[^.:]"
FRAMEWORKS = (
    ("vitest", r"from\s+['\"]vitest['\"]|require\(['\"]vitest['\"]\)"),
    ("jest", r"@jest/globals|jest\.(?:mock|fn|spyOn)\s*\("),
    ("mocha", r"require\(['\"]mocha['\"]\)|from\s+['\"]mocha['\"]"),
    ("pytest", r"import\s+pytest|from\s+pytest\s+import"),
    ("unittest", r"import\s+unittest|unittest\.TestCase"),
    ("go test", r"func\s+Test\w+\s*\(\s*t\s+\*testing\.T"),
)
CASES = r"\b(?:it|test)\s*(?:\.\w+)*\s*(?:\([^()]*\)|`[^`]*`)?\s*\(\s*['\"`]|\bdef\s+test_\w+\s*\(|\bfunc\s+Test\w+\s*\("
ASSERTS = r"\bexpect\s*\(|\bassert\b|\bshould\b|\bt\.(?:Error|Fatal)\b"
IMPORTS = (r"require\(\s*['\"](\.[^'\"]+)['\"]\s*\)", r"import\s+[^'\"]*from\s+['\"](\.[^'\"]+)['\"]", r"import\s*\(\s*['\"](\.[^'\"]+)['\"]\s*\)", r"from\s+(\.[\w.]+)\s+import")
EXPORTS = (r"export\s+(?:async\s+)?function\s+(\w+)", r"export\s+(?:const|let|var|class|interface|type|enum)\s+(\w+)", r"module\.exports\.(\w+)\s*=", r"exports\.(\w+)\s*=", r"(?m)^def\s+(\w+)\s*\(", r"(?m)^class\s+(\w+)")
EXPORTED_TOGETHER, EXPORTS_MOST = r"module\.exports\s*=\s*\{([^}]*)\}", 100


def estimate_complexity(text: Column) -> Column:
    """One more than the branches that a text names."""
    return F.regexp_count(text, F.lit(BRANCHES)) + 1


_BLOCK = re.compile(r"/\*(?:/|[^\n]*?\*/)[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_REST = re.compile(r"//[^\n]*")
_STRING = re.compile(r"(['\"`])(?:\\[^\n]|(?!\1)[^\\\n])*+\1")
_CONTROL = re.compile(r"\b(?:if|else|for|while|do|switch|try|catch|finally)\b")
_BARE_CONTROL = re.compile(r"\b(?:if|else|for|while|do|switch|try|catch|finally)\b\s*$")
_BRACE = re.compile(r"[{}\n]")


def _nesting(text: str) -> tuple[int, int]:
    """Greatest depth of control blocks in braces and the first line that reaches it."""
    plain = _STRING.sub('""', _REST.sub("", _BLOCK.sub(lambda m: "\n" * m.group().count("\n"), text)))
    opened, depth, best, line, at, control = [], 0, (0, 0), 1, 0, False
    for m in _BRACE.finditer(plain):
        part, at = plain[at : m.start()], m.end()
        control = control or bool(_CONTROL.search(part))
        if m.group() == "{":
            opened.append(control)
            depth += control
            if depth > best[0]:
                best = depth, line
            control = bool(_BARE_CONTROL.search(part))  # a brace right after the keyword leaves it in force
        elif m.group() == "}":
            depth -= opened.pop() if opened else False
        else:
            line, control = line + 1, False
    return best


def nesting_depth(text: Column) -> Column:
    """(depth, line) of nested control blocks in braces, outside comments and strings; 0, 0 for none and for null.

    Braces close what was opened last, so this is a stack over a file's own text.
    """

    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_nesting(t or "") for t in texts], columns=["depth", "line"]).astype("int32")

    return F.pandas_udf(each, "depth int, line int")(text)


def indent_nesting(text: Column) -> Column:
    """(depth, line): greatest indentation in steps of four blanks over lines of code, and the first line that has it; 0, 0 for none."""
    own = F.transform(F.split(text, "\r?\n"), lambda s, i: F.struct(F.when(s.rlike(r"^\s*(?:#|$)"), 0).otherwise(F.floor(F.length(F.regexp_extract(s, r"^\s*", 0)) / 4)).cast("int").alias("depth"), (-i - 1).cast("int").alias("line")))
    top = F.array_max(own)
    return F.struct(top["depth"].alias("depth"), F.when(top["depth"] > 0, -top["line"]).otherwise(0).alias("line"))


def test_framework(text: Column) -> Column:
    """The first framework that a text speaks of, null for none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in FRAMEWORKS:
        out = out.when(text.rlike(pattern), name)
    return out


def test_cases(text: Column) -> Column:
    """How many test cases a text declares."""
    return F.regexp_count(text, F.lit(CASES))


def has_assertions(text: Column) -> Column:
    return text.rlike(ASSERTS)


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """First groups of all matches, pattern by pattern."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])


def relative_imports(text: Column) -> Column:
    """Distinct specifiers of imports that start with a dot, by the form of import and then by place."""
    return F.array_distinct(_matches(text, IMPORTS))


def exports(text: Column) -> Column:
    """Distinct names that a text gives to others, without those that start with an underscore, at most a hundred.

    Names of ``module.exports = {...}`` follow the others, whatever they start with.
    """
    one = F.filter(_matches(text, EXPORTS), lambda x: ~x.startswith("_"))
    parts = F.transform(F.split(F.regexp_extract(text, EXPORTED_TOGETHER, 1), ","), lambda x: F.regexp_replace(F.split_part(x, F.lit(":"), F.lit(1)), r"^\s+|\s+$", ""))
    return F.slice(F.array_distinct(F.concat(one, F.filter(parts, lambda x: x.rlike(r"^\w+$")))), 1, EXPORTS_MOST)


def test_facts(files: DataFrame) -> DataFrame:
    """``files`` (content, ...) with framework, cases, asserts, imports, exports and complexity of their texts; a null text has none."""
    t = F.coalesce("content", F.lit(""))
    return files.withColumns({"framework": test_framework(t), "cases": test_cases(t), "asserts": has_assertions(t), "imports": relative_imports(t), "exports": exports(t), "complexity": estimate_complexity(t)})
