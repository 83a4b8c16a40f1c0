"""An index of a repository's code that follows changes and is published as a whole.

An index is a folder of versions, each a set of tables, and a manifest with a row for every
version.  Readers take the version of the manifest's last row, which is written after all
tables are: they see the old index or the new one, never a part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.operators import graph, resolution
from repolith.operators.intelligence import changed_files
from repolith.shared import cut

#: What a parser finds, by table; each has ``path``.
FACTS = {
    "imports": "path string, specifier string, line int, names array<string>",
    "routes": "path string, method string, route string, line int",
    "uses": "path string, target string, via string, line int",
    "calls": "path string, enclosing string, receiver string, callee string, line int",
    "symbols": "path string, name string",
}
FILES = "path string, language string, is_test boolean, content_hash string"
EDGES = "type string, from_key string, to_key string, confidence string, line int"
TABLES = {"files": FILES, **FACTS, "edges": EDGES}
MANIFEST = "version long, folder string"

#: From the changed files to the tables of FACTS.
Parser = Callable[[DataFrame], dict[str, DataFrame]]


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, folder) of all that was published."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], MANIFEST)
        raise


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, DataFrame]]:
    """(version, tables) last published; version 0 and empty tables before that."""
    last = versions(spark, root).orderBy(F.desc("version"), "folder").first()
    if not last:
        return 0, {k: spark.createDataFrame([], v) for k, v in TABLES.items()}
    return last["version"], {k: spark.read.schema(v).parquet(f"{root}/{last['folder']}/{k}") for k, v in TABLES.items()}


def _written(spark: SparkSession, folder: str, name: str, rows: DataFrame) -> DataFrame:
    rows.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.parquet(f"{folder}/{name}")
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all versions but the last ``keep`` from the manifest's folder; readers of those must have ended.

    Their rows stay in the manifest, so that version numbers go on.
    """
    old = [r["folder"] for r in versions(spark, root).orderBy(F.desc("version")).collect()[keep:]]
    sc = spark.sparkContext
    for folder in old:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return old


def edges_of(files: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    return graph.built_edges(files, *[facts[k] for k in FACTS])


def outdated(before: DataFrame, after: DataFrame, imports: DataFrame) -> DataFrame:
    """(path): files that stay as they are but have an import which may lead elsewhere now.

    That is, one of its candidates is a file that came, went, or became or ceased to be a test.
    """
    now = after.select("path", "is_test")
    moved = before.select("path", F.col("is_test").alias("_was")).join(now, "path", "full_outer").where(~F.col("_was").eqNullSafe(F.col("is_test"))).select("path")
    specs = imports.join(after.select("path", "language"), "path").select("path", "specifier", "language").distinct()
    return resolution.candidates(specs).join(moved.select(F.col("path").alias("target")), "target", "left_semi").select("path").distinct()


def update(spark: SparkSession, root: str, files: DataFrame, parse: Parser) -> DataFrame:
    """Bring the index up to ``files`` (path, language, is_test, content_hash, content, ...) and publish it.

    Only new and changed files are parsed.  Edges are built anew for those and for files whose
    imports may lead elsewhere; what else belongs to changed or removed files goes, the rest
    stays.  The outcome equals that of an index built from nothing.  Gives one row of counts:
    (version, files, parsed, removed, relinked).  Files of one path count as one, any of them.
    """
    version, old = current(spark, root)
    folder = f"v{version + 1}-{uuid.uuid4().hex[:8]}"
    files = files.dropDuplicates(["path"])
    _written(spark, f"{root}/{folder}", "files", files)
    state_of = lambda d: d.select("path", F.concat_ws("|", "content_hash", "language", F.col("is_test").cast("string")).alias("content_hash"))
    state = changed_files(state_of(old["files"]), state_of(files))
    parsed = cut(state.where(F.col("status").isin("added", "changed")).select("path"))
    removed = cut(state.where(F.col("status") == "removed").select("path"))
    stale = parsed.unionByName(removed)
    new = parse(files.join(parsed, "path", "left_semi"))
    facts = {k: _written(spark, f"{root}/{folder}", k, old[k].join(stale, "path", "left_anti").unionByName(new[k].select(*old[k].columns))) for k in FACTS}
    moved = cut(outdated(old["files"], files, facts["imports"]).join(stale, "path", "left_anti"))
    again = parsed.unionByName(moved)
    rebuilt = edges_of(files, {k: v.join(again, "path", "left_semi") for k, v in facts.items()})
    kept = old["edges"].withColumn("_owner", graph.file_of(F.col("from_key"))).join(stale.unionByName(moved).withColumnRenamed("path", "_owner"), "_owner", "left_anti").drop("_owner")
    _written(spark, f"{root}/{folder}", "edges", kept.unionByName(rebuilt))
    spark.createDataFrame([(version + 1, folder)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    kinds = {"files": spark.read.schema(FILES).parquet(f"{root}/{folder}/files"), "parsed": parsed, "removed": removed, "relinked": moved}
    each = None
    for name, d in kinds.items():
        row = d.select(F.lit(name).alias("kind"))
        each = row if each is None else each.unionByName(row)
    return each.agg(F.lit(version + 1).alias("version"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
