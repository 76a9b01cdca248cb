"""Project metadata: assembly definitions, project files, solutions, version-control logs and saved snapshots.

Functions over DataFrames of (path, text) run on executors; what only looks for a folder is plain Python on the driver.
Null and empty texts, and texts that don't parse, give no rows.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def assets_folder(path: str) -> str:
    """The folder Assets below a path if there is one, else the path."""
    inner = Path(path) / "Assets"
    return str(inner) if inner.is_dir() else path


def project_root(path: str) -> str:
    """The nearest of a folder and four above it that holds a project version, a solution or a project file; else the folder."""
    folder = start = Path(path).resolve()
    for _ in range(5):
        if (folder / "ProjectSettings" / "ProjectVersion.txt").is_file() or any(folder.glob("*.sln")) or any(folder.glob("*.csproj")):
            return str(folder)
        if folder.parent == folder:
            break
        folder = folder.parent
    return str(start)


def editor_symbols(version: str | None) -> list[str]:
    """Symbols that an editor of this version defines."""
    if not version:
        return []
    major, dot, _ = version.partition(".")
    return ["UNITY_EDITOR", *([f"UNITY_{major}"] if dot and major.isdecimal() else [])]


def merged_symbols(version: str | None, defines: Iterable[str]) -> list[str]:
    return list(dict.fromkeys([*editor_symbols(version), *defines]))


def read_texts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, text) of the files below a folder whose names match."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(folder)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*\\z", "")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), "\\.[^.]*\\z", "")


def guids(metas: DataFrame) -> DataFrame:
    """(path of the definition, guid in lower case) from the files beside definitions (path ends in .meta)."""
    line = F.regexp_extract("text", "(?im)^[^\\S\\n]*guid:[^\\S\\n]*([^\\n]*)", 1)
    return metas.select(F.regexp_replace("path", "\\.meta\\z", "").alias("path"), F.lower(F.trim(F.translate(line, "\r\t", "  "))).alias("guid")).filter("guid <> ''")


def assembly_definitions(files: DataFrame, metas: DataFrame | None = None) -> DataFrame:
    """(path, directory, name, references, unresolved) of definitions (path, text in JSON).

    A reference ``GUID:x`` is the name of the definition with that guid, the first in order of path, whatever its case; those of no
    definition are ``unresolved``. A null name is that of the file. References keep their order.
    """
    parsed = files.withColumn("j", F.from_json("text", "name string, references array<string>")).filter("j IS NOT NULL AND text IS NOT NULL")
    rows = parsed.select("path", _folder(F.col("path")).alias("directory"), F.coalesce("j.name", _stem(F.col("path"))).alias("name"), F.coalesce("j.references", F.array().cast("array<string>")).alias("given"))
    empty = rows.select(F.lit(None).cast("string").alias("guid"), F.lit(None).cast("string").alias("named")).limit(0)
    lookup = empty if metas is None else guids(metas).join(rows.select("path", "name"), "path").groupBy("guid").agg(F.min_by("name", "path").alias("named"))
    each = rows.select("path", F.posexplode("given").alias("place", "given")).filter("given IS NOT NULL")
    by_guid = F.lower(F.col("given")).startswith("guid:")
    found = each.withColumn("guid", F.when(by_guid, F.lower(F.substring("given", 6, 1 << 20)))).join(lookup, "guid", "left")
    name = F.when(F.col("guid").isNull(), F.col("given")).otherwise(F.col("named"))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda s: s["x"])
    lists = found.groupBy("path").agg(
        ordered(F.when(name.isNotNull(), F.struct("place", name.alias("x")))).alias("references"), ordered(F.when(name.isNull(), F.struct("place", F.col("given").alias("x")))).alias("unresolved"),
    )
    none = F.array().cast("array<string>")
    return rows.join(lists, "path", "left").select("path", "directory", "name", F.coalesce("references", none).alias("references"), F.coalesce("unresolved", none).alias("unresolved"))


def assembly_of(paths: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, name, directory) of the definition in the nearest folder above each path; null for loose files.

    A path is joined by its folders, so it takes an equi-join and no comparison of every path with every definition.
    """
    parts = F.split(F.lower("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    owned = definitions.groupBy(F.lower("directory").alias("key")).agg(F.min_by("name", "path").alias("name"), F.min("directory").alias("directory"))
    found = paths.select("path", F.explode(above).alias("key")).join(owned, "key")
    nearest = found.groupBy("path").agg(F.max_by(F.struct("name", "directory"), F.length("key")).alias("n"))
    return paths.join(nearest, "path", "left").select("path", F.col("n.name").alias("name"), F.col("n.directory").alias("directory"))


def with_loose_files(definitions: DataFrame, sources: DataFrame, assets: str) -> DataFrame:
    """Definitions, and one of the files below no definition if there are both; it refers to all the others and excludes their folders."""
    if not (definitions.limit(1).count() and assembly_of(sources.select("path"), definitions).filter("name IS NULL").limit(1).count()):
        return definitions.withColumn("exclude", F.lit(None).cast("array<string>"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("path", c))), lambda s: s[c])
    none = F.array().cast("array<string>")
    loose = definitions.agg(ordered("name").alias("references"), ordered("directory").alias("exclude")).select(
        F.lit(None).cast("string").alias("path"), F.lit(assets).alias("directory"), F.lit("Assembly-CSharp").alias("name"), "references", none.alias("unresolved"), "exclude",
    )
    return definitions.withColumn("exclude", F.lit(None).cast("array<string>")).unionByName(loose)


class NotFound(ValueError):
    """No assembly has the name that was asked for."""


def by_name(assemblies: DataFrame, name: str) -> DataFrame:
    """Assemblies of this name or with it behind a full stop, whatever the case; an error if there is none."""
    lower, wanted = F.lower("name"), name.lower()
    found = assemblies.filter((lower == wanted) | F.endswith(lower, F.lit(f".{wanted}")))
    if not found.limit(1).count():
        raise NotFound(f"no assembly {name}")
    return found


def by_prefix(assemblies: DataFrame, prefix: str) -> DataFrame:
    return assemblies.filter(F.startswith(F.lower("name"), F.lit(prefix.lower())))


def solution_projects(solutions: DataFrame) -> DataFrame:
    """(path of the solution, project): the project files of its ``Project(`` lines, in their order, with their folder before them."""
    lines = solutions.select("path", F.posexplode(F.split("text", "\\r?\\n")).alias("line", "t")).filter(F.startswith("t", F.lit("Project(")))
    parts = lines.select("path", "line", F.posexplode(F.split("t", '"')).alias("place", "part")).filter(F.lower("part").endswith(".csproj"))
    return parts.select("path", F.concat_ws("/", _folder(F.col("path")), F.translate("part", "\\", "/")).alias("project"), "line", "place").orderBy("path", "line", "place").select("path", "project")


def discovered_projects(solutions: DataFrame, projects: DataFrame) -> DataFrame:
    """(path): projects that solutions name, or without any all those outside of a Library folder."""
    named = solution_projects(solutions).select(F.col("project").alias("path")).distinct()
    if named.limit(1).count():
        return named
    return projects.filter(~F.contains("path", F.lit("Library/"))).select("path").distinct()


def project_files(files: DataFrame) -> DataFrame:
    """(path, hints, projects, defines, language) of project files (path, text in XML), whatever their namespace.

    hints: the paths of referenced libraries, from the folder of the project; whether they exist is for the caller to see.
    """
    plain = F.regexp_replace(F.regexp_replace("text", "<!--(?s:.)*?-->", ""), '\\sxmlns(?::\\w+)?="[^"]*"', "")
    rows = files.select("path", plain.alias("x")).filter("x IS NOT NULL AND x <> '' AND contains(x, '<Project')")
    inside = lambda tag: F.regexp_extract_all("x", F.lit(f"<{tag}(?:\\s[^>]*)?>([^<]*)</{tag}>"), F.lit(1))
    unescaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    defines = F.filter(F.transform(F.flatten(F.transform(inside("DefineConstants"), lambda d: F.split(unescaped(d), "[;,]"))), lambda d: F.trim(d)), lambda d: d != "")
    hints = F.transform(inside("HintPath"), lambda h: F.concat_ws("/", _folder(F.col("path")), F.translate(unescaped(h), "\\", "/")))
    projects = F.regexp_extract_all("x", F.lit('<ProjectReference\\s[^>]*?Include="([^"]*)"'), F.lit(1))
    return rows.select("path", hints.alias("hints"), F.transform(projects, unescaped).alias("projects"), F.array_distinct(defines).alias("defines"), F.get(inside("LangVersion"), F.lit(0)).alias("language"))


def merged_projects(rows: DataFrame) -> DataFrame:
    """One row (hints, defines, language): all hints (the first of those alike but for case), all defines, the first language; none without hints or defines."""
    def all_of(c: str) -> DataFrame:
        return rows.select("path", F.posexplode(c).alias("place", "x"))

    first = all_of("hints").groupBy(F.lower("x").alias("key")).agg(F.min(F.struct("path", "place", "x")).alias("s"))
    ordered = lambda s: F.transform(F.array_sort(F.collect_list(s)), lambda e: e["x"])
    hints = first.agg(ordered("s").alias("hints"))
    defines = all_of("defines").groupBy("x").agg(F.min(F.struct("path", "place", "x")).alias("s")).agg(ordered("s").alias("defines"))
    language = rows.agg(F.min_by("language", F.when(F.col("language").isNotNull(), F.col("path"))).alias("language"))
    both = hints.withColumn("k", F.lit(1)).join(defines.withColumn("k", F.lit(1)), "k").join(language.withColumn("k", F.lit(1)), "k")
    return both.filter("size(hints) + size(defines) > 0").select("hints", "defines", "language")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, at) of a log with one changed path a line, as `operators.snapshots.change_counts` takes it."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))


def git_log(spark: SparkSession, repository: str, since: str, target: str) -> DataFrame:
    """The log of a repository since a date, written to ``target`` and read from there; an error if git fails."""
    with open(target, "wb") as out:
        done = subprocess.run(["git", "-C", repository, "log", "--name-only", "--pretty=format:", f"--since={since}"], stdout=out, stderr=subprocess.PIPE, check=False)
    if done.returncode:
        raise RuntimeError(f"git log failed: {done.stderr.decode(errors='replace').strip()}")
    return read_log(spark, target)


_METHOD = "methodName string, cognitiveComplexity int, cyclomaticComplexity int, maxNestingDepth int, parameterCount int, lineCount int, startLine int, maintainabilityIndex double, halsteadDifficulty double, halsteadEffort double, halsteadEstimatedBugs double"
_SMELL = "kind string, severity string, typeName string, methodName string, message string"
_METRICS = (
    "typeName string, namespace string, assembly string, lineCount int, methodCount int, maxNestingDepth int, averageCognitiveComplexity double, maxCognitiveComplexity int, "
    "averageCyclomaticComplexity double, maxCyclomaticComplexity int, excessiveParameterMethodCount int, codeHealth double, "
    f"methods array<struct<{_METHOD.replace(' ', ':')}>>, lcom double, cbo int, dit int, codeSmells array<struct<{_SMELL.replace(' ', ':')}>>, afferentCoupling int, efferentCoupling int, "
    "instability double, averageMaintainabilityIndex double, minMaintainabilityIndex double, wmc int, noc int, rfc int, typeRank double, boxingCount int, closureCaptureCount int, "
    "paramsAllocationCount int, filePath string, startLine int, qualifiedName string, typeId string"
).replace(",:", ",")
SNAPSHOT = (
    "projectPath string, analyzedAt timestamp, assemblies array<struct<name:string,directory:string,references:array<string>>>, "
    "dependencies array<struct<fromType:string,toType:string,kind:string,fromTypeId:string,toTypeId:string>>, "
    "typeMetrics array<struct<" + ",".join(p.strip().replace(" ", ":", 1) if "<" not in p else p.strip().replace(" ", ":", 1) for p in _METRICS.split(", ")) + ">>, "
    "analysisLevel string, cyclicDependencies array<struct<cycle:array<string>,level:string>>"
)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Saved snapshots, one a file, in order of their names; with the columns of SNAPSHOT and ``file``. Empty and null files are left out."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path).withColumn("file", F.col("_metadata.file_path"))
    return rows.filter("projectPath IS NOT NULL OR typeMetrics IS NOT NULL OR analyzedAt IS NOT NULL").orderBy("file")


#: Columns of the type metrics of this library, and what saved snapshots call them.
RENAMED = {
    "type_id": "typeId", "name": "typeName", "namespace": "namespace", "assembly": "assembly", "line_count": "lineCount", "method_count": "methodCount", "avg_cog": "averageCognitiveComplexity",
    "max_cog": "maxCognitiveComplexity", "avg_cyc": "averageCyclomaticComplexity", "max_cyc": "maxCyclomaticComplexity", "max_nesting": "maxNestingDepth", "many_params": "excessiveParameterMethodCount",
    "health": "codeHealth", "avg_mi": "averageMaintainabilityIndex", "min_mi": "minMaintainabilityIndex", "lcom": "lcom", "cbo": "cbo", "dit": "dit", "ca": "afferentCoupling", "ce": "efferentCoupling",
    "instability": "instability", "wmc": "wmc", "noc": "noc", "rfc": "rfc", "type_rank": "typeRank", "path": "filePath", "start_line": "startLine", "qualified": "qualifiedName",
}


def snapshot_types(snapshots: DataFrame) -> DataFrame:
    """A row for each type of each snapshot, with the column names of this library, ``at`` (its time), ``position`` and its smells."""
    rows = snapshots.select(F.col("analyzedAt").alias("at"), "projectPath", F.posexplode("typeMetrics").alias("position", "t"))
    return rows.select("at", "projectPath", "position", *[F.col(f"t.{old}").alias(new) for new, old in RENAMED.items()], F.col("t.codeSmells").alias("smells"), F.col("t.methods").alias("methods"))


def first_per_guid(rows: DataFrame) -> DataFrame:
    """Of rows (guid, name, path) the first in order of path for each guid, whatever its case."""
    n = F.row_number().over(Window.partitionBy(F.lower("guid")).orderBy("path"))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Paths (path), of those alike but for their case the least."""
    return paths.groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path")).select("path")
