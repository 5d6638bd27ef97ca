"""Dependencies of projects: reading manifests, comparing with a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import schema
from notespark.functions import text as tx
from notespark.functions.versions import clean_version, update_type


def npm_dependencies(manifest: Column) -> Column:
    """Packages of a ``package.json``; a development entry overrides one of the same name."""
    parsed = F.from_json(manifest, schema.NPM_MANIFEST)
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_zip_with(
        F.coalesce(parsed["dependencies"], empty), F.coalesce(parsed["devDependencies"], empty),
        lambda _name, run, dev: F.coalesce(dev, run),
    )
    return F.transform(
        F.map_entries(merged),
        lambda e: F.struct(e["key"].alias("name"), clean_version(e["value"]).alias("current")),
    )


def _requirement(line: Column) -> Column:
    name = F.trim(F.regexp_replace(F.regexp_extract(line, r"^([^><=~!]*)", 1), r"\[.*\]", ""))
    version = F.trim(F.regexp_extract(line, r"^[^><=~!]*[><=~!]+(.*)$", 1))
    return F.struct(name.alias("name"), version.alias("current"))


def pyproject_dependencies(content: Column) -> Column:
    block = F.regexp_extract(content, r"(?sm)^[ \t]*dependencies = \[[ \t]*\n(.*?)^[ \t]*\][ \t]*$", 1)
    return F.transform(tx.find_all(block, r'(?m)^\s*"([^"]+)"', 1), _requirement)


def requirements(content: Column) -> Column:
    lines = F.filter(
        F.transform(tx.lines(content), lambda s: tx.strip(s)),
        lambda s: (s != "") & ~s.startswith("#"),
    )
    return F.transform(lines, _requirement)


def pubspec_dependencies(content: Column) -> Column:
    blocks = tx.find_all(
        content, r"(?m)^[ \t]*(?:dev_)?dependencies:[ \t]*((?:\n[ \t][^\n]*)*)", 1
    )
    entry = r"(?m)^\s+(\w[\w_]*)\s*:\s*\^?([0-9][^\s#]*)"
    body = F.array_join(blocks, "\n")
    pairs = F.arrays_zip(
        tx.find_all(body, entry, 1).alias("name"), tx.find_all(body, entry, 2).alias("current")
    )
    return F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), p["current"].alias("current")))


# Which file gives a project's dependencies, in order of preference.
_MANIFESTS = [
    ("package.json", "npm", npm_dependencies),
    ("pyproject.toml", "pip", pyproject_dependencies),
    ("requirements.txt", "pip", requirements),
    ("pubspec.yaml", "flutter", pubspec_dependencies),
]


def from_manifests(files: DataFrame) -> DataFrame:
    """``(project, manager, name, current)`` from files ``project/<manifest>``.

    A project's first kind of manifest counts; a pyproject without dependencies leaves the
    choice to requirements.txt.
    """
    name = F.element_at(F.split("path", "/"), -1)
    found = F.when(F.lit(False), F.array().cast("array<struct<name:string,current:string>>"))
    kind = F.when(F.lit(False), F.lit(""))
    rank = F.when(F.lit(False), F.lit(0))
    for i, (file, manager, read) in enumerate(_MANIFESTS):
        found = found.when(name == file, read(F.col("raw_content")))
        kind = kind.when(name == file, F.lit(manager))
        rank = rank.when(name == file, F.lit(i))
    rows = (
        files.where(F.size(F.split("path", "/")) == 2).where(name.isin([m[0] for m in _MANIFESTS]))
        .select(
            F.split("path", "/")[0].alias("project"), kind.alias("manager"), rank.alias("_rank"),
            found.alias("_deps"),
        )
        .where(~((F.col("_rank") == 1) & (F.size("_deps") == 0)))
    )
    best = rows.groupBy("project").agg(F.min_by(F.struct("manager", "_deps"), "_rank").alias("_b"))
    return best.select("project", "_b.manager", F.inline("_b._deps"))


def compare(dependencies: DataFrame, registry: DataFrame, parity: bool = False) -> DataFrame:
    """Dependencies whose registry entry is known: ``status`` and ``update_type``.

    ``registry`` has one row per ``(manager, name)``.  A pip dependency without a version is up
    to date, one of the other managers is outdated.
    """
    joined = dependencies.join(registry, ["manager", "name"])
    given = (F.col("manager") != "pip") | (F.col("current") != "")
    old = (F.col("latest") != "") & given & (F.col("latest") != F.col("current"))
    kind = update_type("current", "latest", parity)
    return joined.select(
        "project", "manager", "name", "current", "latest",
        F.when(old, F.lit("outdated")).otherwise(F.lit("up to date")).alias("status"),
        F.when(old, kind).alias("update_type"),
    )


def summary(compared: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Per project: dependencies, how many are current and how many are behind, by kind."""
    totals = dependencies.groupBy("project").agg(F.count(F.lit(1)).alias("total_deps"))
    states = compared.groupBy("project").agg(
        F.count_if(F.col("status") == "up to date").alias("up_to_date"),
        F.count_if(F.col("status") == "outdated").alias("outdated"),
        *[F.count_if(F.col("update_type") == k).alias(k) for k in ("major", "minor", "patch", "unknown")],
    )
    return totals.join(states, "project", "left").fillna(0)
