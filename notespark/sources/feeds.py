"""Stored feeds and other structured files: facts, snapshots, scans, repositories, manifests.

Fetching from the network is left to whoever fills the folders these read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark import schema
from notespark.functions import text as tx
from notespark.operators import dependencies


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Indented JSON files; what cannot be read gives no rows, as an empty store would."""
    return spark.read.schema(ddl).json(path, multiLine=True, mode="DROPMALFORMED")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schema.FACT)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schema.SNAPSHOT)


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """A stored radar scan as rows ``(scan_date, relevance, name, description, ...)``."""
    scan = read_json(spark, path, schema.RADAR_SCAN)
    bands = [
        scan.select("scan_date", F.lit(band).alias("relevance"), F.inline(f"{band}_relevance"))
        for band in ("high", "medium", "low")
    ]
    return bands[0].unionByName(bands[1]).unionByName(bands[2])


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of a stored search result, with the defaults of missing fields."""
    rows = read_json(spark, path, schema.REPO)
    return rows.select(
        "full_name", F.coalesce("description", F.lit("")).alias("description"),
        F.col("html_url").alias("url"), F.col("stargazers_count").alias("stars"),
        F.col("forks_count").alias("forks"), F.coalesce("language", F.lit("Unknown")).alias("language"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        "created_at", "pushed_at",
    )


def readme_text(encoded: str = "content"):
    """Text of a readme delivered in base64."""
    return F.decode(F.unbase64(F.regexp_replace(encoded, r"\s", "")), "UTF-8")


def read_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of all projects from their manifests: ``(project, manager, name, current)``."""
    return dependencies.from_manifests(files)


def watch_list(files: DataFrame, path: str = "_global/github-watchlist.md") -> DataFrame:
    """Rows of the watch list's table; names and categories may hold dashes."""
    row = r"^\|\s*\d+\s*\|\s*\[@?([\w-]+)\].*?\|\s*([\w-]+)\s*\|\s*([\d-]+)\s*\|"
    lines = files.where(F.col("path") == path).select(F.posexplode(tx.lines("raw_content")))
    found = lines.where(F.col("col").rlike(row))
    return found.select(
        F.col("pos").alias("line"),
        *[
            F.regexp_extract("col", row, i).alias(name)
            for i, name in enumerate(["username", "category", "added"], 1)
        ],
    )
