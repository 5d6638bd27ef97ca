"""The vault's catalog and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark import vocab
from notespark.functions import text as tx


def catalog_lines(notes: DataFrame) -> DataFrame:
    """One catalog line per note of a project directory, with its place in the catalog.

    Lines stay rows: a writer range-sorts them by ``project, rank, path``, so no project is ever
    put together in one task.
    """
    project = F.split("path", "/")[0]
    rows = notes.where(F.contains("path", F.lit("/"))).withColumn("directory", project)
    return rows.where(~F.col("directory").rlike(r"^[._]")).select(
        F.col("directory").alias("project"),
        tx.type_rank("note_type", vocab.CATALOG_TYPE_RANK).alias("rank"), "path",
        F.concat(
            F.lit("- ["), "title", F.lit("]("), "path", F.lit(") `"), "note_type", F.lit("` — "),
            tx.summary_line("content"),
        ).alias("line"),
    )


def catalog_headers(notes: DataFrame) -> DataFrame:
    """Heading of each project: its number of notes and their types."""
    types = (
        notes.where(F.contains("path", F.lit("/")))
        .groupBy(F.split("path", "/")[0].alias("project"), "note_type").agg(F.count(F.lit(1)).alias("n"))
        .where(~F.col("project").rlike(r"^[._]"))
    )
    listed = types.groupBy("project").agg(
        F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("note_type")), ", ").alias("t")
    )
    return listed.select(
        "project",
        F.concat(F.lit("## 📁 "), "project", F.lit(" ("), F.col("n").cast("string"), F.lit(" notes: "), "t",
                 F.lit(")")).alias("line"),
    )


def global_lines(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("path").startswith("_global/")).select(
        "path", F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(") — "), "note_type").alias("line")
    )


def catalog(notes: DataFrame) -> DataFrame:
    """Headers and lines in reading order."""
    heads = catalog_headers(notes).select(
        "project", F.lit(-1).alias("rank"), F.lit("").alias("path"), "line")
    return heads.unionByName(catalog_lines(notes)).orderBy("project", "rank", "path")


def write_catalog(notes: DataFrame, path: str) -> None:
    """Write the catalog as text files whose order is the reading order."""
    catalog(notes).select("line").write.mode("overwrite").text(path)
