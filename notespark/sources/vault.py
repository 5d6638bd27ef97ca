"""Notes: reading a directory of Markdown files and parsing them.

Input of the parser is a table of files ``(path, raw_content)`` with paths relative to the
vault, so that files kept in Parquet parse the same way as files read from a directory.
"""

from __future__ import annotations

import datetime
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from notespark import schema, vocab
from notespark.functions import text as tx

FRONT_MATTER = r"(?sd)\A\s*-{3,}[^\S\n]*\n(.*?)(?<=\n)-{3,}[^\S\n]*(?:\n|\z)"


def _hidden_paths(spark: SparkSession, root: str) -> list[str]:
    """Files and directories Spark's listing passes over for their names, at any depth.

    Named as inputs of their own they are read like others; a scan decides which of them count.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, level = [], root.rstrip("/")
    while True:
        hidden = fs.globStatus(hadoop.Path(f"{level}/[_.]*")) or []
        found += [status.getPath().toString() for status in hidden]
        level += "/*"
        if not any(status.isDirectory() for status in fs.globStatus(hadoop.Path(level)) or []):
            return found


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All files under ``root`` matching ``glob``, one row each, listed and read by Spark."""
    found = spark.read.text(
        [root, *_hidden_paths(spark, root)], wholetext=True, recursiveFileLookup=True,
        pathGlobFilter=glob,
    ).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("_p"),
        F.col("value").alias("raw_content"),
    )
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(path).toUri().getPath().rstrip("/")
    # what follows the root itself, however often its name comes again below it
    inside = F.regexp_replace("_p", r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    relative = F.substring(inside, len(base.encode("utf-16-le")) // 2 + 2, 1 << 30)
    return found.select(relative.alias("path"), "raw_content")


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    return read_files(spark, root, "*.md")


def in_scan(path: Column | str) -> Column:
    """Whether a scan takes a file: no hidden part, not below the template directory."""
    parts = F.split(tx.col(path), "/")
    return ~F.exists(parts, lambda p: p.startswith(".")) & ~F.array_contains(
        parts, vocab.TEMPLATE_DIR
    )


def _plain(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, (list, dict)):
        return json.dumps(value, ensure_ascii=False, default=str)
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


# Plain scalars that YAML takes for truth values or null; anything else made of words is text.
_YAML_WORDS = {"yes", "no", "true", "false", "on", "off", "null", "y", "n"}
# A number sign inside a word is part of it; at the head of one it starts a comment.
_WORDS = r"[A-Za-z][\w./#-]*(?: [\w./-][\w./#-]*)*"
_FIELD = re.compile(r"([A-Za-z_][\w-]*):(?: +(.*?))? *")
_ITEM = re.compile(rf" *- +(?:\"([\w ./-]*)\"|({_WORDS})) *")
_SCALAR = re.compile(rf"{_WORDS}|\d{{4}}-\d\d-\d\d", re.ASCII)
_LIST = re.compile(rf"\[ *({_WORDS}(?: *, *{_WORDS})*) *\]", re.ASCII)


def _simple_yaml(block: str) -> dict | None:
    """Fields of a block made of plain words, days and lists of words only, the common case.

    Gives up (None) on any line whose meaning is not plain, for the YAML parser to decide.
    """
    fields: dict = {}
    key = None
    for line in block.split("\n"):
        item = _ITEM.fullmatch(line)
        if item and key is not None and isinstance(fields[key], list):
            word = item[1] if item[1] is not None else item[2]
            if item[1] is None and word.lower() in _YAML_WORDS:
                return None
            fields[key].append(word)
            continue
        if not line:
            continue
        field = _FIELD.fullmatch(line)
        if not field or field[1].lower() in _YAML_WORDS or not line.isascii():
            return None
        if key is not None and fields[key] == []:
            return None
        key, value = field[1], field[2]
        if key in fields:
            return None
        if not value:
            fields[key] = []  # items must follow
            continue
        listed = _LIST.fullmatch(value)
        if listed:
            fields[key] = [w.strip() for w in listed[1].split(",")]
            words = fields[key]
        elif _SCALAR.fullmatch(value):
            if value[0].isdigit():
                try:
                    datetime.date.fromisoformat(value)
                except ValueError:
                    return None
            fields[key] = value
            words = [value]
        else:
            return None
        if any(w.lower() in _YAML_WORDS for w in words):
            return None
        if listed:
            key = None
    if not fields or (key is not None and fields[key] == []):
        return None
    return fields


def _yaml(block: str) -> dict | None:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        fields = yaml.load(block, Loader=loader)
    except (yaml.YAMLError, ValueError):
        return None
    return fields if isinstance(fields, dict) else None


def _read_yaml(block: str | None) -> str | None:
    """One front-matter block as JSON: fields as strings, and the tags."""
    if not block:
        return None
    fields = _simple_yaml(block)
    if fields is None:
        fields = _yaml(block)
    if fields is None:
        return None
    tags = fields.get("tags")
    if isinstance(tags, str):
        tags = [t.strip() for t in tags.split(",")]
    elif not isinstance(tags, list):
        tags = []
    meta = {str(k): _plain(v) for k, v in fields.items()}
    return json.dumps({"meta": meta, "tags": [_plain(t) or "" for t in tags]}, ensure_ascii=False)


@pandas_udf(StringType())
def yaml_as_json(blocks: pd.Series) -> pd.Series:
    return blocks.map(_read_yaml)


def with_front_matter(files: DataFrame) -> DataFrame:
    """Add ``meta``, ``meta_tags`` and ``body``.

    Only the front-matter block itself goes through Python; the text stays in the JVM.
    """
    read = files.withColumn("_json", yaml_as_json(F.regexp_extract("raw_content", FRONT_MATTER, 1)))
    parsed = tx.once(
        read, _fm=F.from_json("_json", schema.NOTE_META),
        body=tx.strip(F.regexp_replace("raw_content", FRONT_MATTER, "")),
    )
    return parsed.select(
        *files.columns,
        F.coalesce(F.col("_fm.meta"), F.create_map().cast("map<string,string>")).alias("meta"),
        F.coalesce(F.col("_fm.tags"), F.array().cast("array<string>")).alias("meta_tags"), "body",
    )


def parse_notes(files: DataFrame) -> DataFrame:
    """Files to notes.  Narrow: no shuffle."""
    notes = with_front_matter(files)
    parts = F.split("path", "/")
    folder = F.when((F.size(parts) > 1) & ~parts[0].startswith("_"), parts[0]).otherwise(F.lit(""))

    def field(name: str) -> Column:
        return F.try_element_at(F.col("meta"), F.lit(name))

    named = F.coalesce(field("project"), F.lit(""))
    return notes.select(
        "path",
        tx.stem("path").alias("stem"),
        tx.title("body", "path").alias("title"),
        tx.clean("body").alias("content"),
        "raw_content",
        F.when(named != "", named).otherwise(folder).alias("project"),
        F.coalesce(field("type"), F.lit(vocab.DEFAULT_TYPE)).alias("note_type"),
        F.array_sort(F.array_union("meta_tags", tx.inline_tags("body"))).alias("tags"),
        F.coalesce(field("priority"), F.lit(vocab.DEFAULT_PRIORITY)).alias("priority"),
        field("created").alias("created"),
        field("updated").alias("updated"),
        tx.checksum("raw_content").alias("checksum"),
        "meta",
    )


def scan(files: DataFrame, filter_tags: list[str] | None = None) -> DataFrame:
    """Parsed notes of a vault, optionally only those with one of the tags or types."""
    notes = parse_notes(files.where(in_scan("path")))
    if not filter_tags:
        return notes
    wanted = [t.lower() for t in filter_tags]
    return notes.where(
        F.arrays_overlap(
            F.transform("tags", lambda t: F.lower(t)), F.array(*[F.lit(t) for t in wanted])
        )
        | F.lower("note_type").isin(wanted)
    )


def projects(files: DataFrame) -> DataFrame:
    """Top-level directories that are projects."""
    parts = F.split("path", "/")
    return (
        files.where(F.size(parts) > 1)
        .select(parts[0].alias("project"))
        .where(~F.col("project").rlike(r"^[._]"))
        .distinct()
    )


def project_notes(files: DataFrame, project: str) -> DataFrame:
    """Notes below a project's directory, whatever project their front matter names."""
    return parse_notes(files.where(F.col("path").startswith(project + "/")))


def get_note(files: DataFrame, path: str) -> DataFrame:
    """One note by path; none when the path leaves the vault."""
    return parse_notes(files.where((F.col("path") == path) & tx.is_inside("path")))


def project_context(files: DataFrame, project: str) -> DataFrame:
    """A project's notes in reading order."""
    return project_notes(files, project).orderBy(
        tx.type_rank("note_type", vocab.CONTEXT_TYPE_RANK), "path"
    )


def list_projects(notes: DataFrame) -> DataFrame:
    """Notes and note types per project directory."""
    return (
        notes.withColumn("directory", F.split("path", "/")[0])
        .where(F.contains("path", F.lit("/")) & ~F.col("directory").rlike(r"^[._]"))
        .groupBy("directory", "note_type").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("directory")
        .agg(
            F.sum("n").alias("notes"),
            F.array_join(F.array_sort(F.collect_list("note_type")), ", ").alias("types"),
        )
        .withColumnRenamed("directory", "project")
    )
