"""Packing a project's files into a token budget, most important first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import vocab
from notespark.functions import text as tx
from notespark.operators.code import suffix
from notespark.scale import running_sum, top_per_key


def packable(files: DataFrame) -> DataFrame:
    """Files worth packing: no built or hidden tool directories, lock files or binaries."""
    parts = F.split("path", "/")
    skipped = F.array(*[F.lit(d) for d in vocab.PACK_SKIP_DIRS])
    name = F.element_at(parts, -1)
    minified = F.lit(False)
    for end in vocab.PACK_SKIP_SUFFIXES:
        minified = minified | F.lower("path").endswith(end)
    return files.where(
        ~F.arrays_overlap(parts, skipped) & ~name.isin(vocab.PACK_SKIP_FILES)
        & ~F.lower(suffix("path")).isin(vocab.PACK_SKIP_EXTS) & ~minified
    )


def priority(path: Column | str) -> Column:
    path = tx.col(path)
    return (
        F.when(tx.contains_any(path, vocab.PACK_HIGH), F.lit("high"))
        .when(tx.contains_any(F.lower(path), vocab.PACK_LOW), F.lit("low"))
        .otherwise(F.lit("medium"))
    )


def shortened(content: Column, keep: int) -> Column:
    """First two thirds and last third of the lines to keep, with a mark of what is left out."""
    head = keep * 2 // 3
    tail = keep - head

    def cut(lines: Column) -> Column:
        kept = F.concat(
            F.array_join(F.slice(lines, 1, head), "\n"), F.lit("\n\n... ["),
            (F.size(lines) - keep).cast("string"), F.lit(" lines omitted] ...\n\n"),
            F.array_join(F.slice(lines, -tail, tail), "\n"),
        )
        return F.when(F.size(lines) <= keep, content).otherwise(kept)

    return tx.let(F.split(content, "\n"), cut)


def prepared(files: DataFrame, mode: str = "compact") -> DataFrame:
    """Files with priority, content as the mode shows it, and token estimate."""
    rows = tx.once(
        packable(files), priority=priority("path"), size_lines=F.size(F.split("raw_content", "\n"))
    )
    content = F.col("raw_content")
    limit = F.lit(None).cast("int")
    for level, keep in vocab.PACK_LINES[mode].items():
        here = F.col("priority") == level
        if keep == 0:
            rows = rows.where(~here)
        elif keep is not None:
            content = F.when(here, shortened(F.col("raw_content"), keep)).otherwise(content)
            limit = F.when(here, F.lit(keep)).otherwise(limit)
    rows = tx.once(
        rows, content=content, compressed=F.coalesce(F.col("size_lines") > limit, F.lit(False))
    )
    return rows.withColumn("token_estimate", tx.estimated_tokens("content")).drop("raw_content")


def pack(files: DataFrame, mode: str = "compact", budget: int | None = None,
         keys: Sequence[str] = ("project",)) -> DataFrame:
    """Files of each project, by priority and path, while the tokens before are below budget.

    The last file taken may overshoot.  Tokens before a file are summed range by range, so one
    large project does not fall to one task; contents are not moved for that.
    """
    budget = vocab.PACK_BUDGET[mode] if budget is None else budget
    rows = prepared(files, mode)
    rank = F.when(F.lit(False), F.lit(0))
    for level, value in vocab.PACK_RANK.items():
        rank = rank.when(F.col("priority") == level, F.lit(value))
    # rank and path as one sortable key
    rows = rows.withColumn("_at", F.concat(rank.cast("string"), F.lit(" "), "path"))
    sizes = rows.select(*keys, "_at", "token_estimate")
    before = running_sum(sizes, list(keys), "_at", F.col("token_estimate"), "tokens_before")
    taken = before.where(F.col("tokens_before") < budget).select(*keys, "_at", "tokens_before")
    return rows.join(taken, [*keys, "_at"]).drop("_at")


def pack_summary(packed: DataFrame, files: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    total = packable(files).groupBy(*keys).agg(F.count(F.lit(1)).alias("total_files"))
    used = packed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("included_files"), F.sum("size_lines").alias("total_lines"),
        F.sum("token_estimate").alias("token_estimate"),
    )
    return total.join(used, list(keys), "left").fillna(0)


def tree(files: DataFrame, children: int = vocab.TREE_CHILDREN) -> DataFrame:
    """Top of a project's file tree: root files, and directories with count and first files."""
    parts = F.split("path", "/")
    rows = files.select(
        "project", F.when(F.size(parts) > 1, parts[0]).alias("directory"),
        F.when(F.size(parts) > 1, F.regexp_replace("path", r"^[^/]*/", "")).otherwise(F.col("path")).alias("file"),
    )
    root = rows.where(F.col("directory").isNull()).select(
        "project", F.lit("").alias("directory"), F.col("file").alias("line"))
    inner = rows.where(F.col("directory").isNotNull())
    count = inner.groupBy("project", "directory").agg(F.count(F.lit(1)).alias("n"))
    first = top_per_key(inner, ["project", "directory"], [F.col("file")], children)
    more = F.when(F.col("n") > children, F.concat(F.lit("... +"), (F.col("n") - children).cast("string"), F.lit(" more")))
    heads = count.select(
        "project", "directory",
        F.explode(F.array_compact(F.array(
            F.concat("directory", F.lit("/ ("), F.col("n").cast("string"), F.lit(" files)")), more
        ))).alias("line"),
    )
    return root.unionByName(heads).unionByName(
        first.select("project", "directory", F.col("file").alias("line"))
    )


def database_schema(files: DataFrame) -> DataFrame:
    """Each project's Prisma schema, else the start of its first models file."""
    prisma = F.col("path") == "prisma/schema.prisma"
    model = F.col("path").rlike(r"(^|/)models\.py$") & ~F.contains("path", F.lit("node_modules"))
    found = files.where(prisma | model).select(
        "project",
        F.struct(
            F.when(prisma, F.lit(0)).otherwise(F.lit(1)).alias("rank"), "path",
            F.when(prisma, F.col("raw_content"))
            .otherwise(F.substring("raw_content", 1, vocab.SCHEMA_CHARS)).alias("schema"),
        ).alias("_s"),
    )
    return found.groupBy("project").agg(F.min("_s").alias("_s")).select("project", "_s.path", "_s.schema")
