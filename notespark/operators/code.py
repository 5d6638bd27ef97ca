"""Source code: layers, imports, stacks, routes and services of projects.

Files come as ``(project, path, raw_content)`` with paths relative to the project.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from notespark import vocab
from notespark.functions import text as tx
from notespark.operators.dependencies import npm_dependencies
from notespark.scale import top_per_key
from notespark.session import cut_lineage


def suffix(path: Column | str) -> Column:
    """Last suffix of the file name, with its dot."""
    return F.regexp_extract(tx.col(path), r"[^/](\.[^./]+)\z", 1)


def layer(path: Column | str) -> Column:
    """First layer with a keyword inside any part of the path.

    A keyword has no slash, so it lies inside a part exactly when it lies inside the path.
    """
    return tx.first_rule(F.lower(tx.col(path)), vocab.LAYERS, vocab.OTHER_LAYER)


def source_files(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Source files of each project: known suffixes, no hidden or built directories, and the
    first ``max_files`` by path when a limit is given."""
    dirs = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    skipped = F.array(*[F.lit(d) for d in vocab.CODE_SKIP_DIRS])
    kept = files.where(
        suffix("path").isin(list(vocab.CODE_LANGUAGES))
        & ~F.arrays_overlap(dirs, skipped) & ~F.exists(dirs, lambda d: d.startswith("."))
    )
    if max_files is None:
        return kept
    return top_per_key(kept, ["project"], [F.col("path")], max_files).drop("rank")


def _python_names(source: str | None) -> list[str]:
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    modules = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            modules += [alias.name for alias in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            modules.append(node.module)
    out = []
    for module in modules:
        first, _, rest = module.partition(".")
        out.append(first)
        if rest:
            out.append(rest.rpartition(".")[2])
    return out


@pandas_udf(ArrayType(StringType()))
def python_imports(sources: pd.Series) -> pd.Series:
    """First and last part of every imported module, by Python's own parser."""
    return sources.map(_python_names)


def script_imports(source: Column | str) -> Column:
    pairs = F.zip_with(
        tx.find_all(source, vocab.TS_IMPORT, 1), tx.find_all(source, vocab.TS_IMPORT, 2),
        lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b),
    )
    bare = F.transform(pairs, lambda t: F.regexp_replace(t, r"^[./]+", ""))
    return F.transform(F.filter(bare, lambda t: t != ""), lambda t: F.split_part(t, F.lit("/"), F.lit(1)))


def dart_imports(source: Column | str) -> Column:
    targets = F.filter(tx.find_all(source, vocab.DART_IMPORT, 1), lambda t: ~t.startswith("dart:"))
    return F.transform(
        targets,
        lambda t: F.split_part(F.regexp_replace(t, "^package:", ""), F.lit("/"), F.lit(1)),
    )


def modules(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """One row per source file with its layer, language, imports and number of lines.

    Only Python sources pass through the Python parser.
    """
    language = F.when(F.lit(False), F.lit(""))
    for ext, name in vocab.CODE_LANGUAGES.items():
        language = language.when(suffix("path") == ext, F.lit(name))
    rows = source_files(files, max_files).withColumn("language", language)
    # a file that ends with a line break has no further line
    ends = F.when(F.col("raw_content").endswith("\n") | (F.col("raw_content") == ""), F.lit(0)).otherwise(1)
    rows = rows.withColumn("size_lines", F.regexp_count("raw_content", F.lit("\n")) + ends)
    fields = ["project", "path", tx.stem("path").alias("name"), layer("path").alias("layer"), "language"]
    python = rows.where(F.col("language") == "python").select(
        *fields, python_imports("raw_content").alias("imports"), "size_lines")
    script = F.when(F.col("language") == "dart", dart_imports("raw_content")).otherwise(
        script_imports("raw_content"))
    others = rows.where(F.col("language") != "python").select(
        *fields, script.alias("imports"), "size_lines")
    return python.unionByName(others)


def _imports(found: DataFrame) -> DataFrame:
    return found.select("project", "path", F.explode("imports").alias("name")).distinct()


def edges(found: DataFrame) -> DataFrame:
    """Imports between a project's own files; of files with one name the last path counts."""
    named = cut_lineage(found.groupBy("project", "name").agg(F.max("path").alias("target")))
    return (
        _imports(found).join(named, ["project", "name"]).where("path <> target")
        .select("project", F.col("path").alias("source"), "target").distinct()
    )


def external(found: DataFrame) -> DataFrame:
    """Imported names that are no file of the project."""
    own = found.select("project", "name")
    return _imports(found).select("project", "name").distinct().join(own, ["project", "name"], "left_anti")


def layer_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("project", "layer").agg(
        F.count(F.lit(1)).alias("modules"), F.sum("size_lines").alias("lines")
    )


def stacks(files: DataFrame) -> DataFrame:
    """Technologies of each project by its marker files and npm packages: ``(project, tech)``."""
    root = files.where(~F.contains("path", F.lit("/")))
    by_file = F.array_compact(
        F.array(*[F.when(F.col("path") == f, F.lit(t)) for f, t in vocab.STACK_FILES])
    )
    names = F.transform(npm_dependencies(F.col("raw_content")), lambda d: d["name"])
    by_package = F.when(
        F.col("path") == "package.json",
        F.array_compact(
            F.array(*[F.when(F.array_contains(names, p), F.lit(t)) for p, t in vocab.STACK_PACKAGES])
        ),
    ).otherwise(F.array().cast("array<string>"))
    return root.select("project", F.explode(F.concat(by_file, by_package)).alias("tech")).distinct()


def routes(files: DataFrame) -> DataFrame:
    """Routes declared in Python files and by route files, each once: ``(project, path, method)``."""
    usable = files.where(~F.contains("path", F.lit("node_modules")) & ~F.contains("path", F.lit(".venv")))
    python = usable.where(F.col("path").endswith(".py"))
    pairs = F.arrays_zip(
        tx.find_all("raw_content", vocab.PY_ROUTE, 2).alias("route"),
        F.transform(tx.find_all("raw_content", vocab.PY_ROUTE, 1), F.upper).alias("method"),
    )
    declared = python.select("project", F.inline(pairs))
    by_file = usable.where(F.col("path").rlike(r"^app/api/(?:.*/)?route\.[tj]s$"))
    body = F.col("raw_content")
    methods = F.array_compact(
        F.array(
            *[
                F.when(body.rlike(rf"export (?:async )?function {m}"), F.lit(m))
                for m in vocab.HTTP_METHODS
            ]
        )
    )
    methods = F.when(F.size(methods) > 0, methods).otherwise(F.array(F.lit("GET")))
    endpoint = F.concat(
        F.lit("/"), F.translate(F.regexp_replace("path", r"^app/|/route\.[tj]s$", ""), "[]", ":")
    )
    exported = by_file.select("project", endpoint.alias("route"), F.explode(methods).alias("method"))
    return declared.unionByName(exported).distinct()


def pages(files: DataFrame) -> DataFrame:
    """Pages a project shows: app router pages, templates and screens."""
    path = F.col("path")
    route = F.concat(
        F.lit("/"), F.translate(F.regexp_replace(path, r"^app/|/?page\.[tj]sx$", ""), "[]", ":")
    )
    name = tx.stem(path)
    page = (
        F.when(path.rlike(r"^app/(?:.*/)?page\.[tj]sx$"), route)
        .when(path.rlike(r"^templates/.*\.html$"), F.concat(F.lit("/"), name))
        .when(path.rlike(r"^lib/(?:screens|pages|views)/.*\.dart$"),
              F.regexp_replace(name, "_screen|_page", ""))
    )
    return files.select("project", page.alias("page")).where(
        F.col("page").isNotNull() & ~F.contains("page", F.lit("/api/"))
    ).distinct()


def databases(files: DataFrame) -> DataFrame:
    """Database of each project with its models: a Prisma schema, else ``models.py``, else a
    database file or a use of the driver."""
    path, body = F.col("path"), F.col("raw_content")
    provider = F.regexp_extract(body, r'provider\s*=\s*"(\w+)"', 1)
    label = provider
    for key, name in vocab.SCHEMA_PROVIDERS.items():
        label = F.when(provider == key, F.lit(name)).otherwise(label)
    usable = ~F.contains(path, F.lit("node_modules")) & ~F.contains(path, F.lit(".venv"))
    prisma = path == "prisma/schema.prisma"
    classes = usable & path.rlike(r"(^|/)models\.py$")
    plain = usable & (path.endswith(".db") | (path.endswith(".py") & F.contains(body, F.lit("sqlite3"))))
    none = F.array().cast("array<string>")
    rows = files.select(
        "project", "path",
        F.when(prisma, F.lit(0)).when(classes, F.lit(1)).when(plain, F.lit(2)).alias("rank"),
        F.when(prisma, F.concat(F.lit("Prisma + "), label)).when(classes, F.lit("SQLAlchemy"))
        .otherwise(F.lit("SQLite")).alias("db_type"),
        F.when(prisma, tx.find_all(body, r"(?m)^model\s+(\w+)", 1))
        .when(classes, tx.find_all(body, r"class\s+(\w+)\(.*(?:Base|Model|db\.Model)", 1))
        .otherwise(none).alias("models"),
    ).where(F.col("rank").isNotNull())
    best = rows.groupBy("project").agg(F.min("rank").alias("rank"))
    return rows.join(best, ["project", "rank"]).select(
        "project", "db_type", F.explode_outer("models").alias("model")
    ).distinct()


def services(files: DataFrame) -> DataFrame:
    """Outside services whose marks occur in a project's sources: ``(project, service)``.

    Whole files are read, and each file tells its services in its own row.
    """
    body = F.col("raw_content")
    marks = F.array_compact(
        F.array(
            *[
                F.when(body.rlike("(?i)" + "|".join(patterns)), F.lit(name))
                for name, patterns in vocab.SERVICE_PATTERNS
            ]
        )
    )
    skipped = ["node_modules", ".venv", ".next", "build", ".dart_tool"]
    kept = files.where(
        suffix("path").isin(list(vocab.CODE_LANGUAGES)) & ~tx.contains_any(F.col("path"), skipped)
    )
    return kept.select("project", F.explode(marks).alias("service")).distinct()
