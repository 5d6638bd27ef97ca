"""Notes derived from the given tables.

The tables hold texts, pages, orders, conversations and events but no Markdown.  Each function
here writes them out as note files ``(path, raw_content)``, row by row, so that the operators
run on the tables at any size.  The SQL beside each function states the same notes for the
correctness check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark import vocab
from notespark.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read in the splits that the session's file settings make."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ------------------------------------------------------------------- documents as notes

TYPE_OF_LANG = {"en": "note", "fr": "decision", "de": "architecture", "es": "research"}


def _mapped(column, mapping: dict, other: str):
    out = F.when(F.lit(False), F.lit(other))
    for key, value in mapping.items():
        out = out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(other))


def _sql_mapped(column: str, mapping: dict, other: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {cases} ELSE '{other}' END"


def _sql_rules(column: str, rules: list, other: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{label}'"
        for label, words in rules
    )
    return f"CASE {cases} ELSE '{other}' END"


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a note of its source's project."""
    d = table(spark, folder, "documents")
    c = F.col
    created = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(c("doc_id"), F.lit(400)).cast("int"))
    return d.select(
        "doc_id",
        _text(c("source"), "/doc-", c("doc_id"), ".md").alias("path"),
        _text(
            "---\nproject: ", c("source"), "\ntype: ", _mapped(c("lang"), TYPE_OF_LANG, "note"),
            "\ntags: [", c("lang"), ", corpus]\ncreated: ", created,
            "\n---\n\n# Document ", c("doc_id"), "\n\n", c("text"), "\n",
        ).alias("raw_content"),
    )


DOCUMENT_NOTES = rf"""
files AS (
  SELECT doc_id, source || '/doc-' || doc_id || '.md' AS path, source AS project,
    {_sql_mapped('lang', TYPE_OF_LANG, 'note')} AS note_type, lang, text AS body_text,
    CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) AS VARCHAR) AS created,
    'Document ' || doc_id AS title
  FROM documents),
notes AS (
  SELECT doc_id, path, project, note_type, created, title,
    '---' || chr(10) || 'project: ' || project || chr(10) || 'type: ' || note_type || chr(10)
      || 'tags: [' || lang || ', corpus]' || chr(10) || 'created: ' || created || chr(10) || '---'
      || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || body_text || chr(10)
      AS raw_content,
    regexp_replace(regexp_replace('# ' || title || chr(10) || chr(10) || body_text,
      '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS content,
    list_sort(list_distinct(list_concat([lang, 'corpus'],
      regexp_extract_all(body_text, '(?m)(?:^|\s)#([a-zA-Z0-9_-]+)', 1)))) AS tags
  FROM files)"""


# ----------------------------------------------------------------------- pages as notes


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each page as a note with wikilinks for its links, and a stub note for every link word
    that six or more pages use; links to rarer words stay broken."""
    pages = table(spark, folder, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^https?://[^/]*\.([a-z]+)(?:[/:?#]|$)", 1).alias("project"),
        F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1)).alias("words"),
    )
    body = F.array_join(F.transform("words", lambda w: F.concat(F.lit("- [["), w, F.lit("]]"))), "\n")
    notes = pages.select(
        _text(F.col("project"), "/page-", F.col("page_id"), ".md").alias("path"),
        _text(
            "---\nproject: ", F.col("project"), "\ntype: research\n---\n\n# Page ",
            F.col("page_id"), "\n\n", body, "\n",
        ).alias("raw_content"),
    )
    used = pages.select("page_id", F.explode(F.array_distinct(F.transform("words", F.lower))).alias("word"))
    stubs = (
        used.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 6")
        .select(
            _text("concepts/", F.col("word"), ".md").alias("path"),
            _text("# ", F.col("word"), "\n\nStub.\n").alias("raw_content"),
        )
    )
    return notes.unionByName(stubs)


PAGE_LINKS = r"""
page_words AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/]*\.([a-z]+)(?:[/:?#]|$)', 1) AS project,
    regexp_extract_all(html, 'href="/([^"]*)"', 1) AS words
  FROM pages),
page_targets AS (
  SELECT page_id, project, unnest(words) AS target FROM page_words),
stubs AS (
  SELECT lower(target) AS word FROM page_targets
  GROUP BY 1 HAVING count(DISTINCT page_id) >= 6),
graph_nodes AS (
  SELECT 'page-' || page_id AS stem, project || '/page-' || page_id || '.md' AS path, project,
    'Page ' || page_id AS title FROM page_words
  UNION ALL
  SELECT word, 'concepts/' || word || '.md', 'concepts', word FROM stubs),
graph_links AS (
  SELECT 'page-' || page_id AS source, project || '/page-' || page_id || '.md' AS path,
    target, lower(target) AS key
  FROM page_targets WHERE target <> ''),
graph_edges AS (
  SELECT source, key AS target, count(*) AS n
  FROM graph_links WHERE key IN (SELECT stem FROM graph_nodes) AND key <> source GROUP BY 1, 2)"""


# ---------------------------------------------------------------------- orders as notes

STATUS_OF_ORDER = {"F": "failed", "O": "success", "P": "partial"}
TECH_OF_PRIORITY = {
    "1-URGENT": "flutter", "2-HIGH": "react", "3-MEDIUM": "redis", "4-NOT SPECIFIED": "postgres",
    "5-LOW": "docker",
}
TECH_OF_ORDER = {"F": "clerk", "O": "vercel", "P": "something else"}


def order_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as a decision note with an outcome, in its customer segment's project.

    Orders whose total is below 20000 have no outcome yet.
    """
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    c = F.col
    status = _mapped(c("o_orderstatus"), STATUS_OF_ORDER, "unknown")
    outcome = _text(
        "\n## Outcome\n**Status**: ", status, "\n**Lessons learned**: plan ",
        c("o_orderpriority"), " work first\n",
    )
    return spread(orders.join(customers, c("o_custkey") == c("c_custkey"))).select(
        "o_orderkey",
        _text(F.lower("c_mktsegment"), "/order-", c("o_orderkey"), ".md").alias("path"),
        _text(
            "---\nproject: ", F.lower("c_mktsegment"), "\ntype: decision\ncreated: ",
            c("o_orderdate").cast("date"), "\n---\n\n# Order ", c("o_orderkey"),
            "\n\n## Decision\nCustomer ", c("o_custkey"), " uses ",
            _mapped(c("o_orderpriority"), TECH_OF_PRIORITY, "nothing"), " and more.\nThey migrated from ",
            _mapped(c("o_orderstatus"), TECH_OF_ORDER, "nothing"), " to ",
            _mapped(c("o_orderpriority"), TECH_OF_PRIORITY, "nothing"), ".\n",
            F.when(c("o_totalprice") < 20000, F.lit("")).otherwise(outcome),
        ).alias("raw_content"),
    )


ORDER_NOTES = f"""
order_notes AS (
  SELECT o_orderkey, lower(c_mktsegment) AS project,
    lower(c_mktsegment) || '/order-' || o_orderkey || '.md' AS path, 'Order ' || o_orderkey AS title,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created, o_totalprice >= 20000 AS has_outcome,
    {_sql_mapped('o_orderstatus', STATUS_OF_ORDER, 'unknown')} AS status,
    'plan ' || o_orderpriority || ' work first' AS lessons, o_custkey,
    {_sql_mapped('o_orderpriority', TECH_OF_PRIORITY, 'nothing')} AS tech,
    {_sql_mapped('o_orderstatus', TECH_OF_ORDER, 'nothing')} AS old_tech
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# --------------------------------------------------------------- conversations as notes

CAUSES = {"user": "Build failed", "assistant": "API timeout", "system": "Firebase crashed"}


def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of a conversation as a session note; every line of it is a reported issue."""
    turns = table(spark, folder, "conversations")
    c = F.col
    bullets = F.regexp_replace(c("text"), r"(?m)^", "- ")
    cause = _text(_mapped(c("role"), CAUSES, "Trouble"), " in turn ", c("turn"), ", workaround: retry ", c("role"))
    return turns.select(
        "conv_id", "turn", "role",
        _text("conv-", c("conv_id"), "/session-", c("turn"), ".md").alias("path"),
        _text(
            "---\nproject: conv-", c("conv_id"), "\ntype: note\ntags: [session]\n---\n\n# Session ",
            c("turn"), "\n\n## What Was Done\n- a turn of the talk\n\n### What Failed\n- ", cause, "\n",
            bullets, "\n\n## Next\n- more\n",
        ).alias("raw_content"),
    )


SESSION_ISSUES = f"""
issue_lists AS (
  SELECT 'conv-' || conv_id AS project, 'Session ' || turn AS session,
    'conv-' || conv_id || '/session-' || turn || '.md' AS path,
    list_prepend({_sql_mapped('role', CAUSES, 'Trouble')} || ' in turn ' || turn
      || ', workaround: retry ' || role, string_split(text, chr(10))) AS lines
  FROM conversations),
issue_lines AS (
  SELECT project, session, path, generate_subscripts(lines, 1) AS line,
    trim(unnest(lines)) AS issue_text FROM issue_lists),
issues AS (
  SELECT *, trim(regexp_extract(issue_text, '(?i)(?:workaround|fix(?:ed)?|solution|resolved|switched '
      || 'to|replaced with|instead of)\\s*[:—–-]?\\s*(.+)', 1)) AS workaround,
    {{category}} AS category,
    substr(trim(regexp_replace(regexp_replace(issue_text, '[a-f0-9]{{{{7,}}}}', '<hash>', 'g'),
      '\\s+', ' ', 'g')), 1, 80) AS pattern
  FROM issue_lines WHERE length(issue_text) >= 10)""".replace("{category}", _sql_rules(
    "lower(issue_text)", vocab.ISSUE_CATEGORIES, vocab.OTHER_CATEGORY)).replace("{{", "{").replace("}}", "}")


# --------------------------------------------------------------------- events as facts

PREDICATE_OF_EVENT = {
    "click": "uses", "view": "uses_db", "signup": "prefers", "purchase": "deploys_to",
    "error": "reports",
}


def event_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as a statement about its user, in order of arrival ``seq``."""
    e = table(spark, folder, "events")
    level = F.floor(F.get_json_object("props", "$.k").cast("bigint") / 20)
    return e.select(
        F.col("event_id").alias("seq"),
        _text("user-", F.col("user_id")).alias("subject"),
        _mapped(F.col("event_type"), PREDICATE_OF_EVENT, "other").alias("predicate"),
        _text("level-", level).alias("object"),
        F.date_format("ts", "yyyy-MM-dd").alias("valid_from"),
        _text("events/", F.col("event_id"), ".md").alias("source_note"),
        F.when(F.col("value") >= 10, F.lit(1.0)).otherwise(F.lit(0.8)).alias("confidence"),
    )


EVENT_FACTS = f"""
stated AS (
  SELECT event_id AS seq, 'user-' || user_id AS subject,
    {_sql_mapped('event_type', PREDICATE_OF_EVENT, 'other')} AS predicate,
    'level-' || (CAST(json_extract_string(props, '$.k') AS BIGINT) // 20) AS object,
    strftime(ts, '%Y-%m-%d') AS valid_from, 'events/' || event_id || '.md' AS source_note,
    CASE WHEN value >= 10 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence
  FROM events),
facts AS (
  SELECT s.*, (SELECT arg_min(n.valid_from, n.seq) FROM stated n
    WHERE n.subject = s.subject AND n.predicate = s.predicate AND n.seq > s.seq
      AND n.object <> s.object) AS closed
  FROM stated s)"""


# ------------------------------------------------------------------ line items as tasks


def task_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer as a status note: one marker per hundred of debt, an open section that is
    empty when there is none, and a last section that is always empty."""
    customers = table(spark, folder, "customer")
    c = F.col
    debt = F.greatest(F.lit(0), F.ceil(-c("c_acctbal") / 100)).cast("int")
    return customers.select(
        _text("status/customer-", c("c_custkey"), ".md").alias("path"),
        _text(
            "# Customer ", c("c_custkey"), "\n\nAt work.\n\n## Open\n\n",
            F.repeat(F.lit("- TODO collect\n"), debt), "\n## Later\n",
        ).alias("raw_content"),
    )


TASK_NOTES = """
task_notes AS (
  SELECT 'status/customer-' || c_custkey || '.md' AS path,
    CAST(greatest(0, ceil(-c_acctbal / 100)) AS BIGINT) AS n
  FROM customer)"""


# ------------------------------------------------------------------- events as captures

KIND_OF_EVENT = {
    "click": "idea", "view": "link", "signup": "decision-link", "purchase": "idea", "error": "memo",
}
KNOWN_PROJECTS = ["Lantern", "harbor", "shopbot", "Client8", "user-7", "my app", "research", "ai"]


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as a captured message of its user: a spec, mentions, a tie, a link or a stub."""
    e = table(spark, folder, "events")
    c = F.col
    text = (
        F.when(c("event_type") == "click", _text("Project: Client", c("user_id"), " wants Flutter soon"))
        .when(c("event_type") == "view",
              _text("see https://example.com/", c("event_id"), " shopbot, Shopbot or harbor"))
        .when(c("event_type") == "signup", F.lit("lantern and harbor, but not harbor-two"))
        .when(c("event_type") == "purchase",
              _text("user-", c("user_id"), " likes my app and [[Topic ", c("user_id"), "]]"))
        .otherwise(F.lit("ok"))
    )
    return e.select("event_id", "user_id", "event_type", text.alias("text"))


def capture_files(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    kind = _mapped(c("event_type"), KIND_OF_EVENT, "memo")
    return captures(spark, folder).select(
        _text("inbox/", kind, "-", c("event_id"), ".md").alias("path"),
        _text("# Note ", c("event_id"), "\n\n", c("text"), "\n").alias("raw_content"),
    )


CAPTURES = f"""
captures AS (
  SELECT event_id, user_id, event_type,
    'inbox/' || {_sql_mapped('event_type', KIND_OF_EVENT, 'memo')} || '-' || event_id || '.md' AS path,
    CASE event_type WHEN 'click' THEN 'Project: Client' || user_id || ' wants Flutter soon'
      WHEN 'view' THEN 'see https://example.com/' || event_id || ' shopbot, Shopbot or harbor'
      WHEN 'signup' THEN 'lantern and harbor, but not harbor-two'
      WHEN 'purchase' THEN 'user-' || user_id || ' likes my app and [[Topic ' || user_id || ']]'
      ELSE 'ok' END AS text
  FROM events)"""


# ------------------------------------------------------------------ events as snapshots


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as a session snapshot of its user's project."""
    e = table(spark, folder, "events")
    none = F.array().cast("array<string>")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        _text("user-", F.col("user_id")).alias("project"),
        _text(F.col("event_type"), " of ", F.col("value")).alias("summary"), none.alias("files_changed"),
        F.lit("").alias("git_status"), F.col("event_type").alias("git_branch"),
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("c"), i.cast("string"))).alias("recent_commits"),
        F.array(F.col("props")).alias("uncommitted_changes"), none.alias("active_decisions"),
        none.alias("blockers"), F.array(F.col("event_type")).alias("next_steps"),
    )


SNAPSHOTS = """
snapshots AS (
  SELECT 'user-' || user_id AS project, ts, event_type, event_id FROM events)"""


# ----------------------------------------------------------------- events as file events

CHANGE_OF_EVENT = {"signup": "created", "error": "deleted"}


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as a change of its user's note; views touch a generated file."""
    e = table(spark, folder, "events")
    name = F.when(F.col("event_type") == "view", F.lit("index")).otherwise(
        _text("user-", F.col("user_id")))
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("notes/"), name, F.lit(".md")).alias("path"),
        _mapped(F.col("event_type"), CHANGE_OF_EVENT, "modified").alias("event_type"),
    )


FILE_EVENTS = f"""
file_events AS (
  SELECT event_id AS seq, ts, 'notes/user-' || user_id || '.md' AS path,
    {_sql_mapped('event_type', CHANGE_OF_EVENT, 'modified')} AS event_type
  FROM events WHERE event_type <> 'view'),
gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 120 SECOND THEN 0 ELSE 1 END AS fresh
  FROM file_events WINDOW w AS (ORDER BY ts, seq)),
placed AS (
  SELECT *, CAST(sum(fresh) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS period
  FROM gaps)"""


# --------------------------------------------------------------------- parts as sources

EXT_OF_SIZE = [".py", ".ts", ".dart", ".js"]
DIR_OF_TYPE = {
    "ECONOMY": "app/api", "PROMO": "src/models", "LARGE": "lib/helper", "SMALL": "tests",
    "MEDIUM": "src/widget", "STANDARD": "src",
}


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each part as a source file that imports two other parts and a library."""
    p = table(spark, folder, "part")
    c = F.col
    ext = F.element_at(F.array(*[F.lit(x) for x in EXT_OF_SIZE]), (c("p_size") % 4 + 1).cast("int"))
    a, b = _text("mod_", c("p_partkey") + 1), _text("mod_", c("p_partkey") + 7)
    body = (
        F.when(ext == ".py", _text("import os\nfrom pkg.", a, " import thing\nimport ", b, "\n\n@app.get('/item/",
                                   c("p_partkey"), "')\ndef f():\n    return 'stripe'\n"))
        .when(ext == ".dart", _text("import 'package:flutter/ui.dart';\nimport '", a, "/x.dart';\nimport 'dart:io';\n"))
        .otherwise(_text("import { x } from './", a, "'\nconst y = require('", b, "/fp')\n"))
    )
    return p.select(
        _text("size-", c("p_size") % 5).alias("project"),
        _text(_mapped(c("p_type"), DIR_OF_TYPE, "src"), "/mod_", c("p_partkey"), ext).alias("path"),
        body.alias("raw_content"),
    )


CODE_FILES = f"""
code_files AS (
  SELECT p_partkey, 'size-' || (p_size % 5) AS project, p_type,
    ['.py', '.ts', '.dart', '.js'][p_size % 4 + 1] AS ext,
    {_sql_mapped('p_type', DIR_OF_TYPE, 'src')} || '/mod_' || p_partkey
      || ['.py', '.ts', '.dart', '.js'][p_size % 4 + 1] AS path, 'mod_' || p_partkey AS name
  FROM part),
code_imports AS (
  SELECT project, path, unnest(CASE ext
    WHEN '.py' THEN ['os', 'pkg', 'mod_' || (p_partkey + 1), 'mod_' || (p_partkey + 7)]
    WHEN '.dart' THEN ['flutter', 'mod_' || (p_partkey + 1)]
    ELSE ['mod_' || (p_partkey + 1), 'mod_' || (p_partkey + 7)] END) AS name
  FROM code_files)"""


# ------------------------------------------------------- documents as files of a project

PLACE_OF_LANG = {"en": "src/doc", "fr": "tests/doc", "de": "main.py/doc", "es": "dist/doc"}


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a file of its source's project; Spanish ones lie in a build folder."""
    d = table(spark, folder, "documents")
    return d.select(
        F.col("source").alias("project"),
        _text(_mapped(F.col("lang"), PLACE_OF_LANG, "doc"), "-", F.col("doc_id"), ".txt").alias("path"),
        F.col("text").alias("raw_content"),
    )


# -------------------------------------------------------------- customers as project cards

STATUS_OF_SEGMENT = {
    "AUTOMOBILE": "active", "BUILDING": "mvp", "FURNITURE": "paused", "HOUSEHOLD": "idea",
    "MACHINERY": "done",
}


def product_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer as a project with a product note."""
    customers = table(spark, folder, "customer")
    nations = spark.read.parquet(f"{folder}/nation.parquet").select("n_nationkey", "n_name")
    c = F.col
    status = _mapped(c("c_mktsegment"), STATUS_OF_SEGMENT, "unknown")
    return spread(customers.join(nations, c("c_nationkey") == c("n_nationkey"))).select(
        _text("customer-", c("c_custkey"), "/prd.md").alias("path"),
        _text(
            "---\ntitle: ", c("c_name"), "\nstatus: ", status, "\nstack: [Spark, ", c("n_name"),
            "]\ndescription: a ", F.lower("c_mktsegment"), " project\n---\n\n# Plan\n\n## What's next\n\n1. Call ",
            c("c_name"), "\n- then wait\nnot a list line\n\n## Later\n- rest\n",
        ).alias("raw_content"),
    )


PRODUCTS = f"""
cards AS (
  SELECT 'customer-' || c_custkey AS id, c_name AS title, n_name,
    {_sql_mapped('c_mktsegment', STATUS_OF_SEGMENT, 'unknown')} AS status,
    'a ' || lower(c_mktsegment) || ' project' AS description
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
