"""Registered queries: routing, extraction, radar, dependencies, code, packing and file events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from notespark import vocab
from notespark.functions import text as tx
from notespark.functions.versions import clean_version, update_type
from notespark.operators import bm25, code, dependencies, extraction, facts, packing, radar, routing
from notespark.plans import corpus
from notespark.plans.reports_search import BM25_SQL, QUERY
from notespark.session import checkpoint_dir, cut_lineage
from notespark.sources import vault
from notespark.streaming import watcher

QUIET = 120.0


# ------------------------------------------------------------------- routing and ingest


def inbox_route(spark, folder):
    routed = routing.classify(corpus.captures(spark, folder), corpus.KNOWN_PROJECTS)
    return routed.select("event_id", "project", "note_type", "reason", "is_new_project")


def inbox_batch(spark, folder):
    notes = vault.scan(corpus.capture_files(spark, folder))
    return routing.route_inbox(notes, corpus.KNOWN_PROJECTS).select("path", "project")


def route_by_join(spark, folder):
    """Mentions of any of the users' projects, matched by an equi-join."""
    captures = corpus.captures(spark, folder)
    names = corpus.table(spark, folder, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("project"))
    return routing.mentioned_project_join(captures, names, "event_id")


def route_messages(spark, folder):
    messages = corpus.captures(spark, folder).select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(F.lit("@ops "), "text")).otherwise(F.col("text")).alias("text"))
    return routing.route_messages(messages, corpus.KNOWN_PROJECTS).select("event_id", "message", "project", "kind")


def entity_mentions(spark, folder):
    found = extraction.entities(corpus.captures(spark, folder), "text", corpus.KNOWN_PROJECTS)
    return found.select("event_id", F.array_join("entities", "|").alias("entities"))


def concept_stubs(spark, folder):
    """Entities of all captures without a page among the product notes and page notes."""
    found = extraction.entities(corpus.captures(spark, folder), "text", corpus.KNOWN_PROJECTS)
    files = corpus.page_files(spark, folder).select("path").unionByName(
        corpus.table(spark, folder, "customer").select(
            F.concat(F.lit("people/topic-"), F.col("c_custkey").cast("string"), F.lit("-page.md")).alias("path")))
    return routing.missing_concepts(
        found.select(F.explode("entities").alias("entity")), files, ["harbor"], extraction.KNOWN_TECH)


def related_notes(spark, folder):
    """Cross references from a search over all documents to the notes it finds."""
    docs = corpus.table(spark, folder, "documents").select(
        "doc_id", "text", F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    hits = bm25.search(docs, QUERY, 10).select(
        F.lit("inbox/new.md").alias("ref_path"), F.col("path").alias("source"), "score")
    notes = docs.select("path", F.col("text").alias("raw_content"))
    return routing.cross_references(hits, notes).select("source", "ref_path")


def extracted_facts(spark, folder):
    notes = vault.scan(corpus.order_files(spark, folder)).select("path", "project", "content", "created")
    return extraction.known_candidates(notes).select(
        "path", "subject", "predicate", "object", F.round("confidence", 2).alias("confidence"))


def fact_candidates(spark, folder):
    """All candidates, unknown names too, counted over all notes."""
    notes = vault.scan(corpus.order_files(spark, folder)).select("project", "content")
    return extraction.candidates(notes).groupBy("predicate", "object").agg(F.count(F.lit(1)).alias("n"))


def extracted_fact_history(spark, folder):
    """Facts read from all decision notes in the order of orders, with the day each ended."""
    notes = vault.scan(corpus.order_files(spark, folder)).select("path", "project", "content", "created")
    found = extraction.known_candidates(notes)
    order = F.regexp_extract("path", r"order-(\d+)", 1).cast("bigint") * 10 + F.col("position")
    said = cut_lineage(extraction.statements(found, "created", "path", order))
    return facts.with_valid_to(said).select("seq", "subject", "predicate", "object", "valid_to")


def migrated_facts(spark, folder):
    notes = vault.scan(corpus.order_files(spark, folder)).select("path", "project", "content", "created")
    return extraction.migrations(extraction.known_candidates(notes), "created")


# ------------------------------------------------------------------------------- radar

LANGUAGE_OF = {"en": "Python", "fr": "Java", "de": "TypeScript", "es": "Go"}
TOPIC_OF = {"en": "llm", "fr": "gaming", "de": "mcp", "es": "flutter"}


def _repos(spark, folder):
    d = corpus.table(spark, folder, "documents")
    return d.select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("full_name"),
        F.col("text").alias("description"), F.array(corpus._mapped(F.col("lang"), TOPIC_OF, "x")).alias("topics"),
        corpus._mapped(F.col("lang"), LANGUAGE_OF, "Unknown").alias("language"),
        F.col("n_chars").cast("int").alias("stars"), F.col("source").alias("topic"), "doc_id",
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(60)).cast("int")),
                      "yyyy-MM-dd").alias("created_at"))


def relevance_score(spark, folder):
    return radar.score_repos(_repos(spark, folder)).select(
        "doc_id", "relevance_score", "relevance_reason", radar.band("relevance_score").alias("band"))


def repo_digest(spark, folder):
    return radar.digest(radar.score_repos(_repos(spark, folder))).select(
        "topic", F.col("rank").cast("bigint").alias("rank"), "full_name")


def trending_repos(spark, folder):
    return radar.trending(_repos(spark, folder), "2024-01-20", 1000, "ai", 20).select(
        "full_name", F.col("stars").cast("bigint").alias("stars"), "relevance_score")


def applicable_projects(spark, folder):
    found = _repos(spark, folder).select(
        "doc_id", radar.applicable_projects("description", "topics").alias("p"))
    return found.select("doc_id", F.array_join("p", ",").alias("projects"))


def developer_latest(spark, folder):
    orders = corpus.table(spark, folder, "orders")
    repos = orders.select(
        F.concat(F.lit("dev-"), F.col("o_custkey").cast("string")).alias("username"),
        F.concat(F.lit("repo-"), F.col("o_orderkey").cast("string")).alias("full_name"),
        F.col("o_orderdate").cast("date").cast("string").alias("updated"))
    return radar.latest_per_developer(repos)


def _tools(spark, folder, month: str):
    """Tools seen in a month: the parts of its line items."""
    start = F.lit(f"{month}-01").cast("timestamp_ntz")
    shipped = F.col("l_shipdate")
    lines = corpus.table(spark, folder, "lineitem").where(
        (shipped >= start) & (shipped < F.add_months(start, 1).cast("timestamp_ntz"))
    ).select(F.col("l_partkey").alias("p_partkey")).distinct()
    what = {"PROMO": "a React helper", "ECONOMY": "Tailwind theme", "SMALL": "docker image"}
    parts = corpus.table(spark, folder, "part").join(lines, "p_partkey", "left_semi")
    return radar.score_tools(parts.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"),
        corpus._mapped(F.col("p_type"), what, "game engine").alias("description")))


def scan_diff_new(spark, folder):
    return radar.new_tools(_tools(spark, folder, "1998-02"), _tools(spark, folder, "1998-01"))


def scan_diff_removed(spark, folder):
    return radar.removed_tools(_tools(spark, folder, "1998-02"), _tools(spark, folder, "1998-01"))


def scan_diff_counts(spark, folder):
    return radar.diff_counts(_tools(spark, folder, "1998-02"), _tools(spark, folder, "1998-01"))


def _watched(spark, folder):
    people = corpus.table(spark, folder, "customer").select(
        F.col("c_name").alias("username"), F.lower("c_mktsegment").alias("category"))
    more = corpus.table(spark, folder, "supplier").select(
        F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("username"),
        F.lit("supplier").alias("category"))
    return people, more


def watch_list(spark, folder):
    people, more = _watched(spark, folder)
    listed = radar.watch(people.where(F.col("category") == "building"), more)
    return radar.unwatch(listed, "CUSTOMER#000000004")


# ------------------------------------------------------------------------ dependencies


def _manifests(spark, folder):
    """Each order as a project with a manifest that names its customer's package."""
    orders = corpus.table(spark, folder, "orders")
    c = F.col
    spec = corpus._text(F.floor(c("o_totalprice") / 20000), ".", F.pmod("o_orderkey", F.lit(10)), ".0")
    name = corpus._text("pkg-", c("o_custkey"))
    file = F.when(c("o_orderstatus") == "F", F.lit("package.json")).when(
        c("o_orderstatus") == "O", F.lit("pyproject.toml")).otherwise(F.lit("pubspec.yaml"))
    body = (
        F.when(c("o_orderstatus") == "F",
               F.concat(F.lit('{"dependencies": {"'), name, F.lit('": "^'), spec, F.lit('"}, "devDependencies": {"dev": "~1.0.0"}}')))
        .when(c("o_orderstatus") == "O",
              F.concat(F.lit('[project]\ndependencies = [\n    "'), name, F.lit(">="), spec, F.lit('",\n    "bare",\n]\n')))
        .otherwise(F.concat(F.lit("name: x\ndependencies:\n  "), F.replace(name, F.lit("-"), F.lit("_")),
                            F.lit(": ^"), spec, F.lit("\n\nflutter:\n  uses: 1.0\n")))
    )
    return orders.select(
        F.concat(corpus._text("order-", c("o_orderkey")), F.lit("/"), file).alias("path"),
        body.alias("raw_content"))


def manifest_dependencies(spark, folder):
    return dependencies.from_manifests(_manifests(spark, folder))


def _registry(spark, folder):
    people = corpus.table(spark, folder, "customer")
    kinds = F.explode(F.array(F.lit("npm"), F.lit("pip"), F.lit("flutter")))
    dash = F.when(F.col("manager") == "flutter", F.lit("_")).otherwise(F.lit("-"))
    return people.select("c_custkey", "c_nationkey", kinds.alias("manager")).select(
        "manager", F.concat(F.lit("pkg"), dash, F.col("c_custkey").cast("string")).alias("name"),
        corpus._text(F.col("c_nationkey"), ".", F.pmod("c_custkey", F.lit(7)), ".1").alias("latest"))


def dependency_status(spark, folder):
    deps = dependencies.from_manifests(_manifests(spark, folder))
    return dependencies.compare(deps, _registry(spark, folder))


def dependency_summary(spark, folder):
    deps = cut_lineage(dependencies.from_manifests(_manifests(spark, folder)))
    return dependencies.summary(dependencies.compare(deps, _registry(spark, folder)), deps)


def version_classify(spark, folder):
    lines = corpus.table(spark, folder, "lineitem")
    old = corpus._text("^", F.col("l_quantity").cast("int"), ".", F.col("l_linenumber"))
    new = corpus._text(F.col("l_linenumber"), ".", F.pmod("l_suppkey", F.lit(9)), ".", F.col("l_linenumber"))
    return lines.select(
        "l_orderkey", "l_linenumber", update_type(clean_version(old), new).alias("clean"),
        update_type(clean_version(old), new, True).alias("parity"))


# -------------------------------------------------------------------------- source code


def _modules(spark, folder):
    return cut_lineage(code.modules(corpus.code_files(spark, folder), None))


def code_modules(spark, folder):
    return _modules(spark, folder).select(
        "project", "path", "name", "layer", "language", F.array_join("imports", ",").alias("imports"),
        F.col("size_lines").cast("bigint").alias("size_lines"))


def code_edges(spark, folder):
    return code.edges(_modules(spark, folder))


def code_external(spark, folder):
    return code.external(_modules(spark, folder))


def code_layers(spark, folder):
    return code.layer_counts(_modules(spark, folder))


def code_routes(spark, folder):
    return code.routes(corpus.code_files(spark, folder))


def code_services(spark, folder):
    return code.services(corpus.code_files(spark, folder))


def layer_of_path(spark, folder):
    pages = corpus.table(spark, folder, "pages")
    return pages.select("page_id", code.layer("url").alias("layer"))


def pack_budget(spark, folder):
    packed = packing.pack(corpus.text_files(spark, folder), "compact", 15000)
    return packed.select(
        "project", "path", "priority", "compressed", "token_estimate", "tokens_before",
        F.md5("content").alias("content_md5"))


def pack_summary(spark, folder):
    files = corpus.text_files(spark, folder)
    return packing.pack_summary(packing.pack(files, "minimal", 5000), files)


def file_tree(spark, folder):
    return packing.tree(corpus.code_files(spark, folder))


# -------------------------------------------------------------------------- file events


def debounce_periods(spark, folder):
    events = corpus.file_events(spark, folder).where(watcher.relevant("path"))
    return watcher.periods(events, QUIET).select("period", "events")


def pending_changes(spark, folder):
    events = corpus.file_events(spark, folder).where(watcher.relevant("path"))
    return watcher.pending(watcher.with_period(events, QUIET)).select(
        "period", "path", "event_type", "created")


def period_counts(spark, folder):
    events = corpus.file_events(spark, folder).where(watcher.relevant("path"))
    return watcher.period_counts(watcher.pending(watcher.with_period(events, QUIET)))


def watcher_replay(spark, folder):
    """The events through the watcher in three micro-batches and an empty one: what it applies.

    The clock stands at the last event of a batch, so periods go on across batches, and moves on for
    the empty one, which closes the last period.
    """
    events = corpus.file_events(spark, folder)
    micros = F.unix_micros("ts")
    # where the batches are cut does not change what is applied, so a bounded sketch will do
    ends = events.agg(F.min(micros).alias("first"), F.percentile_approx(micros, [0.3, 0.6]).alias("cuts"), F.max(micros).alias("last")).first()
    bounds = [ends["first"], *(ends["cuts"] or []), ends["last"]]
    done, clock, parts = f"{checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}", [0.0], []

    def apply(todo, batch_id):
        parts.append(f"{done}/part-{batch_id}")
        todo.write.mode("overwrite").parquet(parts[-1])

    watch = watcher.Watcher(spark, f"{done}/state", apply, QUIET, clock=lambda: clock[0])
    if ends["first"] is not None:
        for k in range(3):
            low = micros > bounds[k] if k else micros >= bounds[k]
            clock[0] = bounds[k + 1] / 1e6
            watch.run(events.where(low & (micros <= bounds[k + 1])), k)
        clock[0] += 2 * QUIET
        watch.run(events.where(F.lit(False)), 3)
    # a batch that closes no period applies nothing: the last one, where only events on generated files end the log
    applied = spark.read.parquet(*parts) if parts else spark.createDataFrame([], watcher.STATE)
    return applied.select("path", "event_type", "created", F.unix_micros("ts").alias("ts"))


def note_ages(spark, folder):
    """How long before the end of the log each event was, as a label."""
    events = corpus.table(spark, folder, "events")
    end = events.agg(F.max(F.col("ts").cast("timestamp")).alias("end"))  # one row
    return events.join(F.broadcast(end), F.lit(True)).select(
        "event_id", tx.age_label(F.col("ts").cast("timestamp"), F.col("end")).alias("age"))


def escaped_pages(spark, folder):
    pages = corpus.table(spark, folder, "pages")
    return pages.select("page_id", F.md5(tx.escape_html("html").cast("binary")).alias("escaped_md5"))


def guarded_paths(spark, folder):
    """Which paths made of part names and steps up stay inside their root."""
    parts = corpus.table(spark, folder, "part")
    up = F.repeat(F.lit("../"), F.pmod(F.col("p_partkey"), F.lit(4)).cast("int"))
    start = F.when(F.col("p_partkey") % 5 == 0, F.lit("/")).when(F.col("p_partkey") % 5 == 1, F.lit("a/./b/")).otherwise(F.lit("a/"))
    return parts.select("p_partkey", tx.is_inside(F.concat(start, up, "p_name")).alias("inside"))


def url_mentions(spark, folder):
    found = corpus.captures(spark, folder).select("event_id", F.explode(tx.urls("text")).alias("url"))
    return found


def message_slugs(spark, folder):
    return corpus.captures(spark, folder).select(
        "event_id", tx.capture_slug("text").alias("capture"), tx.file_slug("text").alias("file"),
        tx.ingest_slug(F.lit(""), "text").alias("ingest"))


QUERIES = {
    f.__name__: f
    for f in [
        inbox_route, inbox_batch, route_by_join, route_messages, entity_mentions, concept_stubs,
        related_notes, extracted_facts, fact_candidates, extracted_fact_history, migrated_facts,
        relevance_score, repo_digest, trending_repos, applicable_projects, developer_latest,
        scan_diff_new, scan_diff_removed, scan_diff_counts, watch_list, manifest_dependencies,
        dependency_status, dependency_summary, version_classify, code_modules, code_edges,
        code_external, code_layers, code_routes, code_services, layer_of_path, pack_budget,
        pack_summary, file_tree, debounce_periods, pending_changes, period_counts, watcher_replay,
        note_ages, escaped_pages, guarded_paths, url_mentions,
        message_slugs,
    ]
}

_C = f"WITH {corpus.CAPTURES}"
_SLUG = "'client' || user_id"
_ROUTE = f"""routed AS (
  SELECT *, CASE event_type WHEN 'click' THEN CASE WHEN user_id = 8 THEN 'Client8' ELSE {_SLUG} END
      WHEN 'view' THEN 'shopbot' WHEN 'signup' THEN 'inbox'
      WHEN 'purchase' THEN CASE WHEN user_id = 7 THEN 'inbox' ELSE 'my app' END ELSE 'inbox' END AS project,
    CASE event_type WHEN 'click' THEN CASE WHEN user_id = 8 THEN 'spec header → existing project ''Client8'''
        ELSE 'spec header → new project ''' || {_SLUG} || '''' END
      WHEN 'view' THEN 'mentions known project ''shopbot''' WHEN 'signup' THEN 'no confident project match'
      WHEN 'purchase' THEN CASE WHEN user_id = 7 THEN 'no confident project match'
        ELSE 'mentions known project ''my app''' END
      ELSE 'too short to classify' END AS reason
  FROM captures)"""


def _tech(text: str) -> str:
    return ("list_filter([" + ", ".join(f"'{t}'" for t in extraction.KNOWN_TECH)
            + f"], lambda t: contains(lower({text}), t))")


_ENTITIES = f"""found AS (
  SELECT event_id, list_sort(list_distinct(list_concat({_tech('text')},
    list_filter([{', '.join(f"'{p}'" for p in corpus.KNOWN_PROJECTS)}],
      lambda p: contains(lower(text), lower(p))),
    regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1)))) AS entities FROM captures)"""

# The order notes say: "Customer k uses T and more", "They migrated from O to T."
_CATEGORY = "CASE {c} " + " ".join(
    f"WHEN '{t}' THEN '{p}'" for p, ts in vocab.TECH_BY_PREDICATE.items() for t in ts) + " ELSE 'uses' END"
_SAID = f"""said AS (
  SELECT o_orderkey, path, project, created, 0 AS position, {_CATEGORY.format(c='tech')} AS predicate,
    tech AS object, 0.8::DOUBLE AS confidence FROM order_notes
  UNION ALL SELECT o_orderkey, path, project, created, 1, 'migration_from', old_tech, 0.9 FROM order_notes)"""

_TOOLS = """SELECT 'part-' || p_partkey AS name, CASE p_type WHEN 'PROMO' THEN 'a React helper'
    WHEN 'ECONOMY' THEN 'Tailwind theme' WHEN 'SMALL' THEN 'docker image' ELSE 'game engine' END AS description,
  CASE p_type WHEN 'PROMO' THEN 'high' WHEN 'ECONOMY' THEN 'medium' WHEN 'SMALL' THEN 'medium' ELSE 'low' END
    AS relevance
  FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '{m}')"""
_SCANS = f"cur AS ({_TOOLS.format(m='1998-02')}), prev AS ({_TOOLS.format(m='1998-01')})"


def _score_sql() -> str:
    points, reasons = [], []
    for topic, words in vocab.REPO_TOPICS.items():
        hits = "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(t, w))"
        points.append(f"20 * least(len({hits}), 3)")
        reasons.append(f"CASE WHEN len({hits}) > 0 THEN '{topic}: ' || array_to_string({hits}[1:3], ', ') END")
    points.append("CASE WHEN language IN ('Python', 'TypeScript') THEN 15 ELSE 0 END")
    points.append("CASE WHEN contains(t, 'mcp') THEN 30 ELSE 0 END")
    reasons.append("CASE WHEN language IN ('Python', 'TypeScript') THEN 'language: ' || language END")
    reasons.append("CASE WHEN contains(t, 'mcp') THEN 'MCP related' END")
    return f"""repos AS (
      SELECT doc_id, source, n_chars, source || '/' || doc_id AS full_name,
        lower(text) || ' ' || {corpus._sql_mapped('lang', TOPIC_OF, 'x')} AS t,
        {corpus._sql_mapped('lang', LANGUAGE_OF, 'Unknown')} AS language,
        strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') AS created_at
      FROM documents),
    scored AS (
      SELECT *, least({' + '.join(points)}, 100) / 100.0::DOUBLE AS s,
        concat_ws('; ', {', '.join(reasons)}) AS r FROM repos)"""


_APPLICABLE = ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{p}' END"
    for p, words in vocab.APPLICABLE_PROJECTS)

_DEPS = """deps AS (
  SELECT 'order-' || o_orderkey AS project,
    CASE o_orderstatus WHEN 'F' THEN 'npm' WHEN 'O' THEN 'pip' ELSE 'flutter' END AS manager,
    CASE o_orderstatus WHEN 'P' THEN 'pkg_' ELSE 'pkg-' END || o_custkey AS name,
    CAST(floor(o_totalprice / 20000) AS INTEGER) || '.' || (o_orderkey % 10) || '.0' AS current,
    CAST(floor(o_totalprice / 20000) AS INTEGER) AS c1, o_orderkey % 10 AS c2,
    c_nationkey AS n1, c_custkey % 7 AS n2, c_nationkey || '.' || (c_custkey % 7) || '.1' AS latest
  FROM orders JOIN customer ON o_custkey = c_custkey),
extra AS (
  SELECT project, manager, CASE manager WHEN 'npm' THEN 'dev' ELSE 'bare' END AS name,
    CASE manager WHEN 'npm' THEN '1.0.0' ELSE '' END AS current FROM deps WHERE manager <> 'flutter'),
states AS (
  SELECT *, 'outdated' AS status, CASE WHEN n1 > c1 THEN 'major' WHEN n1 < c1 THEN 'unknown'
    WHEN n2 > c2 THEN 'minor' WHEN n2 < c2 THEN 'unknown' ELSE 'patch' END AS update_type FROM deps)"""

_LAYER_OF_TYPE = {"ECONOMY": "api", "PROMO": "model", "LARGE": "util", "SMALL": "test", "MEDIUM": "ui"}
_TEXTS = """texts AS (
  SELECT source AS project, CASE lang WHEN 'en' THEN 'src/doc' WHEN 'fr' THEN 'tests/doc' ELSE 'main.py/doc' END
      || '-' || doc_id || '.txt' AS path, string_split(text, chr(10)) AS lines, text,
    CASE lang WHEN 'en' THEN 'medium' WHEN 'fr' THEN 'low' ELSE 'high' END AS priority,
    CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 0 END AS prank
  FROM documents WHERE lang <> 'es')"""


def _packed(limits: dict, budget: int) -> str:
    keep = "CASE priority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in limits.items()) + " END"
    return f"""{_TEXTS}, sized AS (
      SELECT *, {keep} AS keep FROM texts WHERE {keep} > 0),
    shown AS (
      SELECT *, len(lines) > keep AS compressed, CASE WHEN len(lines) <= keep THEN text ELSE
        array_to_string(lines[1:keep * 2 // 3], chr(10)) || chr(10) || chr(10) || '... [' || (len(lines) - keep)
        || ' lines omitted] ...' || chr(10) || chr(10)
        || array_to_string(lines[len(lines) - (keep - keep * 2 // 3) + 1:], chr(10)) END AS content FROM sized),
    summed AS (
      SELECT *, length(content) // 4 AS tokens, CAST(coalesce(sum(length(content) // 4) OVER (PARTITION BY project
        ORDER BY prank, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM shown),
    packed AS (SELECT * FROM summed WHERE before < {budget})"""


_LAYER_SQL = corpus._sql_rules("lower(url)", vocab.LAYERS, vocab.OTHER_LAYER)
_MIGRATED = "CASE WHEN old_tech = 'something else' THEN 'something else' ELSE old_tech END"

ORACLE = {
    "inbox_route": f"""{_C}, {_ROUTE} SELECT event_id, project,
        CASE WHEN event_type = 'view' THEN 'research' ELSE 'note' END AS note_type, reason,
        event_type = 'click' AND user_id <> 8 AS is_new_project FROM routed""",
    "inbox_batch": f"""{_C}, {_ROUTE} SELECT path, project FROM routed WHERE project <> 'inbox'""",
    "route_by_join": f"""{_C} SELECT event_id, 'user-' || user_id AS project FROM captures
        WHERE event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer)""",
    "route_messages": f"""{_C}, {_ROUTE} SELECT event_id, text AS message,
        CASE WHEN event_type = 'error' THEN 'ops' ELSE project END AS project,
        CASE WHEN event_type = 'view' THEN 'link' ELSE 'idea' END AS kind FROM routed""",
    "entity_mentions": f"""{_C}, {_ENTITIES} SELECT event_id, array_to_string(entities, '|') AS entities
        FROM found""",
    "concept_stubs": f"""{_C}, {_ENTITIES}, {corpus.PAGE_LINKS},
        wanted AS (SELECT DISTINCT unnest(entities) AS entity FROM found),
        stems AS (SELECT lower(stem) AS stem FROM graph_nodes
          UNION SELECT 'topic-' || c_custkey || '-page' FROM customer),
        named AS (SELECT entity, replace(lower(entity), ' ', '-') AS slug FROM wanted
          WHERE entity <> 'harbor'
            AND (length(entity) >= 3 OR list_contains([{', '.join(f"'{t}'" for t in extraction.KNOWN_TECH)}], lower(entity))))
        SELECT entity, slug FROM named WHERE NOT EXISTS (SELECT 1 FROM stems WHERE contains(stem, slug))""",
    "related_notes": f"""WITH {BM25_SQL}, top AS (
          SELECT * FROM scored ORDER BY raw_score DESC, doc_id LIMIT 10)
        SELECT source || '/doc-' || doc_id || '.md' AS source, 'inbox/new.md' AS ref_path
        FROM top WHERE raw_score > 0.3 ORDER BY raw_score DESC, source LIMIT 5""",
    "extracted_facts": f"""WITH {corpus.ORDER_NOTES}, {_SAID}, known AS (
          SELECT *, row_number() OVER (PARTITION BY path, predicate, object ORDER BY position) AS k FROM said
          WHERE object NOT IN ('nothing', 'something else'))
        SELECT path, project AS subject, predicate, object, confidence FROM known WHERE k = 1""",
    "migrated_facts": f"""WITH {corpus.ORDER_NOTES} SELECT project AS subject,
        {_CATEGORY.format(c='old_tech')} AS predicate, old_tech AS object, created AS ended
        FROM order_notes WHERE old_tech <> 'something else'""",
    "fact_candidates": f"""WITH {corpus.ORDER_NOTES}, {_SAID}
        SELECT predicate, object, count(*) AS n FROM said GROUP BY 1, 2""",
    "extracted_fact_history": f"""WITH {corpus.ORDER_NOTES}, f AS (
          SELECT o_orderkey * 10 AS seq, project AS subject, {_CATEGORY.format(c='tech')} AS predicate,
            tech AS object, created FROM order_notes),
        runs AS (SELECT *, sum(changed) OVER (PARTITION BY subject, predicate ORDER BY seq) AS run FROM (
          SELECT *, CASE WHEN lag(object) OVER (PARTITION BY subject, predicate ORDER BY seq) = object
            THEN 0 ELSE 1 END AS changed FROM f)),
        heads AS (SELECT subject, predicate, run, arg_min(created, seq) AS started FROM runs GROUP BY 1, 2, 3)
        SELECT r.seq, r.subject, r.predicate, r.object, coalesce(h.started, '') AS valid_to
        FROM runs r LEFT JOIN heads h ON h.subject = r.subject AND h.predicate = r.predicate
          AND h.run = r.run + 1""",
    "relevance_score": f"""WITH {_score_sql()} SELECT doc_id, s AS relevance_score,
        CASE WHEN r = '' THEN 'no relevant signals' ELSE r END AS relevance_reason,
        CASE WHEN s >= 0.6 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'other' END AS band FROM scored""",
    "repo_digest": f"""WITH {_score_sql()} SELECT topic, rank, full_name FROM (
        SELECT source AS topic, full_name, row_number() OVER (PARTITION BY source
          ORDER BY s DESC, n_chars DESC, full_name) AS rank FROM scored WHERE s >= 0.5) WHERE rank <= 5""",
    "trending_repos": f"""WITH {_score_sql()} SELECT full_name, n_chars AS stars, s AS relevance_score
        FROM scored WHERE created_at > '2024-01-20' AND n_chars >= 1000 AND (contains(t, 'artificial-intelligence')
          OR contains(t, 'machine-learning')
          OR contains(t, 'llm')
          OR contains(t, 'gpt')
          OR contains(t, 'openai')
          OR contains(t, 'langchain')
          OR contains(t, 'rag')
          OR contains(t, 'embeddings')
          OR contains(t, 'vector-database')
          OR contains(t, 'ai-agent')
          OR contains(t, 'autonomous')
          OR contains(t, 'deep-learning')
          OR contains(t, 'transformer'))
        ORDER BY n_chars DESC, full_name LIMIT 20""",
    "applicable_projects": f"""WITH {_score_sql()} SELECT doc_id, concat_ws(',', {_APPLICABLE}) AS projects
        FROM scored""",
    "developer_latest": """SELECT 'dev-' || o_custkey AS username,
        split_part(max(strftime(o_orderdate, '%Y-%m-%d') || '|repo-' || o_orderkey), '|', 2) AS full_name,
        strftime(max(o_orderdate), '%Y-%m-%d') AS updated FROM orders GROUP BY o_custkey""",
    "scan_diff_new": f"""WITH {_SCANS} SELECT * FROM cur WHERE relevance <> 'low'
        AND name NOT IN (SELECT name FROM prev)""",
    "scan_diff_removed": f"""WITH {_SCANS} SELECT * FROM prev WHERE relevance <> 'low'
        AND name NOT IN (SELECT name FROM cur)""",
    "scan_diff_counts": f"""WITH {_SCANS} SELECT (SELECT count(*) FROM cur) AS total_current,
        (SELECT count(*) FROM prev) AS total_previous,
        (SELECT count(*) FROM cur WHERE relevance = 'high' AND name NOT IN (SELECT name FROM prev)) AS new_high,
        (SELECT count(*) FROM cur WHERE relevance = 'medium' AND name NOT IN (SELECT name FROM prev))
          AS new_medium,
        (SELECT count(*) FROM prev WHERE relevance <> 'low' AND name NOT IN (SELECT name FROM cur)) AS removed""",
    "watch_list": """WITH l AS (
          SELECT c_name AS username, lower(c_mktsegment) AS category FROM customer
          WHERE c_mktsegment = 'BUILDING'),
        a AS (SELECT upper(replace(s_name, 'Supplier', 'Customer')) AS username, 'supplier' AS category
          FROM supplier)
        SELECT * FROM (SELECT * FROM l UNION ALL
          SELECT * FROM a WHERE lower(username) NOT IN (SELECT lower(username) FROM l))
        WHERE lower(username) <> 'customer#000000004'""",
    "manifest_dependencies": f"""WITH {_DEPS} SELECT project, manager, name, current FROM deps
        UNION ALL SELECT * FROM extra""",
    "dependency_status": f"""WITH {_DEPS} SELECT project, manager, name, current, latest, status, update_type
        FROM states""",
    "dependency_summary": f"""WITH {_DEPS} SELECT project,
        CASE WHEN manager = 'flutter' THEN 1 ELSE 2 END::BIGINT AS total_deps, 0::BIGINT AS up_to_date, 1::BIGINT AS outdated,
        CAST(update_type = 'major' AS BIGINT) AS major, CAST(update_type = 'minor' AS BIGINT) AS minor,
        CAST(update_type = 'patch' AS BIGINT) AS patch, CAST(update_type = 'unknown' AS BIGINT) AS unknown
        FROM states""",
    "version_classify": """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS c1,
          l_linenumber AS n, l_suppkey % 9 AS m FROM lineitem)
        SELECT l_orderkey, l_linenumber,
          CASE WHEN n > c1 THEN 'major' WHEN n < c1 THEN 'unknown' WHEN m > n THEN 'minor'
            WHEN m < n THEN 'unknown' ELSE 'patch' END AS clean,
          CASE WHEN n > c1 THEN 'major' WHEN m > n THEN 'minor' ELSE 'patch' END AS parity
        FROM v""",
    "code_modules": f"""WITH {corpus.CODE_FILES} SELECT project, path, name,
        {corpus._sql_mapped('p_type', _LAYER_OF_TYPE, 'other')} AS layer,
        CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.dart' THEN 'dart'
          ELSE 'javascript' END AS language,
        CASE ext WHEN '.py' THEN 'os,pkg,mod_' || (p_partkey + 1) || ',mod_' || (p_partkey + 7)
          WHEN '.dart' THEN 'flutter,mod_' || (p_partkey + 1)
          ELSE 'mod_' || (p_partkey + 1) || ',mod_' || (p_partkey + 7) END AS imports,
        CAST(CASE ext WHEN '.py' THEN 7 WHEN '.dart' THEN 3 ELSE 2 END AS BIGINT) AS size_lines
        FROM code_files""",
    "code_edges": f"""WITH {corpus.CODE_FILES} SELECT DISTINCT i.project, i.path AS source, f.path AS target
        FROM code_imports i JOIN code_files f ON f.project = i.project AND f.name = i.name""",
    "code_external": f"""WITH {corpus.CODE_FILES} SELECT DISTINCT project, name FROM code_imports i
        WHERE NOT EXISTS (SELECT 1 FROM code_files f WHERE f.project = i.project AND f.name = i.name)""",
    "code_layers": f"""WITH {corpus.CODE_FILES} SELECT project,
        {corpus._sql_mapped('p_type', _LAYER_OF_TYPE, 'other')} AS layer, count(*) AS modules,
        CAST(sum(CASE ext WHEN '.py' THEN 7 WHEN '.dart' THEN 3 ELSE 2 END) AS BIGINT) AS lines
        FROM code_files GROUP BY 1, 2""",
    "code_routes": f"""WITH {corpus.CODE_FILES} SELECT project, '/item/' || p_partkey AS route, 'GET' AS method
        FROM code_files WHERE ext = '.py'""",
    "code_services": f"""WITH {corpus.CODE_FILES} SELECT DISTINCT project, 'Stripe' AS service
        FROM code_files WHERE ext = '.py'""",
    "layer_of_path": f"SELECT page_id, {_LAYER_SQL} AS layer FROM pages",
    "pack_budget": f"""WITH {_packed({'high': 1000000, 'medium': 100, 'low': 30}, 15000)}
        SELECT project, path, priority, compressed AND priority <> 'high' AS compressed,
          tokens AS token_estimate, before AS tokens_before, md5(content) AS content_md5 FROM packed""",
    "pack_summary": f"""WITH {_packed({'high': 50, 'medium': 20, 'low': 0}, 5000)}
        SELECT t.project, t.total_files, coalesce(p.n, 0) AS included_files,
          coalesce(p.lines, 0) AS total_lines, coalesce(p.tokens, 0) AS token_estimate
        FROM (SELECT project, count(*) AS total_files FROM texts GROUP BY 1) t
        LEFT JOIN (SELECT project, count(*) AS n, CAST(sum(len(lines)) AS BIGINT) AS lines,
          CAST(sum(tokens) AS BIGINT) AS tokens FROM packed GROUP BY 1) p ON p.project = t.project""",
    "file_tree": f"""WITH {corpus.CODE_FILES}, f AS (
          SELECT project, split_part(path, '/', 1) AS directory,
            regexp_replace(path, '^[^/]*/', '') AS file FROM code_files),
        d AS (SELECT project, directory, count(*) AS n FROM f GROUP BY 1, 2)
        SELECT project, directory, directory || '/ (' || n || ' files)' AS line FROM d
        UNION ALL SELECT project, directory, '... +' || (n - 5) || ' more' FROM d WHERE n > 5
        UNION ALL SELECT project, directory, file FROM (
          SELECT *, row_number() OVER (PARTITION BY project, directory ORDER BY file) AS k FROM f)
          WHERE k <= 5""",
    "debounce_periods": f"""WITH {corpus.FILE_EVENTS} SELECT period, count(*) AS events FROM placed
        GROUP BY period""",
    "pending_changes": f"""WITH {corpus.FILE_EVENTS} SELECT period, path,
        arg_max(event_type, seq) AS event_type, bool_or(event_type = 'created') AS created
        FROM placed GROUP BY 1, 2""",
    "period_counts": f"""WITH {corpus.FILE_EVENTS}, p AS (
        SELECT period, path, arg_max(event_type, seq) AS event_type FROM placed GROUP BY 1, 2)
        SELECT period, count(*) FILTER (event_type = 'created') AS created,
          count(*) FILTER (event_type = 'modified') AS modified,
          count(*) FILTER (event_type = 'deleted') AS deleted FROM p GROUP BY period""",
    "watcher_replay": f"""WITH {corpus.FILE_EVENTS} SELECT path, arg_max(event_type, seq) AS event_type,
        bool_or(event_type = 'created') AS created, epoch_us(max(ts)) AS ts FROM placed GROUP BY period, path""",
    "note_ages": """WITH e AS (SELECT event_id, ts, date_diff('microsecond', ts, (SELECT max(ts) FROM events))
            // 1000000 // 60 AS m FROM events)
        SELECT event_id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h'
          WHEN m < 10080 THEN (m // 1440) || 'd' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM e""",
    "escaped_pages": "SELECT page_id, md5(replace(replace(html, '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages",
    "guarded_paths": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN FALSE
          WHEN p_partkey % 5 = 1 THEN p_partkey % 4 <= 2 ELSE p_partkey % 4 <= 1 END AS inside FROM part""",
    "url_mentions": f"""{_C} SELECT event_id, 'https://example.com/' || event_id AS url FROM captures
        WHERE event_type = 'view'""",
    "message_slugs": f"""{_C}, s AS (SELECT event_id, text, rtrim(substr(text, 1, 80), '.') AS head
          FROM captures)
        SELECT event_id,
          substr(trim(regexp_replace(regexp_replace(lower(text), '[^\\w\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-'), 1, 60)
            AS capture,
          regexp_replace(regexp_replace(lower(text), '[ /]', '-', 'g'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g') AS file,
          substr(trim(regexp_replace(regexp_replace(lower(head), '[^\\w\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-'), 1, 60)
            AS ingest
        FROM s""",
}
