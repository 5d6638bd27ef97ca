"""Registered queries: the wikilink graph and vault health."""

from __future__ import annotations

from pyspark.sql import functions as F

from notespark.operators import links, lint, paths
from notespark.plans import corpus
from notespark.session import cut_lineage
from notespark.sources import vault

AS_OF = "2024-09-01"
PATTERN = r"(?i)\b(the|hein|thouble|ndonre|and|with)\b"


def _graph(spark, folder):
    notes = cut_lineage(links.narrow(vault.scan(corpus.page_files(spark, folder))))
    nodes = links.nodes(notes)
    return notes, nodes, cut_lineage(links.edges(notes))


def graph_edges(spark, folder):
    return _graph(spark, folder)[2]


def link_degree_hubs(spark, folder):
    _, nodes, edges = _graph(spark, folder)
    return links.hubs(links.degrees(nodes, edges)).select("node", "degree", "title", "project")


def graph_stats(spark, folder):
    _, nodes, edges = _graph(spark, folder)
    return links.graph_stats(
        links.degrees(nodes, edges), edges, links.components(nodes, edges)
    )


def cluster_summary(spark, folder):
    _, nodes, edges = _graph(spark, folder)
    return links.clusters(links.degrees(nodes, edges))[0]


def cluster_top5(spark, folder):
    _, nodes, edges = _graph(spark, folder)
    return links.clusters(links.degrees(nodes, edges))[1].select(
        "project", F.col("rank").cast("bigint").alias("rank"), "node", "degree"
    )


def bfs_khop(spark, folder):
    _, nodes, edges = _graph(spark, folder)
    return links.neighbors(nodes, edges, "page-0", 3)


def shortest_path(spark, folder):
    _, _, edges = _graph(spark, folder)
    return links.shortest_path(edges, "page-2", "page-106")


def shortest_paths(spark, folder):
    """How far every page is from another one, and how many nodes the path that was found has."""
    _, _, edges = _graph(spark, folder)
    pages = corpus.table(spark, folder, "pages").select("page_id")
    n = pages.agg(F.count("*").alias("n"))
    pairs = pages.join(F.broadcast(n)).select(  # a row
        F.concat(F.lit("page-"), "page_id").alias("source"), F.concat(F.lit("page-"), (F.col("page_id") * 37 + 11) % F.col("n")).alias("target"))
    found = paths.shortest_paths(edges, pairs)
    return found.groupBy("source", "target").agg(F.max("step").alias("length"), F.count_distinct("node").alias("nodes"))


def components(spark, folder):
    _, nodes, edges = _graph(spark, folder)
    return links.components(nodes, edges)


def find_node(spark, folder):
    notes = vault.scan(corpus.page_files(spark, folder))
    return links.find_node(links.nodes(notes), "age-24").select("node", "path")


def suggest_nodes(spark, folder):
    notes = vault.scan(corpus.page_files(spark, folder))
    return links.suggest_nodes(links.nodes(notes), "page-7-the").select(
        "node", F.col("overlap").cast("bigint").alias("overlap"))


def orphans(spark, folder):
    return lint.orphans(vault.scan(corpus.page_files(spark, folder)))


def broken_links(spark, folder):
    return lint.broken_links(vault.scan(corpus.page_files(spark, folder)))


def stale_notes(spark, folder):
    return lint.stale(vault.scan(corpus.document_files(spark, folder)), AS_OF)


def missing_concepts(spark, folder):
    notes = cut_lineage(lint.extracted(vault.scan(corpus.document_files(spark, folder)), PATTERN))
    return lint.missing_concepts(notes, PATTERN)


def todo_markers(spark, folder):
    """Markers in notes on customers, as many as their debt calls for."""
    return lint.todo_markers(vault.scan(corpus.task_files(spark, folder)))


def empty_sections(spark, folder):
    return lint.empty_sections(vault.scan(corpus.task_files(spark, folder)))


def front_matter(spark, folder):
    return lint.front_matter(vault.scan(corpus.page_files(spark, folder)))


def lint_report(spark, folder):
    """All checks over the notes made of pages, documents and customers."""
    parts = [corpus.page_files(spark, folder), corpus.document_files(spark, folder), corpus.task_files(spark, folder)]
    files = [p.select("path", "raw_content") for p in parts]
    notes = vault.scan(files[0].unionByName(files[1]).unionByName(files[2]))
    return lint.severity_counts(lint.lint(notes, AS_OF))


QUERIES = {
    f.__name__: f
    for f in [
        graph_edges, link_degree_hubs, graph_stats, cluster_summary, cluster_top5, bfs_khop,
        shortest_path, shortest_paths, components, find_node, suggest_nodes, orphans, broken_links, stale_notes,
        missing_concepts, todo_markers, empty_sections, front_matter, lint_report,
    ]
}

_BOTH = """
sym AS (SELECT source AS a, target AS b FROM graph_edges
  UNION SELECT target, source FROM graph_edges)"""
_DEGREE = """
degs AS (
  SELECT stem AS node, title, project, (SELECT count(*) FROM graph_edges WHERE source = stem)
    + (SELECT count(*) FROM graph_edges WHERE target = stem) AS degree
  FROM graph_nodes)"""
_COMPONENTS = """
walk(node, label) USING KEY (node) AS (
  SELECT stem, stem FROM graph_nodes
  UNION ALL
  SELECT s.b, min(w.label) FROM walk w JOIN sym s ON s.a = w.node
  JOIN recurring.walk r ON r.node = s.b
  GROUP BY s.b, r.label HAVING min(w.label) < r.label)"""
_DISTANCE = """
dist(node, d) AS (
  SELECT '{start}' AS node, 0 AS d
  UNION
  SELECT s.b, d + 1 FROM dist JOIN sym s ON s.a = node WHERE d < {depth})"""

_ORPHANS = """
SELECT 'info' AS severity, 'orphan' AS category, path AS file,
  'No inbound WikiLinks — this page is isolated' AS message,
  'Add [[' || stem || ']] link from related notes' AS suggestion
FROM graph_nodes WHERE stem NOT IN (SELECT key FROM graph_links WHERE key <> source)"""
_BROKEN = """
SELECT 'warning' AS severity, 'broken_link' AS category, path AS file,
  'Broken WikiLink: [[' || target || ']] — target not found' AS message,
  'Create the page or fix the link' AS suggestion
FROM graph_links WHERE key NOT IN (SELECT stem FROM graph_nodes)"""
_FIELDS = """
SELECT 'info' AS severity, 'frontmatter' AS category, path AS file,
  'Missing recommended fields: created, tags, updated' AS message, '' AS suggestion
FROM graph_nodes WHERE project <> 'concepts'
UNION ALL
SELECT 'warning', 'frontmatter', path, 'Missing frontmatter entirely',
  'Add YAML frontmatter with project, type, tags' FROM graph_nodes WHERE project = 'concepts'"""

ORACLE = {
    "graph_edges": f"WITH {corpus.PAGE_LINKS} SELECT source, target, n FROM graph_edges",
    "link_degree_hubs": f"""WITH {corpus.PAGE_LINKS}, {_DEGREE}
        SELECT node, degree, title, project FROM degs WHERE degree > 0
        ORDER BY degree DESC, node LIMIT 10""",
    "graph_stats": f"""WITH RECURSIVE {corpus.PAGE_LINKS}, {_BOTH}, {_DEGREE}, {_COMPONENTS}
        SELECT count(*) AS nodes, CAST((SELECT sum(n) FROM graph_edges) AS BIGINT) AS edges,
          round((SELECT sum(n) FROM graph_edges) / (count(*) * (count(*) - 1))::DOUBLE, 4) AS density,
          round(sum(degree) / count(*)::DOUBLE, 2) AS avg_degree,
          (SELECT count(DISTINCT label) FROM walk) AS components
        FROM degs""",
    "cluster_summary": f"""WITH {corpus.PAGE_LINKS}, {_DEGREE}
        SELECT project, count(*) AS node_count, CAST(sum(degree) AS BIGINT) AS total_connections
        FROM degs GROUP BY project""",
    "cluster_top5": f"""WITH {corpus.PAGE_LINKS}, {_DEGREE}
        SELECT project, rank, node, degree FROM (
          SELECT *, row_number() OVER (PARTITION BY project ORDER BY degree DESC, node) AS rank
          FROM degs) WHERE rank <= 5""",
    "bfs_khop": f"""WITH RECURSIVE {corpus.PAGE_LINKS}, {_BOTH},
        {_DISTANCE.format(start='page-0', depth=3)},
        near AS (SELECT node, min(d) AS depth FROM dist GROUP BY node HAVING min(d) > 0)
        SELECT depth, near.node, title, project,
          CASE WHEN depth > 1 THEN 'indirect' ELSE concat_ws(' ',
            CASE WHEN EXISTS (SELECT 1 FROM graph_edges WHERE source = 'page-0' AND target = near.node)
              THEN '→' END,
            CASE WHEN EXISTS (SELECT 1 FROM graph_edges WHERE target = 'page-0' AND source = near.node)
              THEN '←' END) END AS direction
        FROM near JOIN graph_nodes ON stem = near.node""",
    "shortest_path": f"""WITH RECURSIVE {corpus.PAGE_LINKS}, {_BOTH},
        {_DISTANCE.format(start='page-106', depth=8)},
        near AS (SELECT node, min(d) AS d FROM dist GROUP BY node),
        path(step, node, d) AS (
          SELECT 0, node, d FROM near WHERE node = 'page-2'
          UNION ALL
          SELECT step + 1, (SELECT min(n.node) FROM sym s JOIN near n ON n.node = s.b
            WHERE s.a = path.node AND n.d = path.d - 1), d - 1
          FROM path WHERE d > 0)
        SELECT step, node FROM path""",
    "shortest_paths": f"""WITH RECURSIVE {corpus.PAGE_LINKS}, {_BOTH},
        pairs AS (SELECT 'page-' || page_id AS source,
            'page-' || (page_id * 37 + 11) % (SELECT count(*) FROM pages) AS target FROM pages),
        walk(source, target, node, d) AS (
          SELECT source, target, source, CAST(0 AS BIGINT) FROM pairs
          UNION SELECT w.source, w.target, s.b, d + 1 FROM walk w JOIN sym s ON s.a = w.node WHERE d < 8 AND w.node <> w.target)
        SELECT source, target, min(d) AS length, min(d) + 1 AS nodes FROM walk WHERE node = target GROUP BY source, target""",
    "components": f"""WITH RECURSIVE {corpus.PAGE_LINKS}, {_BOTH}, {_COMPONENTS}
        SELECT node, label AS component FROM walk""",
    "find_node": f"""WITH {corpus.PAGE_LINKS}
        SELECT stem AS node, path FROM graph_nodes
        WHERE contains(stem, 'age-24') OR contains('age-24', stem)
        ORDER BY stem = 'age-24' DESC, path LIMIT 1""",
    "suggest_nodes": f"""WITH {corpus.PAGE_LINKS}
        SELECT node, overlap FROM (
          SELECT stem AS node, path,
            len(list_intersect(list_distinct(string_split(stem, '-')), ['page', '7', 'the'])) AS overlap
          FROM graph_nodes) WHERE overlap > 0 ORDER BY overlap DESC, path LIMIT 5""",
    "orphans": f"WITH {corpus.PAGE_LINKS} {_ORPHANS}",
    "broken_links": f"WITH {corpus.PAGE_LINKS} {_BROKEN}",
    "stale_notes": f"""WITH {corpus.DOCUMENT_NOTES}
        SELECT 'warning' AS severity, 'stale' AS category, path AS file,
          'Not updated for ' || date_diff('day', CAST(created AS DATE), DATE '{AS_OF}')
            || ' days (since ' || created || ')' AS message,
          'Review and update, or mark as archived' AS suggestion
        FROM notes WHERE CAST(created AS DATE) < DATE '{AS_OF}' - INTERVAL 90 DAY""",
    "missing_concepts": f"""WITH {corpus.DOCUMENT_NOTES},
        hits AS (SELECT lower(unnest(regexp_extract_all(content,
          '(?i)\\b(the|hein|thouble|ndonre|and|with)\\b'))) AS concept FROM notes),
        counted AS (SELECT concept, count(*) AS mentions FROM hits GROUP BY 1 HAVING count(*) >= 3
          ORDER BY 2 DESC, 1 LIMIT 20)
        SELECT 'info' AS severity, 'missing_concept' AS category, '(vault-wide)' AS file,
          '"' || concept || '" mentioned ' || mentions || ' times but has no concept page' AS message,
          'Create a concept page: concept-' || concept || '.md' AS suggestion
        FROM counted WHERE NOT EXISTS (SELECT 1 FROM notes WHERE contains(lower(title), concept))""",
    "todo_markers": f"""WITH {corpus.TASK_NOTES}
        SELECT 'warning' AS severity, 'empty_section' AS category, path AS file,
          'Contains ' || n || ' TODO/FIXME markers' AS message,
          'Complete or remove TODO items' AS suggestion FROM task_notes WHERE n > 0""",
    "empty_sections": f"""WITH {corpus.TASK_NOTES}
        SELECT 'info' AS severity, 'empty_section' AS category, path AS file,
          'Empty section: "' || heading || '"' AS message,
          'Add content or remove the heading' AS suggestion
        FROM (
          SELECT path, unnest(CASE WHEN n = 0 THEN ['Open', 'Later'] ELSE ['Later'] END) AS heading
          FROM task_notes)""",
    "front_matter": f"WITH {corpus.PAGE_LINKS} {_FIELDS}",
    "lint_report": f"""WITH {corpus.PAGE_LINKS}, {corpus.DOCUMENT_NOTES}, {corpus.TASK_NOTES},
        found AS ({_ORPHANS} UNION ALL {_BROKEN} UNION ALL {_FIELDS}
          UNION ALL SELECT 'info', 'orphan', path, '', '' FROM notes UNION ALL SELECT 'info', 'orphan', path, '', '' FROM task_notes
          UNION ALL SELECT 'warning', 'stale', path, '', '' FROM notes
            WHERE CAST(created AS DATE) < DATE '{AS_OF}' - INTERVAL 90 DAY
          UNION ALL SELECT 'info', 'frontmatter', path, '', '' FROM notes
          UNION ALL SELECT 'warning', 'frontmatter', path, '', '' FROM task_notes
          UNION ALL SELECT 'warning', 'empty_section', path, '', '' FROM task_notes WHERE n > 0
          UNION ALL SELECT 'info', 'empty_section', path, '', '' FROM
            (SELECT path, unnest(CASE WHEN n = 0 THEN ['Open', 'Later'] ELSE ['Later'] END) FROM task_notes))
        SELECT severity, category, count(*) AS issues FROM found GROUP BY 1, 2""",
}
