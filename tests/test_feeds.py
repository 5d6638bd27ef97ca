import base64
import json

import pytest
from pyspark.sql import functions as F

from notespark.operators import dependencies, radar
from notespark.sources import feeds


@pytest.mark.parametrize("text, topics, language, score", [
    ("MCP server for filesystem access", ["mcp", "model-context-protocol"], "Python", 0.85),
    ("AI agent framework using LLM and RAG", ["ai-agent", "llm", "rag"], "Python", 0.75),
    ("CLI tool for developers", ["devtools", "cli"], "TypeScript", 0.55),
    ("Minecraft server plugin", ["minecraft", "gaming"], "Java", 0.0),
    ("Generic tool", [], "Python", 0.15),
    ("Generic tool", [], "Java", 0.0),
    (None, [], None, 0.0),
])
def test_repo_score(spark, text, topics, language, score):
    df = spark.createDataFrame([(text, topics, language)], "description string, topics array<string>, language string")
    row = radar.score_repos(df).first()
    assert row.relevance_score == score
    assert (row.relevance_reason == "no relevant signals") == (score == 0.0)


def test_repo_reason_and_bands(spark, value):
    df = spark.createDataFrame([("MCP server", ["mcp"], "Python")], "description string, topics array<string>, language string")
    assert radar.score_repos(df).first().relevance_reason == "mcp: mcp; language: Python; MCP related"
    assert [value(radar.band(F.lit(s))) for s in (0.6, 0.3, 0.29)] == ["high", "medium", "other"]
    assert value(radar.applicable_projects(F.lit("A Telegram bot"), F.array(F.lit("saas")))) == ["landing-pages", "chat-bots"]


@pytest.mark.parametrize("name, text, want", [
    ("x", "MCP server for Flutter", "high"), ("y", "tailwind helper", "medium"), ("z", "game engine", "low")])
def test_tool_relevance(value, name, text, want):
    assert value(radar.tool_relevance(F.lit(name), F.lit(text))) == want


def tools(spark, rows):
    return spark.createDataFrame(rows, "name string, relevance string, description string")


def test_scan_diff(spark):
    before = tools(spark, [("t", "medium", ""), ("gone", "high", ""), ("low-gone", "low", "")])
    now = tools(spark, [("t", "high", ""), ("new", "high", "<b>"), ("new-low", "low", "")])
    # a tool that moved between bands is neither new nor gone
    assert [r.name for r in radar.new_tools(now, before).collect()] == ["new"]
    assert [r.name for r in radar.removed_tools(now, before).collect()] == ["gone"]
    assert sorted(r.name for r in radar.new_tools(now, None).collect()) == ["new", "t"]
    assert radar.diff_counts(now, before).first().asDict() == {
        "total_current": 3, "total_previous": 3, "new_high": 1, "new_medium": 0, "removed": 1}
    assert [r.line for r in radar.alert_lines(radar.new_tools(now, before)).collect()] == ["new — &lt;b&gt;"]


def test_trending_and_digest(spark):
    rows = [(f"r{i}", "an llm tool" if i % 2 else "game", [], "Python", i * 10, f"2024-01-{i + 10:02d}") for i in range(10)]
    df = spark.createDataFrame(rows, "full_name string, description string, topics array<string>, language string, "
                                     "stars int, created_at string")
    got = [r.full_name for r in radar.trending(df, "2024-01-12", 50, "ai", 3).collect()]
    assert got == ["r9", "r7", "r5"]
    scored = radar.score_repos(df).withColumn("topic", F.lit("ai")).withColumn("relevance_score", F.col("stars") / 100)
    assert [r.full_name for r in radar.digest(scored, n=2).orderBy("rank").collect()] == ["r9", "r8"]


def test_watch_list(spark):
    table = "| # | Username | Category | Added |\n|---|---|---|---|\n| 1 | [@ann-b](https://x/ann-b) | ai-tools | 2024-01-01 |\n"
    files = spark.createDataFrame([("_global/github-watchlist.md", table)], "path string, raw_content string")
    listed = feeds.watch_list(files).select("username", "category", "added")
    assert [tuple(r) for r in listed.collect()] == [("ann-b", "ai-tools", "2024-01-01")]
    more = spark.createDataFrame([("ANN-B", "x", "2024-02-01"), ("cy", "x", "2024-02-01")],
                                 "username string, category string, added string")
    both = radar.watch(listed, more)
    assert sorted(r.username for r in both.collect()) == ["ann-b", "cy"]
    assert [r.username for r in radar.unwatch(both, "CY").collect()] == ["ann-b"]


def test_stored_feeds(spark, tmp_path, value):
    scan = {"scan_date": "2024-01-01", "tools_found": 1, "high_relevance": [{"name": "a", "url": "u"}],
            "medium_relevance": [], "low_relevance": []}
    (tmp_path / "latest.json").write_text(json.dumps(scan, indent=2), encoding="utf-8")
    assert [(r.name, r.relevance) for r in feeds.read_scan(spark, str(tmp_path / "latest.json")).collect()] == [("a", "high")]
    repos = [{"full_name": "o/r", "description": None, "html_url": "u", "stargazers_count": 5, "forks_count": 1}]
    (tmp_path / "repos.json").write_text(json.dumps(repos), encoding="utf-8")
    row = feeds.read_repos(spark, str(tmp_path / "repos.json")).first()
    assert (row.description, row.language, row.topics, row.stars) == ("", "Unknown", [], 5)
    coded = base64.encodebytes("héllo".encode()).decode()
    df = spark.createDataFrame([(coded,)], "content string")
    assert df.select(feeds.readme_text().alias("t")).first().t == "héllo"


MANIFESTS = [
    ("web/package.json", '{"dependencies": {"react": "^18.2.0", "next": "^14.0.0"}, "devDependencies": {"next": "~15.1.0"}}'),
    ("api/pyproject.toml", '[project]\nname = "x"\ndependencies = [\n    "fastapi[all]>=0.100.0",\n    "httpx",\n]\n[tool]\n'),
    ("job/pyproject.toml", "[project]\n"),
    ("job/requirements.txt", "# c\nrequests==2.0.0\n\nrich\n"),
    ("app/pubspec.yaml", "name: app\ndependencies:\n  flutter:\n    sdk: flutter\n  riverpod: ^2.4.0 # c\n\ndev_dependencies:\n  lints: 3.0.0\nflutter:\n  x: 1.0\n"),
    ("web/deep/package.json", '{"dependencies": {"no": "1.0.0"}}'),
    ("bad/package.json", "{broken"),
]


def test_manifests(spark):
    files = spark.createDataFrame(MANIFESTS, "path string, raw_content string")
    got = {(r.project, r.manager, r.name, r.current) for r in feeds.read_dependencies(files).collect()}
    assert got == {
        ("web", "npm", "react", "18.2.0"), ("web", "npm", "next", "15.1.0"),
        ("api", "pip", "fastapi", "0.100.0"), ("api", "pip", "httpx", ""),
        ("job", "pip", "requests", "2.0.0"), ("job", "pip", "rich", ""),
        ("app", "flutter", "riverpod", "2.4.0"), ("app", "flutter", "lints", "3.0.0")}


def test_compare(spark):
    files = spark.createDataFrame(MANIFESTS, "path string, raw_content string")
    deps = feeds.read_dependencies(files)
    registry = spark.createDataFrame(
        [("npm", "react", "19.0.0"), ("npm", "next", "15.1.0"), ("pip", "httpx", "1.0.0"), ("pip", "requests", "2.0.1")],
        "manager string, name string, latest string")
    compared = dependencies.compare(deps, registry)
    got = {r.name: (r.status, r.update_type) for r in compared.collect()}
    assert got == {"react": ("outdated", "major"), "next": ("up to date", None), "httpx": ("up to date", None),
                   "requests": ("outdated", "patch")}
    row = {r.project: r for r in dependencies.summary(compared, deps).collect()}
    assert (row["web"].total_deps, row["web"].outdated, row["web"].major) == (2, 1, 1) and row["app"].outdated == 0


def test_a_scan_run_twice_finds_nothing_new(spark, tmp_path):
    from notespark.sources import versions

    path = str(tmp_path / "scans")

    def scan(rows):
        return spark.createDataFrame(rows, "name string, description string")

    def names(df):
        return sorted(r.name for r in df.collect())

    first = scan([("a", "MCP server for Flutter"), ("b", "tailwind helper"), ("c", "game engine")])
    new, gone, version = radar.run_scan(first, path)
    assert (names(new), names(gone), version) == (["a", "b"], [], 1)
    new, gone, version = radar.run_scan(first, path)
    assert (names(new), names(gone), version) == ([], [], 1)
    second = scan([("a", "MCP server for Flutter"), ("c", "MCP server for Flutter"), ("d", "tailwind & <more>"), ("e", "MCP flutter")])
    new, gone, version = radar.run_scan(second, path)
    assert (names(new), names(gone), version) == (["d", "e"], ["b"], 2)
    assert names(versions.read(spark, path, 1)) == ["a", "b", "c"]
    assert {r["name"]: r.change for r in versions.changes(spark, path, "name", 1).collect()} == {
        "b": "removed", "c": "changed", "d": "added", "e": "added"}
    assert [r.name for r in radar.alert_lines(new).collect()] == ["e"]
