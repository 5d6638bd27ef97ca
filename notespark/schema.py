"""Schemas of the stored relations, as DDL that readers and ``from_json`` take."""

FILE = "path string, raw_content string"
NOTE_META = "meta map<string,string>, tags array<string>"
FACT = (
    "subject string, predicate string, object string, valid_from string, valid_to string, "
    "source_note string, confidence double"
)
SNAPSHOT = (
    "timestamp string, project string, summary string, files_changed array<string>, "
    "git_status string, git_branch string, recent_commits array<string>, "
    "uncommitted_changes array<string>, active_decisions array<string>, "
    "blockers array<string>, next_steps array<string>"
)
_TOOLS = (
    "array<struct<name:string, description:string, url:string, stars:int, category:string, "
    "source:string>>"
)
RADAR_SCAN = (
    f"scan_date string, tools_found int, high_relevance {_TOOLS}, "
    f"medium_relevance {_TOOLS}, low_relevance {_TOOLS}"
)
REPO = (
    "full_name string, description string, html_url string, stargazers_count int, "
    "forks_count int, language string, topics array<string>, created_at string, pushed_at string"
)
NPM_MANIFEST = (
    "name string, dependencies map<string,string>, devDependencies map<string,string>"
)
FILE_EVENT = "seq bigint, ts timestamp, path string, event_type string"
