from pyspark.sql import functions as F

from notespark.plans import catalog
from notespark.sources import vault


def write(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")


FILES = {
    "app/prd.md": "---\nproject: app\ntype: prd\ntags: [One, \"two\"]\ncreated: 2024-01-02\nupdated: '2024-03-01'\n---\n\n# Plan\n\nText #three\n",
    "app/sub dir/note+1.md": "no front matter\n",
    "app/.hidden/x.md": "hidden",
    "_templates/t.md": "template",
    "_global/rules.md": "---\ntype: guidelines\ntags: a, b\n---\nrule",
    "web/bad.md": "---\nx: [\n---\nbody",
    "web/skip.txt": "not a note",
}


def test_scan(spark, tmp_path):
    write(tmp_path, FILES)
    notes = {r.path: r for r in vault.scan(vault.read_vault(spark, str(tmp_path))).collect()}
    assert sorted(notes) == ["_global/rules.md", "app/prd.md", "app/sub dir/note+1.md", "web/bad.md"]
    prd = notes["app/prd.md"]
    assert (prd.title, prd.project, prd.note_type, prd.created, prd.updated) == (
        "Plan", "app", "prd", "2024-01-02", "2024-03-01")
    assert prd.tags == ["One", "three", "two"] and prd.priority == "medium"
    assert prd.content == "# Plan\n\nText #three"
    plain = notes["app/sub dir/note+1.md"]
    assert (plain.project, plain.note_type, plain.stem, plain.meta) == ("app", "note", "note+1", {})
    assert notes["_global/rules.md"].project == "" and notes["_global/rules.md"].tags == ["a", "b"]
    assert notes["web/bad.md"].content == "body"


def test_tag_filter_matches_tags_and_types(spark, tmp_path):
    write(tmp_path, FILES)
    files = vault.read_vault(spark, str(tmp_path))
    assert [r.path for r in vault.scan(files, ["ONE"]).collect()] == ["app/prd.md"]
    assert [r.path for r in vault.scan(files, ["Guidelines"]).collect()] == ["_global/rules.md"]


def test_projects(spark, tmp_path):
    write(tmp_path, FILES)
    files = vault.read_vault(spark, str(tmp_path))
    assert sorted(r.project for r in vault.projects(files).collect()) == ["app", "web"]
    # a project's notes go by directory, hidden ones included
    assert vault.project_notes(files, "app").count() == 3
    listed = {r.project: (r.notes, r.types) for r in vault.list_projects(vault.scan(files)).collect()}
    assert listed == {"app": (2, "note, prd"), "web": (1, "note")}


def test_get_note_stays_inside(spark, tmp_path):
    write(tmp_path, FILES)
    files = vault.read_vault(spark, str(tmp_path))
    assert vault.get_note(files, "app/prd.md").first().title == "Plan"
    assert vault.get_note(files, "../app/prd.md").count() == 0


def test_catalog(spark, tmp_path):
    write(tmp_path, FILES)
    lines = [r.line for r in catalog.catalog(vault.scan(vault.read_vault(spark, str(tmp_path)))).collect()]
    assert lines == [
        "## 📁 app (2 notes: note, prd)",
        "- [Plan](app/prd.md) `prd` — Text #three",
        "- [Note+1](app/sub dir/note+1.md) `note` — no front matter",
        "## 📁 web (1 notes: note)",
        "- [Bad](web/bad.md) `note` — body",
    ]


def test_only_front_matter_goes_through_python(spark):
    files = spark.createDataFrame([("a/b.md", "---\nx: 1\n---\ntext")], "path string, raw_content string")
    plan = vault.parse_notes(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert files.select(F.col("path")).count() == 1


BLOCKS = [
    "project: app\ntype: note\ncreated: 2024-01-02\n", "tags: [a, b c]\ntype: x\n", "tags:\n  - \"s t\"\n  - word\nupdated: 2024-02-30\n",
    "tags:\n  - one\n  - two\ntype: y\n", "a: yes\n", "a: no way\n", "b: ~\n", "c: 1.50\nd: 007\n", "e: 'q'\n", "f: x # c\n", "g:\n",
    "h:\ni: x\n", "tags: a, b\n", "j: [yes, a]\n", "k: [ a , b ]\n", "- x\n", "l: {a: 1}\n", "m: x: y\n", "on: x\n", "n1: a\nn1: b\n",
    "o: \n- a\n", "p: a  \n", "tags: []\n", "q: 2024-01-01 10:00:00\n", "r: é\n", "s: a b  c\n", "t: http://x.y/z\n", "  u: x\n", "v:x\n",
    "tags: [a]\n  - b\n", "w: |\n  text\n", "x: y\n\nz: w\n", "tags:\n- a\n- b\n", "a-b: c-d\n", "d: a.b/c_d-e\n", "f: .5\n", "tags:\n  - 5\n",
]


def test_plain_blocks_read_like_yaml():
    quick = 0
    for block in BLOCKS:
        fields = vault._simple_yaml(block)
        if fields is not None:
            quick += 1
            plain = {str(k): vault._plain(v) for k, v in vault._yaml(block).items()}
            assert {k: vault._plain(v) for k, v in fields.items()} == plain, block
    assert quick >= 9


def test_paths_start_below_the_root_however_it_is_given(spark, tmp_path, monkeypatch):
    root = tmp_path / "notes"
    (root / "proj" / "notes").mkdir(parents=True)
    (root / "proj" / "notes" / "a b.md").write_text("x")
    monkeypatch.chdir(tmp_path)
    for given in (str(root), f"file://{root}", f"{root}/"):
        assert [r.path for r in vault.read_vault(spark, given).collect()] == ["proj/notes/a b.md"]
