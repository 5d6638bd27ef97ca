import pytest
from pyspark.sql import functions as F

from notespark.functions import text as tx
from notespark.functions.versions import clean_version, update_type


def lit(s):
    return F.lit(s)


@pytest.mark.parametrize("text, want", [
    ("Ёлка Next.js v2_x-y naïve", ["ёлка", "next.js", "v2_x-y", "na", "ve"]),
    ("", []),
])
def test_tokens(value, text, want):
    assert value(tx.tokens(lit(text))) == want
    assert tx.query_tokens(text) == want


@pytest.mark.parametrize("body, path, want", [
    ("intro\n  # The Title  \n# Other", "a/b.md", "The Title"),
    ("## only two\n#tag", "a/my-note_file.md", "My Note File"),
    ("", "x.md", "X"),
])
def test_title(value, body, path, want):
    assert value(tx.title(lit(body), lit(path))) == want


@pytest.mark.parametrize("body, want, parity", [
    ("see [[a|b]] and [[p/q]]", "see b and p/q", "see b and p/q"),
    ("![[x]]", "", "!x"),
    ("a\n\n\n\nb\n", "a\n\nb", "a\n\nb"),
])
def test_clean(value, body, want, parity):
    assert value(tx.clean(lit(body))) == want
    assert value(tx.clean(lit(body), parity=True)) == parity


def test_links_and_tags(value):
    assert value(tx.links(lit("[[x|y]] [[p/q]]"))) == ["x", "p/q"]
    assert value(tx.link_stem(lit("p/Page.md#part"))) == "page"
    assert value(tx.link_stem(lit("p/Page#part"), keep_anchor=True)) == "page#part"
    assert value(tx.inline_tags(lit("#a b#c\n#d-e ##f"))) == ["a", "d-e"]


def test_jaccard(value):
    a = F.array(F.lit("a"), F.lit("b"))
    assert value(tx.jaccard(a, F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert value(tx.jaccard(a, F.array().cast("array<string>"))) == 0.0


@pytest.mark.parametrize("name, want", [
    ("Тест", ""), ("KeyRing", "keyring"), ("Auto Transport", "auto-transport"), ("x", ""),
    ("«Big -- App»", "big-app"),
])
def test_project_slug(value, name, want):
    assert value(tx.project_slug(lit(name))) == want


def test_file_names(value):
    assert value(tx.file_slug(lit("Mein Ü/Plan: 2"))) == "mein-ü-plan-2"
    assert value(tx.ingest_slug(lit(""), lit("Hello, World. It goes on..."))) == "hello-world-it-goes-on"
    assert value(tx.capture_slug(lit("  ?? "))) == "untitled"


@pytest.mark.parametrize("content, want", [
    ("# h\n> q\n- **b**\n| t\n\nprose here", "prose here"),
    ("# only", "(no summary)"),
    ("w " * 60, ("w " * 40).rstrip().rsplit(" ", 1)[0] + " w…"),
])
def test_summary_line(value, content, want):
    got = value(tx.summary_line(lit(content)))
    assert got == want or (got.endswith("…") and len(got) <= 81)


def test_section_text(value):
    note = "x\n## Decision\n> why\n\nuse it\nnow\nand\nnever\n## Next\nz"
    assert value(tx.section_text(lit(note), "Decision")) == "use it now and"
    assert value(tx.section_text(lit(note), "Absent")) == ""


def test_page_text(value):
    html = ("<html><title> T &amp; U </title><body><nav>skip</nav><main>a<script>x()</script>"
            "<b>b</b> &amp;lt; c</main></body></html>")
    assert value(tx.page_title(lit(html))) == "T &amp; U"
    # the ampersand is decoded first, so a doubly escaped sign is decoded twice
    assert value(tx.page_text(lit(html))) == "a b < c"
    assert value(tx.page_text(lit("<p>" + "y" * 20 + "</p>"), 10)) == "y" * 10 + "\n\n...(truncated)"


def test_readme_summary(value):
    readme = "# T\n![badge](x)\nA [link](u) with *some* text in it\nmore\n\nsecond\n## H\nz"
    assert value(tx.readme_summary(lit(readme))) == "A link with some text in it more"
    assert value(tx.readme_summary(lit("short\n\nthis one is long enough to be taken"))) == (
        "this one is long enough to be taken")
    assert value(tx.readme_summary(lit(""))) == ""


@pytest.mark.parametrize("path, want", [
    ("a/b.md", True), ("a/../b.md", True), ("../x", False), ("a/../../x", False), ("/etc/x", False)])
def test_is_inside(value, path, want):
    assert value(tx.is_inside(lit(path))) is want


@pytest.mark.parametrize("minutes, want", [(0, "now"), (5, "5m"), (150, "2h"), (4000, "2d"), (20000, "2024-01-01")])
def test_age_label(value, minutes, want):
    moment = F.lit("2024-01-01 12:00:00").cast("timestamp")
    now = F.timestamp_add("MINUTE", F.lit(minutes), moment)
    assert value(tx.age_label(moment, now)) == want


@pytest.mark.parametrize("spec", ["^1.2.3", "~1.2.3", ">=1.2.3", "1.2.3"])
def test_clean_version(value, spec):
    assert value(clean_version(lit(spec))) == "1.2.3"


@pytest.mark.parametrize("old, new, want, parity", [
    ("1.0.0", "2.0.0", "major", "major"), ("1.0.0", "1.1.0", "minor", "minor"),
    ("1.0.0", "1.0.1", "patch", "patch"), ("abc", "def", "unknown", "unknown"),
    ("2.0.0", "1.5.0", "unknown", "minor"), ("1.0", "1.0.1", "patch", "patch"), ("1", "1", "unknown", "unknown"),
])
def test_update_type(value, old, new, want, parity):
    assert value(update_type(lit(old), lit(new))) == want
    assert value(update_type(lit(old), lit(new), True)) == parity
