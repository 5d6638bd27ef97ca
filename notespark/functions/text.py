"""Column expressions over note text.  All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import vocab


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that they are computed once per row.

    Spark inlines a projected expression wherever it is used, in pushed filters too, and so may
    parse a text many times; it never moves an expression across a generator.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(values)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The characters of Unicode's White_Space property, which are those of ``(?U)\\s``.
WHITE_SPACE = "".join(map(chr, [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Remove white space, newlines included, from both ends.  Looks at the ends only, whatever the text's length."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def find_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def rest(items: Column, drop: int | Column = 1) -> Column:
    """An array without its first items."""
    return F.slice(items, F.lit(1) + drop, F.greatest(F.size(items), F.lit(0)))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def tokens(c: Column | str) -> Column:
    """Lower-cased search tokens, in order, repeats kept."""
    return find_all(F.lower(col(c)), vocab.TOKEN)


def query_tokens(text: str) -> list[str]:
    """The same tokens for a query given on the driver."""
    return re.findall(vocab.TOKEN, text.lower())


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two token arrays; 0 when either is empty."""
    a, b = col(a), col(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / F.size(F.array_union(a, b))
    )


def checksum(c: Column | str) -> Column:
    return F.md5(F.encode(col(c), "UTF-8"))


def stem(path: Column | str) -> Column:
    """File name without directory and last suffix."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def title(body: Column | str, path: Column | str) -> Column:
    """First level-one heading, else the file name in title case."""
    heading = F.regexp_extract(col(body), r"(?md)^[^\S\n]*# [^\S\n]*(\S.*?)[^\S\n]*$", 1)
    fallback = F.initcap(F.regexp_replace(stem(path), "[-_]", " "))
    return F.coalesce(F.nullif(heading, F.lit("")), fallback)


def inline_tags(body: Column | str) -> Column:
    return F.array_distinct(find_all(body, vocab.INLINE_TAG, 1))


def links(raw: Column | str) -> Column:
    """Targets of wikilinks as written, one per occurrence."""
    return find_all(raw, vocab.WIKILINK, 1)


def link_stem(target: Column | str, keep_anchor: bool = False) -> Column:
    """Node key a link points at: last path part, lower case, no ``.md``.

    A heading anchor ``page#part`` points at ``page``; ``keep_anchor`` keeps it in the key.
    """
    key = F.replace(F.lower(F.element_at(F.split(col(target), "/"), -1)), F.lit(".md"), F.lit(""))
    return key if keep_anchor else F.regexp_replace(key, r"(?<=.)#.*\z", "")


def resolve_links(c: Column | str) -> Column:
    with_alias = F.regexp_replace(col(c), vocab.WIKILINK_WITH_ALIAS, "$1")
    return F.regexp_replace(with_alias, vocab.WIKILINK_PLAIN, "$1")


def clean(body: Column | str, parity: bool = False) -> Column:
    """Text to search: links as plain words, embeds removed, blank lines collapsed.

    Embeds go first; ``parity`` resolves links first, which leaves ``!name`` of an embed.  Patterns run on
    texts only that hold the characters they begin with.
    """
    def plain(text: Column) -> Column:
        if parity:
            return F.regexp_replace(resolve_links(text), vocab.EMBED, "")
        return resolve_links(F.regexp_replace(text, vocab.EMBED, ""))

    def lines(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\n\n\n")), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text)

    linked = let(col(body), lambda text: F.when(F.contains(text, F.lit("[[")), plain(text)).otherwise(text))
    return strip(let(linked, lines))


def urls(c: Column | str) -> Column:
    return find_all(c, vocab.URL)


def file_slug(name: Column | str) -> Column:
    """File name of a note made from its title."""
    dashed = F.regexp_replace(F.lower(col(name)), "[ /]", "-")
    return F.regexp_replace(dashed, r"[^\p{L}\p{N}_-]", "")


def _word_slug(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", "")
    dashed = F.regexp_replace(kept, r"(?U)[\s_]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+\z", "")


def ingest_slug(name: Column | str, content: Column | str, length: int = 60) -> Column:
    """File name of an ingested source: from its title, else from how it begins."""
    start = F.regexp_replace(F.substring(col(content), 1, 80), r"\.+\z", "")
    base = F.when(F.coalesce(col(name), F.lit("")) != "", col(name)).otherwise(start)
    cut = F.substring(_word_slug(base), 1, length)
    return F.when(cut != "", cut).otherwise(F.lit("untitled"))


def capture_slug(c: Column | str, length: int = 60) -> Column:
    cut = F.substring(_word_slug(strip(c)), 1, length)
    return F.when(cut != "", cut).otherwise(F.lit("untitled"))


def project_slug(name: Column | str) -> Column:
    """Directory name of a project named in a text; empty if fewer than two characters stay."""
    kept = F.regexp_replace(col(name), r"[^A-Za-z0-9\- ]", "")
    dashed = F.regexp_replace(F.lower(F.trim(kept)), r"[ \-]+", "-")
    out = F.regexp_replace(dashed, r"^-+|-+\z", "")
    return F.when(F.length(out) >= 2, out).otherwise(F.lit(""))


def escape_html(c: Column | str) -> Column:
    out = F.replace(col(c), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def summary_line(content: Column | str, length: int = 80) -> Column:
    """First line of prose: no heading, rule, quote, bold list item or table row."""
    prose = F.filter(
        F.transform(lines(content), lambda s: F.trim(s)),
        lambda s: (s != "") & ~s.rlike(r"^(#|---|>|- \*\*|\| )"),
    )

    def shown(first: Column) -> Column:
        head = F.substring(first, 1, length)
        cut = F.concat(F.regexp_replace(head, r" [^ ]*\z", ""), F.lit("…"))
        return F.when(F.length(first) > length, cut).otherwise(head)

    return F.coalesce(let(F.get(prose, F.lit(0)), shown), F.lit(vocab.NO_SUMMARY))


def section_text(content: Column | str, heading: str, keep: int = 3) -> Column:
    """First lines under a level two or three heading, quotes left out, joined by spaces."""
    starts = r"(?i)^[^\S\n]*###? " + re.escape(heading.lower())
    parts = F.split(col(content), r"\n(?=[^\S\n]*##)")
    body = F.get(F.filter(parts, lambda p: p.rlike(starts)), F.lit(0))
    kept = F.filter(
        F.transform(let(lines(body), lambda x: rest(x)), lambda s: F.trim(s)),
        lambda s: (s != "") & ~s.startswith(">"),
    )
    return F.coalesce(F.array_join(F.slice(kept, 1, keep), " "), F.lit(""))


def type_rank(note_type: Column | str, ranks: dict[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in ranks.items():
        out = out.when(col(note_type) == name, F.lit(rank))
    return out.otherwise(F.lit(vocab.OTHER_TYPE_RANK))


def contains_any(c: Column | str, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(col(c), F.lit(word))
    return out


def first_rule(c: Column | str, rules: list[tuple[str, list[str]]], other: str) -> Column:
    """Label of the first rule with a keyword inside the text."""

    def pick(text: Column) -> Column:
        out = F.when(F.lit(False), F.lit(other))
        for label, words in rules:
            out = out.when(contains_any(text, words), F.lit(label))
        return out.otherwise(F.lit(other))

    return let(col(c), pick)


def estimated_tokens(c: Column | str) -> Column:
    return F.floor(F.length(col(c)) / 4)


def page_title(html: Column | str) -> Column:
    return strip(F.regexp_extract(col(html), vocab.PAGE_TITLE, 1))


def page_text(html: Column | str, max_chars: int | None = vocab.PAGE_CHARS) -> Column:
    """Readable text of an HTML page.

    The first of article, main and body gives the content, else the whole page; script,
    navigation and the like are removed, then all tags.  ``max_chars=None`` keeps it whole.
    """
    html = col(html)
    body = F.lit(None).cast("string")
    for tag in reversed(vocab.PAGE_CONTAINERS):
        pattern = rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"
        inner = F.regexp_extract(html, pattern, 1)
        body = F.when(html.rlike(pattern), inner).otherwise(body)
    out = F.when(F.coalesce(body, F.lit("")) != "", body).otherwise(html)
    for tag in vocab.PAGE_NOISE:
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    for entity, char in vocab.PAGE_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = strip(out)
    if max_chars is None:
        return out
    return let(
        out,
        lambda t: F.when(
            F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit(vocab.PAGE_CUT_MARK))
        ).otherwise(t),
    )


def readme_summary(readme: Column | str, length: int = 500) -> Column:
    """First paragraph of more than 20 characters before the first level-two heading.

    Badges, images and HTML lines are left out; links keep their words.
    """
    head = F.split_part(F.concat(F.lit("\n"), F.regexp_replace(col(readme), r"(?m)^[ \t]+", "")),
                        F.lit("\n## "), F.lit(1))
    kept = F.filter(lines(head), lambda s: ~s.rlike(r"^(!\[|<)"))
    marked = F.transform(
        kept, lambda s: F.when(s.startswith("# "), F.lit("")).otherwise(strip(s))
    )
    paragraphs = F.transform(
        F.split(F.array_join(marked, "\n"), r"\n{2,}"),
        lambda p: F.trim(F.regexp_replace(p, "\n", " ")),
    )
    plain = F.transform(
        paragraphs,
        lambda p: F.regexp_replace(
            F.regexp_replace(p, r"\[([^\]]+)\]\([^)]+\)", "$1"), "[*_`]", ""
        ),
    )
    first = F.get(F.filter(plain, lambda p: F.length(p) > 20), F.lit(0))
    return F.coalesce(F.substring(first, 1, length), F.lit(""))


def age_label(moment: Column | str, now: Column | str) -> Column:
    """How long ago, as minutes, hours or days, or the date from a week on."""
    moment, now = col(moment), col(now)
    minutes = F.floor(F.timestamp_diff("SECOND", moment, now) / 60)
    return (
        F.when(minutes < 1, F.lit("now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
        .when(minutes < 10080, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
        .otherwise(F.date_format(moment, "yyyy-MM-dd"))
    )


def is_inside(path: Column | str) -> Column:
    """Whether a relative path stays inside its root: not absolute, never above it."""
    path = col(path)
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, part: F.struct(
            (acc["at"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(
                acc["low"],
                acc["at"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1),
            ).alias("low"),
        ),
    )
    return ~path.startswith("/") & (depth["low"] >= 0)
