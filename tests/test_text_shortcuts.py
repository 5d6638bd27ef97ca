"""Quick forms of text expressions give what the patterns in their place gave."""

import time

from pyspark.sql import functions as F

from notespark import vocab
from notespark.functions import text as tx

TEXTS = [
    "", " ", "\n\n\n", "plain", "  a b　\r\n", "​kept​", "﻿a\x1c", "\x85 x ",
    "#a b", "x #a\n#b #c #d\t#e##f #\n#g#h", "a\r#b\r\n#c", "see ![[x]] [[a|b]] [[c]]\n\n\n\nend ", "!![[[q]]]", "[x]]\n\n\n",
]


def test_strip_tags_and_clean_are_as_the_patterns_say(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    for parity in (False, True):
        embeds = lambda c: F.regexp_replace(c, vocab.EMBED, "")
        out = embeds(tx.resolve_links("t")) if parity else tx.resolve_links(embeds(F.col("t")))
        got = rows.select(
            F.regexp_replace("t", r"(?U)^\s+|\s+\z", "").alias("s"), tx.strip("t").alias("s2"),
            F.array_distinct(tx.find_all("t", r"(?m)(?:^|\s)#([a-zA-Z0-9_-]+)", 1)).alias("g"), tx.inline_tags("t").alias("g2"),
            F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "").alias("c"),
            tx.clean("t", parity).alias("c2")).collect()
        assert [(r.s, r.g, r.c) for r in got] == [(r.s2, r.g2, r.c2) for r in got]


def test_strip_looks_at_the_ends_only(spark):
    """A run of white space inside a text was tried from each of its places: seconds for one text."""
    rows = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 200_000), F.lit("b")).alias("t")).cache()
    rows.count()
    start = time.time()
    assert rows.select(F.length(tx.strip("t"))).first()[0] == 200_002
    assert time.time() - start < 4
