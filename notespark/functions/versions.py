"""Version strings of dependencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notespark.functions.text import col, let


def clean_version(spec: Column | str) -> Column:
    """``^1.2.3``, ``~1.2.3`` and ``>=1.2.3`` to ``1.2.3``."""
    return F.regexp_replace(col(spec), r"^[^0-9]*", "")


def _parts(version: Column) -> Column:
    given = F.transform(F.slice(F.split(version, r"\."), 1, 3), lambda p: p.try_cast("bigint"))
    return F.slice(F.concat(given, F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))), 1, 3)


def update_type(current: Column | str, latest: Column | str, parity: bool = False) -> Column:
    """major, minor or patch by the first of three parts that differs, when it grew.

    A downgrade is unknown.  ``parity`` tests each part alone, so that a lower major with a
    higher minor counts as minor.
    """

    def compared(c: Column, n: Column) -> Column:
        readable = F.lit(True)
        for part in (c[0], c[1], c[2], n[0], n[1], n[2]):
            readable = readable & part.isNotNull()
        out = F.when(~readable, F.lit("unknown"))
        for i, name in enumerate(["major", "minor", "patch"]):
            out = out.when(n[i] > c[i], F.lit(name))
            if not parity:
                out = out.when(n[i] < c[i], F.lit("unknown"))
        return out.otherwise(F.lit("unknown"))

    return let(
        F.struct(_parts(col(current)).alias("c"), _parts(col(latest)).alias("n")),
        lambda v: compared(v["c"], v["n"]),
    )
