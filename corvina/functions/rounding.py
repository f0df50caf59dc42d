"""Rounding that does not hang on the last bit of a sum."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Put on before rounding, so that a half that floating point puts on either side of itself goes up.
NUDGE = 1e-9


def rounded(value: Column | str, places: int = 0) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(NUDGE), places)


def nudged_sql(sql: str) -> str:
    """SQL whose calls of round(x, places) do the same."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[m.end() : i - 1]
        comma = inner.rfind(",")
        if comma < 0 or not inner[comma + 1 :].strip().isdigit():
            continue
        out += [sql[at : m.end() + comma], " + 0.000000001::DOUBLE"]
        at = m.end() + comma
    return "".join(out) + sql[at:]
