"""Selections that people write: outlets by group, code or name, and years."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How the two groups of outlets are called, by the beginning of the word.
GROUPS = {"tradiciona": "tradicional", "digita": "digital_nativo"}


def select_outlets(outlets: DataFrame, wanted: str, code: str = "codigo", name: str = "nome", kind: str = "tipo") -> DataFrame:
    """The outlets that a list separated by commas names: a group, or a part of code or name; all, if it names none.

    Letter case doesn't count; an empty list names none.
    """
    parts = [p.strip().lower() for p in wanted.split(",") if p.strip()]
    if not parts:
        return outlets

    def named(part: str) -> Column:
        for start, group in GROUPS.items():
            if part.startswith(start):
                return F.col(kind) == group
        return F.lower(code).contains(part) | F.lower(name).contains(part)

    hit = F.coalesce(reduce(lambda a, b: a | b, map(named, parts)), F.lit(False))
    any_ = F.broadcast(outlets.agg(F.coalesce(F.max(hit), F.lit(False)).alias("any_")))
    return outlets.crossJoin(any_).where(hit | ~F.col("any_")).drop("any_")


def years_of(wanted: str) -> list[tuple[int, int]]:
    """Spans of years in a list such as "2015-2018, 2020"; what is no year is left out."""
    spans = []
    for part in wanted.split(","):
        ends = [p.strip() for p in part.split("-")]
        if all(len(p) == 4 and p.isdigit() for p in ends) and len(ends) <= 2:
            spans.append((min(map(int, ends)), max(map(int, ends))))
    return spans


def in_years(year: Column, wanted: str) -> Column:
    """Whether a year lies in the spans of :func:`years_of`; every year does if there are none."""
    spans = years_of(wanted)
    return reduce(lambda a, b: a | b, [year.between(a, b) for a, b in spans]) if spans else F.lit(True)
