"""Distributed statistics: one aggregation, then closed forms on a few rows.

Rank tests work on the histogram of values, so ties and mid-ranks come from a
window over distinct values, not over rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvina.functions.rounding import rounded
from corvina.session import stash


def descriptives(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median, sample deviation, extremes and count of a column, rounded to 4 places.

    Nulls don't count; a group of one has deviation 0; without groups an empty
    table gives one row of zeros.
    """
    v = F.col(value)
    zero = lambda c, name: rounded(F.coalesce(c, F.lit(0.0)), 4).alias(name)
    measures = [zero(F.avg(v), "media"), zero(F.percentile(v, F.lit(0.5)), "mediana"), zero(F.stddev_samp(v), "desvio_padrao"), zero(F.min(v), "minimo"), zero(F.max(v), "maximo"), F.count(v).alias("n")]
    return df.groupBy(*(by or [])).agg(*measures)


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, m, v): count, mean and sample variance of each group, nulls left out."""
    return df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))


def _pick(column: str, group: str) -> Column:
    return F.max(F.when(F.col("group") == group, F.col(column)))


def welch(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """One row: Welch's t of two groups, its degrees of freedom and p, and Cohen's d; t 0 and p 1 below two values."""
    g = group_moments(df, value, group).agg(*[_pick(c, x).alias(f"{c}{i}") for i, x in ((1, first), (2, second)) for c in ("n", "m", "v")])
    ready = (F.coalesce("n1", F.lit(0)) >= 2) & (F.coalesce("n2", F.lit(0)) >= 2)
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    spread = F.sqrt(e1 + e2)
    t = F.when(ready & (spread > 0), (F.col("m1") - F.col("m2")) / spread).otherwise(0.0)
    dof = F.when(ready & (spread > 0), (e1 + e2) ** 2 / (e1**2 / (F.col("n1") - 1) + e2**2 / (F.col("n2") - 1))).otherwise(1.0)
    d = F.when(ready & (pooled > 0), (F.col("m1") - F.col("m2")) / pooled).otherwise(0.0)
    return g.select(t.alias("t"), dof.alias("dof"), d.alias("cohen_d")).select(rounded("t", 4).alias("t"), rounded("dof", 2).alias("dof"), rounded(student_p("t", "dof"), 6).alias("p"), rounded("cohen_d", 4).alias("cohen_d"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: F of a one-way analysis of variance over groups of two values or more, and its p."""
    g = group_moments(df, value, group).where("n >= 2")
    g = g.crossJoin(g.agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("all"), F.count("*").alias("k")))
    between = F.sum(F.col("n") * (F.col("m") - F.col("s") / F.col("all")) ** 2)
    within = F.sum((F.col("n") - 1) * F.col("v"))
    sums = g.groupBy("all", "k").agg(between.alias("b"), within.alias("w")).agg(F.max("all").alias("all"), F.max("k").alias("k"), F.max("b").alias("b"), F.max("w").alias("w"))
    ready = (F.col("k") >= 2) & (F.col("w") > 0)
    f = F.when(ready, (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("all") - F.col("k")))).otherwise(0.0)
    return sums.select(f.alias("f"), F.coalesce(F.col("k") - 1, F.lit(1)).alias("d1"), F.coalesce(F.col("all") - F.col("k"), F.lit(1)).alias("d2")).select(rounded("f", 4).alias("f"), "d1", "d2", rounded(fisher_p("f", "d1", "d2"), 6).alias("p"))


def mid_ranks(df: DataFrame, value: str, group: str) -> DataFrame:
    """(value, group, n, rank, ties): the histogram of values by group with the mid-rank of each value.

    Distinct values are parted into ranges of equal size, whatever they are;
    the running count is taken over the ranges first, of which there are as
    many as partitions, and then inside each.
    """
    h = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).cast("double").alias("value"), F.col(group).alias("group")).agg(F.count("*").alias("n"))
    per_value = stash(h.groupBy("value").agg(F.sum("n").alias("ties")).repartitionByRange("value").withColumn("block", F.spark_partition_id()))
    blocks = per_value.groupBy("block").agg(F.sum("ties").alias("b")).withColumn("ahead", F.coalesce(F.sum("b").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("b")
    inside = Window.partitionBy("block").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per_value.withColumn("in", F.coalesce(F.sum("ties").over(inside), F.lit(0))).join(F.broadcast(blocks), "block").select("value", "ties", (F.col("ahead") + F.col("in") + (F.col("ties") + 1) / 2).alias("rank"))
    return h.join(ranked, "value")


def mann_whitney(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """One row: U of the first group and its two-sided p (ties corrected, continuity one half; exact below nine without ties)."""
    r = mid_ranks(df.where(F.col(group).isin(first, second)), value, group)
    ties = r.select("value", "ties").distinct().agg(F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("tie_sum"))
    sums = r.agg(F.coalesce(F.sum(F.when(F.col("group") == first, F.col("n") * F.col("rank"))), F.lit(0.0)).alias("r1"), *[F.coalesce(F.sum(F.when(F.col("group") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in ((1, first), (2, second))])
    one = sums.crossJoin(ties).withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    return one.select("u", "n1", "n2", rounded(_rank_p("u", "n1", "n2", F.coalesce("tie_sum", F.lit(0.0))), 6).alias("p"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: H of the Kruskal-Wallis test with ties corrected, its degrees of freedom and p."""
    r = mid_ranks(df, value, group)
    ties = r.select("value", "ties").distinct().agg(F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("tie_sum"))
    g = r.groupBy("group").agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").cast("double").alias("n"))
    sums = g.agg(F.sum(F.col("r") ** 2 / F.col("n")).alias("s"), F.sum("n").alias("all"), F.count("*").alias("k")).crossJoin(ties)
    n = F.col("all")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("tie_sum") / (n**3 - n))
    ready = (F.col("k") >= 2) & (F.col("tie_sum") < n**3 - n)
    return sums.select(F.when(ready, h).otherwise(0.0).alias("h"), F.greatest(F.col("k") - 1, F.lit(1)).alias("dof")).select(rounded("h", 4).alias("h"), "dof", rounded(chi2_p("h", "dof"), 6).alias("p"))


def chi_square(counts: DataFrame, row: str, column: str, n: str) -> DataFrame:
    """One row: chi-square of a table of counts (Yates if it has one degree of freedom), p and Cramer's V; zeros where a margin is empty."""
    c = counts.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.sum(n).cast("double").alias("o"))
    rows, columns, total = c.groupBy("r").agg(F.sum("o").alias("rs")), c.groupBy("c").agg(F.sum("o").alias("cs")), c.agg(F.sum("o").alias("t"))
    size = rows.agg(F.count("*").alias("nr")).crossJoin(columns.agg(F.count("*").alias("nc")))
    grid = rows.crossJoin(columns).join(c, ["r", "c"], "left").crossJoin(total).crossJoin(size).withColumn("e", F.col("rs") * F.col("cs") / F.col("t")).withColumn("dof", (F.col("nr") - 1) * (F.col("nc") - 1))
    off = F.abs(F.coalesce("o", F.lit(0.0)) - F.col("e"))
    off = F.when(F.col("dof") == 1, F.greatest(off - 0.5, F.lit(0.0))).otherwise(off)
    sums = grid.agg(F.sum(off**2 / F.col("e")).alias("x"), F.max("dof").alias("dof"), F.max("t").alias("t"), F.max(F.least("nr", "nc")).alias("k"))
    ready = F.col("dof") >= 1
    return sums.select(F.when(ready, F.col("x")).otherwise(0.0).alias("x"), F.greatest(F.coalesce("dof", F.lit(1)), F.lit(1)).alias("dof"), F.when(ready, F.sqrt(F.col("x") / (F.col("t") * (F.col("k") - 1)))).otherwise(0.0).alias("v")).select(
        rounded("x", 4).alias("chi2"), "dof", rounded(chi2_p("x", "dof"), 6).alias("p"), rounded("v", 4).alias("cramer_v")
    )


def mute_effect(counts: DataFrame, axis: str, group: str, n: str, first: str, second: str) -> DataFrame:
    """(axis, share_1, share_2, ratio, index_log, index_sym): how much more one group covers an axis than the other."""
    wide = counts.where(F.col(axis).isNotNull()).groupBy(F.col(axis).alias("axis")).agg(*[F.coalesce(F.sum(F.when(F.col(group) == x, F.col(n))), F.lit(0)).alias(f"c{i}") for i, x in ((1, first), (2, second))])
    shares = wide.crossJoin(F.broadcast(wide.agg(F.sum("c1").alias("t1"), F.sum("c2").alias("t2")))).select("axis", *[F.when(F.col(f"t{i}") > 0, F.col(f"c{i}") / F.col(f"t{i}")).otherwise(0.0).alias(f"p{i}") for i in (1, 2)])
    off, both = F.abs(F.col("p1") - F.col("p2")), F.col("p1") + F.col("p2")
    return shares.select(
        "axis", rounded("p1", 4).alias("share_1"), rounded("p2", 4).alias("share_2"), rounded(F.when(F.col("p2") > 0, F.col("p1") / F.col("p2")).otherwise(999.0), 3).alias("ratio"),
        rounded(off * F.log2(1 + off / (F.least("p1", "p2") + 0.001)), 4).alias("index_log"), rounded(F.when(both > 0, off / both).otherwise(0.0), 4).alias("index_sym"),
    )


def change_point(series: DataFrame, order: str, value: str, edge: int = 12) -> DataFrame:
    """One row (position, at, before, after, sse): where two means explain a series best, ``edge`` values kept at either end.

    Shorter series than twice the edge split at their peak.  One series of
    aggregated points, as by month; its window is as long as the series.
    """
    v = F.col("value")
    s = series.where(F.col(value).isNotNull()).select(F.col(order).alias("at"), F.col(value).cast("double").alias("value"))
    w, past = Window.orderBy("at"), Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("at", "value", (F.row_number().over(w) - 1).alias("i"), F.coalesce(F.sum("value").over(past), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(v * v).over(past), F.lit(0.0)).alias("q1"))
    s = s.crossJoin(F.broadcast(s.agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(v * v).alias("q"))))
    left, right = F.col("i"), F.col("n") - F.col("i")
    sse = (F.col("q1") - F.try_divide(F.col("s1") ** 2, left)) + (F.col("q") - F.col("q1") - F.try_divide((F.col("s") - F.col("s1")) ** 2, right))
    allowed = (F.col("i") >= edge) & (F.col("i") < F.col("n") - edge)
    long = F.col("n") >= 2 * edge
    key = F.when(long, F.when(allowed, rounded(sse, 9))).otherwise(-v)
    best = s.select("i", "at", F.try_divide(F.col("s1"), left).alias("before"), F.try_divide(F.col("s") - F.col("s1"), right).alias("after"), F.when(long, sse).alias("sse"), key.alias("key")).where(F.col("key").isNotNull())
    return best.agg(F.min_by(F.struct("i", "at", "before", "after", "sse"), F.struct("key", "i")).alias("b")).select(F.col("b.i").alias("position"), "b.at", rounded("b.before", 4).alias("before"), rounded("b.after", 4).alias("after"), rounded("b.sse", 6).alias("sse"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * out


def _gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        b += 2
        d = 1 / ((-i * (i - a)) * d + b or 1e-300)
        c = b + (-i * (i - a)) / c
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def _exact_u(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U by counting arrangements."""
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n2 + 1):
        up, down = n1 + i, i
        for s in range(n1 * n2, up - 1, -1):
            ways[s] -= ways[s - up]
        for s in range(down, n1 * n2 + 1):
            ways[s] += ways[s - down]
    most = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(ways[math.ceil(most) :]) / math.comb(n1 + n2, n1))


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_beta(d / 2, 0.5, d / (d + x * x)) for x, d in zip(t, dof, strict=True)])


@F.pandas_udf(DoubleType())
def fisher_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([_beta(b / 2, a / 2, b / (b + a * x)) if x > 0 else 1.0 for x, a, b in zip(f, d1, d2, strict=True)])


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_gamma_tail(d / 2, v / 2) for v, d in zip(x, dof, strict=True)])


@F.pandas_udf(DoubleType())
def _rank_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    def p(u: float, a: int, b: int, ties: float) -> float:
        if not a or not b:
            return 1.0
        if min(a, b) <= 8 and not ties and a * b <= 100_000:
            return _exact_u(u, int(a), int(b))
        n = a + b
        spread = math.sqrt(a * b / 12 * ((n + 1) - ties / (n * (n - 1))))
        return min(1.0, math.erfc((max(u, a * b - u) - a * b / 2 - 0.5) / spread / math.sqrt(2))) if spread else 1.0

    return pd.Series([p(*x) for x in zip(u, n1, n2, ties, strict=True)])
