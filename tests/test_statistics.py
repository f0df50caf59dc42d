"""Statistics against brute force and worked values."""

import math
import random

import pytest

from corvina.operators import statistics as S


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, x double, n long, value double")


def test_descriptives(spark):
    r = S.descriptives(frame(spark, [("a", v, 1, None) for v in (1.0, 2.0, 10.0, 20.0)]), "x").first()
    assert (r.media, r.mediana, r.minimo, r.maximo, r.n) == (8.25, 6.0, 1.0, 20.0, 4)
    empty = S.descriptives(frame(spark, []), "x").first()
    assert (empty.media, empty.n) == (0.0, 0)


def test_exact_mann_whitney(spark):
    r = S.mann_whitney(frame(spark, [("a", 1.0, 1, None), ("a", 2.0, 1, None), ("b", 3.0, 1, None), ("b", 4.0, 1, None), (None, 9.0, 1, None), ("a", None, 1, None)]), "x", "g", "a", "b").first()
    assert (r.u, r.p) == (0.0, pytest.approx(1 / 3, abs=1e-6))


def test_rank_tests_with_ties(spark):
    random.seed(3)
    rows = [(random.choice("ab"), float(random.randint(0, 9)), 1, None) for _ in range(300)]
    xs, ys = [r[1] for r in rows if r[0] == "a"], [r[1] for r in rows if r[0] == "b"]
    u = sum((x > y) + 0.5 * (x == y) for x in xs for y in ys)
    r = S.mann_whitney(frame(spark, rows), "x", "g", "a", "b").first()
    back = S.mann_whitney(frame(spark, rows), "x", "g", "b", "a").first()
    assert r.u == pytest.approx(u) and r.u + back.u == len(xs) * len(ys) and 0 < r.p <= 1
    k = S.kruskal(frame(spark, rows), "x", "g").first()
    ranks = {v: sum(r[1] < v for r in rows) + (sum(r[1] == v for r in rows) + 1) / 2 for v in {r[1] for r in rows}}
    n = len(rows)
    ties = sum(c**3 - c for c in (sum(r[1] == v for r in rows) for v in ranks))
    h = (12 / (n * (n + 1)) * sum(sum(ranks[x] for x in g) ** 2 / len(g) for g in (xs, ys)) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    assert k.h == pytest.approx(h, abs=1e-3)


def test_welch_and_anova(spark):
    rows = [("a", v, 1, None) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", v, 1, None) for v in (3.0, 5.0, 7.0)]
    w, a = S.welch(frame(spark, rows), "x", "g", "a", "b").first(), S.anova(frame(spark, rows), "x", "g").first()
    assert w.t == pytest.approx((2.5 - 5) / math.sqrt(5 / 3 / 4 + 4 / 3), abs=1e-4)
    assert a.f == pytest.approx((4 * (2.5 - 25 / 7) ** 2 + 3 * (5 - 25 / 7) ** 2) / ((5 + 8) / 5), abs=1e-3)
    assert S.student_p.func(__import__("pandas").Series([2.0]), __import__("pandas").Series([10.0]))[0] == pytest.approx(0.07338803, abs=1e-7)
    lone = S.welch(frame(spark, rows[:1]), "x", "g", "a", "b").first()
    assert (lone.t, lone.p) == (0.0, 1.0)


def test_chi_square(spark):
    table = [("a", 10, "x"), ("a", 20, "y"), ("b", 20, "x"), ("b", 10, "y")]
    df = spark.createDataFrame(table, "r string, n long, c string")
    r = S.chi_square(df, "r", "c", "n").first()
    assert (r.chi2, r.dof) == (5.4, 1) and r.p == pytest.approx(0.020137, abs=1e-5)
    flat = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 2, "x"), ("b", 4, "y"), ("b", 6, "z")], "r string, n long, c string")
    r = S.chi_square(flat, "r", "c", "n").first()
    assert (r.chi2, r.dof, r.p) == (0.0, 2, 1.0)


def test_mute_effect(spark):
    df = spark.createDataFrame([("a", "t", 3), ("b", "t", 1), ("a", "d", 1), ("b", "d", 3), (None, "d", 5)], "axis string, g string, n long")
    r = {x.axis: x for x in S.mute_effect(df, "axis", "g", "n", "t", "d").collect()}
    assert r["a"].index_log == pytest.approx(0.7906, abs=1e-4) and (r["a"].ratio, r["b"].ratio) == (3.0, 0.333)


def test_change_point(spark):
    df = spark.createDataFrame([(i, float(i >= 15)) for i in range(30)], "i int, v double")
    r = S.change_point(df, "i", "v").first()
    assert (r.position, r.sse, r.before, r.after) == (15, 0.0, 0.0, 1.0)
    short = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 5.0, 5.0, 2.0])], "i int, v double")
    assert S.change_point(short, "i", "v").first().position == 1
