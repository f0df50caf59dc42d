"""Events, graphs, queue state and text expressions on small fixtures."""

import datetime as dt
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.functions import text as T
from corvina.operators import events as E
from corvina.operators import graph as G
from corvina.operators import statistics as S
from corvina.operators import upserts as U


def test_anchored_windows(spark):
    days = [dt.date(2020, 1, d) for d in (1, 6, 7, 20)]
    df = spark.createDataFrame([(d,) for d in [*days, None, days[0]]], "d date")
    w = E.anchored_windows(df, "d")
    assert [(r.start.day, r.end.day) for r in w.orderBy("window_id").collect()] == [(1, 6), (7, 12), (20, 25)]
    assert E.anchored_windows(df.limit(0), "d").count() == 0
    assert {(r.d and r.d.day, r.window_id) for r in E.with_window(df, w, "d").collect()} == {(1, 1), (6, 1), (7, 2), (20, 3), (None, None)}


def test_leader_groups_are_not_transitive():
    a = np.array([1.0, 0.0])
    turn = lambda t: np.array([np.cos(t), np.sin(t)])
    assert E.leader_groups(np.stack([a, turn(0.8), turn(1.5)]), 0.65).tolist() == [0, 0, -1]


def test_density_groups_find_tight_clusters():
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:3]
    v = np.concatenate([c + rng.normal(0, 0.02, (6, 8)) for c in centres] + [rng.normal(0, 1, (2, 8))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = E._condensed_groups(v, 0.35)
    assert all(len(set(label[i * 6 : i * 6 + 6])) == 1 and label[i * 6] >= 0 for i in range(3)) and len({label[0], label[6], label[12]}) == 3


def test_event_groups(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 1, [0.0, 1.0]), (4, 2, [0.0, 1.0]), (5, None, [0.0, 1.0]), (6, 2, None)]
    got = {r.key: r.event_id for r in E.event_groups(spark.createDataFrame(rows, "id long, window_id long, v array<double>"), "id", "v").collect()}
    assert got == {1: 1, 2: 1, 3: -1, 4: -1}


def _edges(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, distance double, weight double")


def test_paths_and_betweenness(spark):
    raw = [(1, 2, 1.0, 1.0), (2, 3, 1.0, 1.0), (1, 4, 1.0, 1.0), (4, 3, 1.0, 1.0), (3, 5, 2.0, 1.0)]
    e = _edges(spark, raw)
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    d = {(r.source, r.node): r.distance for r in G.distances(e, nodes).collect()}
    assert d[1, 5] == 4.0 and d[2, 4] == 2.0 and len(d) == 25
    got = {r.node: r.betweenness for r in G.betweenness(e, nodes).collect()}
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w, _ in raw:
        near.setdefault(a, []).append((b, w)), near.setdefault(b, []).append((a, w))
    want = dict.fromkeys(near, 0.0)
    for s in near:  # all shortest ways, one by one
        for t in near:
            if s < t:
                ways, todo = [], deque([([s], 0.0)])
                while todo:
                    path, far = todo.popleft()
                    if path[-1] == t and far == d[s, t]:
                        ways.append(path)
                    elif far < d[s, t]:
                        todo += [([*path, n], far + w) for n, w in near[path[-1]] if n not in path]
                for p in ways:
                    for n in p[1:-1]:
                        want[n] += 1 / len(ways)
    assert got == {n: pytest.approx(v) for n, v in want.items() if n in got} and all(v == 0 for n, v in want.items() if n not in got)


def test_communities_split_two_cliques(spark):
    clique = lambda xs: [(a, b, 1.0, 1.0) for a in xs for b in xs if a < b]
    e = _edges(spark, [*clique([1, 2, 3, 4]), *clique([5, 6, 7, 8]), (4, 5, 1.0, 1.0)])
    labels = {r.node: r.label for r in G.communities(e).collect()}
    assert len({labels[n] for n in (1, 2, 3, 4)}) == 1 and len({labels[n] for n in (5, 6, 7, 8)}) == 1
    assert G.modularity(e, G.communities(e)).first().modularity == pytest.approx(2 * (6 / 13 - 0.25), abs=1e-5)


def test_queue_state(spark):
    old, new = spark.createDataFrame([(1, "u"), (2, None)], "id long, url string"), spark.createDataFrame([(3, "u"), (5, "w"), (4, "w"), (6, None), (7, None)], "id long, url string")
    assert sorted(r.id for r in U.insert_or_ignore(old, new, "url", "id").collect()) == [4, 6, 7]
    rows = spark.createDataFrame([(1, 9, "a", "h"), (2, 9, "b", "i"), (3, None, "a", "j"), (4, None, "c", "h"), (5, None, "d", "k")], "id long, url_id long, url string, hash_conteudo string")
    assert {r.id for r in U.admit_articles(rows).where("situacao = 'extraido'").collect()} == {1, 5}
    up = U.upsert(old, spark.createDataFrame([(2, "x"), (3, None), (1, None)], "id long, url string"), "id")
    assert {(r.id, r.url) for r in up.collect()} == {(1, "u"), (2, "x"), (3, None)}


def test_text(spark):
    rows = [("URGENTE: veja o video!", 0.5069), ("", 0.0), ("Oi", 0.15), (None, 0.0)]
    got = spark.createDataFrame(rows, "t string, want double").select("want", T.clickbait(F.col("t"))["score"].alias("s"))
    assert all(r.s == pytest.approx(r.want, abs=2e-4) for r in got.collect())
    s = spark.createDataFrame([("recorde e crise",), ("avanco",), ("",)], "t string").select(T.lexicon_sentiment(F.col("t")).alias("s")).collect()
    assert [(r.s.pos, r.s.neg, r.s.neu, r.s.polarity) for r in s] == [(0.3333, 0.3333, 0.3334, 0.0), (0.5, 0.0, 0.5, 0.5), (0.0, 0.0, 1.0, 0.0)]
    u = spark.createDataFrame([("http://a.org:80/x?utm_source=f&ref=z&page=2#t",)], "u string").select(T.canonical_url(F.col("u")).alias("u")).first().u
    assert u == "https://a.org/x?page=2"
    t = spark.createDataFrame([("Operação Lava Jato no Banco Central",)], "t string").select(T.title_terms(F.col("t")).alias("t")).first().t
    assert t == ["operação", "lava_jato", "banco_central"]
    a = spark.createDataFrame([("https://x/mercado/politica/", None), ("https://x/abc", "zzz")], "u string, t string").select(T.topic_axis(F.col("u"), F.col("t")).alias("a")).collect()
    assert [r.a for r in a] == ["politico", "politico"]
    b = spark.createDataFrame([("Da Redação - Texto um\r\n\r\n\r\nPublicidade\nLeia  também: x",)], "b string").select(T.without_signatures(T.tidy(F.col("b"))).alias("b")).first().b
    assert b == "Texto um\n\nx"
    long = "palavra " * 60
    assert spark.createDataFrame([(long,)], "b string").select(T.summary(F.col("b")).alias("s")).first().s.endswith("palavra...")


def test_exact_similarity_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 2) if i % 11 else None, sorted({f"t{x}" for x in rng.integers(0, 9, size=rng.integers(0, 6))})) for i in range(80)]
    rows.append((200, 0, ["t1"] * 3))
    df = spark.createDataFrame(rows, "id long, w long, terms array<string>")
    sets = [(i, w, set(t)) for i, w, t in rows if w is not None and t]
    for cosine in (0.65, 0.93875, 1.0):
        want = {(a, b) for a, w, s in sets for b, v, t in sets if a < b and w == v and len(s & t) / (len(s) * len(t)) ** 0.5 >= cosine - 1e-9}
        assert {(r.a, r.b) for r in E.similar_pairs(df, "id", "w", "terms", cosine).collect()} == want


def test_selectors(spark):
    from corvina.operators import selectors as Q

    v = spark.createDataFrame([(1, "gz", "Gazeta", "tradicional"), (2, "pn", "Portal Novo", "digital_nativo"), (3, None, None, None)], "id long, codigo string, nome string, tipo string")
    ids = lambda wanted: sorted(r.id for r in Q.select_outlets(v, wanted).collect())
    assert (ids("Tradicionais"), ids("digital, gaz"), ids("PORTAL"), ids("nada"), ids(" , ")) == ([1], [1, 2], [2], [1, 2, 3], [1, 2, 3])
    assert Q.years_of("2018-2016, 2020, x, 20-21") == [(2016, 2018), (2020, 2020)]


def test_mid_ranks_of_concentrated_values(spark):
    rng = np.random.default_rng(9)
    x = np.round(0.5 + rng.random(400) * 1e-4, 6)
    df = spark.createDataFrame([(float(v), "ab"[i % 2]) for i, v in enumerate(x)], "v double, g string")
    rank = {v: (x < v).sum() + ((x == v).sum() + 1) / 2 for v in x}
    assert all(r["rank"] == rank[r.value] for r in S.mid_ranks(df, "v", "g").collect())


def test_components_and_article_dates(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.component) for r in G.components(chain).collect()} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}
    rows = [("2020-03-04T10:00:00Z", "https://a/2019/01/02/x", None), (None, "https://a/2019/01/02/x", None), ("ontem", "https://a/2019/13/02/x", None), (None, "https://a/2018/07/x", None), (None, "https://a/x", '<meta property="article:published_time" content="2017-05-06">'), (None, "https://a/x", None)]
    d = spark.createDataFrame(rows, "w string, u string, h string").select(T.article_date(F.col("w"), F.col("u"), F.col("h"), F.lit("2021-01-01").cast("date")).alias("d")).collect()
    assert [(str(r.d.date), r.d.origin) for r in d] == [("2020-03-04", "metadados"), ("2019-01-02", "url_dia"), ("2021-01-01", "coleta"), ("2018-07-01", "url_mes"), ("2017-05-06", "meta"), ("2021-01-01", "coleta")]


def test_vectors(spark):
    from corvina.functions import vectors as V

    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [2.0, 0.2], 0), (3, [0.0, 3.0], 1), (4, [0.0, 0.0], 1), (5, None, None)], "id long, v array<float>, label int")
    got = {r.id: (r.anchor, r.similarity) for r in V.nearest_anchor(df, "id", "v", "label").collect()}
    assert got[1][0] == 0 and got[3][0] == 1 and got[4] == (0, 0.0)
    back = df.select("id", V.from_blob(V.to_blob(F.col("v"))).alias("v")).collect()
    assert [r.v for r in back][:1] == [[1.0, 0.0]] and back[4].v is None
