"""Grouping articles into events, and what is said about each event."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.fixed import DEFAULT_AXIS
from corvina.functions.rounding import rounded
from corvina.session import hinted


def anchored_windows(df: DataFrame, date: str, days: int = 5) -> DataFrame:
    """(window_id, start, end): windows that begin at the first date not covered and last ``days`` more.

    Both ends belong to the window, and the next one begins at the next date
    that occurs.  Only distinct dates enter, which are as many as the days of
    the archive; null dates are left out.
    """
    dates = df.where(F.col(date).isNotNull()).select(F.col(date).cast("date").alias("d")).distinct().agg(F.sort_array(F.collect_list("d")).alias("dates"))
    start = F.lit(None).cast("array<date>")
    anchors = F.aggregate("dates", F.coalesce(start, F.array().cast("array<date>")), lambda acc, d: F.when((F.size(acc) == 0) | (d > F.date_add(F.element_at(acc, -1), days)), F.array_append(acc, d)).otherwise(acc))
    return dates.select(F.posexplode(anchors).alias("pos", "start")).select((F.col("pos") + 1).alias("window_id"), "start", F.date_add("start", days).alias("end"))


def with_window(df: DataFrame, windows: DataFrame, date: str) -> DataFrame:
    """``df`` with the window that holds its date, null where none does.

    Windows become one row a day, so the join is one of equal days.
    """
    by_day = windows.select("window_id", F.explode(F.sequence("start", "end")).alias("day_"))
    return df.join(hinted(by_day), df[date].cast("date") == F.col("day_"), "left").drop("day_")


def _condensed_groups(v: np.ndarray, epsilon: float) -> np.ndarray:
    """Density groups of unit vectors with two members or more, -1 for noise.

    With a single neighbour for a core distance the hierarchy is single
    linkage; the stable groups of its condensed tree are chosen by excess of
    mass, the root excepted, and groups born below ``epsilon`` are merged up.
    """
    n = len(v)
    d = np.sqrt(np.maximum(0, 2 - 2 * np.clip(v @ v.T, -1, 1)))
    inside, near, parent = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (d[at] < near)
        near[closer], parent[closer] = d[at][closer], at
        at = int(np.where(inside, np.inf, near).argmin())
        edges.append((near[at], parent[at], at))
    edges.sort()
    tree, top, size, members = {}, list(range(n)), {i: 1 for i in range(n)}, {i: [i] for i in range(n)}
    find = lambda x: x if top[x] == x else find(top[x])
    for height, a, b in edges:
        a, b, new = find(a), find(b), len(top)
        top.append(new)
        top[a] = top[b] = new
        tree[new], size[new], members[new] = (a, b, height), size[a] + size[b], members[a] + members[b]
    lam = lambda h: 1 / max(h, 1e-12)
    groups: dict[int, dict] = {}

    def grow(node: int, born: float, up: int | None) -> int:
        """A group of the condensed tree from ``node`` down to where it splits in two."""
        me = len(groups)
        groups[me] = {"born": born, "up": up, "mass": 0.0, "kids": [], "node": node}
        while node in tree:
            a, b, h = tree[node]
            big = [x for x in (a, b) if size[x] >= 2]
            for x in (a, b):
                if size[x] < 2 or len(big) == 2:
                    groups[me]["mass"] += (lam(h) - born) * size[x]
            if len(big) == 2:
                groups[me]["kids"] = [grow(x, lam(h), me) for x in big]
                return me
            if not big:
                return me
            node = big[0]
        return me

    root = grow(len(top) - 1, 0.0, None) if n > 1 else None
    chosen: set[int] = set()

    def pick(g: int) -> float:
        below = sum(pick(k) for k in groups[g]["kids"])
        if g != root and groups[g]["mass"] >= below:
            for k in groups[g]["kids"]:
                drop(k)
            chosen.add(g)
            return groups[g]["mass"]
        return below

    def drop(g: int) -> None:
        chosen.discard(g)
        for k in groups[g]["kids"]:
            drop(k)

    if root is not None:
        pick(root)
    merged = set()
    for g in chosen:
        while 1 / max(groups[g]["born"], 1e-12) < epsilon and groups[g]["up"] not in (None, root):
            g = groups[g]["up"]
        merged.add(g)
    label = np.full(n, -1)
    for i, g in enumerate(sorted(merged, key=lambda g: min(members[groups[g]["node"]]))):
        up = groups[g]["up"]
        while up is not None and up not in merged:
            up = groups[up]["up"]
        if up is None:
            label[members[groups[g]["node"]]] = i
    return label


def leader_groups(v: np.ndarray, similarity: float) -> np.ndarray:
    """Each unvisited vector leads those after it that are as similar; groups of one are noise (-1)."""
    s, label, free, k = v @ v.T, np.full(len(v), -1), np.ones(len(v), bool), 0
    for i in range(len(v)):
        if free[i]:
            took = free & (s[i] >= similarity) & (np.arange(len(v)) > i)
            free[i] = False
            if took.any():
                free[took], label[took], label[i], k = False, k, k, k + 1
    return label


def event_groups(articles: DataFrame, key: str, vector: str, window: str = "window_id", similarity: float = 0.65, epsilon: float = 0.35, few: int = 5) -> DataFrame:
    """(key, window, event_id): articles of one window grouped by their vectors, -1 where alone.

    Windows of fewer than ``few`` articles are grouped by leaders, larger ones
    by density.  Event ids follow windows and, inside, the least key.  A window
    holds the articles of some days; null vectors or windows are alone.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        v = np.stack(pdf["vector"].to_numpy()).astype(float)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(norm == 0, 1, norm)
        label = np.full(len(v), -1) if len(v) < 2 else leader_groups(v, similarity) if len(v) < few else _condensed_groups(v, epsilon)
        return pd.DataFrame({"key": pdf["key"], "window": pdf["window"], "label": label})

    known = articles.where(F.col(vector).isNotNull() & F.col(window).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(window).cast("long").alias("window"), F.col(vector).alias("vector"))
    labelled = known.groupBy("window").applyInPandas(lambda pdf: group(pdf), "key long, window long, label long")
    events = labelled.where("label >= 0").groupBy("window", "label").agg(F.min("key").alias("first"))
    # Events of a window are numbered inside it, windows by how many events stand before them: one row a window.
    ranked = events.withColumn("rank_", F.row_number().over(Window.partitionBy("window").orderBy("first")))
    ahead = events.groupBy("window").agg(F.count("*").alias("n_")).withColumn("ahead_", F.coalesce(F.sum("n_").over(Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ids = ranked.join(ahead.select("window", "ahead_"), "window").withColumn("event_id", (F.col("ahead_") + F.col("rank_")).cast("long"))
    return labelled.join(ids.select("window", "label", "event_id"), ["window", "label"], "left").select("key", "window", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


def similar_pairs(articles: DataFrame, key: str, window: str, terms: str, cosine: float) -> DataFrame:
    """(window, a, b, cosine), a < b: articles of one window whose sets of terms, as unit vectors, have at least this cosine.

    Exact at any size of window: a pair shares one of the rarest terms of
    either set, of which as many are indexed as ``cosine`` allows to differ;
    nothing is compared beyond the articles that meet there.  Null windows and
    empty sets have no pairs.
    """
    rows = articles.where(F.col(window).isNotNull() & (F.size(terms) > 0)).select(F.col(key).alias("key"), F.col(window).alias("window"), F.array_sort(F.array_distinct(terms)).alias("terms"))
    each = rows.select("key", "window", F.explode("terms").alias("term"))
    rarity = each.groupBy("window", "term").agg(F.count("*").alias("df"))
    ordered = each.join(rarity, ["window", "term"]).groupBy("key", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("terms"))
    n = F.size("terms")
    prefix = n - F.ceil(n * (cosine * cosine) - 1e-9).cast("int") + 1
    indexed = ordered.select("key", "window", "terms", F.explode(F.slice("terms", F.lit(1), prefix)).alias("term"))
    side = lambda x: indexed.select("window", "term", F.col("key").alias(x), F.col("terms").alias(f"terms_{x}"))
    both = F.size(F.array_intersect("terms_a", "terms_b")) / F.sqrt(F.size("terms_a").cast("double") * F.size("terms_b"))
    met = side("a").join(side("b"), ["window", "term"]).where("a < b").select("window", "a", "b", both.alias("cosine"))
    return met.where(F.col("cosine") >= cosine - 1e-9).distinct()


def event_summaries(articles: DataFrame, event: str = "evento_id", outlet: str = "veiculo_id", date: str = "data", axis: str = "eixo_tematico", polarity: str = "sentimento_polaridade", title: str = "titulo", key: str = "id") -> DataFrame:
    """One row per event: first title, dates, articles, outlets, commonest axis and spread of sentiment.

    The axis is the commonest one, the first by alphabet in a tie, and the
    default where all are null; unassigned articles (-1 or null) have no event.
    """
    rows = articles.where(F.col(event) >= 0)
    axes = rows.where(F.col(axis).isNotNull()).groupBy(event, axis).agg(F.count("*").alias("n")).groupBy(event).agg(F.min_by(axis, F.struct(-F.col("n"), axis)).alias("eixo"))
    out = rows.groupBy(event).agg(
        F.min_by(title, F.struct(date, key)).alias("nome_evento"), F.min(date).alias("data_inicio"), F.max(date).alias("data_fim"), F.count("*").alias("total_materias"),
        F.countDistinct(outlet).alias("total_veiculos"), rounded(F.coalesce(F.stddev_pop(F.coalesce(polarity, F.lit(0.0))), F.lit(0.0)), 4).alias("divergencia_sentimento"),
    )
    return out.join(axes, event, "left").withColumn("eixo_predominante", F.coalesce("eixo", F.lit(DEFAULT_AXIS))).drop("eixo")


def shared_events(summaries: DataFrame) -> DataFrame:
    """Events of two articles or more at two outlets or more."""
    return summaries.where("total_materias >= 2 and total_veiculos >= 2")


def event_profile(articles: DataFrame, event: str = "evento_id", outlet: str = "veiculo_id", kind: str = "tipo", score: str = "score_clickbait", polarity: str = "sentimento_polaridade") -> DataFrame:
    """One row per event: articles of either kind of outlet, polarisation, and unweighted means of the outlets' means."""
    per_outlet = articles.where(F.col(event) >= 0).groupBy(event, outlet, kind).agg(F.count("*").alias("n"), F.avg(score).alias("cb"), F.avg(polarity).alias("pol"))
    t, d = F.sum(F.when(F.col(kind) == "tradicional", F.col("n")).otherwise(0)), F.sum(F.when(F.col(kind) != "tradicional", F.col("n")).otherwise(0))
    out = per_outlet.groupBy(event).agg(t.alias("n_tradicional"), d.alias("n_digital"), F.count("*").alias("n_veiculos"), rounded(F.avg("cb"), 4).alias("clickbait_medio"), rounded(F.avg("pol"), 4).alias("sentimento_medio"))
    return out.withColumn("polarizacao", rounded((F.col("n_digital") - F.col("n_tradicional")) / (F.col("n_digital") + F.col("n_tradicional") + F.lit(1e-5)), 6))
