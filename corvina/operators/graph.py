"""Graphs of outlets and events, and of terms that stand together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.session import hinted, stash


def coverage_edges(articles: DataFrame, event: str = "evento_id", outlet: str = "veiculo_id", share: float = 0.08) -> DataFrame:
    """(event, outlet, n, weight, distance): which outlets carry an event.

    An outlet with a lesser share of the event is left out, unless the event
    has two outlets at most.
    """
    n = articles.where(F.col(event) >= 0).groupBy(F.col(event).alias("event"), F.col(outlet).alias("outlet")).agg(F.count("*").alias("n"))
    all_ = n.groupBy("event").agg(F.sum("n").alias("total"), F.count("*").alias("outlets"))
    kept = n.join(all_, "event").where((F.col("n") / (F.col("total") + F.lit(1e-5)) >= share) | (F.col("outlets") <= 2))
    return kept.select("event", "outlet", "n", F.round(0.3 + 1.2 * F.least(F.lit(1.0), F.col("n") / 15), 3).alias("weight"), F.round(1 / (1 + F.log1p(F.col("n").cast("double"))), 4).alias("distance"))


def consensus_edges(events: DataFrame, order: str, key: str, most: int = 800) -> DataFrame:
    """(a, b, weight, distance): the first events in ``order``, tied in pairs of neighbours."""
    top = events.select(F.col(key).alias("key"), F.col(order).alias("order")).orderBy(F.desc("order"), "key").limit(most)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("order"), "key")) - 1)
    pairs = placed.groupBy(F.floor(F.col("place") / 2).alias("pair")).agg(F.min_by("key", "place").alias("a"), F.max_by("key", "place").alias("b"))
    return pairs.where("a <> b").select("a", "b", F.lit(0.4).alias("weight"), F.lit(0.65).alias("distance"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of a labelling (node, label) of undirected edges (a, b, weight)."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    e = edges.join(of("a"), "a").join(of("b"), "b")
    inside = e.where("label_a = label_b").groupBy(F.col("label_a").alias("label")).agg(F.sum("weight").alias("w_in"))
    degree = e.select(F.explode(F.array(F.struct(F.col("label_a").alias("label"), "weight"), F.struct(F.col("label_b").alias("label"), "weight"))).alias("x")).groupBy("x.label").agg(F.sum("x.weight").alias("deg"))
    total = F.broadcast(e.agg(F.sum("weight").alias("w")))
    return degree.join(inside, "label", "left").crossJoin(total).agg(F.round(F.sum(F.coalesce("w_in", F.lit(0.0)) / F.col("w") - (F.col("deg") / (2 * F.col("w"))) ** 2), 6).alias("modularity"))


def local_moving(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label): communities by local moving.

    In each round a node hears how much weight ties it to each label next to
    it and what the label's degree takes off, and moves to the best; nodes of
    even and odd hash move in turn, which keeps neighbours from changing places.
    Ties go to the least label.  Every round is written to the shared folder;
    it ends when nothing moves for two rounds, and every state on the way is a
    labelling of its own, so ``rounds`` may end it earlier.
    """
    both = stash(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    degree = stash(both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("deg")))
    total = both.agg(F.sum("weight").alias("w2")).first().w2 or 1.0
    labels, still = degree.select("node", F.col("node").alias("label")), 0
    for r in range(rounds):
        size = labels.join(degree, "node").groupBy("label").agg(F.sum("deg").alias("size"))
        ties = both.join(labels.select(F.col("node").alias("b"), "label"), "b").where("a <> b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("tie"))
        stay = labels.select("node", "label", F.lit(0.0).alias("tie"))
        own = labels.select("node", F.col("label").alias("own"))
        options = ties.unionByName(stay).groupBy("node", "label").agg(F.sum("tie").alias("tie")).join(size, "label").join(degree, "node").join(own, "node")
        gain = F.col("tie") - F.col("deg") * (F.col("size") - F.when(F.col("own") == F.col("label"), F.col("deg")).otherwise(0.0)) / total
        best = options.groupBy("node").agg(F.max_by("label", F.struct(F.round(gain, 12), F.col("own") == F.col("label"), -F.col("label"))).alias("best"), F.first("own").alias("own"))
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        moved = stash(best.select("node", F.when(moves, F.col("best")).otherwise(F.col("own")).alias("label"), (moves & (F.col("best") != F.col("own"))).alias("moved")))
        labels = moved.select("node", "label")
        still = still + 1 if moved.where("moved").isEmpty() else 0
        if still == 2:
            break
    return labels


def communities(edges: DataFrame, levels: int = 20) -> DataFrame:
    """(node, label): communities by local moving, whose communities then move as nodes of their own, until none joins another.

    Ties inside a community stay as a tie of it with itself.  A label is the
    name of one of its nodes.
    """
    labels, level = None, edges.select("a", "b", "weight")
    for _ in range(levels):
        found = stash(local_moving(level))
        labels = found if labels is None else stash(labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label")))
        if found.where("node <> label").isEmpty():
            break
        of = lambda x: found.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))  # noqa: B023, E731
        named = level.join(of("a"), "a").join(of("b"), "b")
        level = stash(named.groupBy(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).agg(F.sum("weight").alias("weight")))
    return labels


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): connected components of links (a, b), named by their least node.

    Minimum labels travel along the links and jump to the label of their label,
    so a chain of n nodes takes about log n rounds; each round is written to
    the shared folder.  It ends when no label changes; more than ``rounds``
    rounds, which no links of fewer than 2 ** 100 nodes need, are an error.
    """
    both = stash(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("heard", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = stash(nearer.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        if labels.where("component <> old").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
    raise RuntimeError(f"labels still change after {rounds} rounds")


def distances(edges: DataFrame, sources: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(source, node, distance, hops): shortest weighted ways from few sources over undirected edges (a, b, distance).

    All sources spread at once; only nodes that came nearer in a round are
    heard in the next.  ``hops`` are the edges of the shortest way.  It ends
    when no way gets shorter; more than ``rounds`` edges on one are an error.
    """
    both = stash(edges.select("a", "b", "distance").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")))
    known = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"), F.lit(0).alias("hops"))
    news = known
    for _ in range(rounds):
        told = news.select("source", F.col("node").alias("a"), F.col("distance").alias("d"), "hops").join(both, "a").select("source", F.col("b").alias("node"), (F.col("d") + F.col("distance")).alias("distance"), (F.col("hops") + 1).alias("hops"))
        best = told.groupBy("source", "node").agg(F.min(F.struct("distance", "hops")).alias("m")).select("source", "node", "m.distance", "m.hops")
        old = known.select("source", "node", F.col("distance").alias("od"), F.col("hops").alias("oh"))
        nearer = stash(best.join(old, ["source", "node"], "left").where("od is null or distance < od - 1e-12").select("source", "node", "distance", "hops"))
        if nearer.isEmpty():
            break
        known = stash(known.join(nearer.select("source", "node"), ["source", "node"], "left_anti").unionByName(nearer))
        news = nearer
    else:
        raise RuntimeError(f"ways of more than {rounds} edges")
    return known


def segregation(ways: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row: mean distances within the first kind, within the others and across, and their ratio."""
    k = lambda x: kinds.select(F.col("node").alias(x), F.col("kind").alias(f"kind_{x}"))
    d = ways.join(k("source"), "source").join(k("node"), "node").where("source < node")
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("distance"))), F.lit(0.0))
    a, b = F.col("kind_source") == "tradicional", F.col("kind_node") == "tradicional"
    m = d.agg(mean(a & b).alias("t"), mean(~a & ~b).alias("d"), mean(a != b).alias("x"))
    return m.select(F.round("t", 4).alias("dentro_tradicional"), F.round("d", 4).alias("dentro_digital"), F.round("x", 4).alias("entre_grupos"), F.round(F.col("x") / (0.5 * (F.col("t") + F.col("d")) + 1e-6), 4).alias("razao_segregacao"))


def betweenness(edges: DataFrame, sources: DataFrame, nodes: int | None = None, rounds: int = 10_000) -> DataFrame:
    """(node, betweenness): how many shortest ways from the sources pass a node.

    Ways are counted outward along edges that lie on a shortest way and
    dependencies are summed up inward, level by level of hops, for all sources
    at once; nothing is gathered in one task.  With fewer sources than nodes
    the sum is scaled up; each way is counted once from either end.
    """
    both = stash(edges.select("a", "b", "distance").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")))
    d = stash(distances(edges, sources, rounds))
    a = d.select("source", F.col("node").alias("a"), F.col("distance").alias("da"))
    b = d.select("source", F.col("node").alias("b"), F.col("distance").alias("db"))
    on = stash(both.join(a, "a").join(b, ["source", "b"]).where("abs(da + distance - db) < 1e-9 and db > da").select("source", "a", "b"))
    # Longest number of edges of a shortest way: nodes settle in the order of their depth.
    depth = d.where("source = node").select("source", "node", F.lit(0).alias("depth"))
    reach, last = depth, 0
    for last in range(1, rounds + 1):
        step = stash(on.join(reach.where(F.col("depth") == last - 1).select("source", F.col("node").alias("a")), ["source", "a"]).select("source", F.col("b").alias("node"), F.lit(last).alias("depth")).distinct())
        if step.isEmpty():
            last -= 1
            break
        reach = stash(reach.unionByName(step))
    else:
        raise RuntimeError(f"ways of more than {rounds} edges")
    depth = stash(reach.groupBy("source", "node").agg(F.max("depth").alias("depth")))
    level = on.join(depth.select("source", F.col("node").alias("b"), "depth"), ["source", "b"])
    paths = depth.where("depth = 0").select("source", "node", F.lit(1.0).alias("ways"))
    for k in range(1, last + 1):
        step = level.where(F.col("depth") == k).join(paths.select("source", F.col("node").alias("a"), "ways"), ["source", "a"]).groupBy("source", F.col("b").alias("node")).agg(F.sum("ways").alias("ways"))
        paths = stash(paths.unionByName(step))
    ways = lambda x: paths.select("source", F.col("node").alias(x), F.col("ways").alias(f"ways_{x}"))
    tied = stash(level.join(ways("a"), ["source", "a"]).join(ways("b"), ["source", "b"]))
    due = paths.select("source", "node", F.lit(0.0).alias("due")).where("false")
    for k in range(last, 0, -1):
        step = tied.where(F.col("depth") == k).join(due.select("source", F.col("node").alias("b"), "due"), ["source", "b"], "left").select("source", F.col("a").alias("node"), (F.col("ways_a") / F.col("ways_b") * (1 + F.coalesce("due", F.lit(0.0)))).alias("due"))
        due = stash(due.unionByName(step).groupBy("source", "node").agg(F.sum("due").alias("due")))
    n_sources = sources.count()
    scale = (nodes / n_sources if nodes else 1.0) / 2
    return due.where("source <> node").groupBy("node").agg(F.round(F.sum("due") * F.lit(float(scale)), 6).alias("betweenness"))


def term_edges(events: DataFrame, key: str, terms: str, kept: DataFrame, least: int = 4) -> DataFrame:
    """(a, b, weight, distance): kept terms that stand in the same title at least ``least`` times; a before b."""
    words = events.select(F.col(key).alias("key"), F.explode(F.array_distinct(terms)).alias("term")).join(hinted(kept.select("term").distinct()), "term", "left_semi")
    listed = words.groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("ts"))
    pairs = listed.select(F.explode(F.expr("flatten(transform(sequence(1, greatest(size(ts), 1)), i -> transform(slice(ts, i + 1, size(ts)), y -> struct(ts[i - 1] as a, y as b))))")).alias("p")).select("p.a", "p.b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least).withColumn("distance", F.round(1 / (1 + F.log1p(F.col("weight").cast("double"))), 4))
