"""Mixing sources to target shares of tokens.

Texts are counted once each and grouped by the set of sources that hold them.
These patterns, not the texts, enter a min-cost flow: tokens run from each
repetition of a pattern to the sources' quotas, later repetitions costing ever
more.  There are as many patterns as sets of listed sources that share a text.  The flow of each arc is then filled with texts in a seeded order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from corvina.session import hinted, stash

#: Ranges of the seeded order, so that no pattern is summed up in one task.
RANGES = 1_024
# Fixed value: the split pattern of the public byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(texts: DataFrame, text: str, ranks: str) -> DataFrame:
    """``texts`` with n_tokens by the byte-level vocabulary in the file ``ranks``; null texts have 0."""
    schema = StructType([*texts.schema.fields, StructField("n_tokens", LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("counted", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})
        for batch in batches:
            yield batch.assign(n_tokens=[len(coder.encode_ordinary(t)) if t else 0 for t in batch[text]])

    return texts.mapInPandas(count, schema)


class Network:
    """A flow from patterns of texts over sources to their quotas, grown one repetition after the other.

    Costs hang on the repetition alone and do not fall, so the cheapest flow
    comes by filling the quotas as far as the first uses go, then the second,
    and so on: augmenting never gives back what was drawn before.
    """

    def __init__(self, sources: list[str]) -> None:
        self.quota = {s: 0 for s in sources}
        self.drawn = {s: 0 for s in sources}
        self.supply: list[int] = []  # what is left of each (pattern, repetition)
        self.keys: list[tuple] = []
        self.flow: dict[str, dict[int, int]] = {s: {} for s in sources}  # source -> supply number -> tokens
        self.reach: list[list[str]] = []

    def add(self, key: tuple, tokens: int, sources: list[str]) -> None:
        self.keys.append(key), self.supply.append(tokens), self.reach.append(sources)

    def _path(self, start: int) -> list | None:
        """Shortest way from a supply to a source with room, through flows that can be moved."""
        came: dict[str, tuple[str | None, int]] = {s: (None, start) for s in self.reach[start]}
        todo = list(came)
        while todo:
            later = []
            for s in todo:
                if self.drawn[s] < self.quota[s]:
                    steps, at = [], s
                    while True:
                        before, k = came[at]
                        steps.append((before, k, at))
                        if before is None:
                            return steps[::-1]
                        at = before
                for k, n in self.flow[s].items():
                    if n > 0:
                        for t in self.reach[k]:
                            if t not in came:
                                came[t] = (s, k)
                                later.append(t)
            todo = later
        return None

    def fill(self, first: int = 0) -> None:
        """Draws all that the quotas take from the supplies from number ``first`` on."""
        for k in range(first, len(self.supply)):
            while self.supply[k] > 0 and (path := self._path(k)):
                last = path[-1][2]
                push = min([self.supply[k], self.quota[last] - self.drawn[last], *(self.flow[s][j] for s, j, _ in path if s is not None)])
                for s, j, t in path:
                    if s is not None:
                        self.flow[s][j] -= push
                    self.flow[t][j] = self.flow[t].get(j, 0) + push
                self.supply[k] -= push
                self.drawn[last] += push

    def missing(self) -> list[str]:
        """Sources whose quotas can't be met, with those that hold what these could draw: the tight side of the flow."""
        short = {s for s in self.quota if self.drawn[s] < self.quota[s]}
        todo = list(short)
        while todo:
            t = todo.pop()
            for s in self.flow:
                if s not in short and any(n > 0 and t in self.reach[k] for k, n in self.flow[s].items()):
                    short.add(s)
                    todo.append(s)
        return sorted(short)


def min_cost_flow(supply: dict[tuple, int], uses: dict[tuple, list], quota: dict) -> dict[tuple, int]:
    """Tokens on each arc (pattern, repetition, source) that fill the quotas as far as they can, earlier repetitions first.

    ``supply``: tokens of each (pattern, repetition); ``uses``: its sources.
    """
    net = Network(list(quota))
    net.quota = dict(quota)
    for level in sorted({r for _, r in supply}):
        first = len(net.supply)
        for key in sorted(k for k in supply if k[1] == level):
            net.add(key, supply[key], [s for s in uses[key] if s in quota])
        net.fill(first)
    return {(*net.keys[k], s): n for s, flows in net.flow.items() for k, n in flows.items() if n > 0}


def largest_total(supply: dict[tuple, int], uses: dict[tuple, list], target: dict[str, float]) -> int:
    """The greatest total of which every source can have its target share, found by the flow itself.

    From the least that the sources could have alone, the total is lowered to
    what the tight sources can draw together, until all quotas are met.
    """
    if not target:
        return 0
    alone = {s: sum(n for k, n in supply.items() if s in uses[k]) for s in target}
    total = min(int(alone[s] / x) for s, x in target.items())
    while True:
        net = Network(list(target))
        net.quota = {s: int(total * x) for s, x in target.items()}
        for key in sorted(supply):
            net.add(key, supply[key], uses[key])
        net.fill()
        tight = net.missing()
        if not any(net.drawn[s] < net.quota[s] for s in target):
            return total
        held = sum(n for k, n in supply.items() if set(uses[k]) & set(tight))
        total = min(total - 1, int(held / sum(target[s] for s in tight)))


def mix(docs: DataFrame, weights: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", source: str = "source", weight: str = "peso", most: str = "max_repeticoes", total: int | None = None, all_tokens: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((source, peso, target, n_tokens, share, n_documents, most_uses), (key, source, uses)).

    The first table has every listed source, with its weight, the share of
    the total it was to have (weights of sources without usable documents are
    spread over the others), and what it got.  The second has the documents to
    take and how often.  ``total`` is the number of tokens to reach; by
    default the largest at which every source can meet its share with its
    documents used as often as allowed; with ``all_tokens`` as many as the
    listed sources hold, where short sources repeat as often as they may and
    may still fall short of their share.  A text that stands in several rows
    or sources is one text: it is used at most as often as the source allows
    that it is used for.  Sources that aren't listed, null and empty texts and
    null keys are not used; an empty ``docs`` gives shares of 0.
    """
    spark = docs.sparkSession
    listed = weights.select(F.col(source).alias("source"), F.col(weight).cast("double").alias("weight"), F.col(most).cast("int").alias("most")).where("source is not null and weight > 0 and most > 0").dropDuplicates(["source"])
    rows = (
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
        .where("key is not null and text is not null and text <> ''")
        .join(hinted(listed.select("source")), "source", "left_semi")
        .withColumn("tid", F.sha2("text", 256))
    )
    holders = stash(rows.groupBy("tid", "source").agg(F.min("key").alias("key")))
    patterns = holders.groupBy("tid").agg(F.array_join(F.sort_array(F.collect_set("source")), "\n").alias("pattern"), F.min("key").alias("key"))
    counted = token_counts(rows.join(patterns.select("tid", "key"), ["tid", "key"], "left_semi").select("tid", "text").dropDuplicates(["tid"]), "text", ranks).select("tid", "n_tokens")
    texts = stash(patterns.select("tid", "pattern").join(counted, "tid").where("n_tokens > 0").withColumn("order", F.xxhash64("tid", F.lit(seed))))
    # One row a pattern: the sets of listed sources that share a text, whatever the number of texts.
    supply = {r.pattern: int(r.n) for r in texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()}
    sources = {r.source: (r.weight, r.most) for r in listed.collect()}
    holds = sorted({s for p in supply for s in p.split("\n")})
    whole = sum(sources[s][0] for s in holds)
    target = {s: sources[s][0] / whole for s in holds}
    levels = {(p, r): n for p, n in supply.items() for r in range(1, max(sources[s][1] for s in p.split("\n")) + 1)}
    uses = {(p, r): [s for s in p.split("\n") if sources[s][1] >= r] for p, r in levels}
    aim = total if total is not None else sum(supply.values()) if all_tokens else largest_total(levels, uses, target)
    flow = min_cost_flow(levels, uses, {s: round(aim * x) for s, x in target.items()})
    # Along the seeded order of a pattern, each repetition begins at 0 and hands its stretch from source to source.
    spans, ends = [], {}
    for (p, r, s), n in sorted(flow.items()):
        spans.append((p, r, s, ends.get((p, r), 0), ends.get((p, r), 0) + n))
        ends[p, r] = ends.get((p, r), 0) + n
    stretches = spark.createDataFrame(spans, "pattern string, repetition int, source string, from long, to long")
    ranged = texts.withColumn("range", F.floor((F.col("order") / 2.0**64 + 0.5) * RANGES))
    before = ranged.groupBy("pattern", "range").agg(F.sum("n_tokens").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = Window.partitionBy("pattern", "range").orderBy("order", "tid").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, ["pattern", "range"]).withColumn("at", F.col("ahead") + F.col("in") + F.col("n_tokens") / 2)
    taken = (
        placed.join(hinted(stretches), "pattern").where("at >= from and at < to")
        .groupBy("tid", "source", "n_tokens").agg(F.count("*").alias("uses"))
        .join(holders, ["tid", "source"]).select("key", "source", "uses", "n_tokens")
    )
    taken = stash(taken)
    got = taken.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("uses").alias("most_uses"))
    sums = got.agg(F.sum("n_tokens").alias("all"))
    targets = spark.createDataFrame([(s, w, target.get(s, 0.0)) for s, (w, _) in sources.items()], "source string, peso double, target double")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = targets.join(got, "source", "left").crossJoin(F.broadcast(sums)).select("source", "peso", F.round("target", 6).alias("target"), zero("n_tokens"), F.round(F.coalesce(F.col("n_tokens") / F.col("all"), F.lit(0.0)), 6).alias("share"), zero("n_documents"), zero("most_uses"))
    return report, taken.select(F.col("key").alias(key), "source", "uses")
