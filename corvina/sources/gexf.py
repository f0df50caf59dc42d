"""Graphs as GEXF documents and as tables: written and read by Spark, one XML element a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _safe(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&quot;", '"'), "&lt;", "<"), "&amp;", "&")


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) in document order, from nodes (node, label, attributes ...) and edges (a, b, weight); for ``df.write.text``."""
    spark = nodes.sparkSession
    text = lambda k, s: spark.createDataFrame([(k, 0, s)], "k int, o long, line string")
    more = [c for c in nodes.columns if c not in ("node", "label")]
    declared = "".join(f'<attribute id="{i}" title="{c}" type="string"/>' for i, c in enumerate(more))
    values = F.concat(F.lit(""), *[F.coalesce(F.concat(F.lit(f'<attvalue for="{i}" value="'), _safe(F.col(c)), F.lit('"/>')), F.lit("")) for i, c in enumerate(more)])
    inner = F.when(values != "", F.concat(F.lit("><attvalues>"), values, F.lit("</attvalues></node>"))).otherwise("/>")
    n = nodes.select(F.lit(1).alias("k"), F.col("node").cast("long").alias("o"), F.concat(F.lit('<node id="'), F.col("node").cast("string"), F.lit('" label="'), _safe(F.col("label")), F.lit('"'), inner).alias("line"))
    e = edges.select(F.lit(3).alias("k"), F.xxhash64("a", "b").alias("o"), F.format_string('<edge source="%s" target="%s" weight="%s"/>', F.col("a").cast("string"), F.col("b").cast("string"), F.col("weight").cast("string")).alias("line"))
    attributes = f'<attributes class="node">{declared}</attributes>' if more else ""
    head, middle, tail = text(0, f'<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected">{attributes}<nodes>'), text(2, "</nodes><edges>"), text(4, "</edges></graph></gexf>")
    return head.unionByName(n).unionByName(middle).unionByName(e).unionByName(tail).orderBy("k", "o").select("line")


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(node, label, attributes), (a, b, weight) of documents with one element a line, as :func:`gexf_lines` writes them; weight 1 where none is given."""
    lines = spark.read.text(path)
    get = lambda c, name: F.regexp_extract(c, rf'\b{name}="([^"]*)"', 1)
    titles = lines.where(F.col("value").contains("<attribute ")).select(F.explode(F.regexp_extract_all("value", F.lit(r"(<attribute [^>]*>)"), F.lit(1))).alias("t"))
    names = F.broadcast(titles.select(get(F.col("t"), "id").alias("id"), get(F.col("t"), "title").alias("title")).agg(F.map_from_entries(F.collect_list(F.struct("id", "title"))).alias("names")))
    n = lines.where(F.trim("value").startswith("<node ")).crossJoin(names)
    pairs = F.transform(F.regexp_extract_all("value", F.lit(r"(<attvalue [^>]*>)"), F.lit(1)), lambda t: F.struct(F.try_element_at("names", get(t, "for")).alias("k"), _plain(get(t, "value")).alias("v")))
    nodes = n.select(get(F.col("value"), "id").alias("node"), _plain(get(F.col("value"), "label")).alias("label"), F.map_from_entries(F.filter(pairs, lambda p: p["k"].isNotNull())).alias("attributes"))
    e = lines.where(F.trim("value").startswith("<edge "))
    edges = e.select(get(F.col("value"), "source").alias("a"), get(F.col("value"), "target").alias("b"), F.coalesce(get(F.col("value"), "weight").try_cast("double"), F.lit(1.0)).alias("weight"))
    return nodes, edges


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, sum of weights, density and mean degree of an undirected graph."""
    n = nodes.agg(F.count("*").alias("n_nos"))
    e = edges.agg(F.count("*").alias("n_arestas"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("peso_total"))
    pairs = F.col("n_nos") * (F.col("n_nos") - 1) / 2
    return n.crossJoin(e).select("n_nos", "n_arestas", F.round("peso_total", 4).alias("peso_total"), F.when(pairs > 0, F.round(F.col("n_arestas") / pairs, 6)).otherwise(0.0).alias("densidade"), F.when(F.col("n_nos") > 0, F.round(2 * F.col("n_arestas") / F.col("n_nos"), 4)).otherwise(0.0).alias("grau_medio"))
