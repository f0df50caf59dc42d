"""Queries over terms, vectors, mentions and the graph of outlets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvina.functions import fixed as X
from corvina.functions import text as T
from corvina.functions import vectors as V
from corvina.functions.rounding import rounded
from corvina.operators import events as E
from corvina.operators import graph as G
from corvina.plans.archive import _COVER, SQL, _any_contains, _graph, _sum_contains, _terms_sql, query
from corvina.tables import table

# Terms of shared events


@query(f"""WITH t AS (SELECT unnest({_terms_sql('nome_evento')}) AS term, eixo_predominante AS eixo, divergencia_sentimento AS d, row_number() OVER (ORDER BY total_materias DESC, id) AS p FROM clusters_eventos WHERE total_veiculos >= 2 QUALIFY p <= 60000)
    SELECT term, count(*) AS n, round(avg(d), 4) AS divergencia, arg_max(eixo, p) AS ultimo_eixo FROM t GROUP BY 1""")
def term_stats(spark, folder):
    """Each term of the 60,000 largest shared events: how often, mean divergence, and the axis of the smallest event that has it."""
    c = table(spark, folder, "clusters_eventos").where("total_veiculos >= 2").select("id", "nome_evento", F.col("eixo_predominante").alias("eixo"), F.col("divergencia_sentimento").alias("d"), "total_materias")
    top = c.orderBy(F.desc("total_materias"), "id").limit(60_000)
    terms = top.select("id", "eixo", "d", "total_materias", F.explode(T.title_terms(F.col("nome_evento"))).alias("term"))
    last = F.max_by("eixo", F.struct(-F.col("total_materias"), "id"))
    return terms.groupBy("term").agg(F.count("*").alias("n"), rounded(F.avg("d"), 4).alias("divergencia"), last.alias("ultimo_eixo"))


@query(f"SELECT term, sum(weight)::BIGINT AS grau FROM (SELECT a AS term, weight FROM ({SQL['term_graph']}) UNION ALL SELECT b, weight FROM ({SQL['term_graph']})) GROUP BY 1")
def term_degrees(spark, folder):
    from corvina.plans.archive import term_graph

    e = term_graph(spark, folder)
    return e.select(F.explode(F.array("a", "b")).alias("term"), "weight").groupBy("term").agg(F.sum("weight").alias("grau"))


# Events by likeness

_WINDOWS = "d AS (SELECT DISTINCT CAST(criado_em AT TIME ZONE 'UTC' AS DATE) AS d FROM materias), w AS (SELECT 1 AS window_id, min(d) AS s FROM d UNION ALL SELECT window_id + 1, (SELECT min(d) FROM d WHERE d > w.s + 5) FROM w WHERE (SELECT min(d) FROM d WHERE d > w.s + 5) IS NOT NULL)"


def _windowed_terms(spark, folder):
    m = table(spark, folder, "materias").withColumn("dia", F.col("criado_em").cast("date"))
    placed = E.with_window(m, E.anchored_windows(m, "dia"), "dia")
    return placed.select("id", "window_id", F.array_distinct(T.title_terms(F.col("titulo"))).alias("terms"))


@query(f"""WITH RECURSIVE {_WINDOWS}, t AS (SELECT m.id, w.window_id, list_distinct({_terms_sql('titulo')}) AS ts FROM materias m JOIN w ON CAST(m.criado_em AT TIME ZONE 'UTC' AS DATE) BETWEEN w.s AND w.s + 5), x AS (SELECT id, window_id, len(ts) AS n, unnest(ts) AS term FROM t)
    SELECT a.id AS a, b.id AS b, round(count(*) / sqrt(any_value(a.n) * any_value(b.n)), 4) AS semelhanca FROM x a JOIN x b ON a.window_id = b.window_id AND a.term = b.term AND a.id < b.id GROUP BY ALL HAVING count(*) / sqrt(any_value(a.n) * any_value(b.n)) >= 0.65 - 1e-9""")
def event_similarity(spark, folder):
    """Pairs of articles of one window whose titles' term vectors have a cosine of 0.65 or more."""
    return E.similar_pairs(_windowed_terms(spark, folder), "id", "window_id", "terms", 0.65).select("a", "b", rounded("cosine", 4).alias("semelhanca"))


@query()
def event_components(spark, folder):
    """Articles of one window grouped by chains of titles at the radius of the density groups, however large the window."""
    pairs = E.similar_pairs(_windowed_terms(spark, folder), "id", "window_id", "terms", 1 - 0.35**2 / 2)
    return G.components(pairs.select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("grupo"))


# Vectors

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt({_DOT.format(a='e', b='e')})) AS v FROM u), p AS (SELECT label, i, avg(v[i]) AS m FROM n, (SELECT unnest(range(1, (SELECT max(len(v)) FROM n) + 1)) AS i) GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY i) AS m FROM p GROUP BY 1), cc AS (SELECT label, list_transform(m, lambda x: x / sqrt({_DOT.format(a='m', b='m')})) AS c FROM c), s AS (SELECT n.vec_id, n.label, cc.label AS near, {_DOT.format(a='n.v', b='cc.c')} AS s FROM n, cc)
    SELECT vec_id, any_value(label) AS label, arg_max(near, (round(s, 9), -near)) AS previsto, round(max(s), 4) AS semelhanca FROM s GROUP BY 1""")
def anchor_topics(spark, folder):
    """Vectors by the nearest of their labels' centroids."""
    return V.nearest_anchor(table(spark, folder, "embeddings"), "vec_id", "embedding", "label").select("vec_id", "label", F.col("anchor").alias("previsto"), rounded("similarity", 4).alias("semelhanca"))


@query(f"""SELECT m.id, coalesce(CASE {" ".join(f"WHEN {_any_contains('lower(m.url)', parts)} THEN '{axis}'" for axis, parts in X.AXIS_SEGMENTS.items())} END, 'rotulo ' || t.previsto) AS eixo FROM materias m JOIN ({SQL['anchor_topics']}) t ON m.id = t.vec_id""")
def guarded_topics(spark, folder):
    """The topic of articles that have a vector: what their address names, else the nearest anchor."""
    near = V.nearest_anchor(table(spark, folder, "embeddings"), "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), "anchor")
    m = table(spark, folder, "materias").select("id", "url")
    return m.join(near, "id").select("id", F.coalesce(T.axis_by_address(F.col("url")), F.concat(F.lit("rotulo "), F.col("anchor").cast("string"))).alias("eixo"))


@query()
def vector_events(spark, folder):
    """Articles that have a vector, grouped inside windows of days: leaders in small windows, density groups in larger ones."""
    m = table(spark, folder, "materias").withColumn("dia", F.col("criado_em").cast("date")).select("id", "dia")
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    placed = E.with_window(m.join(e, "id"), E.anchored_windows(m, "dia"), "dia")
    return E.event_groups(placed, "id", "embedding").select(F.col("key").alias("id"), "window", "event_id")


@query("SELECT m.id, e.label, len(e.embedding)::INT AS dimensoes FROM materias m JOIN embeddings e ON m.id = e.vec_id WHERE CAST(m.criado_em AT TIME ZONE 'UTC' AS DATE) BETWEEN DATE '2016-01-01' AND DATE '2020-12-31'")
def window_vectors(spark, folder):
    """Articles of a window of dates with their vectors."""
    m = table(spark, folder, "materias").where(F.col("criado_em").cast("date").between(F.lit("2016-01-01").cast("date"), F.lit("2020-12-31").cast("date"))).select("id")
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", F.size("embedding").alias("dimensoes"))
    return m.join(e, "id")


@query("SELECT vec_id, (4 * len(embedding))::INT AS bytes, round(embedding[1]::DOUBLE, 6) AS primeiro, round(embedding[len(embedding)]::DOUBLE, 6) AS ultimo FROM embeddings")
def vector_blobs(spark, folder):
    """Vectors as little-endian float32 blobs, and read back from them."""
    b = table(spark, folder, "embeddings").select("vec_id", V.to_blob(F.col("embedding").cast("array<float>")).alias("blob"))
    return b.select("vec_id", F.length("blob").alias("bytes"), V.from_blob(F.col("blob")).alias("v")).select("vec_id", "bytes", rounded(F.col("v")[0].cast("double"), 6).alias("primeiro"), rounded(F.element_at("v", -1).cast("double"), 6).alias("ultimo"))


# Mentions

_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_SPAN = 30


@query(rf"""WITH r AS (SELECT e.*, row_number() OVER (PARTITION BY materia_id ORDER BY contagem DESC, id) AS r FROM entidades_mencoes e), t AS (SELECT r.id, r.r, r.tipo_entidade, coalesce(m.sentimento_polaridade, 0) AS pol, regexp_extract_all(lower(m.corpo), '{_TOKEN}') AS tl, regexp_extract_all(lower(r.texto_entidade), '{_TOKEN}') AS et FROM r JOIN materias m ON r.materia_id = m.id),
    p AS (SELECT *, instr(' ' || array_to_string(tl, ' ') || ' ', ' ' || array_to_string(et, ' ') || ' ') AS pos FROM t), k AS (SELECT *, CASE WHEN r <= 3 AND tipo_entidade IN ('PER', 'ORG') AND len(et) > 0 AND pos > 0 THEN length(substr(array_to_string(tl, ' '), 1, pos - 1)) - length(replace(substr(array_to_string(tl, ' '), 1, pos - 1), ' ', '')) END AS before FROM p),
    w AS (SELECT id, pol, CASE WHEN before IS NOT NULL THEN array_to_string(list_slice(tl, greatest(1, before + 1 - {_SPAN}), before + len(et) + {_SPAN}), ' ') END AS txt FROM k), s AS (SELECT id, pol, txt, {_sum_contains('txt', X.POSITIVE)} AS p, {_sum_contains('txt', X.NEGATIVE)} AS n FROM w),
    q AS (SELECT id, pol, txt, round(p / (p + n + 1.0::DOUBLE), 4) AS pp, round(n / (p + n + 1.0::DOUBLE), 4) AS nn FROM s), f AS (SELECT id, CASE WHEN txt IS NULL THEN pol ELSE pp - nn END AS v FROM q) SELECT id, round(v, 4) AS polaridade FROM f""")
def entity_attribution(spark, folder):
    """The polarity of each mention: of the words around its first place in the body, for persons and organisations among an article's first three; else the article's."""
    e = table(spark, folder, "entidades_mencoes")
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("materia_id").orderBy(F.desc("contagem"), "id")))
    spaced = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), 0), " ")
    # Bodies become tokens once, before mentions are joined to them.
    m = table(spark, folder, "materias").select(F.col("id").alias("materia_id"), spaced("corpo").alias("body"), F.coalesce("sentimento_polaridade", F.lit(0.0)).alias("pol"))
    t = ranked.join(m, "materia_id").select("id", "pol", ((F.col("r") <= 3) & F.col("tipo_entidade").isin("PER", "ORG")).alias("asked"), F.concat(F.lit(" "), "body", F.lit(" ")).alias("body"), spaced("texto_entidade").alias("name"))
    t = t.withColumn("at", F.when(F.col("asked") & (F.col("name") != ""), F.position(F.concat(F.lit(" "), "name", F.lit(" ")), F.col("body"))))
    near = F.concat(F.substring_index(F.trim(F.expr("substring(body, 1, at - 1)")), " ", -_SPAN), F.lit(" "), F.expr(f"substring_index(substring(body, at + 1), ' ', size(split(name, ' ')) + {_SPAN})"))
    scored = t.select("id", "pol", F.when(F.col("at") > 0, near).alias("txt")).withColumn("s", T.lexicon_sentiment(F.col("txt")))
    return scored.select("id", rounded(F.when(F.col("txt").isNull(), F.col("pol")).otherwise(F.col("s.polarity")), 4).alias("polaridade"))


# Ways between outlets


@query(f"""WITH RECURSIVE {_COVER}, e AS (SELECT -outlet AS a, event AS b FROM c WHERE n / (total + 0.00001::DOUBLE) >= 0.08 OR outlets <= 2), x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), f AS (SELECT DISTINCT a AS source, a AS node, 0 AS h FROM e UNION SELECT f.source, x.b, f.h + 1 FROM f JOIN x ON x.a = f.node WHERE f.h < 16),
    s AS (SELECT source, node, min(h) AS h FROM f WHERE node < 0 AND source < node GROUP BY ALL) SELECT source, max(h)::INT AS saltos_max, round(avg(h), 4) AS saltos_medio FROM s GROUP BY 1""")
def outlet_hops(spark, folder):
    """Fewest edges from each outlet to the others, at most and on average."""
    e = _graph(spark, folder).withColumn("distance", F.lit(1.0))
    hubs = e.select(F.col("a").alias("node")).distinct()
    d = G.distances(e, hubs).where("node < 0 and source < node")
    return d.groupBy("source").agg(F.max("hops").alias("saltos_max"), rounded(F.avg("hops"), 4).alias("saltos_medio"))
