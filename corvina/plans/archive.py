"""Queries of the news archive, each with the SQL that says the same.

The SQL is written for another engine and by itself, so that agreement means
something; lists of words are shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions import fixed as X
from corvina.functions import text as T
from corvina.functions.rounding import nudged_sql, rounded
from corvina.operators import events as E
from corvina.operators import graph as G
from corvina.operators import statistics as S
from corvina.operators import upserts as U
from corvina.session import hinted
from corvina.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = nudged_sql(sql)
        return f

    return keep


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """materias with kind and code of their outlet and the day they were fetched."""
    outlets = hinted(table(spark, folder, "veiculos").select(F.col("id").alias("v_"), "tipo", "codigo"))
    m = table(spark, folder, "materias")
    return m.join(outlets, m["veiculo_id"] == F.col("v_")).drop("v_").withColumn("data", F.col("criado_em").cast("date"))


ART = "a AS (SELECT m.*, v.tipo, v.codigo, CAST(m.criado_em AT TIME ZONE 'UTC' AS DATE) AS data FROM materias m JOIN veiculos v ON m.veiculo_id = v.id)"


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _sum_contains(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words) + ")"


def _any_contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


# Counts, joins, anti joins


@query("SELECT fonte_coleta, status_extracao, count(*) AS n, count(DISTINCT veiculo_id) AS n_veiculos FROM urls_coletadas GROUP BY ALL")
def queue_status(spark, folder):
    return table(spark, folder, "urls_coletadas").groupBy("fonte_coleta", "status_extracao").agg(F.count("*").alias("n"), F.countDistinct("veiculo_id").alias("n_veiculos"))


@query("SELECT u.id, u.url, v.codigo FROM urls_coletadas u JOIN veiculos v ON u.veiculo_id = v.id WHERE u.status_extracao IN ('pendente', 'erro_download')")
def queue_pending(spark, folder):
    u = table(spark, folder, "urls_coletadas").where(F.col("status_extracao").isin("pendente", "erro_download"))
    v = table(spark, folder, "veiculos").select(F.col("id").alias("veiculo_id"), "codigo")
    return u.join(hinted(v), "veiculo_id").select("id", "url", "codigo")


@query("SELECT m.id FROM materias m WHERE NOT EXISTS (SELECT 1 FROM entidades_mencoes e WHERE e.materia_id = m.id)")
def articles_without_mentions(spark, folder):
    e = table(spark, folder, "entidades_mencoes").select(F.col("materia_id").alias("id"))
    return table(spark, folder, "materias").select("id").join(e, "id", "left_anti")


@query("SELECT id FROM materias WHERE ner_processado = 0 AND length(corpo) >= 150 AND evento_id > -1")
def articles_to_tag(spark, folder):
    return table(spark, folder, "materias").where((F.col("ner_processado") == 0) & (F.length("corpo") >= X.LEAST_BODY) & (F.col("evento_id") > -1)).select("id")


@query("""SELECT v.codigo, (SELECT count(*) FROM urls_coletadas u WHERE u.veiculo_id = v.id) AS n_urls, (SELECT count(*) FROM materias m WHERE m.veiculo_id = v.id) AS n_materias,
    (SELECT count(*) FROM materias m WHERE m.veiculo_id = v.id AND m.evento_id > -1) AS n_em_eventos, (SELECT count(*) FROM materias m JOIN entidades_mencoes e ON e.materia_id = m.id WHERE m.veiculo_id = v.id) AS n_mencoes FROM veiculos v""")
def outlet_report(spark, folder):
    m = table(spark, folder, "materias")
    n_urls = table(spark, folder, "urls_coletadas").groupBy("veiculo_id").agg(F.count("*").alias("n_urls"))
    n_articles = m.groupBy("veiculo_id").agg(F.count("*").alias("n_materias"), F.count_if(F.col("evento_id") > -1).alias("n_em_eventos"))
    n_mentions = table(spark, folder, "entidades_mencoes").join(m.select(F.col("id").alias("materia_id"), "veiculo_id"), "materia_id").groupBy("veiculo_id").agg(F.count("*").alias("n_mencoes"))
    v = table(spark, folder, "veiculos").select(F.col("id").alias("veiculo_id"), "codigo")
    for n in (n_urls, n_articles, n_mentions):
        v = v.join(n, "veiculo_id", "left")
    return v.select("codigo", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_urls", "n_materias", "n_em_eventos", "n_mencoes")])


@query(f"""WITH {ART} SELECT codigo, count(*) AS n, round(avg(score_clickbait), 4) AS clickbait, round(avg(sentimento_polaridade), 4) AS polaridade,
    count(*) FILTER (WHERE sentimento_polaridade > 0.05) AS n_pos, count(*) FILTER (WHERE sentimento_polaridade < -0.05) AS n_neg, count(*) FILTER (WHERE sentimento_polaridade BETWEEN -0.05 AND 0.05) AS n_neu FROM a GROUP BY codigo""")
def outlet_sentiment(spark, folder):
    p = F.col("sentimento_polaridade")
    return articles(spark, folder).groupBy("codigo").agg(F.count("*").alias("n"), rounded(F.avg("score_clickbait"), 4).alias("clickbait"), rounded(F.avg(p), 4).alias("polaridade"), F.count_if(p > 0.05).alias("n_pos"), F.count_if(p < -0.05).alias("n_neg"), F.count_if(p.between(-0.05, 0.05)).alias("n_neu"))


@query(f"WITH {ART} SELECT eixo_tematico, count(*) FILTER (WHERE tipo = 'tradicional') AS tradicional, count(*) FILTER (WHERE tipo <> 'tradicional') AS digital FROM a WHERE eixo_tematico IS NOT NULL AND eixo_tematico <> '' GROUP BY 1")
def axis_by_kind(spark, folder):
    t = F.col("tipo") == "tradicional"
    return articles(spark, folder).where("eixo_tematico is not null and eixo_tematico <> ''").groupBy("eixo_tematico").agg(F.count_if(t).alias("tradicional"), F.count_if(~t).alias("digital"))


@query("SELECT e.tipo_entidade, m.veiculo_id, count(*) AS n, count(DISTINCT e.texto_entidade) AS n_entidades, round(avg(coalesce(e.polaridade_atribuicao, 0)), 4) AS polaridade FROM entidades_mencoes e JOIN materias m ON e.materia_id = m.id WHERE m.evento_id > -1 GROUP BY ALL")
def mentions_by_outlet(spark, folder):
    m = table(spark, folder, "materias").where("evento_id > -1").select(F.col("id").alias("materia_id"), "veiculo_id")
    return table(spark, folder, "entidades_mencoes").join(m, "materia_id").groupBy("tipo_entidade", "veiculo_id").agg(F.count("*").alias("n"), F.countDistinct("texto_entidade").alias("n_entidades"), rounded(F.avg(F.coalesce("polaridade_atribuicao", F.lit(0.0))), 4).alias("polaridade"))


@query("""SELECT materia_id, texto_entidade, tipo_entidade, n FROM (SELECT *, row_number() OVER (PARTITION BY materia_id ORDER BY n DESC, texto_entidade, tipo_entidade) AS r
    FROM (SELECT materia_id, texto_entidade, tipo_entidade, sum(contagem) AS n FROM entidades_mencoes GROUP BY ALL)) WHERE r <= 15""")
def top_entities(spark, folder):
    n = table(spark, folder, "entidades_mencoes").groupBy("materia_id", "texto_entidade", "tipo_entidade").agg(F.sum("contagem").alias("n"))
    r = F.row_number().over(Window.partitionBy("materia_id").orderBy(F.desc("n"), "texto_entidade", "tipo_entidade"))
    return n.withColumn("r", r).where("r <= 15").drop("r")


# Events


@query(f"""WITH {ART}, x AS (SELECT evento_id, eixo_tematico, count(*) AS n FROM a WHERE evento_id >= 0 AND eixo_tematico IS NOT NULL GROUP BY ALL),
    y AS (SELECT evento_id, eixo_tematico FROM (SELECT *, row_number() OVER (PARTITION BY evento_id ORDER BY n DESC, eixo_tematico) AS r FROM x) WHERE r = 1)
    SELECT a.evento_id, first(titulo ORDER BY data, id) AS nome_evento, CAST(min(data) AS VARCHAR) AS data_inicio, CAST(max(data) AS VARCHAR) AS data_fim, count(*) AS total_materias, count(DISTINCT veiculo_id) AS total_veiculos,
    round(stddev_pop(coalesce(sentimento_polaridade, 0)), 4) AS divergencia_sentimento, coalesce(any_value(y.eixo_tematico), 'politico') AS eixo_predominante FROM a LEFT JOIN y ON a.evento_id = y.evento_id WHERE a.evento_id >= 0 GROUP BY a.evento_id""")
def event_summary(spark, folder):
    out = E.event_summaries(articles(spark, folder))
    return out.withColumns({c: F.col(c).cast("string") for c in ("data_inicio", "data_fim")})


@query(f"WITH {ART} SELECT evento_id, count(*) AS n, count(DISTINCT veiculo_id) AS n_veiculos, round(stddev_pop(coalesce(sentimento_polaridade, 0)), 4) AS divergencia FROM a WHERE evento_id >= 0 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT veiculo_id) >= 2")
def shared_event_divergence(spark, folder):
    return E.shared_events(E.event_summaries(articles(spark, folder))).select("evento_id", F.col("total_materias").alias("n"), F.col("total_veiculos").alias("n_veiculos"), F.col("divergencia_sentimento").alias("divergencia"))


@query(f"""WITH {ART}, o AS (SELECT evento_id, veiculo_id, tipo, count(*) AS n, avg(score_clickbait) AS cb, avg(sentimento_polaridade) AS pol FROM a WHERE evento_id >= 0 GROUP BY ALL)
    SELECT evento_id, sum(CASE WHEN tipo = 'tradicional' THEN n ELSE 0 END)::BIGINT AS n_tradicional, sum(CASE WHEN tipo = 'tradicional' THEN 0 ELSE n END)::BIGINT AS n_digital, count(*) AS n_veiculos, round(avg(cb), 4) AS clickbait_medio, round(avg(pol), 4) AS sentimento_medio,
    round((sum(CASE WHEN tipo = 'tradicional' THEN -n ELSE n END)) / (sum(n) + 0.00001::DOUBLE), 6) AS polarizacao FROM o GROUP BY 1""")
def event_profiles(spark, folder):
    return E.event_profile(articles(spark, folder))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT data_inicio AS d FROM clusters_eventos WHERE data_inicio IS NOT NULL),
    w AS (SELECT 1 AS window_id, min(d) AS s FROM d UNION ALL SELECT window_id + 1, (SELECT min(d) FROM d WHERE d > w.s + 5) FROM w WHERE (SELECT min(d) FROM d WHERE d > w.s + 5) IS NOT NULL)
    SELECT window_id, CAST(s AS VARCHAR) AS inicio, CAST(s + 5 AS VARCHAR) AS fim, count(c.id) AS n FROM w LEFT JOIN clusters_eventos c ON c.data_inicio BETWEEN s AND s + 5 GROUP BY ALL""")
def anchored_windows(spark, folder):
    c = table(spark, folder, "clusters_eventos")
    w = E.anchored_windows(c, "data_inicio")
    n = E.with_window(c, w, "data_inicio").groupBy("window_id").agg(F.count("*").alias("n"))
    return w.join(n, "window_id", "left").select("window_id", F.col("start").cast("string").alias("inicio"), F.col("end").cast("string").alias("fim"), F.coalesce("n", F.lit(0)).alias("n"))


MONTHS = "s AS (SELECT strftime(data_inicio, '%Y-%m') AS mes, avg(divergencia_sentimento) AS v, count(*) AS n FROM clusters_eventos WHERE total_materias >= 2 AND data_inicio IS NOT NULL GROUP BY 1)"


def _events(spark, folder):
    return table(spark, folder, "clusters_eventos").where("total_materias >= 2 and data_inicio is not null").withColumn("mes", F.date_format("data_inicio", "yyyy-MM"))


@query("SELECT strftime(data_inicio, '%Y-%m') AS mes, eixo_predominante, count(*) AS n, round(avg(divergencia_sentimento), 4) AS divergencia FROM clusters_eventos WHERE total_materias >= 2 AND data_inicio IS NOT NULL GROUP BY ALL")
def month_axis_divergence(spark, folder):
    return _events(spark, folder).groupBy("mes", "eixo_predominante").agg(F.count("*").alias("n"), rounded(F.avg("divergencia_sentimento"), 4).alias("divergencia"))


@query(f"WITH {MONTHS} SELECT substr(mes, 1, 4) AS ano, round(avg(v), 4) AS divergencia, count(*) AS meses FROM s GROUP BY 1")
def year_divergence(spark, folder):
    by_month = _events(spark, folder).groupBy("mes").agg(F.avg("divergencia_sentimento").alias("v"))
    return by_month.groupBy(F.substring("mes", 1, 4).alias("ano")).agg(rounded(F.avg("v"), 4).alias("divergencia"), F.count("*").alias("meses"))


@query(f"""WITH {MONTHS}, r AS (SELECT mes, round(v, 6) AS v, row_number() OVER (ORDER BY mes) - 1 AS i, count(*) OVER () AS n FROM s),
    c AS (SELECT mes, v, i, n, coalesce(sum(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s1, coalesce(sum(v * v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q1, sum(v) OVER () AS s, sum(v * v) OVER () AS q FROM r),
    e AS (SELECT *, CASE WHEN n >= 24 THEN (q1 - s1 * s1 / nullif(i, 0)) + (q - q1 - (s - s1) * (s - s1) / (n - i)) END AS sse FROM c WHERE n < 24 OR (i >= 12 AND i < n - 12))
    SELECT i::INT AS position, mes AS at, round(s1 / nullif(i, 0), 4) AS before, round((s - s1) / (n - i), 4) AS after, round(sse, 6) AS sse FROM e ORDER BY CASE WHEN n >= 24 THEN sse ELSE -v END, i LIMIT 1""")
def divergence_change_point(spark, folder):
    by_month = _events(spark, folder).groupBy("mes").agg(rounded(F.avg("divergencia_sentimento"), 6).alias("v"))
    return S.change_point(by_month, "mes", "v")


@query(f"WITH {MONTHS} SELECT mes, round(v, 4) AS divergencia, n FROM s ORDER BY round(v, 6) DESC, mes LIMIT 1")
def divergence_peak(spark, folder):
    by_month = _events(spark, folder).groupBy("mes").agg(F.avg("divergencia_sentimento").alias("v"), F.count("*").alias("n"))
    return by_month.orderBy(rounded("v", 6).desc(), "mes").limit(1).select("mes", rounded("v", 4).alias("divergencia"), "n")


@query("""SELECT id, eixo_predominante, total_materias FROM (SELECT *, row_number() OVER (PARTITION BY eixo_predominante ORDER BY total_materias DESC, id) AS r FROM clusters_eventos WHERE total_materias >= 3)
    WHERE r <= CASE eixo_predominante WHEN 'politico' THEN 6000 WHEN 'economico' THEN 4000 WHEN 'social' THEN 3500 WHEN 'internacional' THEN 3000 ELSE 1800 END""")
def macro_events(spark, folder):
    quota = F.when(F.col("eixo_predominante") == "politico", 6000).when(F.col("eixo_predominante") == "economico", 4000).when(F.col("eixo_predominante") == "social", 3500).when(F.col("eixo_predominante") == "internacional", 3000).otherwise(1800)
    r = F.row_number().over(Window.partitionBy("eixo_predominante").orderBy(F.desc("total_materias"), "id"))
    return table(spark, folder, "clusters_eventos").where("total_materias >= 3").withColumn("r", r).where(F.col("r") <= quota).select("id", "eixo_predominante", "total_materias")


# Addresses, titles and bodies

_LOW = "lower(url)"


def _axis_sql(url: str, text: str) -> str:
    low, content = f"lower({url})", f"(lower({url}) || ' ' || lower(coalesce({text}, '')))"
    score = {axis: _sum_contains(content, words) for axis, words in X.AXIS_WORDS.items()}
    best = f"greatest({', '.join(score.values())})"
    case = "CASE " + " ".join(f"WHEN {_any_contains(low, parts)} THEN '{axis}'" for axis, parts in X.AXIS_SEGMENTS.items())
    case += " " + " ".join(f"WHEN {s} = {best} AND {s} > 0 THEN '{axis}'" for axis, s in score.items())
    return case + " " + " ".join(f"WHEN {_any_contains(content, words)} THEN '{axis}'" for axis, words in X.AXIS_LAST.items()) + f" ELSE '{X.DEFAULT_AXIS}' END"


@query(f"SELECT id, {_axis_sql('url', 'titulo')} AS eixo FROM materias")
def topic_axes(spark, folder):
    return table(spark, folder, "materias").select("id", T.topic_axis(F.col("url"), F.col("titulo")).alias("eixo"))


@query(f"""SELECT id, coalesce(url LIKE 'http%' AND NOT {_any_contains(_LOW, X.URL_EXCLUDED)} AND length(url) >= 22
    AND coalesce(TRY_CAST(nullif(regexp_extract(coalesce(data_prevista, ''), '(20[0-9][0-9])', 1), '') AS INT) BETWEEN 2015 AND 2025, true)
    AND coalesce(TRY_CAST(nullif(regexp_extract(lower(url), '[/_-](20[0-9][0-9])([/_.-]|$)', 1), '') AS INT) BETWEEN 2015 AND 2025, true)
    AND {_any_contains(_LOW, [*X.URL_NEWS, *(f'/{y}/' for y in range(2015, 2026))])}, false) AS valida FROM urls_coletadas""")
def url_validity(spark, folder):
    return table(spark, folder, "urls_coletadas").select("id", T.url_ok(F.col("url"), F.col("data_prevista")).alias("valida"))


@query(r"""WITH b AS (SELECT id, regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://', 'https://') AS u FROM urls_coletadas),
    p AS (SELECT id, regexp_replace(split_part(u, '?', 1), '^(https://[^/:]+):(80|443)(/|$)', '\1\3') AS head, list_filter(string_split(CASE WHEN contains(u, '?') THEN u[instr(u, '?') + 1:] ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(amp|ref|utm_[^=]*)(=|$)')) AS kept FROM b)
    SELECT id, CASE WHEN len(kept) > 0 THEN head || '?' || array_to_string(kept, '&') ELSE head END AS url FROM p""")
def canonical_urls(spark, folder):
    return table(spark, folder, "urls_coletadas").select("id", T.canonical_url(F.col("url")).alias("url"))


@query("SELECT id, sha256(lower(trim(titulo)) || '|||' || lower(trim(substr(corpo, 1, 300)))) AS hash FROM materias")
def content_hashes(spark, folder):
    return table(spark, folder, "materias").select("id", T.content_hash(F.col("titulo"), F.col("corpo")).alias("hash"))


_PLAIN = "regexp_replace(lower(strip_accents(titulo)), '[^\\x00-\\x7F]', '', 'g')"


@query(f"""WITH t AS (SELECT id, titulo, length(regexp_replace(titulo, '[^\\p{{L}}]', '', 'g')) AS l, length(regexp_replace(titulo, '[^\\p{{Lu}}]', '', 'g')) AS u, len(regexp_extract_all(titulo, '[!?]+|\\.{{3,}}')) AS runs,
    CAST(regexp_matches(titulo, '(^|[^\\p{{L}}\\p{{N}}_])\\d+($|[^\\p{{L}}\\p{{N}}_])') AS INT) AS number, {' + '.join(f"CAST(regexp_matches({_PLAIN}, '\\b{w}\\b') AS INT)" for w in X.TRIGGERS)} AS triggers FROM materias),
    x AS (SELECT *, CASE WHEN l > 0 THEN u / l ELSE 0 END AS share FROM t)
    SELECT id, round(share, 4) AS upper, runs::INT AS runs, number, triggers, round(greatest(0, least(1, 0.3::DOUBLE * share + 0.25::DOUBLE * least(1.0::DOUBLE, runs / 3) + 0.15::DOUBLE * number + 0.3::DOUBLE * least(1.0::DOUBLE, triggers / 2))), 4) AS score FROM x""")
def clickbait_scores(spark, folder):
    return table(spark, folder, "materias").select("id", T.clickbait(F.col("titulo")).alias("c")).select("id", "c.*")


@query(f"""WITH t AS (SELECT id, {_sum_contains("lower(corpo)", X.POSITIVE)} AS p, {_sum_contains("lower(corpo)", X.NEGATIVE)} AS n FROM materias), x AS (SELECT id, round(p / (p + n + 1.0::DOUBLE), 4) AS pos, round(n / (p + n + 1.0::DOUBLE), 4) AS neg FROM t)
    SELECT id, pos, neg, round(1 - (pos + neg), 4) AS neu, round(pos - neg, 4) AS polarity FROM x""")
def lexicon_sentiments(spark, folder):
    return table(spark, folder, "materias").select("id", T.lexicon_sentiment(F.col("corpo")).alias("s")).select("id", "s.*")


def _terms_sql(column: str) -> str:
    t = f"lower({column})"
    for pattern, term in X.PHRASES:
        t = f"regexp_replace({t}, '{pattern}', '{term}', 'g')"
    return f"list_filter(regexp_split_to_array({t}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '{X.TERM}') AND x NOT IN ({_list(X.STOPWORDS)}))"


@query(f"""WITH t AS (SELECT eixo_predominante AS eixo, unnest({_terms_sql('nome_evento')}) AS term FROM clusters_eventos WHERE total_veiculos >= 2), n AS (SELECT eixo, term, count(*) AS n FROM t GROUP BY ALL)
    SELECT eixo, term, n FROM (SELECT *, row_number() OVER (PARTITION BY eixo ORDER BY n DESC, term) AS r FROM n) WHERE r <= 65""")
def axis_terms(spark, folder):
    return _axis_terms(spark, folder)


def _shared(spark, folder):
    return table(spark, folder, "clusters_eventos").where("total_veiculos >= 2").select("id", F.col("eixo_predominante").alias("eixo"), T.title_terms(F.col("nome_evento")).alias("terms"))


def _axis_terms(spark, folder):
    n = _shared(spark, folder).select("eixo", F.explode("terms").alias("term")).groupBy("eixo", "term").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("eixo").orderBy(F.desc("n"), "term"))
    return n.withColumn("r", r).where("r <= 65").drop("r")


@query(f"""WITH e AS (SELECT id, eixo_predominante AS eixo, {_terms_sql('nome_evento')} AS ts FROM clusters_eventos WHERE total_veiculos >= 2), t AS (SELECT id, eixo, unnest(ts) AS term FROM e), n AS (SELECT eixo, term, count(*) AS n FROM t GROUP BY ALL),
    k AS (SELECT DISTINCT term FROM (SELECT *, row_number() OVER (PARTITION BY eixo ORDER BY n DESC, term) AS r FROM n) WHERE r <= 65), d AS (SELECT DISTINCT id, t.term FROM t JOIN k ON t.term = k.term)
    SELECT x.term AS a, y.term AS b, count(*) AS weight, round(1 / (1 + ln(1 + count(*))), 4) AS distance FROM d x JOIN d y ON x.id = y.id AND x.term < y.term GROUP BY ALL HAVING count(*) >= 4""")
def term_graph(spark, folder):
    return G.term_edges(_shared(spark, folder), "id", "terms", _axis_terms(spark, folder))


# Statistics


@query(f"WITH {ART} SELECT codigo, round(avg(score_clickbait), 4) AS media, round(quantile_cont(score_clickbait, 0.5), 4) AS mediana, round(coalesce(stddev_samp(score_clickbait), 0), 4) AS desvio_padrao, round(min(score_clickbait), 4) AS minimo, round(max(score_clickbait), 4) AS maximo, count(*) AS n FROM a GROUP BY 1")
def clickbait_descriptives(spark, folder):
    return S.descriptives(articles(spark, folder), "score_clickbait", ["codigo"])


_TWO = "g AS (SELECT tipo, count(*) AS n, avg(score_clickbait) AS m, var_samp(score_clickbait) AS v FROM a GROUP BY 1), d AS (SELECT * FROM g WHERE tipo = 'digital_nativo'), t AS (SELECT * FROM g WHERE tipo = 'tradicional')"


@query(f"""WITH {ART}, {_TWO} SELECT round((d.m - t.m) / sqrt(d.v / d.n + t.v / t.n), 4) AS t, round((d.v / d.n + t.v / t.n) ** 2 / ((d.v / d.n) ** 2 / (d.n - 1) + (t.v / t.n) ** 2 / (t.n - 1)), 2) AS dof,
    round((d.m - t.m) / sqrt(((d.n - 1) * d.v + (t.n - 1) * t.v) / (d.n + t.n - 2)), 4) AS cohen_d FROM d, t""")
def clickbait_welch(spark, folder):
    return S.welch(articles(spark, folder), "score_clickbait", "tipo", "digital_nativo", "tradicional").drop("p")


_RANKS = "r AS (SELECT {g} AS g, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2 AS k FROM a)"


@query(f"WITH {ART}, {_RANKS.format(g='tipo', v='score_clickbait')} SELECT sum(k) - count(*) * (count(*) + 1) / 2 AS u, count(*) AS n1, (SELECT count(*) FROM r WHERE g = 'tradicional') AS n2 FROM r WHERE g = 'digital_nativo'")
def clickbait_mann_whitney(spark, folder):
    return S.mann_whitney(articles(spark, folder), "score_clickbait", "tipo", "digital_nativo", "tradicional").select("u", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"))


@query(f"""WITH {ART}, g AS (SELECT codigo, count(*) AS n, avg(sentimento_polaridade) AS m, var_samp(sentimento_polaridade) AS v FROM a GROUP BY 1 HAVING count(*) >= 2), s AS (SELECT sum(n * m) / sum(n) AS mm, count(*) AS k, sum(n) AS nn FROM g)
    SELECT round((sum(n * (m - mm) ** 2) / (any_value(k) - 1)) / (sum((n - 1) * v) / (any_value(nn) - any_value(k))), 4) AS f, any_value(k) - 1 AS d1, (any_value(nn) - any_value(k))::BIGINT AS d2 FROM g, s""")
def sentiment_anova(spark, folder):
    return S.anova(articles(spark, folder), "sentimento_polaridade", "codigo").drop("p")


@query(f"""WITH {ART}, {_RANKS.format(g='codigo', v='sentimento_polaridade')}, g AS (SELECT g, sum(k) AS r, count(*)::DOUBLE AS n FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS ts FROM (SELECT count(*)::DOUBLE AS c FROM a GROUP BY sentimento_polaridade)), n AS (SELECT sum(n) AS n, count(*) AS k FROM g)
    SELECT round((12 / (any_value(n.n) * (any_value(n.n) + 1)) * sum(r * r / g.n) - 3 * (any_value(n.n) + 1)) / (1 - any_value(ts) / (any_value(n.n) ** 3 - any_value(n.n))), 4) AS h, any_value(k) - 1 AS dof FROM g, t, n""")
def sentiment_kruskal(spark, folder):
    return S.kruskal(articles(spark, folder), "sentimento_polaridade", "codigo").drop("p")


@query(f"""WITH {ART}, c AS (SELECT tipo, eixo_tematico AS e, count(*)::DOUBLE AS o FROM a WHERE eixo_tematico IS NOT NULL GROUP BY ALL), r AS (SELECT tipo, sum(o) AS rs FROM c GROUP BY 1), k AS (SELECT e, sum(o) AS cs FROM c GROUP BY 1), t AS (SELECT sum(o) AS t FROM c),
    x AS (SELECT sum((coalesce(o, 0) - rs * cs / t) ** 2 / (rs * cs / t)) AS x, any_value(t) AS t FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.tipo = r.tipo AND c.e = k.e), s AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nk)
    SELECT round(x, 4) AS chi2, (nr - 1) * (nk - 1) AS dof, round(sqrt(x / (t * (least(nr, nk) - 1))), 4) AS cramer_v FROM x, s""")
def axis_chi_square(spark, folder):
    counts = articles(spark, folder).where("eixo_tematico is not null").groupBy("tipo", "eixo_tematico").agg(F.count("*").alias("n"))
    return S.chi_square(counts, "tipo", "eixo_tematico", "n").drop("p")


@query(f"""WITH {ART}, c AS (SELECT eixo_tematico AS axis, count(*) FILTER (WHERE tipo = 'tradicional') AS c1, count(*) FILTER (WHERE tipo = 'digital_nativo') AS c2 FROM a WHERE eixo_tematico IS NOT NULL GROUP BY 1), p AS (SELECT axis, c1 / sum(c1) OVER () AS p1, c2 / sum(c2) OVER () AS p2 FROM c)
    SELECT axis, round(p1, 4) AS share_1, round(p2, 4) AS share_2, round(CASE WHEN p2 > 0 THEN p1 / p2 ELSE 999 END, 3) AS ratio, round(abs(p1 - p2) * log2(1 + abs(p1 - p2) / (least(p1, p2) + 0.001)), 4) AS index_log, round(CASE WHEN p1 + p2 > 0 THEN abs(p1 - p2) / (p1 + p2) ELSE 0 END, 4) AS index_sym FROM p""")
def axis_mute_effect(spark, folder):
    counts = articles(spark, folder).groupBy("eixo_tematico", "tipo").agg(F.count("*").alias("n"))
    return S.mute_effect(counts, "eixo_tematico", "tipo", "n", "tradicional", "digital_nativo")


@query(f"""WITH {ART} SELECT CASE WHEN ano IN (2016, 2018, 2020, 2022, 2024) THEN 1 ELSE 0 END AS eleitoral, count(*) AS n, round(avg(abs(sentimento_polaridade) + 0.5::DOUBLE * score_clickbait), 4) AS media, round(stddev_samp(abs(sentimento_polaridade) + 0.5::DOUBLE * score_clickbait), 4) AS desvio_padrao FROM a GROUP BY 1""")
def election_bias(spark, folder):
    bias = F.abs("sentimento_polaridade") + 0.5 * F.col("score_clickbait")
    return articles(spark, folder).groupBy(F.col("ano").isin(X.ELECTION_YEARS).cast("int").alias("eleitoral")).agg(F.count("*").alias("n"), rounded(F.avg(bias), 4).alias("media"), rounded(F.stddev_samp(bias), 4).alias("desvio_padrao"))


# Marts of the figures


@query(f"""WITH {ART}, n AS (SELECT avg(score_clickbait) AS nacional FROM a), o AS (SELECT codigo, tipo, avg(score_clickbait) AS m, quantile_cont(score_clickbait, 0.5) AS md, quantile_cont(score_clickbait, 0.75) AS p75, quantile_cont(score_clickbait, 0.9) AS p90, stddev_samp(score_clickbait) AS s, count(*) AS total FROM a GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY round(m, 6) DESC, codigo)::INT AS ranking, codigo, tipo, round(m, 4) AS clickbait_medio, round(md, 4) AS mediana, round(p75, 4) AS percentil_75, round(p90, 4) AS percentil_90, round(s, 4) AS desvio_padrao, total, round(nacional, 4) AS media_nacional, round(m - nacional, 4) AS diferenca FROM o, n""")
def mart_clickbait_ranking(spark, folder):
    a, c = articles(spark, folder), F.col("score_clickbait")
    o = a.groupBy("codigo", "tipo").agg(F.avg(c).alias("m"), *[F.percentile(c, F.lit(q)).alias(n) for q, n in ((0.5, "md"), (0.75, "p75"), (0.9, "p90"))], F.stddev_samp(c).alias("s"), F.count("*").alias("total"))
    rank = F.row_number().over(Window.orderBy(rounded("m", 6).desc(), "codigo"))  # one row an outlet
    r4 = lambda x, n: rounded(x, 4).alias(n)
    return o.crossJoin(F.broadcast(a.agg(F.avg(c).alias("nacional")))).select(rank.alias("ranking"), "codigo", "tipo", r4("m", "clickbait_medio"), r4("md", "mediana"), r4("p75", "percentil_75"), r4("p90", "percentil_90"), r4("s", "desvio_padrao"), "total", r4("nacional", "media_nacional"), r4(F.col("m") - F.col("nacional"), "diferenca"))


@query(f"""WITH {ART} SELECT ano * 100 + mes AS ano_mes, count(*) AS volume, round(avg(abs(sentimento_polaridade) + 0.5::DOUBLE * score_clickbait), 4) AS vies_medio, round(avg(score_clickbait), 4) AS clickbait_medio, round(avg(sentimento_polaridade) FILTER (WHERE tipo = 'tradicional'), 4) AS polaridade_tradicional,
    round(avg(sentimento_polaridade) FILTER (WHERE tipo <> 'tradicional'), 4) AS polaridade_digital, round(abs(avg(sentimento_polaridade) FILTER (WHERE tipo = 'tradicional') - avg(sentimento_polaridade) FILTER (WHERE tipo <> 'tradicional')), 4) AS divergencia_absoluta FROM a GROUP BY 1""")
def mart_monthly(spark, folder):
    p, t = F.col("sentimento_polaridade"), F.col("tipo") == "tradicional"
    a, b = F.avg(F.when(t, p)), F.avg(F.when(~t, p))
    return articles(spark, folder).groupBy((F.col("ano") * 100 + F.col("mes")).alias("ano_mes")).agg(F.count("*").alias("volume"), rounded(F.avg(F.abs(p) + 0.5 * F.col("score_clickbait")), 4).alias("vies_medio"), rounded(F.avg("score_clickbait"), 4).alias("clickbait_medio"), rounded(a, 4).alias("polaridade_tradicional"), rounded(b, 4).alias("polaridade_digital"), rounded(F.abs(a - b), 4).alias("divergencia_absoluta"))


@query(f"""WITH {ART}, t AS (SELECT tipo, eixo_tematico AS eixo, CASE WHEN sentimento_polaridade > 0.05 THEN 'positivo' WHEN sentimento_polaridade < -0.05 THEN 'negativo' ELSE 'neutro' END AS tom FROM a WHERE eixo_tematico IN ({_list(X.AXES)})), c AS (SELECT tipo, eixo, tom, count(*) AS volume FROM t GROUP BY ALL)
    SELECT *, round(100 * volume / sum(volume) OVER (PARTITION BY tipo), 2) AS proporcao FROM c""")
def mart_sankey(spark, folder):
    p = F.col("sentimento_polaridade")
    tone = F.when(p > 0.05, "positivo").when(p < -0.05, "negativo").otherwise("neutro")
    c = articles(spark, folder).where(F.col("eixo_tematico").isin(X.AXES)).groupBy("tipo", F.col("eixo_tematico").alias("eixo"), tone.alias("tom")).agg(F.count("*").alias("volume"))
    return c.withColumn("proporcao", rounded(100 * F.col("volume") / F.sum("volume").over(Window.partitionBy("tipo")), 2))


@query(f"""WITH {ART}, g AS (SELECT veiculo_id, least(greatest(round((sentimento_polaridade + 0.788) / (1.576::DOUBLE / 64), 0), 0), 64)::INT AS ponto FROM a), c AS (SELECT veiculo_id, ponto, count(*) AS n FROM g GROUP BY ALL)
    SELECT v.id AS veiculo_id, p.ponto::INT AS ponto, round(-0.788::DOUBLE + p.ponto * 1.576::DOUBLE / 64, 4) AS polaridade, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY v.id) / (1.576::DOUBLE / 64), 4) AS densidade FROM (SELECT DISTINCT veiculo_id AS id FROM a) v CROSS JOIN generate_series(0, 64) p(ponto) LEFT JOIN c ON c.veiculo_id = v.id AND c.ponto = p.ponto""")
def mart_density(spark, folder):
    step = 1.576 / 64
    a = articles(spark, folder)
    point = F.least(F.greatest(rounded((F.col("sentimento_polaridade") + 0.788) / step, 0), F.lit(0.0)), F.lit(64.0)).cast("int")
    c = a.groupBy("veiculo_id", point.alias("ponto")).agg(F.count("*").alias("n"))
    grid = a.select("veiculo_id").distinct().select("veiculo_id", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("ponto"))
    d = grid.join(c, ["veiculo_id", "ponto"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.select("veiculo_id", "ponto", rounded(-0.788 + F.col("ponto") * 1.576 / 64, 4).alias("polaridade"), rounded(F.col("n") / F.sum("n").over(Window.partitionBy("veiculo_id")) / step, 4).alias("densidade"))


@query(f"""WITH {ART}, n AS (SELECT veiculo_id AS v, evento_id AS e, count(*)::DOUBLE AS n FROM a WHERE evento_id >= 0 GROUP BY ALL), l AS (SELECT v, sqrt(sum(n * n)) AS l FROM n GROUP BY 1)
    SELECT x.v AS veiculo_a, y.v AS veiculo_b, round(sum(x.n * y.n) / any_value(p.l * q.l), 4) AS similaridade FROM n x JOIN n y ON x.e = y.e JOIN l p ON p.v = x.v JOIN l q ON q.v = y.v GROUP BY ALL""")
def mart_outlet_similarity(spark, folder):
    n = articles(spark, folder).where("evento_id >= 0").groupBy("veiculo_id", "evento_id").agg(F.count("*").cast("double").alias("n"))
    length = n.groupBy("veiculo_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l"))
    side = lambda x: n.select("evento_id", F.col("veiculo_id").alias(f"veiculo_{x}"), F.col("n").alias(f"n_{x}"))
    norm = lambda x: length.select(F.col("veiculo_id").alias(f"veiculo_{x}"), F.col("l").alias(f"l_{x}"))
    dot = side("a").join(side("b"), "evento_id").groupBy("veiculo_a", "veiculo_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("dot"))
    return dot.join(hinted(norm("a")), "veiculo_a").join(hinted(norm("b")), "veiculo_b").select("veiculo_a", "veiculo_b", rounded(F.col("dot") / (F.col("l_a") * F.col("l_b")), 4).alias("similaridade"))


@query(f"""WITH m AS (SELECT strftime(data_inicio, '%Y-%m') AS mes, eixo_predominante AS e, avg(divergencia_sentimento) AS d FROM clusters_eventos WHERE total_materias >= 2 AND data_inicio IS NOT NULL AND eixo_predominante IN ({_list(X.AXES)}) GROUP BY ALL)
    SELECT mes, round(avg(d), 4) AS geral, {', '.join(f"round(max(d) FILTER (WHERE e = '{x}'), 4) AS {x}" for x in X.AXES)} FROM m GROUP BY 1""")
def mart_divergence_series(spark, folder):
    m = _events(spark, folder).where(F.col("eixo_predominante").isin(X.AXES)).groupBy("mes", "eixo_predominante").agg(F.avg("divergencia_sentimento").alias("d"))
    return m.groupBy("mes").agg(rounded(F.avg("d"), 4).alias("geral"), *[rounded(F.max(F.when(F.col("eixo_predominante") == x, F.col("d"))), 4).alias(x) for x in X.AXES])


# Graphs

_COVER = f"{ART}, n AS (SELECT evento_id AS event, veiculo_id AS outlet, count(*) AS n FROM a WHERE evento_id >= 0 GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event) AS total, count(*) OVER (PARTITION BY event) AS outlets FROM n)"


@query(f"WITH {_COVER} SELECT event, outlet, n, round(0.3::DOUBLE + 1.2::DOUBLE * least(1.0::DOUBLE, n / 15), 3) AS weight, round(1 / (1 + ln(1 + n)), 4) AS distance FROM c WHERE n / (total + 0.00001::DOUBLE) >= 0.08 OR outlets <= 2")
def coverage_graph(spark, folder):
    return G.coverage_edges(articles(spark, folder))


@query("""WITH t AS (SELECT id, row_number() OVER (ORDER BY total_materias DESC, id) - 1 AS p FROM clusters_eventos WHERE total_veiculos >= 2), k AS (SELECT * FROM t WHERE p < 800)
    SELECT x.id AS a, y.id AS b, 0.4::DOUBLE AS weight, 0.65::DOUBLE AS distance FROM k x JOIN k y ON x.p % 2 = 0 AND y.p = x.p + 1""")
def consensus_graph(spark, folder):
    return G.consensus_edges(table(spark, folder, "clusters_eventos").where("total_veiculos >= 2"), "total_materias", "id")


def _graph(spark, folder):
    """Coverage edges with outlets as negative nodes, so that one number names a node."""
    return G.coverage_edges(articles(spark, folder)).select((-F.col("outlet")).alias("a"), F.col("event").alias("b"), "weight", "distance")


@query(f"""WITH {_COVER}, e AS (SELECT event, outlet, round(0.3::DOUBLE + 1.2::DOUBLE * least(1.0::DOUBLE, n / 15), 3) AS w FROM c WHERE n / (total + 0.00001::DOUBLE) >= 0.08 OR outlets <= 2), l AS (SELECT event, arg_min(outlet, (-w, outlet)) AS label FROM e GROUP BY 1),
    x AS (SELECT e.w, e.outlet AS la, l.label AS lb FROM e JOIN l ON e.event = l.event), d AS (SELECT lab, sum(w) AS deg FROM (SELECT la AS lab, w FROM x UNION ALL SELECT lb, w FROM x) GROUP BY 1), i AS (SELECT la AS lab, sum(w) AS w_in FROM x WHERE la = lb GROUP BY 1), s AS (SELECT sum(w) AS w FROM x)
    SELECT round(sum(coalesce(w_in, 0) / s.w - (deg / (2 * s.w)) ** 2), 6) AS modularity FROM d LEFT JOIN i ON d.lab = i.lab CROSS JOIN s""")
def leader_modularity(spark, folder):
    """Modularity where each event belongs to the outlet that covers it most."""
    e = _graph(spark, folder)
    labels = e.groupBy("b").agg(F.min_by("a", F.struct(-F.col("weight"), -F.col("a"))).alias("label")).select(F.col("b").alias("node"), "label").unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    return G.modularity(e, labels)


@query()
def graph_communities(spark, folder):
    e = _graph(spark, folder)
    return G.modularity(e, G.communities(e))


@query()
def outlet_distances(spark, folder):
    e = _graph(spark, folder)
    hubs = e.select(F.col("a").alias("node")).distinct()
    return G.distances(e, hubs).where("node < 0 and source < node").select("source", "node", rounded("distance", 4).alias("distance"), "hops")


@query()
def outlet_segregation(spark, folder):
    e = _graph(spark, folder)
    kinds = table(spark, folder, "veiculos").select((-F.col("id")).alias("node"), F.col("tipo").alias("kind"))
    return G.segregation(G.distances(e, e.select(F.col("a").alias("node")).distinct()), kinds)


@query()
def bridge_events(spark, folder):
    """Events that most shortest ways between outlets pass, with their mart columns."""
    e = _graph(spark, folder)
    b = G.betweenness(e, e.select(F.col("a").alias("node")).distinct()).where("node >= 0")
    c = table(spark, folder, "clusters_eventos").select(F.col("id").alias("node"), F.col("data_inicio").alias("data_evento"), "eixo_predominante", "divergencia_sentimento", "total_materias")
    return b.join(c, "node", "left").select("node", "data_evento", "eixo_predominante", "divergencia_sentimento", F.col("betweenness").alias("score_fato_ponte"), "total_materias")


# State of the queue


@query("""SELECT u.id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS r FROM urls_coletadas WHERE fonte_coleta <> 'cdx') u WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM urls_coletadas o WHERE o.fonte_coleta = 'cdx' AND o.url = u.url)""")
def queue_inserts(spark, folder):
    u = table(spark, folder, "urls_coletadas")
    return U.insert_or_ignore(u.where("fonte_coleta = 'cdx'"), u.where("fonte_coleta <> 'cdx'"), "url", "id").select("id")


@query("""WITH a AS (SELECT *, CASE WHEN url_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY url_id ORDER BY id) END AS r FROM materias), b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS s FROM a WHERE r = 1),
    c AS (SELECT *, row_number() OVER (PARTITION BY hash_conteudo ORDER BY id) AS t FROM b WHERE s = 1) SELECT m.id, CASE WHEN k.id IS NULL THEN 'duplicado' ELSE 'extraido' END AS situacao FROM materias m LEFT JOIN (SELECT id FROM c WHERE t = 1) k ON m.id = k.id""")
def article_admission(spark, folder):
    return U.admit_articles(table(spark, folder, "materias")).select("id", "situacao")


@query(f"SELECT m.id, CASE WHEN u.eixo_tematico IN ({_list(X.AXES)}) AND m.eixo_tematico <> u.eixo_tematico THEN u.eixo_tematico ELSE m.eixo_tematico END AS eixo_tematico FROM materias m LEFT JOIN urls_coletadas u ON m.url_id = u.id")
def axis_restored(spark, folder):
    return U.restore_axis(table(spark, folder, "materias"), table(spark, folder, "urls_coletadas"), X.AXES).select("id", "eixo_tematico")
