"""Queries of the archive's upkeep: selections, state changes, dates, features and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import fixed as X
from corvina.functions import text as T
from corvina.functions.rounding import rounded
from corvina.operators import events as E
from corvina.operators import results as R
from corvina.operators import selectors as Q
from corvina.operators import upserts as U
from corvina.plans.archive import ART, SQL, _any_contains, _list, articles, query
from corvina.session import hinted
from corvina.tables import table

# Selections

_DIGITAL = "(tipo = 'digital_nativo' OR contains(lower(codigo), 'jornal') OR contains(lower(nome), 'jornal'))"


@query(f"SELECT id, codigo FROM veiculos WHERE {_DIGITAL}")
def outlets_selected(spark, folder):
    """A group by its name together with outlets by a part of theirs."""
    return Q.select_outlets(table(spark, folder, "veiculos"), "Digitais, jornal").select("id", "codigo")


@query(f"SELECT u.id, u.url, v.codigo FROM urls_coletadas u JOIN veiculos v ON u.veiculo_id = v.id WHERE u.status_extracao = 'pendente' AND {_DIGITAL} ORDER BY u.id LIMIT 250")
def queue_next(spark, folder):
    """The next page of the queue: 250 pending addresses of the chosen outlets, oldest first."""
    v = Q.select_outlets(table(spark, folder, "veiculos"), "Digitais, jornal").select(F.col("id").alias("veiculo_id"), "codigo")
    u = table(spark, folder, "urls_coletadas").where("status_extracao = 'pendente'")
    return u.join(hinted(v), "veiculo_id").select("id", "url", "codigo").orderBy("id").limit(250)


@query("SELECT id, ano FROM materias WHERE ano BETWEEN 2016 AND 2018 OR ano = 2022")
def articles_of_years(spark, folder):
    return table(spark, folder, "materias").where(Q.in_years(F.col("ano"), "2016-2018, 2022")).select("id", "ano")


@query("SELECT id, data_inicio::VARCHAR AS data_inicio FROM clusters_eventos WHERE CAST(data_inicio AS VARCHAR) BETWEEN '2018-08-01' AND '2018-10-31'")
def events_in_window(spark, folder):
    """Events whose first day lies between two days, both included."""
    c = table(spark, folder, "clusters_eventos")
    return c.where(F.col("data_inicio").between(F.lit("2018-08-01").cast("date"), F.lit("2018-10-31").cast("date"))).select("id", F.col("data_inicio").cast("string").alias("data_inicio"))


@query("SELECT id FROM materias WHERE coalesce(score_clickbait, 0) = 0 AND coalesce(sentimento_polaridade, 0) = 0 AND coalesce(sentimento_neu, 0) = 0 AND length(corpo) >= 150")
def articles_to_score(spark, folder):
    none = lambda c: F.coalesce(c, F.lit(0.0)) == 0
    return table(spark, folder, "materias").where(none("score_clickbait") & none("sentimento_polaridade") & none("sentimento_neu") & (F.length("corpo") >= X.LEAST_BODY)).select("id")


@query("SELECT id, coalesce(titulo, '') || '. ' || substr(coalesce(corpo, ''), 1, 300) AS texto, CASE WHEN sentimento_pos = 0 AND sentimento_neg = 0 AND sentimento_neu = 0 THEN 0.0001 ELSE sentimento_neu END AS neu FROM materias")
def sentiment_inputs(spark, folder):
    """What a model would read of each article, and the neutral share with its mark for articles that were read without a result."""
    zero = (F.col("sentimento_pos") == 0) & (F.col("sentimento_neg") == 0) & (F.col("sentimento_neu") == 0)
    return table(spark, folder, "materias").select("id", T.sentiment_input(F.col("titulo"), F.col("corpo")).alias("texto"), F.when(zero, 0.0001).otherwise(F.col("sentimento_neu")).alias("neu"))


# State changes


@query("SELECT id, CASE WHEN id IN (SELECT url_id FROM materias WHERE url_id IS NOT NULL) THEN 'extraido' ELSE status_extracao END AS status_extracao FROM urls_coletadas")
def queue_marked(spark, folder):
    """The queue after the rows that have an article were marked as done."""
    return U.set_status(table(spark, folder, "urls_coletadas"), table(spark, folder, "materias").select("url_id"), "extraido").select("id", "status_extracao")


@query(f"SELECT u.id, CASE WHEN status_extracao = 'erro_download' AND {_DIGITAL} THEN 'pendente' ELSE status_extracao END AS status_extracao FROM urls_coletadas u LEFT JOIN veiculos v ON u.veiculo_id = v.id")
def queue_reset(spark, folder):
    """The queue after failed downloads of the chosen outlets were set back to pending."""
    v = Q.select_outlets(table(spark, folder, "veiculos"), "Digitais, jornal").select(F.col("id").alias("v_"))
    u = table(spark, folder, "urls_coletadas")
    joined = u.join(hinted(v), u["veiculo_id"] == F.col("v_"), "left")
    return U.reset_status(joined, "erro_download", "pendente", F.col("v_").isNotNull()).select("id", "status_extracao")


@query("SELECT id FROM materias WHERE titulo IS NOT NULL AND corpo IS NOT NULL AND length(corpo) >= 150")
def articles_kept(spark, folder):
    """The articles that deleting the invalid and the short ones leaves."""
    return U.sound_articles(table(spark, folder, "materias")).select("id")


@query(f"SELECT s.id, c.score AS score_clickbait, s.polarity AS sentimento_polaridade, s.pos AS sentimento_pos, s.neg AS sentimento_neg, s.neu AS sentimento_neu FROM ({SQL['lexicon_sentiments']}) s JOIN ({SQL['clickbait_scores']}) c ON s.id = c.id")
def features_updated(spark, folder):
    """All articles after their five features were derived anew and written over the old ones."""
    m = table(spark, folder, "materias").select("id", "titulo", "corpo", "score_clickbait", "sentimento_polaridade", "sentimento_pos", "sentimento_neg", "sentimento_neu")
    s, c = T.lexicon_sentiment(F.col("corpo")), T.clickbait(F.col("titulo"))
    new = m.select("id", "titulo", "corpo", c["score"].alias("score_clickbait"), s["polarity"].alias("sentimento_polaridade"), s["pos"].alias("sentimento_pos"), s["neg"].alias("sentimento_neg"), s["neu"].alias("sentimento_neu"))
    return U.upsert(m, new, "id").drop("titulo", "corpo")


@query("SELECT m.id, CASE WHEN EXISTS (SELECT 1 FROM entidades_mencoes e WHERE e.materia_id = m.id) THEN 1 ELSE ner_processado END AS ner_processado FROM materias m")
def ner_flags(spark, folder):
    """Articles flagged as read for names where mentions of them stand."""
    m = table(spark, folder, "materias").select("id", "ner_processado")
    e = table(spark, folder, "entidades_mencoes").select(F.col("materia_id").alias("m_")).distinct()
    return m.join(e, m["id"] == F.col("m_"), "left").select("id", F.when(F.col("m_").isNotNull(), 1).otherwise(F.col("ner_processado")).alias("ner_processado"))


@query("SELECT m.id, CASE WHEN evento_id >= 0 AND (SELECT count(*) FROM materias o WHERE o.evento_id = m.evento_id) >= 2 THEN evento_id ELSE -1 END AS evento_id FROM materias m")
def events_cleared(spark, folder):
    """Articles after events of one article were dissolved."""
    return U.clear_small_events(table(spark, folder, "materias")).select("id", "evento_id")


@query(f"""SELECT id, coalesce(e, CASE {" ".join(f"WHEN {_any_contains('lower(url)', parts)} THEN '{axis}'" for axis, parts in X.AXIS_SEGMENTS.items())} END) AS eixo_tematico
    FROM (SELECT m.id, m.url, CASE WHEN u.eixo_tematico IN ({_list(X.AXES)}) AND m.eixo_tematico <> u.eixo_tematico THEN u.eixo_tematico ELSE m.eixo_tematico END AS e FROM materias m LEFT JOIN urls_coletadas u ON m.url_id = u.id)""")
def axis_repaired(spark, folder):
    """Both steps of the repair: the axis of the address row, then null axes from the address itself."""
    restored = U.restore_axis(table(spark, folder, "materias"), table(spark, folder, "urls_coletadas"), X.AXES)
    return U.fill_axis(restored, T.axis_by_address(F.col("url"))).select("id", "eixo_tematico")


@query("""SELECT e.id, e.texto_entidade FROM entidades_mencoes e WHERE e.materia_id NOT IN (SELECT id FROM materias WHERE evento_id > -1)
    UNION ALL SELECT -m.id AS id, upper(trim(autor)) AS texto_entidade FROM materias m WHERE evento_id > -1 AND autor IS NOT NULL""")
def mentions_replaced(spark, folder):
    """Mentions after those of articles in events gave way to new ones: here the byline of each."""
    m = table(spark, folder, "materias").where("evento_id > -1")
    old = table(spark, folder, "entidades_mencoes").select("id", "materia_id", "texto_entidade")
    new = m.select((-F.col("id")).alias("id"), F.col("id").alias("materia_id"), F.upper(F.trim("autor")).alias("texto_entidade"))
    return U.replace_children(old, new, "materia_id").where("texto_entidade is not null or id > 0").select("id", "texto_entidade")


@query("SELECT vec_id, CASE WHEN label = 0 THEN 99 ELSE label END AS label, len(embedding)::INT AS dimensoes FROM embeddings")
def embeddings_upserted(spark, folder):
    """Vectors after those of one label were computed anew, here under another label."""
    e = table(spark, folder, "embeddings")
    new = e.where("label = 0").withColumn("label", F.lit(99).cast(e.schema["label"].dataType))
    return U.upsert(e, new, "vec_id").select("vec_id", F.col("label").cast("int").alias("label"), F.size("embedding").alias("dimensoes"))


# Dashboards


@query("""SELECT (SELECT count(*) FROM urls_coletadas) AS n_urls, (SELECT count(*) FROM urls_coletadas WHERE status_extracao = 'pendente') AS n_pendentes, (SELECT count(*) FROM materias) AS n_materias, (SELECT count(*) FROM materias WHERE evento_id >= 0) AS n_em_eventos,
    (SELECT count(DISTINCT evento_id) FROM materias WHERE evento_id >= 0) AS n_eventos, (SELECT count(*) FROM entidades_mencoes) AS n_mencoes, (SELECT count(*) FROM materias WHERE ner_processado = 1) AS n_lidas, (SELECT round(avg(score_clickbait), 4) FROM materias) AS clickbait""")
def dashboard_quick(spark, folder):
    """The archive in one row."""
    u = table(spark, folder, "urls_coletadas").agg(F.count("*").alias("n_urls"), F.count_if(F.col("status_extracao") == "pendente").alias("n_pendentes"))
    in_event = F.col("evento_id") >= 0
    m = table(spark, folder, "materias").agg(F.count("*").alias("n_materias"), F.count_if(in_event).alias("n_em_eventos"), F.countDistinct(F.when(in_event, F.col("evento_id"))).alias("n_eventos"), F.count_if(F.col("ner_processado") == 1).alias("n_lidas"), rounded(F.avg("score_clickbait"), 4).alias("clickbait"))
    return u.crossJoin(m).crossJoin(table(spark, folder, "entidades_mencoes").agg(F.count("*").alias("n_mencoes")))


@query("""SELECT v.codigo, u.fonte_coleta, u.status_extracao, count(*) AS n, count(u.eixo_tematico) AS n_com_eixo, count(m.url_id) AS n_extraidas, CAST(min(CAST(u.criado_em AT TIME ZONE 'UTC' AS DATE)) AS VARCHAR) AS primeira, CAST(max(CAST(u.criado_em AT TIME ZONE 'UTC' AS DATE)) AS VARCHAR) AS ultima
    FROM urls_coletadas u JOIN veiculos v ON u.veiculo_id = v.id LEFT JOIN (SELECT DISTINCT url_id FROM materias WHERE url_id IS NOT NULL) m ON m.url_id = u.id GROUP BY ALL""")
def dashboard_full(spark, folder):
    """The queue by outlet, source and status: how many have an axis and an article, and from when to when."""
    u, day = table(spark, folder, "urls_coletadas"), F.col("criado_em").cast("date")
    v = table(spark, folder, "veiculos").select(F.col("id").alias("veiculo_id"), "codigo")
    m = table(spark, folder, "materias").select(F.col("url_id").alias("m_")).where("m_ is not null").distinct()
    joined = u.join(hinted(v), "veiculo_id").join(m, F.col("id") == F.col("m_"), "left")
    return joined.groupBy("codigo", "fonte_coleta", "status_extracao").agg(F.count("*").alias("n"), F.count("eixo_tematico").alias("n_com_eixo"), F.count("m_").alias("n_extraidas"), F.min(day).cast("string").alias("primeira"), F.max(day).cast("string").alias("ultima"))


@query(f"SELECT p.* FROM ({SQL['event_profiles']}) p JOIN ({SQL['macro_events']}) s ON p.evento_id = s.id")
def macro_event_profiles(spark, folder):
    """Profiles of the selected events only: the selection is joined to the articles before anything is counted."""
    from corvina.plans.archive import macro_events

    chosen = macro_events(spark, folder).select(F.col("id").alias("evento_id"))
    return E.event_profile(articles(spark, folder).join(chosen, "evento_id", "left_semi"))


# Dates, texts and labels

_ISO = r"'^\s*(\d{4})-(\d{2})-(\d{2})'"


def _day(text: str, pattern: str) -> str:
    return f"TRY_CAST(regexp_extract({text}, {pattern}, 1) || '-' || regexp_extract({text}, {pattern}, 2) || '-' || regexp_extract({text}, {pattern}, 3) AS DATE)"


@query(rf"""WITH d AS (SELECT id, {_day("coalesce(data_publicacao, '')", _ISO)} AS a, {_day("url", "'/(20[0-9][0-9])/([0-9][0-9])/([0-9][0-9])/'")} AS b, TRY_CAST(regexp_extract(url, '/(20[0-9][0-9])/([0-9][0-9])/', 1) || '-' || regexp_extract(url, '/(20[0-9][0-9])/([0-9][0-9])/', 2) || '-01' AS DATE) AS c,
    TRY_CAST(regexp_extract(substr(coalesce(corpo, ''), 1, 5000), '(?i)(published_time|datePublished)[^0-9]{{0,30}}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 2) AS DATE) AS t, CAST(criado_em AT TIME ZONE 'UTC' AS DATE) AS k FROM materias), e AS (SELECT id, coalesce(a, b, c, t, k) AS d, CASE WHEN a IS NOT NULL THEN 'metadados' WHEN b IS NOT NULL THEN 'url_dia' WHEN c IS NOT NULL THEN 'url_mes' WHEN t IS NOT NULL THEN 'meta' ELSE 'coleta' END AS origem FROM d)
    SELECT id, CAST(d AS VARCHAR) AS data, year(d)::INT AS ano, month(d)::INT AS mes, CASE WHEN year(d) IN (2016, 2018, 2020, 2022, 2024) THEN year(d) END::INT AS ano_eleitoral, origem FROM e WHERE year(d) BETWEEN 2015 AND 2025""")
def article_dates(spark, folder):
    """The day of each article by the first source that has one; articles outside the period are left out."""
    d = table(spark, folder, "materias").select("id", T.article_date(F.col("data_publicacao"), F.col("url"), F.col("corpo"), F.col("criado_em")).alias("d")).select("id", "d.date", "d.origin")
    year = F.year("date")
    return d.where(year.between(X.FIRST_YEAR, X.LAST_YEAR)).select("id", F.col("date").cast("string").alias("data"), year.alias("ano"), F.month("date").alias("mes"), F.when(year.isin(X.ELECTION_YEARS), year).alias("ano_eleitoral"), F.col("origin").alias("origem"))


@query(f"SELECT eixo, term, n, CASE {' '.join(f'''WHEN term = '{k}' THEN '{v}' ''' for k, v in X.TERM_LABELS.items())} ELSE upper(substr(replace(term, '_', ' '), 1, 1)) || lower(substr(replace(term, '_', ' '), 2)) END AS rotulo FROM ({SQL['axis_terms']})")
def term_labels(spark, folder):
    from corvina.plans.archive import _axis_terms

    return _axis_terms(spark, folder).withColumn("rotulo", T.term_label(F.col("term")))


@query()
def plain_titles(spark, folder):
    """Titles with compatibility signs as plain ones."""
    return table(spark, folder, "materias").select("id", T.nfkc(F.col("titulo")).alias("titulo"))


@query("SELECT id, CASE WHEN length(corpo) >= 150 THEN 'corpo' WHEN length(resumo) >= 150 THEN 'resumo' END AS origem, CASE WHEN length(corpo) >= 150 THEN length(corpo) WHEN length(resumo) >= 150 THEN length(resumo) END::INT AS tamanho FROM materias WHERE length(corpo) >= 150 OR length(resumo) >= 150")
def extraction_cascade(spark, folder):
    """The first of several readings of an article that is long enough; articles without one are left out."""
    return R.first_long(table(spark, folder, "materias"), ["corpo", "resumo"], X.LEAST_BODY).select("id", F.col("source").alias("origem"), F.length("text").alias("tamanho"))


# Results


@query(f"""WITH {ART} SELECT 'clickbait_' || tipo AS pergunta, ano::BIGINT AS id, round(avg(score_clickbait), 4) AS valor, count(*) AS n, round(max(score_clickbait), 4) AS maximo FROM a GROUP BY tipo, ano
    QUALIFY row_number() OVER (PARTITION BY tipo ORDER BY ano DESC) = 1""")
def results_latest(spark, folder):
    """The latest result of each question: one result a year is appended with its details in JSON, then read back."""
    by_year = articles(spark, folder).groupBy("tipo", "ano").agg(rounded(F.avg("score_clickbait"), 4).alias("valor"), F.count("*").alias("n"), rounded(F.max("score_clickbait"), 4).alias("maximo"))
    log = R.append_results(None, by_year.select(F.concat(F.lit("clickbait_"), "tipo").alias("pergunta"), F.col("ano").cast("long").alias("id"), "valor", "n", "maximo"), "pergunta", "id", "valor")
    return R.read_details(R.latest_results(log, "pergunta", "id"), "n long, maximo double")
