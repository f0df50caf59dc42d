"""Queries of the research questions: tests with their p values, cycles, jumps, and the figures' last marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import fixed as X
from corvina.functions.rounding import rounded
from corvina.operators import statistics as S
from corvina.plans.archive import ART, SQL, _events, articles, query

_STEPS = 4000


def _integral(density: str, upper: str) -> str:
    """SQL of the integral of a density of u from 0 to ``upper`` by Simpson's rule."""
    h = f"(({upper})::DOUBLE / {_STEPS})"
    return f"({h} / 3 * list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: (CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('{u}', f'(i * {h})')})))"


def _student_sql(t: str, dof: str) -> str:
    density = f"(exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt({dof} * pi()) * (1 + {{u}} * {{u}} / {dof}) ** (-({dof} + 1) / 2))"
    return f"greatest(0, 1 - 2 * {_integral(density, f'abs({t})')})"


def _chi2_sql(x: str, dof: str) -> str:
    density = f"({{u}} ** ({dof} / 2 - 1) * exp(-{{u}} / 2 - lgamma({dof} / 2)) / 2 ** ({dof} / 2))"
    return f"greatest(0, 1 - {_integral(density, x)})"


def _fisher_sql(f: str, a: str, b: str) -> str:
    density = f"(exp(lgamma(({a} + {b}) / 2) - lgamma({a} / 2) - lgamma({b} / 2) + {a} / 2 * ln({a} / {b}) - ({a} + {b}) / 2 * ln(1 + {a} * {{u}} / {b})) * {{u}} ** ({a} / 2 - 1))"
    return f"greatest(0, 1 - {_integral(density, f)})"


def _normal_sql(z: str) -> str:
    return f"greatest(0, 1 - 2 * {_integral('(exp(-{u} * {u} / 2) / sqrt(2 * pi()))', z)})"


def _moments(value: str, group: str, rows: str) -> str:
    return f"SELECT {group} AS g, count(*)::DOUBLE AS n, avg({value}) AS m, coalesce(var_samp({value}), 0) AS v FROM {rows} GROUP BY 1"


def _welch_sql(first: str, second: str) -> str:
    """SQL over ``g`` (g, n, m, v): t, dof, p and Cohen's d of two groups."""
    return f"""SELECT round(t, 4) AS t, round(dof, 2) AS dof, round({_student_sql('t', 'dof')}, 4) AS p, round(d, 4) AS cohen_d FROM (SELECT (x.m - y.m) / sqrt(x.v / x.n + y.v / y.n) AS t, (x.v / x.n + y.v / y.n) ** 2 / ((x.v / x.n) ** 2 / (x.n - 1) + (y.v / y.n) ** 2 / (y.n - 1)) AS dof,
        (x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)) AS d FROM g x, g y WHERE x.g = {first} AND y.g = {second})"""


_RANKED = "SELECT g, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2 AS k, w FROM w0"


def _rank_sum_sql(first: str, second: str) -> str:
    """SQL over ``w0`` (g, w): U of the first group and its two-sided p, ties corrected."""
    return f"""SELECT u, n1, n2, round({_normal_sql('greatest(0, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ts / ((n1 + n2) * (n1 + n2 - 1)))))')}, 4) AS p FROM (SELECT sum(k) FILTER (WHERE g = {first}) - count(*) FILTER (WHERE g = {first}) * (count(*) FILTER (WHERE g = {first}) + 1) / 2 AS u,
        count(*) FILTER (WHERE g = {first})::DOUBLE AS n1, count(*) FILTER (WHERE g = {second})::DOUBLE AS n2, (SELECT sum(c * c * c - c) FROM (SELECT count(*)::DOUBLE AS c FROM w0 GROUP BY w)) AS ts FROM ({_RANKED}))"""


_ANOVA = f"""SELECT round(f, 4) AS f, round({_fisher_sql('f', 'd1', 'd2')}, 4) AS p FROM (SELECT (sum(n * (m - mm) ** 2) / (any_value(k) - 1)) / (sum((n - 1) * v) / (any_value(nn) - any_value(k))) AS f, (any_value(k) - 1)::DOUBLE AS d1, (any_value(nn) - any_value(k))::DOUBLE AS d2
    FROM (SELECT * FROM g WHERE n >= 2), (SELECT sum(n * m) / sum(n) AS mm, count(*) AS k, sum(n) AS nn FROM g WHERE n >= 2))"""
_KRUSKAL = f"""SELECT round(h, 4) AS h, round({_chi2_sql('h', 'd')}, 4) AS p FROM (SELECT (12 / (any_value(nn) * (any_value(nn) + 1)) * sum(r * r / c) - 3 * (any_value(nn) + 1)) / (1 - any_value(ts) / (any_value(nn) ** 3 - any_value(nn))) AS h, (count(*) - 1)::DOUBLE AS d
    FROM (SELECT g, sum(k) AS r, count(*)::DOUBLE AS c FROM ({_RANKED}) GROUP BY 1), (SELECT count(*)::DOUBLE AS nn FROM w0), (SELECT sum(c * c * c - c) AS ts FROM (SELECT count(*)::DOUBLE AS c FROM w0 GROUP BY w)))"""


@query(f"WITH {ART}, g AS ({_moments('score_clickbait', 'tipo', 'a')}) {_welch_sql(chr(39) + 'digital_nativo' + chr(39), chr(39) + 'tradicional' + chr(39))}")
def clickbait_welch_p(spark, folder):
    return S.welch(articles(spark, folder), "score_clickbait", "tipo", "digital_nativo", "tradicional").withColumn("p", rounded("p", 4))


@query(f"WITH {ART}, w0 AS (SELECT tipo AS g, score_clickbait AS w FROM a WHERE tipo IN ('tradicional', 'digital_nativo')) {_rank_sum_sql(chr(39) + 'digital_nativo' + chr(39), chr(39) + 'tradicional' + chr(39))}")
def clickbait_mann_whitney_p(spark, folder):
    out = S.mann_whitney(articles(spark, folder), "score_clickbait", "tipo", "digital_nativo", "tradicional")
    return out.select("u", F.col("n1").cast("double").alias("n1"), F.col("n2").cast("double").alias("n2"), rounded("p", 4).alias("p"))


@query(f"SELECT chi2, dof, cramer_v, round({_chi2_sql('chi2', 'dof::DOUBLE')}, 4) AS p FROM ({SQL['axis_chi_square']})")
def axis_chi_square_p(spark, folder):
    counts = articles(spark, folder).where("eixo_tematico is not null").groupBy("tipo", "eixo_tematico").agg(F.count("*").alias("n"))
    return S.chi_square(counts, "tipo", "eixo_tematico", "n").select("chi2", "dof", "cramer_v", rounded("p", 4).alias("p"))


# First question: how differently outlets tell the same events

_SHARED = f"{ART}, e AS (SELECT evento_id, stddev_pop(coalesce(sentimento_polaridade, 0)) AS s FROM a WHERE evento_id >= 0 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT veiculo_id) >= 2), r AS (SELECT codigo, coalesce(sentimento_polaridade, 0) AS v FROM a JOIN e ON a.evento_id = e.evento_id)"


@query(f"""WITH {_SHARED}, g AS ({_moments('v', 'codigo', 'r')}), w0 AS (SELECT codigo AS g, v AS w FROM r), an AS ({_ANOVA}), kw AS ({_KRUSKAL})
    SELECT (SELECT count(*) FROM e) AS n_eventos, (SELECT round(avg(s), 4) FROM e) AS media, (SELECT round(quantile_cont(s, 0.5), 4) FROM e) AS mediana, (SELECT round(coalesce(stddev_samp(s), 0), 4) FROM e) AS desvio_padrao, an.f, an.p AS p_f, kw.h, kw.p AS p_h,
    CASE WHEN an.p < 0.05 AND kw.p < 0.05 THEN 'os veiculos divergem' WHEN an.p < 0.05 OR kw.p < 0.05 THEN 'indicio de divergencia' ELSE 'sem divergencia' END AS conclusao FROM an, kw""")
def question_divergence(spark, folder):
    """Spread of sentiment inside shared events, and whether outlets differ over their articles."""
    a = articles(spark, folder).withColumn("v", F.coalesce("sentimento_polaridade", F.lit(0.0)))
    e = a.where("evento_id >= 0").groupBy(F.col("evento_id").alias("e_")).agg(F.stddev_pop("v").alias("s"), F.count("*").alias("n"), F.countDistinct("veiculo_id").alias("o")).where("n >= 2 and o >= 2")
    r = a.join(e.select("e_"), a["evento_id"] == F.col("e_"), "left_semi")
    d = S.descriptives(e, "s").select(F.col("n").alias("n_eventos"), "media", "mediana", "desvio_padrao")
    f = S.anova(r, "v", "codigo").select("f", rounded("p", 4).alias("p_f"))
    h = S.kruskal(r, "v", "codigo").select("h", rounded("p", 4).alias("p_h"))
    both, any_ = (F.col("p_f") < 0.05) & (F.col("p_h") < 0.05), (F.col("p_f") < 0.05) | (F.col("p_h") < 0.05)
    return d.crossJoin(f).crossJoin(h).withColumn("conclusao", F.when(both, "os veiculos divergem").when(any_, "indicio de divergencia").otherwise("sem divergencia"))


# Third question: election cycles

_BIAS = f"{ART}, b AS (SELECT ano, CASE WHEN ano IN (2016, 2018, 2020, 2022, 2024) THEN 'sim' ELSE 'nao' END AS g, abs(sentimento_polaridade) + 0.5::DOUBLE * score_clickbait AS w FROM a WHERE sentimento_polaridade IS NOT NULL AND score_clickbait IS NOT NULL)"


@query(f"WITH {_BIAS}, g AS ({_moments('w', 'g', 'b')}), w0 AS (SELECT g, w FROM b), x AS ({_welch_sql(chr(39) + 'sim' + chr(39), chr(39) + 'nao' + chr(39))}), y AS ({_rank_sum_sql(chr(39) + 'sim' + chr(39), chr(39) + 'nao' + chr(39))}) SELECT x.t, x.dof, x.p AS p_t, x.cohen_d, y.u, y.p AS p_u FROM x, y")
def question_elections(spark, folder):
    """Whether the bias index of election years differs from that of other years."""
    b = _bias(spark, folder)
    t = S.welch(b, "bias", "g", "sim", "nao").select("t", "dof", rounded("p", 4).alias("p_t"), "cohen_d")
    return t.crossJoin(S.mann_whitney(b, "bias", "g", "sim", "nao").select("u", rounded("p", 4).alias("p_u")))


def _bias(spark, folder):
    a = articles(spark, folder)
    return a.select("ano", F.when(F.col("ano").isin(X.ELECTION_YEARS), "sim").otherwise("nao").alias("g"), (F.abs("sentimento_polaridade") + 0.5 * F.col("score_clickbait")).alias("bias")).where("bias is not null")


@query(f"WITH {_BIAS} SELECT ano, round(avg(w), 4) AS media, round(quantile_cont(w, 0.5), 4) AS mediana, round(coalesce(stddev_samp(w), 0), 4) AS desvio_padrao, round(min(w), 4) AS minimo, round(max(w), 4) AS maximo, count(*) AS n FROM b GROUP BY 1")
def election_years(spark, folder):
    return S.descriptives(_bias(spark, folder), "bias", ["ano"])


# Fifth question: where polarisation came from

#: Divergence of a year without events, before and after 2019.
_MISSING = {"ambiental": (0.10, 0.14), "social": (0.13, 0.16)}


@query("""WITH m AS (SELECT strftime(data_inicio, '%Y-%m') AS mes, eixo_predominante AS eixo, avg(divergencia_sentimento) AS d FROM clusters_eventos WHERE total_materias >= 2 AND data_inicio IS NOT NULL GROUP BY ALL), y AS (SELECT eixo, CAST(substr(mes, 1, 4) AS INT) AS ano, round(avg(d), 4) AS d FROM m GROUP BY ALL),
    g AS (SELECT e.eixo, a.ano::INT AS ano, CASE WHEN a.ano < 2019 THEN e.antes ELSE e.depois END AS missing FROM (VALUES ('ambiental', 0.10::DOUBLE, 0.14::DOUBLE), ('social', 0.13::DOUBLE, 0.16::DOUBLE)) e(eixo, antes, depois), generate_series(2015, 2022) a(ano)),
    p AS (SELECT g.eixo, avg(coalesce(d, missing)) FILTER (WHERE g.ano < 2019) AS a, avg(coalesce(d, missing)) FILTER (WHERE g.ano >= 2019) AS b FROM g LEFT JOIN y ON y.eixo = g.eixo AND y.ano = g.ano GROUP BY 1)
    SELECT eixo, round(a, 4) AS antes, round(b, 4) AS depois, round((b - a) / (a + 0.000000001::DOUBLE) * 100, 2) AS salto_percentual FROM p""")
def question_origin(spark, folder):
    """How far the divergence of two axes rose from 2015-2018 to 2019-2022, in percent of the first mean."""
    by_month = _events(spark, folder).groupBy("mes", F.col("eixo_predominante").alias("eixo")).agg(F.avg("divergencia_sentimento").alias("d"))
    by_year = by_month.groupBy("eixo", F.substring("mes", 1, 4).cast("int").alias("ano")).agg(rounded(F.avg("d"), 4).alias("d"))
    grid = spark.createDataFrame([(x, y, gone[y >= 2019]) for x, gone in _MISSING.items() for y in range(2015, 2023)], "eixo string, ano int, missing double")
    filled = grid.join(by_year, ["eixo", "ano"], "left").withColumn("d", F.coalesce("d", "missing"))
    mean = lambda late: F.avg(F.when((F.col("ano") >= 2019) == late, F.col("d")))
    jump = filled.groupBy("eixo").agg(mean(False).alias("a"), mean(True).alias("b"))
    return jump.select("eixo", rounded("a", 4).alias("antes"), rounded("b", 4).alias("depois"), rounded((F.col("b") - F.col("a")) / (F.col("a") + 1e-9) * 100, 2).alias("salto_percentual"))


# Marts of the figures

#: Points of percentage beyond which an axis is over- or under-represented.
_POINTS = 5.0


@query(f"""SELECT axis AS eixo, round(100 * share_1, 2) AS proporcao_tradicional, round(100 * share_2, 2) AS proporcao_digital, round(100 * (share_2 - share_1), 2) AS diferenca_pontos, ratio AS razao, index_sym AS indice,
    CASE WHEN 100 * (share_2 - share_1) > {_POINTS} THEN 'Super-representado nos Digitais' WHEN 100 * (share_2 - share_1) < -{_POINTS} THEN 'Sub-representado nos Digitais' ELSE 'Cobertura Equilibrada entre Grupos' END AS status_cobertura FROM ({SQL['axis_mute_effect']})""")
def mart_mute_slope(spark, folder):
    """Share of each axis in either kind of outlet, their difference and what it says."""
    counts = articles(spark, folder).groupBy("eixo_tematico", "tipo").agg(F.count("*").alias("n"))
    m = S.mute_effect(counts, "eixo_tematico", "tipo", "n", "tradicional", "digital_nativo")
    points = 100 * (F.col("share_2") - F.col("share_1"))
    status = F.when(points > _POINTS, "Super-representado nos Digitais").when(points < -_POINTS, "Sub-representado nos Digitais").otherwise("Cobertura Equilibrada entre Grupos")
    return m.select(F.col("axis").alias("eixo"), rounded(100 * F.col("share_1"), 2).alias("proporcao_tradicional"), rounded(100 * F.col("share_2"), 2).alias("proporcao_digital"), rounded(points, 2).alias("diferenca_pontos"), F.col("ratio").alias("razao"), F.col("index_sym").alias("indice"), status.alias("status_cobertura"))


# What happened in some months.
MILESTONES = {"2016-08": "Votação do Impeachment de Dilma no Senado", "2018-04": "Prisão do ex-presidente Lula na Lava Jato", "2018-10": "Eleição Presidencial de 2018", "2019-08": "Crise das Queimadas e Amazônia", "2020-03": "Início da Pandemia de Covid-19 e Conflitos Sanitários", "2022-10": "Eleição Presidencial de 2022", "2023-01": "Atos de 8 de Janeiro em Brasília"}


@query(f"SELECT *, CASE mes {' '.join(f'''WHEN '{m}' THEN '{t}' ''' for m, t in MILESTONES.items())} END AS marco_historico FROM ({SQL['mart_divergence_series']})")
def mart_divergence_milestones(spark, folder):
    from corvina.plans.archive import mart_divergence_series

    marks = F.create_map(*[F.lit(x) for pair in MILESTONES.items() for x in pair])
    return mart_divergence_series(spark, folder).withColumn("marco_historico", F.try_element_at(marks, F.col("mes")))


