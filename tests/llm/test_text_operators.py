"""The operators on training text: brute force, held-out accuracy, and hard cases."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvina.llm import boilerplate, leakage, mixture, names, neardup, repeated, residue, spam, text, truncation

COLS = "id long, veiculo_id long, titulo string, corpo string, key string, source long, line string, text string"
PROSE = "O relator {} disse que o parecer de {} será votado em plenário na próxima semana, depois de três audiências sobre o tema."
NAMES = ["Ana Belo", "Caio Lima", "Davi Reis", "Eva Pinto", "Gil Souza", "Hugo Maia", "Iara Nunes", "João Prado"]
TOPICS = ["saneamento", "transporte", "moradia", "energia", "pesca", "turismo", "saúde", "ensino", "clima", "cultura"]


def word(rng, n=6):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def body(rng, n=6):
    return [PROSE.format(rng.choice(NAMES), rng.choice(TOPICS)) + f" O texto {rng.randrange(10**6)} cita {rng.choice(TOPICS)} e {rng.choice(TOPICS)} entre as prioridades." for _ in range(n)]


def frame(spark, rows):
    """Columns with clashing names on top, which no operator may read."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], COLS)


EMPTY = [(1, 1, None, None), (2, None, "", ""), (3, 1, "t", "\n\n \n"), (None, 1, "t", "Fim.")]


def test_line_keys_match_the_pattern_of_digits():
    lines = ["Leia  em 3 MIN:", " 12 - ", "٣٤ teste ١٢.", "ΣΑΣ 12:", "É 😀 12 — “x” 3", "x\u00a01\u2009²³ ½ 5)", "१ um", "\ud800 7", "", "a1b2"]
    want = [text.DIGITS.sub("", "".join(x.lower().split())).rstrip(text.CLOSING) for x in lines]
    assert text.line_keys("\n".join(lines)) == [text.line_keys(x)[0] for x in lines] == list(map(text.line_key, lines)) == want


def test_no_hint_of_residue_is_overlooked():
    lines = [f"{a}{hint}{b}" for hint in (*residue.HINTS, "Internal Server Error", "completar depois") for a in ("", "Um. ", "é", "“", "http\u00a0", "…\u2009", "digite o texto ") for b in ("", " n", "\u00a0página", "é", "4 não", "3—not")]
    lines += [x.upper() for x in lines] + ["uma linha sem nada", "İ", "erro\nerro", "404\npágina"]
    asked = residue.looked(lines)
    assert {x for x in lines if residue._hinted(x.lower())} <= asked and "uma linha sem nada" not in asked


def test_line_keys():
    assert text.line_key("Leia  em 3 MIN:") == text.line_key("leia em 12 min") and text.line_key(" 12 - ") == ""
    assert text.words("Olho-d'Água, É­ TESTE") == ["olho", "d", "agua", "e", "teste"]


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, i % 3 or None, "t", "\n".join(rng.choice([f"Menu {rng.randrange(9)}", "Rodapé", "", "Siga-nos!", f"frase {chr(97 + rng.randrange(26)) * 3}{chr(97 + rng.randrange(26))}"]) for _ in range(8))) for i in range(90)]
    rows += [(7, 1, "t", rows[7][3])] + EMPTY
    n, df = Counter(r[1] for r in rows), Counter()
    for r in rows:
        df.update({(r[1], k) for k in map(text.line_key, (r[3] or "").split("\n")) if k})
    want = sorted((str(r[0]), i) for r in rows for i, x in enumerate((r[3] or "").split("\n"), 1) if (k := text.line_key(x)) and df[r[1], k] >= max(5, 0.05 * n[r[1]]))
    got = repeated.repeated_lines(frame(spark, rows))
    assert sorted((str(r.key), r.linha) for r in got.collect()) == want
    left = repeated.without_lines(frame(spark, rows).where("id = 8"), got, "id", "corpo").first().corpo.split("\n")
    assert len(left) == 8 - sum(w[0] == "8" for w in want)


LINES = "rid long, key long, source long, linhas array<int>, lines array<long>"


def test_blocks_are_the_repeated_stretches(spark):
    docs = [(i, i, 1, [1, 2, 3], [1, 2, 3]) for i in range(6)] + [(9, 9, 1, [1, 2, 3, 4, 5], [2, 3, 4, 77, 3]), (10, 10, None, [1], [1])]
    floor = spark.createDataFrame([(1, 5), (None, 2)], "source long, least long")
    got = {tuple(r.block): r.n_docs for r in repeated.repeated_blocks(repeated.suffix_array(spark.createDataFrame(docs, LINES), floor)).collect()}
    assert got == {(1, 2, 3): 6, (2, 3): 7, (3,): 7}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_blocks_match_brute_force_across_ranges(spark, partitions):
    rng = random.Random(14)
    docs = [(i, i, i % 2, list(range(1, 9)), [rng.choice([1, 2, 3, 4, 100 + i]) for _ in range(8)]) for i in range(60)]
    floor = spark.createDataFrame([(0, 4), (1, 9)], "source long, least long")
    holds = Counter()
    for _, i, src, _, ls in docs:
        holds.update({(src, tuple(ls[a:b])) for a in range(8) for b in range(a + 1, 9) if max(ls[a:b]) < 100})
    enough = {k: n for k, n in holds.items() if n >= (4, 9)[k[0]]}
    want = {k: n for k, n in enough.items() if not any(enough.get((k[0], (*k[1], x))) == n for x in (1, 2, 3, 4))}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.source, tuple(r.block)): r.n_docs for r in repeated.repeated_blocks(repeated.suffix_array(spark.createDataFrame(docs, LINES), floor)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == want


def test_prefix_counts_decide_which_lines_are_repeated(spark):
    # Without the counts of the common prefixes every line that two documents share would stay.
    rows = [(i, 1, "t", f"Menu\ntexto {chr(97 + i // 2)}") for i in range(8)]
    assert sorted((r.key, r.linha) for r in repeated.repeated_lines(frame(spark, rows)).collect()) == [(i, 1) for i in range(8)]


def test_residue(spark):
    page = "\n".join(body(random.Random(2)))
    bad = ["{{titulo}}", page + "\nO <%= nome %> disse", page + "\nTexto texto texto texto.", "Acesso negado. Seu endereço não tem permissão.", "Carregando...", "404 Not Found", page.replace("parecer", "__CAMPO__", 1)]
    good = [page, page + "\n“Pedia para habilitar o JavaScript e travava”, contou a moradora.", page + "\nO edital saiu com a palavra [CIDADE] no lugar do nome da vila.", "- um item\n- outro item\n" + page]
    good += [page + f"\nNa oficina {x}, a professora {x} ensinou a turma a pôr {{{{nome}}}} antes do verbo nas cartas {x}." for x in ("azul", "verde", "clara", "escura")]
    rows = [(i, 1, "Um título", b) for i, b in enumerate(bad + good)] + [(50, 1, "undefined", page), (50, 1, "undefined", page)]
    got = sorted(r.key for r in residue.residue_rows(frame(spark, rows)).collect())
    assert got == [*range(len(bad)), 50]


def test_slots_are_induced_by_alignment(spark):
    rng = random.Random(17)
    fill = lambda x: f"O prefeito {x} disse ontem que a obra fica pronta. " + body(rng, 1)[0]
    rows = [(i, 1 + i % 3, f"Título {word(rng)}", fill(n)) for i, n in enumerate(NAMES)]
    rows += [(100, 1, "Um título", fill("[nome]")), (101, 1, "Um título", fill("____")), (102, 1, "Um título", "A ata diz que o termo [sic] consta do livro antigo. " + body(rng, 1)[0])]
    got = lambda align: sorted(r.key for r in residue.residue_rows(frame(spark, rows), align=align).collect())
    assert got(True) == [100, 101] and got(False) == []


def test_places_are_looked_for_in_blocks(spark):
    docs = spark.createDataFrame([("um dois tres quatro cinco", None), (None, "Um, dois seis sete quatro cinco")], "title string, body string")
    places = spark.createDataFrame([(int(residue.place_hashes(residue._hashes(w.split()), g).view(np.int64)[0]),) for w, g in (("um dois x quatro cinco", 1), ("um dois x y quatro cinco", 2), ("a b c d e", 1))], "place long")
    assert residue.fillings(docs, places, 1).count() == residue.fillings(docs, places).count() == 2


def test_whole_pages_repeated_under_many_titles(spark):
    rng = random.Random(18)
    blank = "O trem das nove não veio e ninguém soube dizer quando vem."
    rows = [(i, 1 + i % 3, f"Título {word(rng)} {word(rng)}", blank) for i in range(6)] + [(50 + i, 1 + i % 3, "O mesmo título", "A ponte nova abriu ontem e a festa durou a noite toda.") for i in range(6)]
    rows += [(90 + i, 1, f"Título {word(rng)}", "\n".join(body(rng, 3))) for i in range(5)]
    assert sorted(r.key for r in residue.residue_rows(frame(spark, rows)).collect()) == list(range(6))


LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur."
DENIED = "Acesso negado. Seu endereço não tem permissão para abrir esta página do portal. Para continuar é preciso habilitar os cookies e fazer nova tentativa. Se você acredita que há um engano, escreva ao responsável pelo portal e informe o número do atendimento que aparece abaixo."


def test_residue_in_long_lines(spark):
    rng = random.Random(12)
    page, joined = "\n".join(body(rng)), " ".join(body(rng, 3))
    tripled = f"{joined} Texto, texto… texto texto."
    bad = [page + "\n" + LOREM, f"{joined} {LOREM}", DENIED, tripled, "Carregando...\n" + "Início • Política • Cultura • " * 12, "Acesso negado.\n" + DENIED]
    good = [joined, f"{joined} A gráfica admitiu que o caderno de domingo saiu com lorem ipsum na capa e no verso.", f"{joined} “Acesso negado. Tente novamente mais tarde”, dizia a tela que a moradora mostrou.", page + "\n" + DENIED.replace("Acesso negado. ", joined)]
    assert min(map(len, (LOREM, DENIED, joined))) > 220
    rows = [(i, 1, "Um título", b) for i, b in enumerate(bad + good)]
    assert sorted(r.key for r in residue.residue_rows(frame(spark, rows)).collect()) == [*range(len(bad))]


@pytest.mark.parametrize("rows", [[], EMPTY])
def test_empty_and_null(spark, rows):
    df = frame(spark, rows)
    assert repeated.repeated_lines(df).count() == 0 and residue.residue_rows(df).count() == 0
    assert truncation.truncated(df).where("cut").count() == 0
    assert neardup.near_duplicates(df)[0].count() == 0 and neardup.near_duplicates(df)[1].count() == 0
    boilerplate.furniture_lines(df).count()
    assert names.same_names(df.withColumn("autor", F.lit(None).cast("string"))).count() == 0
    docs = df.select(F.col("id").alias("doc_id"), F.col("corpo").alias("text"), F.lit("h").alias("source"))
    assert leakage.leaked_items(docs, df.select(F.col("id").alias("item_id"), F.col("titulo").alias("texto"))).count() == 0
    assert spam.spam_pages(docs).where("spam").count() == 0


def pages(rng, n):
    rows, truth = [], {}
    for i in range(n):
        lines = [("Início | Política | Cultura | Assine", 1), ("Usamos cookies para melhorar sua experiência. Ao continuar, você concorda.", 1)]
        lines += [(x, 0) for x in body(rng, 4)]
        lines.insert(4, (f"O que muda no plano de {word(rng)} {word(rng)}", 0))
        lines += [("Últimas de " + rng.choice(TOPICS), 1)] + [(f"{k}. O relator {rng.choice(NAMES)} adiou o plano de {rng.choice(TOPICS)}", 1) for k in (1, 2)]
        lines += [("Tags: " + ", ".join(rng.sample(TOPICS, 3)), 1), (f"© {2000 + i % 20} Gazeta. Todos os direitos reservados.", 1)]
        rows.append((i, 1, "Título", "\n".join(x for x, _ in lines)))
        truth[i] = {k for k, (_, f) in enumerate(lines, 1) if f}
    return rows, truth


def test_furniture_held_out(spark):
    rows, truth = pages(random.Random(5), 120)
    got: dict[int, set] = {}
    for r in boilerplate.furniture_lines(frame(spark, rows), sample_docs=60, trees=5).collect():
        got.setdefault(r.key, set()).add(r.linha)
    hit = sum(len(got.get(i, set()) & t) for i, t in truth.items())
    assert hit / sum(map(len, truth.values())) > 0.95 and hit / sum(map(len, got.values())) > 0.95


def test_furniture_in_words_never_seen(spark):
    """The trees alone decide, from place and repetition: half of the pages' own lines are in no word list."""
    rng, rows, truth = random.Random(20), [], {}
    for i in range(150):
        lines = [("Zum Zam Zim Zem", 1), ("Painel de bordo da casa", 1)] + [(x, 0) for x in body(rng, 4)] + [("Fala com a gente no balcão", 1), (f"Ronda {rng.randrange(99)} da casa", 1), ("Casa das letras do porto velho", 1)]
        rows.append((i, 1, "Título", "\n".join(x for x, _ in lines)))
        truth[i] = {k for k, (_, f) in enumerate(lines, 1) if f}
    got: dict[int, set] = {}
    for r in boilerplate.furniture_lines(frame(spark, rows), sample_docs=60, trees=5).collect():
        got.setdefault(r.key, set()).add(r.linha)
    hit = sum(len(got.get(i, set()) & t) for i, t in truth.items())
    assert hit / sum(map(len, truth.values())) > 0.95 and hit / sum(map(len, got.values())) > 0.95


def test_shares_joined_when_too_many_to_hold(spark):
    rows, _ = pages(random.Random(21), 40)
    df = frame(spark, rows)
    held, joined = boilerplate.known_shares(df, "veiculo_id", "corpo"), boilerplate.known_shares(df, "veiculo_id", "corpo", held=0)
    picked = df.select(F.col("id").alias("key"), F.col("veiculo_id").alias("source"), F.col("titulo").alias("title"), F.col("corpo").alias("body"))
    a = boilerplate.Pages(held).lines(held.beside(picked).toPandas().sort_values("key"))[2]
    b = boilerplate.Pages(joined.held()).lines(joined.beside(picked).toPandas().sort_values("key"))[2]
    assert joined.joined is not None and np.allclose(a, b) and (a[:, 0] > np.log(0.5)).any()


def test_decoding_keeps_blocks_whole():
    doc, block = np.zeros(4, int), np.array([0, 0, 0, 1])
    assert boilerplate.decode(doc, block, np.array([3.0, 2.0, -0.5, -1.0])).tolist() == [True, True, True, False]


def test_truncation(spark):
    rng = random.Random(3)
    full = ["\n".join(body(rng, rng.randrange(3, 9))) for _ in range(160)]
    rows = [(i, 1 + i % 2, "Um título qualquer", b[:700] if i % 2 and len(b) > 700 else b) for i, b in enumerate(full)]
    rows.append((500, 1, "t", full[0][:-40] + ' <a href="/no'))
    cut = {r[0] for r in rows if not r[3].endswith(".")}
    got = {r.key for r in truncation.truncated(frame(spark, rows)).where("cut").collect()}
    assert len(got & cut) / len(cut) > 0.9 and len(got - cut) <= 2
    report = {r.source: r for r in truncation.truncation_report(frame(spark, rows + EMPTY), truncation.truncated(frame(spark, rows))).collect()}
    assert report[2].n_cut > report[1].n_cut and report[1].n_rows == sum(r[1] == 1 for r in rows + EMPTY)


def test_censoring_decides_where_words_may_end(spark):
    rng = random.Random(13)
    ends = ["o texto cita saneamento", "o texto cita transporte", "o texto cita moradia", "o texto cita energia"]
    rows = []
    for i in range(400):
        b = "\n".join(body(rng, rng.randrange(3, 7)))
        # Half of the second source is cut at one length, at words that end sentences elsewhere too; other texts of it lack a full stop at any length.
        end = ends[i % 3]
        text_ = (b + " E " * 900)[: 896 - len(end)] + " " + end if i % 4 == 1 else b + " Por fim, " + end + ("" if i % 8 == 3 else ".")
        rows.append((i, 1 + i % 2, "Um título qualquer", text_))
    with_fits, without = ({r.key for r in truncation.truncated(frame(spark, rows), fits=f).where("cut").collect()} for f in (True, False))
    cut = {r[0] for r in rows if r[0] % 4 == 1}
    # In 200 texts some lengths come together by chance.
    assert len(with_fits & cut) >= 95 > 5 >= len(without) and len(with_fits - cut) <= 25


def test_truncation_marks(spark):
    rng = random.Random(16)
    rows = [(i, 1, "t", "\n".join(body(rng, 4))) for i in range(60)]
    page = rows[0][3][: rows[0][3].rindex("entre")].rstrip()
    rows += [(100, 1, "t", page + " [...]"), (101, 1, "t", page + " [+]"), (102, 1, "t", page + "…"), (103, 1, "t", rows[1][3] + "\n“Ninguém sabe o que vem depois...”"), (104, 1, "t", rows[2][3] + " [...]")]
    got = {r.key for r in truncation.truncated(frame(spark, rows)).where("cut").collect()}
    assert got == {100, 101, 102}


def test_censored_fit_recovers_the_whole():
    rng = np.random.default_rng(4)
    y = np.exp(rng.normal(7, 0.5, 20_000))
    cut = y > 1500
    mu, sigma = truncation.censored_fit(np.minimum(y, 1500), np.ones(len(y)), cut)
    assert mu == pytest.approx(7, abs=0.03) and sigma == pytest.approx(0.5, abs=0.03)


def test_bk_tree_matches_a_scan():
    rng = random.Random(6)
    marks = [rng.getrandbits(256) for _ in range(200)]
    marks += [m ^ (1 << rng.randrange(256)) ^ (1 << rng.randrange(256)) for m in marks[:50]]
    tree = neardup.BKTree()
    for i, m in enumerate(marks):
        tree.add(m, i)
    for r in (0, 2, 100):
        assert sorted(tree.within(marks[0], r)) == [i for i, m in enumerate(marks) if (m ^ marks[0]).bit_count() <= r]


@pytest.mark.parametrize("shard", [400, 3])
def test_near_duplicates_match_brute_force(spark, shard):
    rng = random.Random(7)
    rows = []
    for i in range(40):
        base = " ".join(word(rng) for _ in range(150)).split()
        for k in range(4):
            w = [x if rng.random() > 0.01 * k else word(rng, 8) for x in base]
            rows.append((i * 4 + k, 1, "t", " ".join(w) + "."))
    rows.append((999, 1, "t", rows[0][3].upper()))
    sets = {r[0]: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for r in rows for w in [text.words(r[3])]}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    found = neardup.stash(neardup.article_sets(frame(spark, rows), "id", "veiculo_id", "titulo", "corpo", 5).withColumn("rid", F.monotonically_increasing_id()))
    member, links = neardup.near_links(found, 0.8, shard=shard)
    got = {(r.id_a, r.id_b) for r in neardup.row_pairs(member, links).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def drawn_sets(rng, n, pairs, similarity):
    sets = []
    for _ in range(pairs):
        both = int(np.ceil(2 * n * similarity / (1 + similarity)))
        x = rng.integers(0, 2**32, size=2 * n - both, dtype=np.uint64)
        sets += [np.unique(x[:n]), np.unique(np.r_[x[:both], x[n:]])]
    return sets


@pytest.mark.parametrize("similarity, least", [(0.5, 0.95), (0.54, 0.98), (0.6, 0.99), (0.8, 0.999)])
@pytest.mark.parametrize("n", [600, 150])
def test_recall_by_similarity(spark, n, similarity, least):
    pairs = 600
    sets = drawn_sets(np.random.default_rng(n), n, pairs, similarity)
    minima = neardup.sketches(sets)
    assert np.array_equal(minima[:3], neardup.sketches(sets[:3]))
    rows = pd.DataFrame({"rid": range(len(sets)), "key": range(len(sets)), "n": [len(h) for h in sets], "shingles": [h.astype(np.uint32).view(np.int32).tolist() for h in sets], "print": neardup.fingerprints(minima).tolist(), "bands": neardup.bands(minima).tolist()})
    found = spark.createDataFrame(rows, "rid long, key long, n int, shingles array<int>, print array<long>, bands array<long>")
    got = {(r.a, r.b) for r in neardup.near_links(found, 0.48)[1].collect()}
    # Three deviations of the draw below the stated recall.
    assert got <= {(2 * i, 2 * i + 1) for i in range(pairs)} and len(got) >= (least - 3 * (least * (1 - least) / pairs) ** 0.5) * pairs


def test_hot_shards_are_split_without_loss(spark):
    sets = drawn_sets(np.random.default_rng(3), 200, 150, 0.6)
    minima = neardup.sketches(sets)
    minima[:, ::48] = 7  # one band that all share
    rows = pd.DataFrame({"rid": range(len(sets)), "key": range(len(sets)), "n": [len(h) for h in sets], "shingles": [h.astype(np.uint32).view(np.int32).tolist() for h in sets], "print": neardup.fingerprints(minima).tolist(), "bands": neardup.bands(minima)[:, :1].tolist()})
    found = spark.createDataFrame(rows, "rid long, key long, n int, shingles array<int>, print array<long>, bands array<long>")
    got = {(r.a, r.b) for r in neardup.near_links(found, 0.48, shard=40)[1].collect()}
    assert len(got) >= 0.97 * 150 and got <= {(2 * i, 2 * i + 1) for i in range(150)}


def test_links_do_not_hang_on_the_size_of_a_shard(spark):
    """A pair that shares one band is found however many others share it, at the threshold as well."""
    sets = drawn_sets(np.random.default_rng(4), 200, 2_000, 0.49)
    minima = neardup.sketches(sets)
    minima[:, ::48] = 7  # one band that all share
    rows = pd.DataFrame({"rid": range(len(sets)), "key": range(len(sets)), "n": [len(h) for h in sets], "shingles": [h.astype(np.uint32).view(np.int32).tolist() for h in sets], "print": neardup.fingerprints(minima).tolist(), "bands": neardup.bands(minima)[:, :1].tolist()})
    found = spark.createDataFrame(rows, "rid long, key long, n int, shingles array<int>, print array<long>, bands array<long>")
    got = {shard: {(r.a, r.b) for r in neardup.near_links(found, 0.48, shard=shard)[1].collect()} for shard in (5_000, 400)}
    assert got[400] == got[5_000] <= {(2 * i, 2 * i + 1) for i in range(2_000)} and len(got[400]) >= 0.98 * 2_000


def shuffled_records(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bands_are_not_shuffled_one_by_one(spark):
    sets = drawn_sets(np.random.default_rng(6), 100, 1_000, 0.6)
    minima = neardup.sketches(sets)
    rows = pd.DataFrame({"rid": range(len(sets)), "key": range(len(sets)), "n": [len(h) for h in sets], "shingles": [h.astype(np.uint32).view(np.int32).tolist() for h in sets], "print": neardup.fingerprints(minima).tolist(), "bands": neardup.bands(minima).tolist()})
    found = neardup.stash(spark.createDataFrame(rows, "rid long, key long, n int, shingles array<int>, print array<long>, bands array<long>"))
    before = shuffled_records(spark)
    assert neardup.near_links(found, 0.48)[1].count() >= 0.99 * 1_000
    # The 96,000 bands leave their tasks in pieces; what else moves are rows, candidates and links.
    assert shuffled_records(spark) - before < 48 * len(sets)


@pytest.mark.parametrize("as_bytes", [False, True])
def test_shared_bands_match_brute_force(spark, monkeypatch, as_bytes):
    monkeypatch.setattr(neardup, "BUCKET", 40)
    monkeypatch.setattr(neardup, "DEALT", 100)
    rng = np.random.default_rng(7)
    held = [rng.integers(-(2**63), 2**63, 400)[rng.integers(0, 400, rng.integers(0, 9))] for _ in range(300)]
    held = [np.unique(np.r_[h, np.int64(5)]) if i % 3 else h[:0] for i, h in enumerate(held)]
    want = Counter(int(b) for h in held for b in h)
    rows = [(i, bytearray(h.tobytes()) if as_bytes else h.tolist()) for i, h in enumerate(held)]
    frame_ = spark.createDataFrame(rows, f"rid long, bands {'binary' if as_bytes else 'array<long>'}").repartition(3)
    got = sorted(map(tuple, neardup.shared_bands(frame_, len(rows)).collect()))
    assert got == sorted((int(b), want[int(b)], i) for i, h in enumerate(held) for b in h if want[int(b)] > 1)


@pytest.mark.parametrize("as_bytes", [False, True])
def test_similarities_match_brute_force(spark, as_bytes):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50), dtype=np.uint32) * np.uint32(70_000_003)) for _ in range(60)]
    cell = [bytearray(h.tobytes()) if as_bytes else h.view(np.int32).tolist() for h in sets]
    kind = "binary" if as_bytes else "array<int>"
    pairs = spark.createDataFrame([(a, b, cell[a], cell[b]) for a in range(60) for b in range(a)], f"a long, b long, set_a {kind}, set_b {kind}")
    of = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    want = sorted((a, b, s) for a in range(60) for b in range(a) if (s := of(sets[a], sets[b])) >= 0.3)
    assert sorted(map(tuple, neardup.similarities(pairs, 0.3).collect())) == want and want


def test_windows_of_many_texts_match_one_by_one():
    said = [[], ["a"], "a b".split(), "a b c a b c a b".split(), "d e f g".split(), "b c".split()]
    for width in (1, 3, 9, 40):
        hashes, sizes = neardup.unique_windows(said, width)
        want = [np.unique(text.window_hashes(np.array([text.word_hash(w) for w in s], np.uint64), width).astype(np.uint32)) for s in said]
        assert sizes.tolist() == [len(w) for w in want] and hashes.tolist() == np.concatenate(want).tolist()


@pytest.mark.parametrize("radii", [(10, 20), (20, 10)])
def test_the_larger_radius_decides_in_any_order(spark, radii):
    rows = [(1, 2, 7, (1 << 15) - 1, 0, 0, 0, radii[0]), (1, 2, 9, 0, 0, 0, 0, radii[1])]
    for order in (rows, rows[::-1]):
        shards = spark.createDataFrame(order, "shard long, size long, member long, p0 long, p1 long, p2 long, p3 long, radius int").coalesce(1)
        assert [tuple(r) for shard in (400, 1) for r in neardup.shard_links(shards, shard).collect()] == [(7, 9)] * 2


def test_cells_searched_together_match_one_by_one():
    rng = random.Random(12)
    marks = [rng.getrandbits(256) for _ in range(40)]
    marks += [m ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(0, 30))) for m in marks * 5]
    radii, stays = [rng.randrange(0, 40) for _ in marks], [rng.random() < 0.5 for _ in marks]
    near = lambda i, j: (marks[i] ^ marks[j]).bit_count() <= max(radii[i], radii[j])
    assert 30 < neardup.TOGETHER < 240
    for k in (30, 240):
        cell = list(zip(range(k), marks, radii, stays, strict=False))
        pairs = [(i, j) for j in range(k) for i in range(j) if near(i, j)]
        assert sorted(map(tuple, neardup.cell_links([(*x[:3], True) for x in cell], True))) == sorted(pairs)
        assert sorted(map(tuple, neardup.cell_links(cell, False))) == sorted(p for p in pairs if stays[p[0]] != stays[p[1]])


@pytest.mark.parametrize("similarity, radius, least, most", [(0.98, 4, 0.0, 0.5), (0.8, None, 0.95, 1.0), (0.5, None, 0.95, 1.0)])
def test_share_of_nodes_that_a_tree_visits(similarity, radius, least, most):
    """Why the bands, not the trees, do the work at half: the radius that half needs follows nearly every edge."""
    prints = neardup.fingerprints(neardup.sketches(drawn_sets(np.random.default_rng(5), 200, 150, similarity))).view(np.uint64).tolist()
    marks = [a | b << 64 | c << 128 | d << 192 for a, b, c, d in prints]
    tree = neardup.BKTree()
    for i, m in enumerate(marks):
        tree.add(m, i)
    tree.visited = 0
    r = radius or int(128 * (1 - similarity) + 2.75 * ((1 - similarity) * (1 + 4 * similarity) * 64) ** 0.5)
    for m in marks:
        list(tree.within(m, r))
    assert least <= tree.visited / len(marks) ** 2 <= most


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.component) for r in names.components(chain).collect()} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}


def test_names(spark):
    same = ["Antônio Talipran", "ANTÔNIO TALIPRAN", "Por Antônio Talipran", "A. Talipran", "TALIPRAN Antônio", "antonio.talipran@jornal.example", "AntÃ´nio Talipran", "Antônio Talipran, de Santa Ilda", "Antônio Talipan"]
    other = ["Fabiana Talipran", "Antônio Cacolando", "Talita Prado e Antônio Talipran", "", None, "Marina Voteraz", "Karina Voteraz", "Marina Sousa", "Marina Lobo", "Marina Dias", "Karina Melo", "Karina Rocha", "Karina Brito"]
    df = frame(spark, [(i, 1, n, None) for i, n in enumerate([*same, *other, *same])] + [(99, 2, "A. Talipran", None)]).withColumn("autor", F.col("titulo"))
    got = {(r.source, r.name_a, r.name_b) for r in names.name_pairs(names.same_names(df)).collect()}
    assert got == {(1, a, b) for a in same for b in same if a < b}
    parted = names.name_pairs(names.same_names(df, block=2, task_names=3))
    assert {(r.source, r.name_a, r.name_b) for r in parted.collect()} == got


def test_linkage_in_rounds_matches_one_task(spark):
    rng = np.random.default_rng(22)
    x = rng.random((30, 4))
    s = 1 - np.linalg.norm(x[:, None] - x[None], axis=2)
    s[s < 0.5] = 0
    links = [(a, b, float(s[a, b])) for a in range(30) for b in range(a + 1, 30) if s[a, b] > 0]
    want = names._linked(s * (1 - np.eye(30)), 0.45)
    got = {r.fid: r.group for r in names.linked_in_rounds(spark.createDataFrame(links, "a long, b long, similar double"), 0.45).collect()}
    same = lambda g: {(a, b) for a in got for b in got if a < b and g[a] == g[b]}
    assert same(got) == same(want)


def test_cosine_and_linkage_part_names_that_rules_would_join(spark):
    df = frame(spark, [(i, 1, n, None) for i, n in enumerate(["Ana Lima", "A. Lima", "A. Lima Prado", "Aldo Lima Prado"])]).withColumn("autor", F.col("titulo"))
    pairs = lambda **k: {(r.name_a, r.name_b) for r in names.name_pairs(names.same_names(df, **k)).collect()}
    assert pairs() < pairs(cosine=0.0, linkage=0.0)


def test_passages_are_taken_out(spark):
    item = " ".join(f"termo{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Antes. {item.upper().replace(' ', ', ')}! Depois, fim."), (2, "Nada aqui."), (3, None), (4, "ﬁm " + item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, texto string")
    got = {r.doc_id: r for r in leakage.without_leaks(docs, items).collect()}
    assert got[1].text == "Antes. ! Depois, fim." and (got[1].n_words, got[1].n_removed) == (23, 20)
    assert got[2].text == "Nada aqui." and got[3].text is None and got[4].text == "ﬁm " and got[4].n_removed == 20
    assert {r.doc_id for r in leakage.without_leaks(docs, items, whole=True).collect()} == {2, 3}


def test_leaks_joined_when_too_many_to_hold(spark):
    docs, items = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(30)))], "d long, t string"), spark.createDataFrame([(5, " ".join(f"t{i}" for i in range(9, 25)))], "i long, t string")
    a, b = (sorted(map(tuple, leakage.leaked_windows(docs, items, "d", "t", "i", "t", 12, held_windows=n).collect())) for n in (100, 0))
    assert a == b == [(1, 5, k) for k in range(9, 14)]


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    items = [" ".join(f"termo{rng.randrange(400)}" for _ in range(40)) for _ in range(20)]
    docs = []
    for i in range(60):
        w = [f"termo{rng.randrange(400)}" for _ in range(30)]
        if i % 3 == 0:
            t, n = rng.choice(items).split(), rng.choice([11, 12, 15])
            at = rng.randrange(40 - n)
            w[10:10] = [x.upper() + "," for x in t[at : at + n]]
        docs.append((i, "  ".join(w)))
    docs += [(100, None), (101, ""), (102, items[0] * 200), (102, items[0])]
    grams = [{tuple(w[j : j + 12]) for j in range(len(w) - 11)} for w in map(text.words, items)]
    want = {(i, k) for i, d in docs if d for w in [text.words(d)] for g in [{tuple(w[j : j + 12]) for j in range(len(w) - 11)}] for k, t in enumerate(grams) if g & t}
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items), (77, None)], "item_id long, texto string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, t).collect()} == want
    report = leakage.leak_report(leakage.leaked_items(d, t), t.withColumn("conjunto", F.lit("c"))).first()
    assert (report.items, report.leaked_items) == (21, len({k for _, k in want}))


def test_mixture(spark, tmp_path):
    import base64

    ranks = tmp_path / "bytes.tiktoken"
    ranks.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(256)))
    docs = [(i, f"{s} {i:04d}" * 5, s) for i, s in enumerate(["a"] * 200 + ["b"] * 20 + ["c"] * 50)] + [(900, None, "a"), (901, "", "b"), (902, "a 0000" * 5, "b")]
    weights = [("a", 0.4, 1), ("b", 0.4, 3), ("none", 0.2, 2)]
    d, w = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(weights, "source string, peso double, max_repeticoes int")
    report, taken = mixture.mix(d, w, str(ranks))
    got = {r.source: r for r in report.collect()}
    assert abs(got["a"].share - 0.5) < 0.03 and got["b"].most_uses <= 3 and got["none"].n_tokens == 0 and got["b"].most_uses > 1
    uses = {(r.doc_id, r.source): r.uses for r in taken.collect()}
    assert all(u <= {"a": 1, "b": 3}[s] for (_, s), u in uses.items()) and not any(s == "c" for _, s in uses)


def test_min_cost_flow_prefers_first_uses():
    flow = mixture.min_cost_flow({("a", 1): 10, ("a", 2): 10, ("a\nb", 1): 10}, {("a", 1): ["a"], ("a", 2): ["a"], ("a\nb", 1): ["a", "b"]}, {"a": 12, "b": 10})
    assert flow == {("a", 1, "a"): 10, ("a", 2, "a"): 2, ("a\nb", 1, "b"): 10}


def test_largest_total_counts_shared_texts_once():
    supply, uses = {("a\nb", 1): 10, ("a", 1): 4}, {("a\nb", 1): ["a", "b"], ("a", 1): ["a"]}
    assert mixture.largest_total(supply, uses, {"a": 0.5, "b": 0.5}) in (13, 14)
    assert mixture.largest_total({}, {}, {}) == 0


def test_flow_moves_what_it_drew_before():
    rng = random.Random(15)
    for _ in range(60):
        names = "abcd"
        supply = {("".join(sorted(rng.sample(names, rng.randrange(1, 4)))) + str(i), 1): rng.randrange(1, 9) for i in range(6)}
        uses = {k: [c for c in k[0] if c in names] for k in supply}
        quota = {c: rng.randrange(0, 12) for c in names}
        flow = mixture.min_cost_flow(supply, uses, quota)
        # The greatest flow equals the least cut, over all sets of sources.
        cut = min(sum(quota[c] for c in names if c not in cut) + sum(n for k, n in supply.items() if set(uses[k]) & cut) for m in range(16) for cut in [{c for i, c in enumerate(names) if m >> i & 1}])
        assert sum(flow.values()) == cut


def test_mixture_repeats_short_sources(spark, tmp_path):
    import base64

    ranks = tmp_path / "bytes.tiktoken"
    ranks.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(256)))
    docs = [(i, f"{s} {i:04d}" * 5, s) for i, s in enumerate(["a"] * 300 + ["b"] * 60)]
    d, w = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], "source string, peso double, max_repeticoes int")
    got = {r.source: r for r in mixture.mix(d, w, str(ranks), all_tokens=True)[0].collect()}
    assert got["b"].most_uses == 3 and got["a"].most_uses == 1 and abs(got["b"].share - 0.5) < 0.03


def test_spam(spark):
    rng = random.Random(9)
    spammy = ["curso online barato " * 40, "\n".join(f"[curso online](https://x{i}.example/p)" for i in range(30)), "\n".join(f"curso barato em cidade{i} - hotel" for i in range(25)), "Curso barato é o curso certo, e curso barato só no nosso curso. " * 12, " ".join("#cursobarato" for _ in range(40))]
    sound = ["\n".join(body(rng)), body(rng)[0] + "\n" + "\n".join(f"{i}. Nome{i} Silva{i * 7} - {i * 31} votos" for i in range(12)), "\n".join(body(rng)) + "\nFontes:\nO relatório final. https://a.example/1\nA ata. https://a.example/2"]
    df = spark.createDataFrame([(i, t, f"h{i % 4}") for i, t in enumerate([*spammy, *sound, None, ""])], "doc_id long, text string, source string")
    assert sorted(r.key for r in spam.spam_pages(df).where("spam").collect()) == list(range(len(spammy)))


def test_counts_by_page_and_host_find_stitched_pages(spark):
    """Pages that say each phrase once or twice are found only by what other hosts' pages say."""
    rng = random.Random(23)
    mods = [word(rng) for _ in range(60)]
    keys = [f"{word(rng)} {word(rng)}" for _ in range(6)]
    loud = [(i, "\n".join(f"{k} {rng.choice(mods)}" for k in keys for _ in range(2)), f"h{i % 4}") for i in range(8)]
    calm = [(100, "\n".join(f"{k} {rng.choice(mods)}" for k in keys), "h9")]
    plain = [(200 + i, "\n".join(f"{word(rng)} {word(rng)} {word(rng)}" for _ in range(12)), f"h{i}") for i in range(8)]
    df = spark.createDataFrame(loud + calm + plain, "doc_id long, text string, source string")
    flagged = lambda hosts: {r.key for r in spam.spam_pages(df, hosts=hosts).where("spam").collect()}
    assert flagged(2) == {*range(8), 100} and len(flagged(99)) < len(flagged(2))


def test_each_host_counts_once(spark):
    """Keywords that three hosts press stay keywords, though one host with many pages says each once."""
    rng = random.Random(24)
    keys = [f"{word(rng)} {word(rng)}" for _ in range(6)]
    said = lambda k: f"{k} {word(rng)}"
    loud = [(i, "\n".join(said(k) for k in keys for _ in range(2)), f"h{i}") for i in range(3)]
    lists = [(100 + i, "\n".join([said(keys[i % 6]), *(f"{word(rng)} {word(rng)} {word(rng)}" for _ in range(19))]), "h9") for i in range(60)]
    df = spark.createDataFrame(loud + lists, "doc_id long, text string, source string")
    found = lambda hosts: spam.spam_pages(df, hosts=hosts).where("spam").collect()
    assert {r.key for r in found(2)} == {0, 1, 2} and all(r.replicated >= 0.25 and not r.pressed for r in found(2)) and not found(99)


def test_long_texts(spark):
    long = "\n".join(body(random.Random(1), 3000))
    df = frame(spark, [(1, 1, "t", long), (2, 1, "t", "x" * 500_000)])
    assert residue.residue_rows(df).count() == 0 and neardup.near_duplicates(df)[0].count() == 1
    assert isinstance(spam.page_evidence(long)[0], float) and isinstance(pd.DataFrame(truncation.shapes(long)[0]), pd.DataFrame)
