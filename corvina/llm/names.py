"""Spellings of the same person or agency within one source.

Names become vectors of character trigrams weighted by rarity; a sparse join
finds every pair above a cosine; pairs are kept if their parts can be aligned
(initials, dropped parts, nicknames, small slips); average linkage groups what
is left.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.text import words
from corvina.operators.graph import components
from corvina.session import hinted, stash

# Short names that are no part of the long one.
NICKNAMES = {
    "ze": "jose", "zeca": "jose", "chico": "francisco", "xico": "francisco", "beto": "roberto", "tonho": "antonio", "toninho": "antonio", "tony": "antonio", "dudu": "eduardo", "edu": "eduardo",
    "guga": "gustavo", "gu": "gustavo", "nando": "fernando", "lulu": "luis", "lula": "luis", "luisinho": "luis", "bia": "beatriz", "gabi": "gabriela", "rafa": "rafael", "leo": "leandro", "cris": "cristiane",
    "bel": "isabel", "fabi": "fabiana", "ju": "julia", "juju": "julia", "dede": "debora", "deb": "debora", "lena": "helena", "nadinha": "nadia", "soninha": "sonia", "val": "valeria", "vava": "wagner",
    "titi": "tiago", "thi": "tiago", "kaka": "karina", "ka": "karina", "mari": "marina", "nina": "marina", "guida": "margarida", "magui": "margarida", "pat": "patricia", "paty": "patricia", "quita": "quiteria",
    "teca": "teresa", "tete": "teresa", "uli": "ulisses", "zelinha": "zelia", "rick": "henrique", "kiko": "henrique", "caique": "caio", "itinho": "italo", "joca": "joao", "janjao": "joao", "aninha": "ana", "yas": "yasmin", "ota": "otavio", "tavinho": "otavio", "beta": "roberta",
}
# Parts of a name line that name nobody.
PARTICLES = frozenset("de da do dos das d e di du del van von la y".split())
LEADS = frozenset("por by texto reportagem da do pela pelo redator reporter edicao com escrito publicado".split())
AGENCY = frozenset("agencia ag agencias noticias news press".split())
TWO = re.compile(r"\s(?:e|and|y|com)\s|\s*[&;/+]\s*|\s+\|\s+", re.IGNORECASE)
TRAILING = re.compile(r"(?:,|\s[-–—])\s*(?:de|em|do|da|d[oe]s?|enviad[oa]|especial|correspondente|rep[óo]rter|colunista|editor)\b.*$", re.IGNORECASE)
BRACKETS = re.compile(r"[(\[].*?[)\]]")
MAIL = re.compile(r"^\W*([\w.+-]+)@[\w.-]+\W*$")


def _mended(name: str) -> str:
    """A name whose UTF-8 was read as Latin-1, as it was."""
    if "Ã" in name or "Â" in name:
        for code in ("cp1252", "latin-1"):
            try:
                return name.encode(code).decode("utf-8")
            except UnicodeError:
                pass
    return name


def parts(name: str) -> list[str]:
    """The parts that count, folded, first name first; empty for two people or none."""
    name = _mended(name)
    if m := MAIL.match(name):
        return [w for w in words(m.group(1)) if not w.isdigit()]
    brackets = " ".join(BRACKETS.findall(name))
    name = TRAILING.sub("", BRACKETS.sub(" ", name)).strip()
    if any(words(x) and words(y) for x, y in _halves(name)):
        return []
    if "," in name:
        head, _, tail = name.partition(",")
        name = f"{tail} {head}"
    shown = [w for w in name.split() if any(c.isalpha() for c in w)]
    while shown and " ".join(words(shown[0])) in LEADS and len(shown) > 1:
        shown = shown[1:]
    loud = [len(w) > 2 and w.isupper() for w in shown]
    if len(shown) > 1 and loud[0] and not loud[-1]:  # SURNAME Name
        cut = loud.index(False)
        shown = shown[cut:] + shown[:cut]
    found = [w for x in shown for w in words(x)]
    if any(_agency(w) or w == "ag" for w in [*found, *words(brackets)]):
        kept = [w for w in found if w not in AGENCY and not _agency(w) and w not in PARTICLES]
        return ["agencia", *kept]
    # One letter at the front is an initial, whatever it means inside a name.
    return [w for i, w in enumerate(found) if w not in PARTICLES or (i == 0 and len(w) == 1 and len(found) > 1)]


def _agency(word: str) -> bool:
    return word.startswith("ag") and len(word) > 4 and _near(word, "agencia")


def _halves(name: str) -> list[tuple[str, str]]:
    return [(name[: m.start()], name[m.end() :]) for m in TWO.finditer(name)]


def _near(x: str, y: str) -> bool:
    """Equal, or a slip apart: an edit, two from six letters and three from ten, neighbours swapped counting one."""
    if x == y:
        return True
    most = 1 + (min(len(x), len(y)) >= 6) + (min(len(x), len(y)) >= 10)
    if min(len(x), len(y)) < 4 or abs(len(x) - len(y)) > most:
        return False
    before, row = [], list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        two, before, row = before, row, [i]
        for j, b in enumerate(y, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b))
            if i > 1 and j > 1 and a == y[j - 2] and x[i - 2] == b:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return False
    return row[-1] <= most


def _given(x: str, y: str, known: frozenset | set) -> bool:
    """Whether two first names may be one."""
    if x == y:
        return True
    x, y = sorted((x, y), key=len)
    if len(x) == 1:
        return y[0] == x
    if NICKNAMES.get(x) == y or (len(x) >= 3 and (y.startswith(x) or y.endswith(x)) and x not in known):
        return True
    return len(x) > 2 and _near(x, y) and not (x in known and y in known)


def alike(a: list[str], b: list[str], known: frozenset | set = frozenset()) -> bool:
    """Whether two names can be aligned: first names agree and the shorter's others follow in the longer's.

    ``known`` holds first names that many people have; two of them are never a slip of each other.
    """
    if not a or not b:
        return False
    if len(a) == 1 or len(b) == 1 or "agencia" in (a[0], b[0]):
        rest = lambda p: p[1:] if p[0] == "agencia" else p
        x, y = rest(a), rest(b)
        return bool(x and y) and len(x) == len(y) and all(_near(p, q) for p, q in zip(x, y, strict=True))
    if not _given(a[0], b[0], known):
        return False
    x, y = sorted((a[1:], b[1:]), key=len)
    strong, j = 0, 0
    for p in x:
        while j < len(y):
            q = y[j]
            j += 1
            if len(p) > 1 and len(q) > 1:
                if _near(p, q):
                    strong += 1
                    break
            elif p[0] == q[0]:
                break
        else:
            return False
    return strong > 0


#: Names that one task pairs on a gram; more are paired part by part.
BLOCK_NAMES = 1_000
#: Names of a component that one task links by itself; larger ones are linked in rounds over all of them.
TASK_NAMES = 200


def linked_in_rounds(links: DataFrame, cut: float, rounds: int = 10_000) -> DataFrame:
    """(fid, group): average-linkage groups of ``links`` (a, b, similar), pairs without a link counting 0.

    In each round all pairs of clusters that are nearest to each other merge at
    once, which average linkage allows without changing its tree; only sums and
    sizes of pairs of clusters are kept, so no component stands in one task.
    """
    edges = stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("similar").alias("sum")))
    sizes = stash(edges.select(F.explode(F.array("a", "b")).alias("c")).distinct().withColumn("n", F.lit(1)))
    groups = sizes.select(F.col("c").alias("fid"), F.col("c").alias("group"))
    for _ in range(rounds):
        n = lambda x: sizes.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"))
        rated = edges.join(n("a"), "a").join(n("b"), "b").withColumn("mean", F.col("sum") / (F.col("n_a") * F.col("n_b"))).where(F.col("mean") >= cut)
        rank = F.struct(F.col("mean"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))
        best = rated.select(F.explode(F.array("a", "b")).alias("c"), "a", "b", rank.alias("rank")).groupBy("c").agg(F.max_by(F.struct("a", "b"), "rank").alias("p"))
        pairs = stash(best.groupBy("p").agg(F.count("*").alias("k")).where("k = 2").select(F.col("p.a").alias("into"), F.col("p.b").alias("gone")))
        if pairs.isEmpty():
            return groups
        named = lambda x: pairs.select(F.col("gone").alias(x), F.col("into").alias(f"{x}_into"))
        moved = edges.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_into", "a").alias("x"), F.coalesce("b_into", "b").alias("y"), "sum").where("x <> y")
        edges = stash(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("sum").alias("sum")))
        sizes = stash(sizes.join(named("c"), "c", "left").groupBy(F.coalesce("c_into", "c").alias("c")).agg(F.sum("n").alias("n")))
        groups = stash(groups.join(named("group"), "group", "left").select("fid", F.coalesce("group_into", "group").alias("group")))
    raise RuntimeError(f"clusters still merge after {rounds} rounds")


def _linked(similar: np.ndarray, cut: float) -> np.ndarray:
    """Average-linkage groups of a symmetric matrix, down to a mean similarity of ``cut``."""
    n = len(similar)
    group, size, s = np.arange(n), np.ones(n), similar.astype(float).copy()
    np.fill_diagonal(s, -1)
    while n > 1:
        i, j = divmod(int(s.argmax()), n)
        if s[i, j] < cut:
            break
        merged = (s[i] * size[i] + s[j] * size[j]) / (size[i] + size[j])
        s[i], s[:, i] = merged, merged
        s[i, i] = -1
        s[j], s[:, j] = -1, -1
        size[i] += size[j]
        group[group == j] = i
    return group


def same_names(docs: DataFrame, name: str = "autor", source: str = "veiculo_id", cosine: float = 0.2, linkage: float = 0.45, first_names: int = 4, task_names: int = TASK_NAMES, block: int = BLOCK_NAMES) -> DataFrame:
    """(source, name, group): spellings of one person or agency within a source share a group.

    Null and empty names, names of two people and names without letters are
    left out.  The cosine join is exact: grams are indexed rarest first until
    the rest of a vector is shorter than ``cosine``, which no pair above it can
    miss; there is no cap on partners.  A first name that ``first_names``
    different surnames share is no slip of another such name.  Equal spellings
    in many rows count once; other columns are not read.
    """
    split = F.pandas_udf(lambda s: s.map(parts), "array<string>")
    names = stash(
        docs.select(F.col(source).cast("long").alias("source"), F.col(name).alias("name"))
        .where(F.col("name").isNotNull() & (F.trim("name") != ""))
        .distinct()
        .withColumn("parts", split("name"))
        .where(F.size("parts") > 0)
        .withColumn("nid", F.xxhash64("source", "name"))
    )
    # Spellings with the same parts are one vector.
    forms = stash(names.select("source", "parts").distinct().withColumn("fid", F.xxhash64("source", "parts")))
    common = (
        forms.where(F.size("parts") > 1)
        .groupBy(F.col("parts")[0].alias("first"))
        .agg(F.countDistinct(F.element_at("parts", -1)).alias("n"))
        .where((F.col("n") >= first_names) & (F.length("first") > 1))
    )
    known = forms.select("source", "fid", "parts").join(hinted(common.select(F.col("first").alias("f_"), F.lit(True).alias("known"))), F.col("parts")[0] == F.col("f_"), "left")
    forms = known.select("source", "fid", "parts", F.coalesce("known", F.lit(False)).alias("known"))
    grams = (
        forms.select("source", "fid", F.explode("parts").alias("part"))
        .select("source", "fid", F.concat(F.lit("^"), "part", F.lit("$")).alias("part"))
        .select("source", "fid", F.explode(F.expr("transform(sequence(1, greatest(length(part) - 2, 1)), i -> substring(part, i, 3))")).alias("gram"))
        .groupBy("source", "fid", "gram")
        .agg(F.count("*").alias("tf"))
    )
    grams = stash(grams)
    rarity = grams.groupBy("gram").agg(F.count("*").alias("df"))
    total = forms.agg(F.count("*").alias("n_forms"))
    weighted = grams.join(hinted(rarity), "gram").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * F.log1p(F.col("n_forms") / F.col("df")))
    norms = weighted.groupBy("fid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = stash(weighted.join(norms, "fid").withColumn("w", F.col("w") / F.col("norm")))
    rest = Window.partitionBy("fid").orderBy(F.col("df").desc(), F.col("gram").desc()).rowsBetween(Window.unboundedPreceding, 0)
    indexed = unit.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).where(F.col("rest") >= cosine).select("source", "gram", "fid", F.ceil(F.col("df") / block).cast("int").alias("parts"))
    # A gram of many names is joined in cells of two parts each, so that none makes a task of its own size squared.
    placed = indexed.withColumn("part", F.pmod(F.xxhash64("fid"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = placed.select("source", "gram", "fid", "part", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"))
    other = cells.select(F.col("source").alias("s_"), F.col("gram").alias("g_"), F.col("fid").alias("fid_b"), F.col("part").alias("p_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"))
    met = cells.join(other, F.col("source").eqNullSafe(F.col("s_")) & (F.col("gram") == F.col("g_")) & (F.col("lo") == F.col("lo_")) & (F.col("hi") == F.col("hi_")) & (F.col("fid") < F.col("fid_b")))
    pairs = met.where((F.least("part", "p_") == F.col("lo")) & (F.greatest("part", "p_") == F.col("hi"))).select(F.col("fid").alias("fid_a"), "fid_b").distinct()
    vectors = unit.groupBy("fid").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("vector")).join(forms, "fid")
    side = lambda x: vectors.select(F.col("fid").alias(f"fid_{x}"), F.col("source").alias(f"source_{x}"), F.col("parts").alias(f"parts_{x}"), F.col("known").alias(f"known_{x}"), F.col("vector").alias(f"vector_{x}"))
    dot = F.aggregate(F.map_entries("vector_a"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("vector_b", e["key"]), F.lit(0.0)))

    @F.pandas_udf("boolean")
    def aligned(a: pd.Series, b: pd.Series, known_a: pd.Series, known_b: pd.Series) -> pd.Series:
        firsts = lambda x, kx, y, ky: {p[0] for p, k in ((x, kx), (y, ky)) if k}
        return pd.Series([alike(list(x), list(y), firsts(x, kx, y, ky)) for x, y, kx, ky in zip(a, b, known_a, known_b, strict=True)], dtype=bool)

    near = stash(
        pairs.join(side("a"), "fid_a").join(side("b"), "fid_b").withColumn("cosine", dot)
        .where(F.col("cosine") >= cosine)
        .where(aligned("parts_a", "parts_b", "known_a", "known_b"))
        .select(F.col("source_a").alias("source"), "fid_a", "fid_b", (0.5 + F.col("cosine") / 2).alias("similar"))
    )
    component = components(near.select(F.col("fid_a").alias("a"), F.col("fid_b").alias("b")))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pd.unique(pd.concat([pdf["fid_a"], pdf["fid_b"]]))
        at = {x: i for i, x in enumerate(ids)}
        s = np.zeros((len(ids), len(ids)))
        for a, b, v in zip(pdf["fid_a"], pdf["fid_b"], pdf["similar"], strict=True):
            s[at[a], at[b]] = s[at[b], at[a]] = v
        return pd.DataFrame({"fid": ids, "group": ids[_linked(s, linkage)]})

    placed = near.join(component.withColumnRenamed("node", "fid_a"), "fid_a")
    large = stash(component.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > task_names).select("component"))
    groups = placed.join(hinted(large), "component", "left_anti").groupBy("component").applyInPandas(group, "fid long, group long")
    if not large.isEmpty():
        rest = placed.join(hinted(large), "component", "left_semi").select(F.col("fid_a").alias("a"), F.col("fid_b").alias("b"), "similar")
        groups = groups.unionByName(linked_in_rounds(rest, linkage))
    return (
        names.withColumn("fid", F.xxhash64("source", "parts")).join(groups, "fid", "left")
        .select("source", "name", F.coalesce("group", "fid").alias("group"))
    )


def name_pairs(groups: DataFrame) -> DataFrame:
    """(source, name_a, name_b): the spellings of each group in pairs, name_a before name_b by code point."""
    other = groups.select(F.col("source").alias("s_"), F.col("group").alias("g_"), F.col("name").alias("name_b"))
    return (
        groups.join(other, F.col("source").eqNullSafe(F.col("s_")) & (F.col("group") == F.col("g_")) & (F.col("name") < F.col("name_b")))
        .select("source", F.col("name").alias("name_a"), "name_b")
    )
