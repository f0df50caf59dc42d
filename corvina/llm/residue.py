"""Template residue, filler and error pages among records.

Each record is reduced to the few pieces that may be residue.  Markers are
aligned with all other records by the words around them: where records of the
same wording hold other words, the place is a slot of their template and was
left unfilled, whatever the marker looks like; where they all hold the same
marker it belongs to what they report.  Short whole pages of one wording that
stand under many titles at several sources are error templates, as are lines
that replace the content of several records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice
from operator import eq

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.furniture import ENDED, seed_furniture
from corvina.llm.text import CLOSING, line_key, window_hashes, word_hash, words
from corvina.session import hinted, stash

# Ways to write the slot of a template.
SLOT = re.compile(
    r"""(?x) \{\{[^{}]{1,60}\}\} | \{%[^{}%]{1,60}%\} | <%[^<>%]{1,60}%> | <\?[^<>?]{1,60}\?> | \$\{[^{}]{1,60}\} | \[\[[^\[\]]{1,60}\]\]
    | %%[\w .-]{1,40}%% | \#\#[\w .-]{1,40}\#\# | @@[\w .-]{1,40}@@ | __[\w .-]{1,40}?__ | \$\$[\w .-]{1,40}\$\$ | \|\*[^*|]{1,40}\*\|
    | %[A-Z][A-Z_]{2,40}% | <<[\w .-]{1,40}>> | \{[A-Za-zÀ-ú]+(?:[_.][A-Za-zÀ-ú]+)*\} | \[[A-ZÀ-Ú][A-ZÀ-Ú_ .-]{2,50}\] | <[A-ZÀ-Ú_]{3,40}>"""
)
PERCENT = re.compile(r"%[A-Z]{3}")
# What may be a slot, or a blank or default in one, if other records fill it.
LOOSE_SLOT = re.compile(r"\{\w{0,60}\}|%[sd](?!\w)|\[[a-zà-ú][\wà-ú .-]*\]|<[a-zà-ú]\w*_\w*>|_{3,}|\?{4,}")
# Words that speak about a marker instead of leaving it behind.
SPEAKS = re.compile(r"(?i)\b(?:palavra|express[ãa]o|marcador|etiqueta|trocar|substituir|placeholder)\W*$")
SPEAKS_AFTER = re.compile(r"(?i)^\W*(?:no|em)\s+lugar\s+d")
# A whole line or title that says there is nothing.
VOID = re.compile(r"(?i)^\W*(?:undefined|null|none|nan|n/a|object object|untitled|sem t[íi]tulo|t[íi]tulo|erro|error|p[áa]gina n[ãa]o encontrada|not found)\W*$")
# Filler.
FILLER = re.compile(
    r"(?i)\b(?:lorem|lipsum)\b|\bdolor sit\b|\bbla bla\b|(?<!x)x{4,}\s+x{3,}|\b(\w{2,12})(?:\W+\1\b){2,}|teste de publica[çc][ãa]o|favor ignorar|completar depois"
    r"|\b(?:digite|escreva|insira|inserir|cole)\b.{0,40}\baqui\b|\b(?:t[íi]tulo|texto|subt[íi]tulo|resumo|legenda) (?:da mat[ée]ria )?aqui\b|m[áa]x\. \d+ toques"
)
# Error messages and notices of servers, scripts and access.
NOTICE = re.compile(
    r"""(?ix) ^\W*(?:http\s)?(?:erro|error|fatal|warning|exception)\b | \bacesso\s+negado\b | \baccess\s+denied\b | \bforbidden\b | \bunauthori[sz]ed\b
    | \b(?:bad\s+gateway|gateway\s+time-?out|internal\s+server\s+error|service\s+unavailable|too\s+many\s+requests|(?:page\s+)?not\s+found)\b
    | \b(?:400|401|403|404|410|429|500|502|503|504)\b\W+(?:n[ãa]o|p[áa]gina|not|bad|erro|error|service|internal|forbidden)
    | n[ãa]o\s+achamos\s+o\s+que | p[áa]gina\s+n[ãa]o\s+(?:foi\s+)?(?:encontrada|existe|est[áa]\s+dispon) | conte[úu]do\s+(?:\w+\s+)?(?:indispon|protegido|n[ãa]o\s+(?:est[áa]\s+)?dispon|restrito|bloqueado|precisa\s+de\s+scripts)
    | (?:ya\s+no|no\s+longer|n[ãa]o)\s+(?:est[áa]|is)\s+(?:mais\s+)?(?:dispon|avail) | sess[ãa]o\s+expir | session\s+(?:has\s+)?expired | fa[çc]a\s+login\s+(?:novamente|para) | tempo\s+limite\s+esgotado
    | (?:habilit|ativ|enabl|activ|habilite)\w*\s+(?:o\s+|los\s+|os\s+)?(?:java\s?script|scripts?|cookies) | scripts?\s+(?:ativos|habilitad|enabled) | (?:requer|requires?|precisa)\s.{0,40}(?:java\s?script|scripts?)\b
    | navegador\s+(?:est[áa]\s+)?desatualizado | browser\s+is\s+(?:out|not) | n[ãa]o\s+[ée]\s+um\s+rob[ôo] | not\s+a\s+robot | voc[êe]\s+[ée]\s+humano | you\s+are\s+human | captcha | ^\W*(?:carregando|aguarde|loading|please\s+wait)\b.{0,20}$ | request\s+blocked | muitas\s+requisi[çc] | mudou\s+de\s+lugar | checking\s+your\s+browser
    | fora\s+do\s+ar\s+para\s+manuten | em\s+manuten[çc][ãa]o\W*$ | tente\s+(?:novamente\s+)?mais\s+tarde | (?:recarregue|reload)\s+(?:a|the|la)\s+p | banco\s+de\s+dados\s+\(c | undefined\s+(?:index|variable|offset) | stack\s?trace | protocolo\s+\d+\W*$"""
)
#: Without one of these no line is filler or a notice; looking for them is cheap.
HINTS = (
    "lorem", "lipsum", "dolor", "dolam", "bla bla", "xxxx", "publicação", "publicacao", "ignorar", "depois", "aqui", "toques", "erro", "error", "fatal", "warning", "exception",
    "negado", "denied", "forbidden", "unauthor", "gateway", "unavailable", "requests", "found", "40", "41", "42", "50", "achamos", "página", "pagina", "conteúdo", "contenido", "dispon", "avail", "expir",
    "login", "limite", "script", "cookies", "navegador", "browser", "robô", "robot", "captcha", "manuten", "mais tarde", "reload", "recarregue", "banco de dados", "undefined", "trace", "protocolo",
    "human", "carregando", "aguarde", "loading", "wait", "blocked", "requisi", "mudou de lugar",
)
# Words that any running text has, in Portuguese, Spanish and English.
FUNCTION = frozenset("a o as os um uma de do da dos das em no na nos nas por para com e que se ao aos el la los las un una del con y en lo the of to in and for is on at with by it this that".split())
#: Lines up to this are judged whole, longer ones sentence by sentence.
WHOLE_CHARS = 220
#: Without one of these, what GUARDED tells, or a word said twice running, no sentence of a long line is filler or a notice.
GUARDED = {
    **dict.fromkeys(("erro", "error", "fatal", "warning", "exception"), re.compile(r"(?:^|[.!?…\n])\W*(?:http\s)?(?:erro|error|fatal|warning|exception)\b")),
    **dict.fromkeys(("40", "41", "42", "50"), re.compile(r"\b(?:400|401|403|404|410|429|500|502|503|504)\b\W+[npbesif]")),
    "aqui": re.compile(r"\b(?:digite|escreva|insira|inserir|cole|t[íi]tulo|texto|subt[íi]tulo|resumo|legenda|mat[ée]ria)\b.{0,40}\baqui\b"),
    "depois": re.compile("completar depois"),
}
#: HINTS and GUARDED as one pattern of Arrow, somewhat wider: its classes know ASCII only.
LOOK = "|".join([
    *(re.escape(h) for h in (*HINTS, "internal server error") if h not in GUARDED), "completar depois", r"(?:digite|escreva|insira|inserir|cole|t[íi]tulo|texto|resumo|legenda|mat[ée]ria)[^\n]*aqui",
    r"(?:^|[.!?…\n])[^0-9A-Za-z_]*(?:http[^0-9A-Za-z_])?(?:erro|error|fatal|warning|exception)", r"(?:400|401|403|404|410|429|500|502|503|504)[^0-9A-Za-z_]+[npbesif]",
])
SENTENCES = re.compile(r"(?<=[.!?…])\s+")
QUOTED = re.compile(r"“[^”]*(?:”|$)|«[^»]*(?:»|$)|\"[^\"]*\"")
#: Share of a long line that its notices hold, at least, if it opens with one and if not.
NOTICE_SHARES = (0.25, 0.5)
#: A wording repeated in so many records is a template.
TEMPLATE_ROWS = 3
#: Other fillings that show a place to be a slot, and words of one filling at most.
FILLINGS, FILLING_WORDS = 2, 4
#: Places that every worker looks for at a time, 8 bytes each; more are looked for in blocks.
HELD_PLACES = 1_000_000
#: Words and lines of a whole page that may be a template, and the share of its rows that differ in title.
PAGE_WORDS, PAGE_LINES, PAGE_TITLES = 60, 3, 0.8


def _may_hold_slot(text: str) -> bool:
    """Whether a text has the signs of a slot at all."""
    if "{" in text or "<" in text or "[" in text or ("%" in text and ("%%" in text or "%s" in text or "%d" in text or PERCENT.search(text) is not None)):
        return True
    return ("$" in text and "$$" in text) or ("@" in text and "@@" in text) or ("#" in text and "##" in text) or ("_" in text and "__" in text) or ("|" in text and "|*" in text) or ("?" in text and "????" in text)


def _mention(before: str, after: str) -> bool:
    return bool(SPEAKS.search(before) or SPEAKS_AFTER.match(after))


def _one_word(parts: list[str]) -> bool:
    """Whether a line says nothing but one word again and again."""
    return parts[0].strip(CLOSING) == parts[-1].strip(CLOSING) and len({x.strip(CLOSING) for x in parts}) == 1


def _short_kind(line: str, hinted_: bool | None = None) -> str | None:
    """The kind of residue that a short line is by itself (``hinted_``: known of :func:`_hinted` already)."""
    if line.startswith(("“", '"', "«")):
        return None
    if VOID.match(line):
        return "void"
    low = line.lower()
    parts = low.split()
    hinted_ = _hinted(low) if hinted_ is None else hinted_
    if "”" not in line and (hinted_ or 2 * len(set(parts)) <= len(parts) or _one_word(parts)) and FILLER.search(line):
        return "filler"
    if hinted_ and "“" not in line and NOTICE.search(line):
        return "notice"
    if len(parts) >= 5 and FUNCTION.isdisjoint(parts) and ENDED.search(line) and FUNCTION.isdisjoint(words(line)) and not seed_furniture(line):
        said = SENTENCES.split(line)
        # The same sentence again and again, without a word of running text.
        return "filler" if len(said) > 1 and len({line_key(x) for x in said}) == 1 else "wordless"
    return None


def _prose(line: str) -> bool:
    return line.count(" ") >= 9 and bool(ENDED.search(line[-16:])) and not seed_furniture(line)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for h in (*HINTS, "internal server error"):
        found.add_word(h, GUARDED.get(h, True))
    found.make_automaton()
    return found


def _hinted(low: str) -> bool:
    """Whether a text in lower case may hold filler or a notice by their words: a cheap look that lets none pass."""
    seen = set()
    for _, guard in _WORDS_OF_RESIDUE.iter(low):
        if guard is True:
            return True
        if id(guard) not in seen:
            seen.add(id(guard))
            if guard.search(low):
                return True
    return False


def looked(lines: list[str]) -> set[str]:
    """Those of many lines that :func:`_hinted` has to be asked about."""
    found = pc.match_substring_regex(pa.array([line.lower() for line in lines], pa.string()), LOOK)
    return {lines[i] for i in np.flatnonzero(found.to_numpy(zero_copy_only=False))}


def _suspect(text: str, hinted_: bool | None = None) -> bool:
    """Whether long lines may hold filler or a notice (``hinted_``: known of :func:`_hinted` already), or say a word twice running."""
    low = text.lower()
    if _hinted(low) if hinted_ is None else hinted_:
        return True
    said = words(low)
    return any(map(eq, said, said[1:]))


def _long_kinds(line: str) -> tuple[list[str], bool]:
    """The kinds of residue among the sentences of a long line, and whether the others are prose.

    Quoted text is what the article reports.  A sentence that names a filler
    among as many function words as prose has speaks about it.  Notices count
    if they hold much of the line or nothing else in it is prose.
    """
    if VOID.match(line):
        return ["void"], False
    prose = opens = False
    noticed = at = 0
    unquoted = QUOTED.sub(" ", line).strip()
    marks = list(FILLER.finditer(unquoted))
    filler = []
    for s in SENTENCES.split(unquoted):
        start = unquoted.index(s, at)
        at = start + len(s)
        if here := [m for m in marks if m.start() < at and m.end() > start]:
            said = words(s)
            spoken = sum(x in FUNCTION for x in said) >= 0.2 * len(said)
            if new := [m for m in here if not (spoken and m.group(0).lower().startswith(("lorem", "lipsum", "dol", "bla", "xxxx")))]:
                filler += new
                continue
        if NOTICE.search(s):
            noticed += len(s)
            opens |= not start
        else:
            prose |= _prose(s)
    kinds = ["filler"] if filler else []
    if noticed and (not prose or noticed >= NOTICE_SHARES[not opens] * len(unquoted)):
        return [*kinds, "notice"], False
    return kinds, prose


_WORDS_OF_RESIDUE = _automaton()


def place_hashes(hashes: np.ndarray, gap: int) -> np.ndarray:
    """Hash of the two words before and the two behind each stretch of ``gap`` words."""
    n = len(hashes) - gap - 3
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in (0, 1, gap + 2, gap + 3):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j]
    return out ^ (out >> np.uint64(29))


def _hashes(said: list[str]) -> np.ndarray:
    return np.fromiter(map(word_hash, said), np.uint64, len(said))


def fillings(docs: DataFrame, places: DataFrame, held: int = HELD_PLACES) -> DataFrame:
    """(place, filling): what stands in all of ``docs`` (title, body) at the ``places`` (place), up to ``FILLING_WORDS`` words."""
    spark = docs.sparkSession
    blocks = -(-places.count() // held)

    def look(batches: Iterator[pd.DataFrame], known: np.ndarray) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [words(t) if t else [] for pair in zip(batch["title"], batch["body"], strict=True) for t in pair]
            ends = np.cumsum([len(w) for w in split])
            flat = _hashes(list(chain.from_iterable(split)))
            of = np.repeat(np.arange(len(split)), [len(w) for w in split])
            out = []
            for gap in range(1, FILLING_WORDS + 1):
                h = place_hashes(flat, gap)
                if not len(h) or not len(known):
                    continue
                at = np.searchsorted(known, h)
                hit = np.flatnonzero((known[np.minimum(at, len(known) - 1)] == h) & (of[: len(h)] == of[gap + 3 : gap + 3 + len(h)]))
                if len(hit):
                    inner = window_hashes(flat, gap)[hit + 2]
                    out.append(pd.DataFrame({"place": h[hit].view(np.int64), "filling": inner.view(np.int64)}))
            if out:
                yield pd.concat(out).drop_duplicates()

    found = None
    for k in range(blocks):
        part = places.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == k).select("place").toPandas()["place"].to_numpy(np.int64)
        sent = spark.sparkContext.broadcast(np.sort(part.view(np.uint64)))
        one = docs.mapInPandas(lambda batches, sent=sent: look(batches, sent.value), "place long, filling long")
        found = one if found is None else found.unionByName(one)
    return (found if found is not None else spark.createDataFrame([], "place long, filling long")).distinct()


def page_lines(title: str | None, body: str | None) -> list[str]:
    """The title and each line of the body, stripped."""
    return [line.strip() for line in (title or "", *(body or "").split("\n"))]


class Pieces:
    """Finds what may be residue in one record after the other."""

    def __init__(self, held: int = 100_000) -> None:
        self.held, self.known = held, {}

    def short(self, line: str, hinted_: bool | None = None) -> str | None:
        if (found := self.known.get(line, self)) is self:
            found = _short_kind(line, hinted_)
            if len(self.known) < self.held:
                self.known[line] = found
        return found

    def of(self, title: str | None, body: str | None, lines: list[str], asked: set[str]) -> Iterator[tuple]:
        """(part, kind, wording, context, flag, line, place, filling): flag is a mention for a slot, else whether the page has prose.

        ``lines`` are those of :func:`page_lines`; only those ``asked`` about may have a hint.
        """
        prose, said, long = False, [], []
        slots = _may_hold_slot(title or "") or _may_hold_slot(body or "")
        for n, line in enumerate(lines):
            if not line:
                continue
            part = "body" if n else "title"
            if slots:
                taken = []
                for kind, shape in (("slot", SLOT), ("loose", LOOSE_SLOT)):
                    for m in shape.finditer(line):
                        if kind == "loose" and any(a < m.end() and m.start() < b for a, b in taken):
                            continue
                        taken.append(m.span())
                        before, after = line[: m.start()], line[m.end() :]
                        left, right, own = words(before)[-2:], words(after)[:2], words(m.group(0))
                        context = " ".join(left) + " _ " + " ".join(right) if len(left) + len(right) > 2 else None
                        place = filling = None
                        if len(left) == len(right) == 2:
                            place = int(place_hashes(_hashes([*left, *(own or ["_"]), *right]), max(len(own), 1)).view(np.int64)[0])
                            filling = int(window_hashes(_hashes(own), len(own)).view(np.int64)[0]) if own else 0
                        yield part, kind, m.group(0), context, _mention(before, after), line_key(line), place, filling
            if len(line) > WHOLE_CHARS:
                long.append((part, line))
            elif kind := self.short(line, None if line in asked else False):
                said.append((part, kind, line_key(line) or line))
            elif n and not prose:
                prose = _prose(line)
        hint = None if any(line in asked for _, line in long) else False
        suspect = bool(long) and _suspect("\n".join([line for _, line in long]), hint)
        for part, line in long:
            kinds, more = _long_kinds(line) if suspect else ([], False)
            if not kinds and " de " not in line and (kind := _short_kind(line, hint)) in ("wordless", "filler"):
                kinds = [kind]
            said += [(part, kind, line_key(line) or line) for kind in kinds]
            if part == "body" and not kinds and not prose:
                prose = more or _prose(line) or any(map(_prose, SENTENCES.split(line)))
            elif part == "body":
                prose |= more
        for part, kind, wording in said:
            yield part, kind, wording, None, prose, wording, None, None
        if body and len(body) < 20 * PAGE_WORDS:
            # One line more than a page may have tells enough.
            own = list(islice((line for line in lines[1:] if line and not seed_furniture(line)), PAGE_LINES + 1))
            if 0 < len(own) <= PAGE_LINES and sum(line.count(" ") + 1 for line in own) <= PAGE_WORDS and (wording := line_key(" ".join(own))):
                yield "body", "page", wording, None, prose, line_key(title or ""), None, None


def residue_rows(docs: DataFrame, key: str = "id", title: str = "titulo", body: str = "corpo", source: str = "veiculo_id", align: bool = True) -> DataFrame:
    """(key): records with an unfilled slot, filler, an error message or a notice in place of content.

    A marker counts unless its sentence speaks about it, or at least three
    different lines hold the very same marker between the same words and no
    record anything else.  What only may be a marker (a blank, a word in
    brackets) counts where at least ``FILLINGS`` other fillings stand at its
    place in other records (``align`` turns that off).  A short whole page
    counts as a template where at least three rows of two sources have it, most
    of them under titles of their own.
    Void titles count where they stand alone on a line, filler there or as
    a sentence of a long line; lines of every length are searched.  A notice
    counts if its page has no other prose or if its wording replaces whole
    pages elsewhere.  Null or empty titles and bodies hold no residue; a key
    that stands in several rows comes out once; other columns are not read.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Pieces()
        for batch in batches:
            split = list(map(page_lines, batch["title"], batch["body"]))
            asked = looked(list(set(chain.from_iterable(split)).difference(found.known)))
            out = [
                (k, src, *piece)
                for k, src, t, b, lines in zip(batch["key"], batch["source"], batch["title"], batch["body"], split, strict=True)
                for piece in found.of(t, b, lines, asked)
            ]
            yield pd.DataFrame(out, columns=["key", "source", "part", "kind", "wording", "context", "flag", "line", "place", "filling"], dtype=object).astype({"place": "Int64", "filling": "Int64"})

    read = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), F.col(title).alias("title"), F.col(body).alias("body")).where(F.col("title").isNotNull() | F.col("body").isNotNull())
    found = stash(read.mapInPandas(scan, "key long, source string, part string, kind string, wording string, context string, flag boolean, line string, place long, filling long"))
    marks = found.where("kind in ('slot', 'loose')")
    alike = marks.where("kind = 'slot' and context is not null").groupBy("context").agg(F.countDistinct("line").alias("lines"), F.countDistinct("wording").alias("markers"))
    reported = alike.where((F.col("lines") >= TEMPLATE_ROWS) & (F.col("markers") == 1)).select("context")
    # Other records are asked about what they decide: whether it is a slot at all, and whether a marker is what is reported.
    asked = marks.where("place is not null and not flag")
    places = asked.where("kind = 'loose'").select("place").union(asked.join(hinted(reported), "context", "left_semi").select("place")).distinct()
    stands = stash(fillings(read.select("title", "body"), places if align else places.limit(0)))
    others = marks.where("place is not null").select("place", "filling").distinct().join(stands.withColumnRenamed("filling", "other"), "place").where("other <> filling")
    # A marker's own words are no filling of its place.
    own = marks.where("place is not null").select("place", F.col("filling").alias("other")).distinct()
    filled = stash(others.select("place", "other").distinct().join(own, ["place", "other"], "left_anti").groupBy("place").agg(F.count("*").alias("fills")))
    marked = marks.join(hinted(filled), "place", "left").withColumn("fills", F.coalesce("fills", F.lit(0)))
    slots = marked.where("kind = 'slot' and context is not null").join(hinted(reported), "context", "left_semi")
    literal = slots.groupBy("context").agg(F.max("fills").alias("most")).where("most = 0").select("context")
    unfilled = marked.where(~F.col("flag") & ((F.col("kind") == "slot") | (F.col("fills") >= FILLINGS))).join(hinted(literal), "context", "left_anti")
    pages = (
        found.where("kind = 'page'")
        .groupBy("wording")
        .agg(F.countDistinct("key").alias("rows"), F.countDistinct("source").alias("sources"), F.countDistinct("line").alias("titles"))
        .where((F.col("rows") >= TEMPLATE_ROWS) & (F.col("sources") > 1) & (F.col("titles") >= PAGE_TITLES * F.col("rows")))
    )
    templated = found.where("kind = 'page'").join(hinted(pages.select("wording")), "wording", "left_semi")
    whole = found.where("kind in ('void', 'filler')")
    # flag: the page has prose of its own
    notices = found.where("kind in ('notice', 'wordless')")
    templates = (
        notices.groupBy("kind", "wording")
        .agg(F.countDistinct(F.when(~F.col("flag"), F.col("key"))).alias("pages"), F.countDistinct("source").alias("sources"))
        .where((F.col("pages") >= TEMPLATE_ROWS) & (F.col("sources") > 1))
        .select("kind", "wording")
    )
    alone = notices.where((F.col("kind") == "notice") & (~F.col("flag") | (F.col("part") == "title")))
    repeated = notices.join(hinted(templates), ["kind", "wording"], "left_semi")
    return unfilled.select("key").union(templated.select("key")).union(whole.select("key")).union(alone.select("key")).union(repeated.select("key")).distinct()
