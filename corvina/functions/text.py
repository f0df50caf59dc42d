"""Column expressions over addresses, titles and bodies of articles."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvina.functions import fixed as X
from corvina.functions.rounding import rounded

_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether a text holds one of the parts."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def hits(text: Column, parts: list[str]) -> Column:
    """How many of the parts a text holds."""
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in parts])


def ascii_lower(text: Column) -> Column:
    """Lower case without accents; other signs beyond ASCII are dropped."""
    return F.regexp_replace(F.lower(F.translate(text, _ACCENTED, _PLAIN)), r"[^\x00-\x7F]", "")


def year_ok(url: Column, expected: Column) -> Column:
    """Whether the years named by an address and by an expected date lie in the period; no year passes."""
    within = lambda pattern, text: F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("int").between(X.FIRST_YEAR, X.LAST_YEAR), F.lit(True))
    return within(r"(20\d{2})", F.coalesce(expected, F.lit(""))) & within(r"[/_-](20\d{2})(?:[/_.-]|$)", F.lower(url))


def url_ok(url: Column, expected: Column) -> Column:
    """Whether an address looks like an article of the period."""
    low = F.lower(url)
    news = [*X.URL_NEWS, *(f"/{y}/" for y in range(X.FIRST_YEAR, X.LAST_YEAR + 1))]
    return F.coalesce(url.startswith("http") & ~any_of(low, X.URL_EXCLUDED) & (F.length(url) >= X.LEAST_URL) & year_ok(url, expected) & any_of(low, news), F.lit(False))


def canonical_url(url: Column) -> Column:
    """https, no default port, no fragment, and without parameters that only track the reader."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^https?://", "https://")
    head = F.regexp_replace(F.regexp_extract(bare, r"^([^?]*)", 1), r"^(https://[^/:]+):(?:80|443)(?=/|$)", "$1")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:amp|ref|utm_[^=]*)(?:=|$)"))
    return F.when(F.size(kept) > 0, F.concat(head, F.lit("?"), F.array_join(kept, "&"))).otherwise(head)


def topic_axis(url: Column, text: Column) -> Column:
    """The topic axis of an article: by a segment of its address, else by words, else by last resorts."""
    content = F.concat(F.lower(url), F.lit(" "), F.lower(F.coalesce(text, F.lit(""))))
    axes = F.array(*map(F.lit, X.AXIS_WORDS))

    def decide(low: Column, content: Column) -> Column:
        scores = F.array(*[hits(content, words) for words in X.AXIS_WORDS.values()])
        # The scores are bound once; the first axis with the most words wins.
        by_words = F.get(F.transform(F.array(scores), lambda s: F.when(F.array_max(s) > 0, F.element_at(axes, F.array_position(s, F.array_max(s)).cast("int")))), F.lit(0))
        last = F.lit(X.DEFAULT_AXIS)
        for axis, words in reversed(X.AXIS_LAST.items()):
            last = F.when(any_of(content, words), axis).otherwise(last)
        out = F.coalesce(by_words, last)
        for axis, parts in reversed(X.AXIS_SEGMENTS.items()):
            out = F.when(any_of(low, parts), axis).otherwise(out)
        return out

    bound = F.array(F.struct(F.lower(url).alias("low"), content.alias("content")))
    return F.when(content.isNotNull(), F.get(F.transform(bound, lambda x: decide(x["low"], x["content"])), F.lit(0))).otherwise(X.DEFAULT_AXIS)


def axis_by_address(url: Column) -> Column:
    """The topic axis that a segment of an address names, null where none does."""
    out = F.lit(None).cast("string")
    for axis, parts in reversed(X.AXIS_SEGMENTS.items()):
        out = F.when(any_of(F.lower(url), parts), axis).otherwise(out)
    return out


def clickbait(title: Column) -> Column:
    """struct(upper, runs, number, triggers, score) of a title; all zero for an empty one."""
    t = F.coalesce(title, F.lit(""))
    letters, upper = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    share = F.when(letters > 0, upper / letters).otherwise(0.0)
    runs = F.regexp_count(t, F.lit(r"[!?]+|\.{3,}"))
    number = t.rlike(r"(?U)\b\d+\b").cast("int")
    plain = ascii_lower(t)
    triggers = reduce(lambda a, b: a + b, [plain.rlike(rf"\b{w}\b").cast("int") for w in X.TRIGGERS])
    score = X.UPPER_WEIGHT * share + X.RUNS_WEIGHT * F.least(F.lit(1.0), runs / 3) + X.NUMBER_WEIGHT * number + X.TRIGGER_WEIGHT * F.least(F.lit(1.0), triggers / 2)
    return F.struct(rounded(share, 4).alias("upper"), runs.alias("runs"), number.alias("number"), triggers.alias("triggers"), rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("score"))


def lexicon_sentiment(text: Column) -> Column:
    """struct(pos, neg, neu, polarity) by which words of good and bad news a text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    p, n = hits(low, X.POSITIVE), hits(low, X.NEGATIVE)
    pos, neg = rounded(p / (p + n + 1.0), 4), rounded(n / (p + n + 1.0), 4)
    return F.struct(pos.alias("pos"), neg.alias("neg"), rounded(1.0 - (pos + neg), 4).alias("neu"), rounded(pos - neg, 4).alias("polarity"))


def tidy(text: Column) -> Column:
    """One kind of line end, single blanks, at most one empty line, no blanks around."""
    t = F.regexp_replace(text, r"\r\n|\r", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n\s*\n+", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def without_signatures(text: Column) -> Column:
    """A body without signatures of newsrooms and prompts; lines that held nothing else are gone."""

    def line(s: Column) -> Column:
        for pattern in X.SIGNATURES:
            s = F.trim(F.regexp_replace(s, f"(?iu){pattern}", ""))
        return s

    lines = F.transform(F.split(text, "\n"), lambda s: line(F.trim(s)))
    return tidy(F.array_join(F.filter(lines, lambda s: s != ""), "\n\n"))


def summary(text: Column, least: int = 30, most: int = 250) -> Column:
    """The first paragraph of more than ``least`` characters, cut at a word after ``most``."""
    first = F.coalesce(F.get(F.filter(F.transform(F.split(text, "\n"), F.trim), lambda p: F.length(p) > least), F.lit(0)), text)
    return F.when(F.length(first) <= most, first).otherwise(F.concat(F.regexp_replace(F.substring(first, 1, most), r"\s+\S*$", ""), F.lit("...")))


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 of the trimmed lower-case title and the first 300 characters of the body."""
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.sha2(F.concat(part(title), F.lit("|||"), F.lower(F.trim(F.substring(F.coalesce(body, F.lit("")), 1, 300)))), 256)


def term_label(term: Column) -> Column:
    """How a term is shown: by the table of known ones, else with blanks and a capital in front."""
    known = F.create_map(*[F.lit(x) for pair in X.TERM_LABELS.items() for x in pair])
    bare = F.regexp_replace(term, "_", " ")
    return F.coalesce(F.try_element_at(known, term), F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substring(bare, 2, 1000))))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility signs (ligatures, full width, hard blanks) as their plain ones; texts in ASCII don't leave the JVM's filter."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _composed(text)).otherwise(text)


def sentiment_input(title: Column, body: Column) -> Column:
    """What a sentiment model reads of an article: its title and the first 300 characters of its body."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.substring(F.coalesce(body, F.lit("")), 1, 300))


def article_date(written: Column, url: Column, head: Column, as_of: Column) -> Column:
    """struct(date, origin): the day of an article by its metadata, its address (day, then month), its meta tags, else ``as_of``."""
    day = lambda text, pattern: F.concat_ws("-", *[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]).try_cast("date")
    month = F.concat(F.concat_ws("-", *[F.regexp_extract(url, r"/(20\d{2})/(\d{2})/", i) for i in (1, 2)]), F.lit("-01")).try_cast("date")
    tag = F.regexp_extract(F.substring(F.coalesce(head, F.lit("")), 1, 5000), r"(?i)(?:published_time|datePublished)[^0-9]{0,30}(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    found = [("metadados", day(written, r"^\s*(\d{4})-(\d{2})-(\d{2})")), ("url_dia", day(url, r"/(20\d{2})/(\d{2})/(\d{2})/")), ("url_mes", month), ("meta", tag), ("coleta", as_of.cast("date"))]
    return F.coalesce(*[F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(name).alias("origin"))) for name, d in found])


def title_terms(title: Column, extra_stopwords: list[str] | None = None) -> Column:
    """The terms of a title: known phrases as one, at least four letters, no stop words; repeats stay."""
    t = F.lower(title)
    for pattern, term in X.PHRASES:
        t = F.regexp_replace(t, f"(?U){pattern}", term)
    stop = F.array(*map(F.lit, [*X.STOPWORDS, *(extra_stopwords or [])]))
    return F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(X.TERM) & ~F.array_contains(stop, w))


def title_label(title: Column, axis: Column) -> Column:
    """A short label: no quotes, cut at 42 characters, with the axis in front."""
    bare = F.regexp_replace(title, "[\"'“”‘’]", "")
    return F.concat(F.initcap(axis), F.lit(": "), F.when(F.length(bare) > 42, F.concat(F.substring(bare, 1, 39), F.lit("..."))).otherwise(bare))
