"""Texts cut off by field limits or broken transfers.

Two kinds of evidence are joined as odds.  Lengths: for every source a
right-censored log-normal is fitted by maximum likelihood, and at each length
where values pile up the share that the distribution can't explain is the
posterior of having been cut there; it is the prior of the ending.  Endings:
how often the last word ends sentences or lines among all its uses, how often
whole texts of the source lack a closing sign, and broken words and tags.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.boilerplate import COL, KNOWN_SHARE, Pages, Shares, known_shares, seed_labels
from corvina.llm.text import DIGITS, hash64, line_key
from corvina.session import hinted, stash

#: A tag or an entity that never closes.
BROKEN = re.compile(r"<[/a-zA-Z!][^<>]*$|&#?\w{0,8}$|&(?:amp;)+#?\w{0,8};?$|[A-Za-z]%[0-9A-F]?$|\\u?[0-9a-f]{0,3}$")
#: Signs of an ellipsis or of more to come, set behind a text.
MORE = re.compile(r"\s*(?:\[\s*(?:\.{2,}|…|\+)\s*\]|\(\s*(?:\.{3}|…)\s*\)|\.{3}|…)\s*$")
#: Ends of sentences, quotations, addresses, and of headlines that name who is quoted.
CLOSED = re.compile(r"[.!?…][\"'”’»)\]]*\s*$|[”»\")\]]\s*$|https?://\S+\s*$|\S@\S+\s*$|”,?\s+diz\s+[ao]s?\s+[\w-]+(?:\s+[A-ZÀ-Ú][\w'-]+){2,}\s*$")
OPEN = re.compile(r"[,;:(“«–—-]\s*$")
#: Signs around a word, and those that close a sentence before them.
EDGE, QUOTES, STOPS = "\"'“”‘’«»()[]*.,;:!?…", "\"'”’»)]", ".!?…"
#: Odds (natural logarithm) of a cut against a whole text for each form of ending; ``bare`` is measured by source.
FORM_ODDS = {"closed": -9.0, "broken": 9.0, "open": 6.0, "marked": 5.0, "listed": -1.5}
#: Odds of a bare line of one sentence with furniture behind it, which may be the headline of another article.
HEADLINE_ODDS = -2.5
#: Documents that end in the same short line, from which it is no end of an article, and its odds.
SAME_ENDS, SAME_END_ODDS = 3, -6.0
#: Share of a word's uses at possible cuts from which it is taken for a fragment.
FRAGMENT = 0.25
#: Share of cuts that fall inside a word, and of cut texts without a closing sign.
INSIDE_WORD, BARE_IF_CUT = 0.6, 0.95
#: Words of a headline, at most.
HEADLINE_WORDS = 22
#: Bounds of what a last word may say either way.
WORD_ODDS = 4.0


def ending(line: str, bullet: bool) -> tuple[str, str]:
    """(form, last word) of the last line of an article."""
    line = line.strip()
    form = "broken" if BROKEN.search(line) else "listed" if bullet else "bare"
    if form != "broken":
        if (more := MORE.search(line)) and not CLOSED.search(line[: more.start()]):
            line, form = line[: more.start()], "marked"
        elif CLOSED.search(line):
            form = "closed"
        elif OPEN.search(line):
            form = "open"
    said = DIGITS.sub("0", line.lower()).split()
    return form, said[-1].strip(EDGE) if said else ""


def shapes(line: str) -> tuple[list[str], list[int]]:
    """The words of a line as they are counted (lower case, digits alike, bare), and where sentences end."""
    raw = DIGITS.sub("0", line.lower()).split()
    ends = [i for i, t in enumerate(raw) if t[-1] in STOPS or (t[-1] in QUOTES and t.rstrip(QUOTES)[-1:] in STOPS and t.rstrip(QUOTES))]
    said = [t.strip(EDGE) for t in raw]
    return said, ends[1:] if ends and ends[0] == 0 and said[0] == "0" else ends  # "3." in front numbers the line


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def censored_fit(length: np.ndarray, count: np.ndarray, cut: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of log lengths by maximum likelihood, values marked ``cut`` being at least so long.

    EM: the moments of the cut values are those of the normal beyond their limit.
    """
    y = np.log(np.maximum(length, 1))
    mu, sigma = float(np.average(y, weights=count)), float(np.sqrt(np.average((y - np.average(y, weights=count)) ** 2, weights=count))) or 0.1
    for _ in range(rounds):
        z = (y - mu) / sigma
        tail = np.maximum(_normal_tail(z), 1e-12)
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        m1 = np.where(cut, mu + sigma * hazard, y)
        m2 = np.where(cut, sigma * sigma * (1 + z * hazard) + 2 * mu * m1 - mu * mu, y * y)
        new = float(np.average(m1, weights=count))
        spread = float(np.sqrt(max(np.average(m2, weights=count) - new * new, 1e-4)))
        if abs(new - mu) + abs(spread - sigma) < 1e-6:
            break
        mu, sigma = new, spread
    return mu, sigma


def length_limits(lengths: pd.DataFrame, least: int = 3, excess: float = 4.0) -> pd.DataFrame:
    """(source, measure, n, posterior): lengths of one source, by one measure, at which values were cut.

    ``lengths`` is its histogram (source, measure, n, rows).  Lengths that hold
    ``excess`` times what their neighbourhood does are candidates; the fit is
    made with them censored, and the posterior is the part of their rows beyond
    what the density and the neighbourhood explain.
    """
    lengths = lengths.sort_values("n")
    n, rows = lengths["n"].to_numpy(float), lengths["rows"].to_numpy(float)
    total = rows.sum()
    cum = np.r_[0, np.cumsum(rows)]
    width = np.maximum(10, n * 0.03)
    lo, hi = np.searchsorted(n, n - width), np.searchsorted(n, n + width, "right")
    around = (cum[hi] - cum[lo] - rows) / (2 * width)
    cand = (rows >= least) & (rows >= excess * np.maximum(around, 0.3))
    if not cand.any():
        return pd.DataFrame({"source": pd.array([], "Int64"), "measure": pd.array([], "str"), "n": np.empty(0, np.int64), "posterior": np.empty(0)})
    mu, sigma = censored_fit(n, rows, cand)
    density = total * np.exp(-(((np.log(np.maximum(n, 1)) - mu) / sigma) ** 2) / 2) / (np.maximum(n, 1) * sigma * math.sqrt(2 * math.pi))
    explained = np.maximum(density, around)
    posterior = 1 - np.minimum(explained, rows) / rows
    # How many lengths would hold as many rows by chance, against those that do.
    grid = np.arange(int(n.min()), int(n.max()) + 1)
    at_grid = np.interp(grid, n, explained)
    for r in np.unique(rows[cand]):
        log_k = np.cumsum(np.r_[0, np.log(np.arange(1, r))])
        below = sum(np.exp(-at_grid + k * np.log(np.maximum(at_grid, 1e-12)) - log_k[k]) for k in range(int(r)))
        chance = np.maximum(1 - below, 0).sum() / np.count_nonzero(rows >= r)
        posterior[rows == r] *= 1 - min(chance, 1.0)
    return pd.DataFrame({"source": lengths["source"].astype("Int64").array[cand], "measure": lengths["measure"].array[cand], "n": n[cand].astype(np.int64), "posterior": posterior[cand]})


def article_endings(docs: DataFrame, source: str, title: str, body: str, key: str, shares: Shares) -> DataFrame:
    """The lines that may end each article, and how often words end sentences, counted in the task.

    kind 'end': key, source, chars and bytes of the body, article (characters
    of the article without furniture), last (nothing follows the line), form,
    word, spaced, single (one sentence no longer than a headline).  The last line that is no furniture may end the article; so
    may those before it, as long as what follows looks like headlines.
    kind 'word': n uses of a word, n_end of them at the end of a sentence,
    title or line with another line behind it.
    """
    columns = ["kind", "key", "source", "chars", "bytes", "article", "last", "word", "form", "spaced", "single", "line", "n", "n_end"]
    held = docs.sparkSession.sparkContext.broadcast(shares.held())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = Pages(held.value)
        seen: Counter = Counter()
        finals: Counter = Counter()
        for batch in batches:
            out = []
            for a in range(0, len(batch), 2_000):
                part = batch.iloc[a : a + 2_000]
                doc, _, x, lines = pages.lines(part)
                if not len(doc):
                    continue
                # Short lines that many pages of a source have end no article.
                kept = np.flatnonzero((seed_labels(doc, x, lines) != 1) & ((x[:, 0] <= np.log(KNOWN_SHARE)) | (x[:, COL["prose"]] > 0)))
                of: dict[int, list[int]] = {}
                for i in kept.tolist():
                    of.setdefault(int(doc[i]), []).append(i)
                for t in part["title"]:
                    if t and (said := shapes(t)[0]):
                        seen.update(said), finals.update(said[-1:])
                keys, sources, bodies = part["key"].to_numpy(), part["source"], part["body"].tolist()
                for d, own in of.items():
                    size = sum(len(lines[i]) + 1 for i in own) - 1
                    src = sources.iloc[d]
                    top = True
                    for i in reversed(own):
                        said, ends = shapes(lines[i])
                        seen.update(said)
                        inner = len(ends) > 1 or (len(ends) == 1 and ends[0] != len(said) - 1)
                        if not top and not ends and said:
                            finals[said[-1]] += 1
                        form, word = ending(lines[i], x[i, COL["bullet"]] > 0) if top else ("", "")
                        finals.update(said[e] for e in ends if form != "marked" or e < len(said) - 1)
                        if top:
                            out.append(("end", keys[d], None if pd.isna(src) else int(src), len(bodies[d]), len(bodies[d].encode("utf-8", "replace")), size, i + 1 == len(doc) or doc[i + 1] != d, word, form, lines[i][-1:] == " ", not inner and len(said) <= HEADLINE_WORDS, hash64(line_key(lines[i])), 1, 0))
                            top = form in ("bare", "closed") and not inner and len(said) <= HEADLINE_WORDS and not (form == "closed" and x[i, COL["prose"]] > 0)
                            size -= len(lines[i]) + 1
            if out:
                yield pd.DataFrame(out, columns=columns).astype({"source": "Int64"})
            if len(seen) > 400_000:
                yield counts(seen, finals)
                seen, finals = Counter(), Counter()
        if seen:
            yield counts(seen, finals)

    def counts(seen: Counter, finals: Counter) -> pd.DataFrame:
        got = pd.DataFrame([("word", w, n, finals[w]) for w, n in seen.items()], columns=["kind", "word", "n", "n_end"])
        return got.assign(key=0, source=pd.array([None] * len(got), "Int64"), chars=0, bytes=0, article=0, last=False, form="", spaced=False, single=False, line=0)[columns]

    picked = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("long").alias("source"), F.col(title).alias("title"), F.col(body).alias("body")).where(F.col("body").isNotNull() & (F.col("body") != ""))
    return shares.beside(picked).mapInPandas(read, "kind string, key long, source long, chars int, bytes int, article int, last boolean, word string, form string, spaced boolean, single boolean, line long, n long, n_end long")


def truncated(docs: DataFrame, key: str = "id", source: str = "veiculo_id", title: str = "titulo", body: str = "corpo", base: float = 0.05, fits: bool = True) -> DataFrame:
    """(key, source, chars, form, posterior, probability, cut): how sure it is that each article was cut.

    ``base`` is the share of cut texts expected away from any limit; standing
    at a limit of its source (in characters, bytes, or characters of the
    article where furniture follows) a text has the posterior of the censored
    fit instead, unless ``fits`` is off.  The ending then weighs for or against
    a cut: its form, how often its last word ends sentences, and how rarely
    whole texts of the source stop without a closing sign.  Complete sentences,
    quotations, lists and texts whose furniture alone was cut are not cut.
    Null and empty texts give no rows; rows repeated under one key come out once
    for each length; other columns are not read.
    """
    read = stash(article_endings(docs, source, title, body, key, known_shares(docs, source, body)))
    ends = read.where("kind = 'end'").drop("kind", "n", "n_end")
    sizes = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in ("chars", "bytes", "article")])
    # Copies of one text, which end in the same line, are one.
    measured = ends.where("last or form <> 'closed'").select("source", "line", F.explode(sizes).alias("m")).select("source", "line", "m.measure", "m.n").distinct()
    histogram = measured.groupBy("source", "measure", "n").agg(F.count("*").alias("rows"))
    limits = stash(histogram.groupBy("source", "measure").applyInPandas(lambda pdf: length_limits(pdf), "source long, measure string, n long, posterior double"))
    placed = ends
    for m in ("chars", "bytes", "article"):
        by = limits.where(F.col("measure") == m).select(F.col("source").alias("s_"), F.col("n").alias("n_"), F.col("posterior").alias(f"at_{m}"))
        placed = placed.join(hinted(by), F.col("source").eqNullSafe(F.col("s_")) & (F.col(m) == F.col("n_")), "left").drop("s_", "n_")
    counted = read.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))
    # How often any word ends a sentence, and how many of those are met once or twice.
    whole = F.broadcast(counted.agg(
        ((F.sum("n_end") + 1) / (F.sum("n") + 20)).alias("rate"), ((F.sum(F.when(F.col("n") <= 2, F.col("n_end"))) + 1) / (F.sum("n_end") + 20)).alias("rare"),
    ))
    same = ends.where("single").groupBy("line").agg(F.count("*").alias("n_same")).where(F.col("n_same") >= SAME_ENDS)
    placed = placed.join(same, "line", "left")
    own = ends.where("form not in ('closed', 'broken', 'open')").groupBy("word").agg(F.count("*").alias("n_own"))
    known = own.join(counted, "word", "left").crossJoin(whole)
    # Uses of the word elsewhere than at endings that may be cuts themselves.
    elsewhere = F.greatest(F.coalesce("n", F.lit(0)) - F.col("n_own"), F.lit(0))
    bound = lambda x: F.greatest(F.lit(-WORD_ODDS), F.least(F.lit(WORD_ODDS), x))
    says = F.when((elsewhere == 0) | (F.col("n_own") >= FRAGMENT * F.col("n")), F.log(F.lit(INSIDE_WORD) / F.least(F.col("rare"), F.lit(INSIDE_WORD)))).otherwise(F.log(F.col("rate") / ((F.coalesce("n_end", F.lit(0)) + F.col("rate") / 2) / (elsewhere + 0.5))))
    words_say = known.select("word", bound(F.coalesce(says, F.lit(0.0))).alias("says"))
    judged = placed.join(words_say, "word", "left").withColumn("says", F.when(F.col("form").isin("closed", "broken", "open"), 0.0).otherwise(F.coalesce("says", F.lit(0.0))))
    at = lambda m: F.coalesce(f"at_{m}", F.lit(0.0))
    stands = F.when(F.col("last"), F.greatest(at("chars"), at("bytes"), at("article"))).otherwise(at("article")) if fits else F.lit(0.0)
    posterior = F.greatest(F.lit(base), stands)
    # Bare ends away from any limit, with words that end sentences, are what whole texts of the source look like.
    habit = judged.groupBy("source").agg(((F.count_if((F.col("form") == "bare") & (F.col("says") < -0.5) & (stands < 0.5)) + 1) / (F.count("*") + 30)).alias("habit")).withColumnRenamed("source", "s_")
    judged = judged.join(hinted(habit), F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    form = F.coalesce(*[F.when(F.col("form") == f, F.lit(odds)) for f, odds in FORM_ODDS.items()], F.log(F.lit(BARE_IF_CUT) / F.col("habit")))
    headline = F.when(F.col("single") & F.col("n_same").isNotNull(), SAME_END_ODDS).when((F.col("form") == "bare") & F.col("single") & ~F.col("last"), HEADLINE_ODDS).otherwise(0.0)
    spaced = F.when(F.col("form").isin("bare", "open") & F.col("spaced") & F.col("last"), 2.0).otherwise(0.0)
    prior = F.least(posterior, F.lit(0.98))
    probability = 1 / (1 + F.exp(-(F.log(prior / (1 - prior)) + form + F.col("says") + spaced + headline)))
    each = judged.select("key", "source", "chars", "form", "word", "says", "habit", "last", posterior.alias("posterior"), probability.alias("probability"))
    return each.groupBy("key", "source", "chars").agg(F.max_by(F.struct("form", "posterior", "probability", "word", "says", "habit", "last"), "probability").alias("b")).select("key", "source", "chars", "b.*", (F.col("b.probability") > 0.5).alias("cut"))


def truncation_report(docs: DataFrame, judged: DataFrame, key: str = "id", source: str = "veiculo_id") -> DataFrame:
    """(source, n_rows, n_cut, share): how often each source truncates, over all rows it has in ``docs``."""
    rows = docs.groupBy(F.col(source).cast("long").alias("source")).agg(F.count("*").alias("n_rows"))
    cut = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("long").alias("source")).join(judged.where("cut").select("key").distinct(), "key").groupBy(F.col("source").alias("s_")).agg(F.count("*").alias("n_cut"))
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("s_")), "left").select("source", "n_rows", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return joined.withColumn("share", F.round(F.col("n_cut") / F.col("n_rows"), 4))
