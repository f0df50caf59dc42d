"""Keyword-stuffed and link-list pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.text import window_hashes, word_hash, words
from corvina.session import stash

URL = re.compile(r"https?://\S+|www\.\S+|<a\s[^>]*>|</a>|\]\([^)]*\)")
SENTENCE_END = re.compile(r"[.!?…][\"'”»)\]]*\s*$")
NEXT_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)]*\s+(?=[A-ZÀ-Ú“\"«¿¡])")
HASHTAG = re.compile(r"#\w+")
# Function words of Portuguese, Spanish and English, folded.
FUNCTION = frozenset(
    "a o as os um uma de do da dos das em no na nos nas por para com e que se ao aos mas ja nao mais como seu sua pelo pela entre sobre ate sem tambem el la los las una del con y en lo su al por the of to in and for is on at with by it this that was will from".split()
)
#: Words of the phrases that are counted: keywords and labels are too short for more.
PHRASE = 2
#: Hosts on which a phrase must stand to count as replicated.
HOSTS = 2
#: Times a page on average from which a phrase is pressed on readers, where it stands on fewer hosts and where it is replicated.
PRESSED, PRESSED_ON_HOSTS = 2.0, 1.5


def _segments(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        for s in NEXT_SENTENCE.split(line):
            if s.strip():
                yield s


def page_evidence(text: str) -> tuple[float, float, float, float, dict[int, int]]:
    """(listed, linked, tagged, stuffed, phrases) of one page.

    listed: share of words outside sentences; linked, tagged: share of words
    in segments with links, and of hashtags; stuffed: share of words in
    sentences that repeat their own content words; phrases: hashes of the
    phrases, numbers aside, inside the segments that are no plain sentences,
    and how often each is said.
    """
    total = listed = linked = stuffed = tags = 0
    phrases: Counter = Counter()
    for s in _segments(text):
        link = bool(URL.search(s))
        bare = URL.sub(" ", s) if link else s
        w = words(bare)
        n = len(w) or 1
        total += n
        content = Counter(x for x in w if x not in FUNCTION and len(x) > 2 and not x.isdigit())
        sentence = not link and n >= 5 and SENTENCE_END.search(s) and sum(x in FUNCTION for x in w) >= 0.15 * n
        if link:
            linked += n
        if "#" in bare:
            tags += sum(len(words(t)) for t in HASHTAG.findall(bare))
        again = sum(c for c in content.values() if c > 1) >= 0.2 * n
        if not sentence:
            listed += n
        elif again:
            stuffed += n
        if not sentence or again:
            w = [x for x in w if not x.isdigit()]
            phrases.update(window_hashes(np.fromiter(map(word_hash, w), np.uint64, len(w)), PHRASE).view(np.int64).tolist())
    total = total or 1
    return listed / total, linked / total, tags / total, stuffed / total, phrases


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", listed: float = 0.5, stitched: float = 0.25, linked: float = 0.5, tagged: float = 0.4, stuffed: float = 0.4, hosts: int = HOSTS) -> DataFrame:
    """(key, listed, linked, tagged, stuffed, pressed, replicated, spam): evidence and verdict per document.

    The phrases of lists and of sentences that repeat themselves are exploded
    and counted by host over the whole crawl: on how many hosts each stands,
    and how often a page says it, on average over its pages or, if that is
    more, over its hosts, so that one host with many pages doesn't outvote the
    others.  ``replicated`` is the share of a page's phrases that stand on at
    least ``hosts`` hosts and are said ``PRESSED_ON_HOSTS`` times, ``pressed``
    the share of those on fewer hosts that are said ``PRESSED`` times.  A page
    is spam if more than ``listed`` of its words stand outside sentences and it
    is stitched mostly from such phrases (replicated + pressed reaches
    ``stitched``), link text or tags; or if ``stuffed`` of its words stand in
    sentences that only repeat a keyword.  Lists that inform are made of
    replicated phrases too, but say each once or twice, so they stay.  Null and
    empty texts are no spam; rows repeated under one key are judged one by one;
    other columns are not read.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, h, *page_evidence(t or "")) for k, h, t in zip(batch["key"], batch["host"], batch["text"], strict=True)]
            found = pd.DataFrame(out, columns=["key", "host", "listed", "linked", "tagged", "stuffed", "said"])
            yield found.assign(phrases=found["said"].map(list), times=found["said"].map(lambda c: list(c.values()))).drop(columns="said")

    pages = stash(
        docs.select(F.col(key).cast("long").alias("key"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
        .mapInPandas(judge, "key long, host string, listed double, linked double, tagged double, stuffed double, phrases array<long>, times array<long>")
        .withColumn("page", F.monotonically_increasing_id())
    )
    said = pages.select("page", "host", F.explode(F.arrays_zip("phrases", "times")).alias("p")).select("page", "host", F.col("p.phrases").alias("phrase"), F.col("p.times").alias("times"))
    # Counted by host first, so that a phrase of all pages is one row a host.
    by_host = said.groupBy("phrase", "host").agg(F.sum("times").alias("times"), F.count("*").alias("pages"))
    by_phrase = by_host.groupBy("phrase").agg((F.sum("times") / F.sum("pages")).alias("by_page"), F.avg(F.col("times") / F.col("pages")).alias("by_host"), F.count("*").alias("n_hosts"))
    # An average over hosts hangs on their order in its last digits.
    phrases = by_phrase.select("phrase", (F.greatest("by_page", "by_host") + 1e-9).alias("rate"), (F.col("n_hosts") >= hosts).alias("on_hosts"))
    replicated = F.col("on_hosts") & (F.col("rate") >= PRESSED_ON_HOSTS)
    pressed = ~F.col("on_hosts") & (F.col("rate") >= PRESSED)
    marked = phrases.where(replicated | pressed).select("phrase", "on_hosts")
    shares = said.join(marked, "phrase").groupBy("page").agg(*[F.sum(F.when(F.col("on_hosts") == is_, F.col("times")).otherwise(0)).alias(name) for is_, name in ((True, "n_replicated"), (False, "n_pressed"))])
    total = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda n: F.coalesce(F.col(n) / total, F.lit(0.0))
    judged = pages.join(shares, "page", "left").withColumns({"pressed": share("n_pressed"), "replicated": share("n_replicated")})
    keywords = F.col("replicated") + F.col("pressed") >= stitched
    lists = (F.col("listed") > listed) & (keywords | (F.col("linked") >= linked) | (F.col("tagged") >= tagged))
    return judged.select("key", "listed", "linked", "tagged", "stuffed", "pressed", "replicated", (lists | (F.col("stuffed") >= stuffed)).alias("spam"))
