"""Main text and furniture of pages.

A page is read as a tree: the page, its blocks (lists with their heading,
single paragraphs) and their lines.  Gradient-boosted trees over features of
each line node, its siblings and its place in the tree give the odds of being
furniture; the tree is then decoded from the blocks down, so that a line can't
contradict the block that holds it.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.furniture import ENDED, FURNITURE_SHARE, seed_furniture
from corvina.llm.lines import frequent_lines
from corvina.llm.residue import FUNCTION
from corvina.llm.text import bare_key, hash64, line_key
from corvina.session import small, stash

#: Least share of a source's rows from which the share of a line is told to the classifier.
KNOWN_SHARE = 0.005
#: Lines whose shares every worker holds, at 12 bytes each; beyond it they are joined line by line.
HELD_SHARES = 1_000_000
#: Documents that the classifier is fitted on, at most.
SAMPLE_DOCS = 3_000
HEADING = re.compile(r"^\W*(?:[úu]ltimas\s+d[eoa]|voc[êe]\s+pode\s+gostar|mais\s+lidas|relacionadas?\b|leia\s+(?:mais|tamb[ée]m)\W*$|veja\s+(?:mais|tamb[ée]m)\W*$)")
NUMBERED = re.compile(r"^\s*\d{1,2}[.)]\s")
SOURCED = re.compile(r"\([^()]{4,70}\)\W*$")
INNER = re.compile(r"[^\W\d]{2}[.!?…][\"”’»)]*\s+[A-ZÀ-Ú“\"«]")
SEPARATORS = ("|", "•", "·", "»", ">", "/", "  ")
CONTEXT = ("words", "ended", "seed", "share", "prose")
FLAGS = ("words", "ended", "seed", "bullet", "numbered", "lower_start", "heading", "sourced", "prose")
DETAILS = ("chars", "function", "digits", "upper", "separators", "quoted", "colon", "link", "commas", "inner")
COLUMNS = ("share", "titled", *FLAGS, *DETAILS)
COL = {name: i for i, name in enumerate(COLUMNS)}


def line_flags(s: str, low: str, parts: list[str]) -> tuple:
    """What a stripped line (``low``: in lower case, ``parts``: its words) shows by itself, in the order of ``FLAGS``."""
    n = len(parts)
    ended = s[-1:] in ".!?…" or ENDED.search(s[-16:]) is not None
    seed = seed_furniture(s, low, ended)
    prose = n >= 8 and not seed and (ended or INNER.search(s) is not None) and sum(map(FUNCTION.__contains__, parts)) > 0.1 * n
    if prose:
        return n, ended, seed, s[:2] in ("- ", "* ", "> "), s[0].isdecimal() and NUMBERED.match(s) is not None, s[0].islower(), False, False, True
    sourced = not ended and ")" in s[-90:] and SOURCED.search(s[-90:]) is not None
    return n, ended, seed, s[:2] in ("- ", "* ", "> "), s[:1].isdecimal() and NUMBERED.match(s) is not None, s[:1].islower(), HEADING.match(low) is not None, sourced, False


def line_details(s: str, low: str) -> tuple:
    """What only the classifier looks at, in the order of ``DETAILS``."""
    parts, size = s.split(), len(s) or 1
    n = len(parts) or 1
    return (
        math.log1p(len(s)), sum(map(FUNCTION.__contains__, low.split())) / n, sum(map(s.count, "0123456789")) / size, sum(map(str.isupper, "".join([p[0] for p in parts]))) / n,
        sum(map(s.count, SEPARATORS)), s.startswith(("“", '"', "«", ">")), ":" in s, "http" in s or "www." in s or "<a " in s, s.count(","), len(INNER.findall(s)),
    )


@dataclass
class Shares:
    """In what share of a source's rows a line stands, where that is greatest: sorted hashes of lines and their shares.

    Where they are too many to be held, ``joined`` has (line, share) instead,
    and :meth:`beside` puts each text's own shares into a column.
    """

    lines: np.ndarray
    share: np.ndarray
    joined: DataFrame | None = None

    def held(self) -> Shares:
        return Shares(self.lines, self.share)

    def of(self, lines: np.ndarray) -> np.ndarray:
        if not len(self.lines):
            return np.zeros(len(lines))
        at = np.minimum(np.searchsorted(self.lines, lines), len(self.lines) - 1)
        return np.where(self.lines[at] == lines, self.share[at], 0.0)

    def beside(self, picked: DataFrame) -> DataFrame:
        """``picked`` (body, ...) with ``known``: a map from line number to share, null where they are held."""
        if self.joined is None:
            return picked.withColumn("known", F.lit(None).cast("map<int,double>"))

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(t, i, hash64(k)) for t, body in zip(batch["text_"], batch["body"], strict=True) for i, piece in enumerate(body.split("\n"), 1) if (k := line_key(piece))]
                yield pd.DataFrame(out, columns=["text_", "linha", "line"], dtype="int64")

        marked = picked.withColumn("text_", F.xxhash64("body"))
        lines = marked.select("text_", "body").where(F.col("body").isNotNull()).dropDuplicates(["text_"]).mapInPandas(split, "text_ long, linha int, line long")
        known = lines.join(self.joined, "line").groupBy("text_").agg(F.map_from_entries(F.collect_list(F.struct("linha", "share"))).alias("known"))
        return marked.join(known, "text_", "left").drop("text_")


def known_shares(docs: DataFrame, source: str, text: str, held: int = HELD_SHARES) -> Shares:
    """Shares of the lines that stand in many rows of a source; pages copied elsewhere take theirs along.

    A source has at most (mean lines a row) / ``KNOWN_SHARE`` of them.  Up to
    ``held`` counted lines are handed to the workers; more are joined.
    """
    # Ten rows at least: copies of one article are no furniture, however small the source.
    frequent = stash(frequent_lines(docs, source, text, KNOWN_SHARE, 10).groupBy("line").agg(F.max(F.col("n_docs") / F.col("n_rows")).alias("share")))
    if not small(frequent, held):
        return Shares(np.empty(0, np.int64), np.empty(0), frequent)
    rows = frequent.toPandas().sort_values("line")
    return Shares(rows["line"].to_numpy(np.int64), rows["share"].to_numpy(np.float32))


class Pages:
    """Line features of many pages, holding those of lines that come again; without ``details`` only what the seeds need."""

    def __init__(self, shares: Shares, details: bool = False, held: int = 120_000) -> None:
        self.shares, self.details, self.held = shares, details, held
        self.width = len(COLUMNS) - 2 if details else len(FLAGS)
        self.pack = struct.Struct(f"{self.width}f").pack
        self.static: dict[str, tuple[bytes, int]] = {}

    def _line(self, line: str) -> tuple[bytes, int]:
        if (found := self.static.get(line)) is None:
            s = line.strip()
            low = s.lower()
            parts = low.split()
            row = line_flags(s, low, parts)
            found = self.pack(*row, *(line_details(s, low) if self.details else ())), hash64(bare_key("".join(parts)))
            if len(line) < 200 and len(self.static) < self.held:
                self.static[line] = found
        return found

    def lines(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Document number, line number, own features (share and match with the title first), and text of every line that isn't empty."""
        linha, rows, hashes, lines, sizes, titled = [], [], [], [], [], []
        for title, body in zip(batch["title"], batch["body"], strict=True):
            before = len(lines)
            for i, piece in enumerate((body or "").split("\n"), 1):
                if piece and not piece.isspace():
                    row, h = self._line(piece)
                    linha.append(i), rows.append(row), hashes.append(h), lines.append(piece)
            sizes.append(len(lines) - before)
            named = line_key(title or "")
            titled.append(hash64(named) if named else 0)
        doc, linha = np.repeat(np.arange(len(sizes)), sizes), np.array(linha, np.int64)
        x = np.zeros((len(doc), 2 + self.width), np.float32)
        if not len(doc):
            return doc, linha, x, lines
        hashes = np.array(hashes, np.int64)
        share = self.shares.of(hashes)
        if "known" in batch and batch["known"].notna().any():
            maps = [dict(k) if k is not None else {} for k in batch["known"]]
            share = np.array([maps[d].get(i, 0.0) for d, i in zip(doc, linha, strict=True)])
        x[:, 2:] = np.frombuffer(b"".join(rows), np.float32).reshape(-1, self.width)
        x[:, 0] = np.log(np.maximum(share, 1e-3))
        x[:, 1] = hashes == np.array(titled, np.int64)[doc]
        return doc, linha, x, lines

    def of(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """What :meth:`lines` gives, the features followed by those of siblings and of the place in the tree."""
        doc, linha, x, lines = self.lines(batch)
        if not len(doc):
            return doc, linha, np.empty((0, N_FEATURES), np.float32), lines
        own = {name: x[:, COL[name]] for name in CONTEXT}
        out = [x]
        for step in (-3, -2, -1, 1, 2, 3):
            near = np.roll(np.arange(len(doc)), -step)
            inside = doc[near] == doc
            if step > 0:
                inside[len(doc) - step :] = False
            else:
                inside[:-step] = False
            for name in CONTEXT:
                out.append(np.where(inside, own[name][near], -1)[:, None])
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[start, len(doc)])
        first, many = np.repeat(start, size), np.repeat(size, size)
        at = np.arange(len(doc)) - first
        prose = np.cumsum(own["prose"])
        before = prose - own["prose"] - np.repeat(prose[start] - own["prose"][start], size)
        total = np.repeat(np.add.reduceat(own["prose"], start), size)
        out += [v[:, None] for v in (at, many - 1 - at, at / many, before, total - before - own["prose"])]
        return doc, linha, np.concatenate(out, axis=1).astype(np.float32), lines


N_FEATURES = len(COLUMNS) + 6 * len(CONTEXT) + 5


def seed_labels(doc: np.ndarray, x: np.ndarray, lines: list[str]) -> np.ndarray:
    """1 furniture, 0 article, -1 unknown: what repetition, wording and lists say by themselves."""
    share, titled = np.exp(x[:, 0]), x[:, 1] > 0
    prose, seed, bullet, sourced = (x[:, COL[n]] > 0 for n in ("prose", "seed", "bullet", "sourced"))
    label = np.full(len(doc), -1)
    label[prose] = 0
    label[bullet & ~prose & (share < FURNITURE_SHARE)] = 0
    label[(share >= FURNITURE_SHARE) | seed] = 1
    label[sourced & ~prose & (x[:, COL["words"]] < 16)] = 1
    label[np.char.startswith(np.array([s.lstrip()[:2] for s in lines], dtype="U2"), "> ") & ~prose] = 1
    label[titled] = 0
    label[blocks(doc, x)[1]] = 1
    # A short line between two paragraphs is a subhead.
    inner = np.zeros(len(doc), bool)
    inner[1:-1] = (label[:-2] == 0) & (label[2:] == 0) & prose[:-2] & prose[2:] & (doc[:-2] == doc[1:-1]) & (doc[2:] == doc[1:-1])
    label[inner & (label == -1)] = 0
    return label


def blocks(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block number of each line, and whether it stands in a list under a heading of the page.

    Such a list begins at its heading and takes in the lines that neither are
    prose nor bullets, nor furniture by their own words; numbered lines in a
    row form a list without a heading.
    """
    col = lambda n: x[:, COL[n]] > 0
    heading, stop = col("heading"), col("prose") | col("bullet") | col("seed") | (x[:, 0] > np.log(FURNITURE_SHARE)) | (x[:, COL["words"]] > 30)
    numbered = col("numbered") & ~col("prose") & ~col("lower_start")
    block, listed = np.zeros(len(doc), np.int64), np.zeros(len(doc), bool)
    b, open_, last = -1, False, -1
    for i in range(len(doc)):
        if doc[i] != last:
            open_, last = False, doc[i]
        goes_on = open_ and not stop[i]
        if heading[i] or not goes_on:
            if not (numbered[i] and i and numbered[i - 1] and doc[i] == doc[i - 1] and not heading[i]):
                b += 1
        open_ = bool(heading[i]) or goes_on
        block[i], listed[i] = b, open_
    return block, listed


def decode(doc: np.ndarray, block: np.ndarray, odds: np.ndarray, mixed: float = 4.0) -> np.ndarray:
    """Whether each line is furniture: blocks of one kind unless their lines outweigh ``mixed``."""
    if not len(doc):
        return np.zeros(0, bool)
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    whole = np.add.reduceat(odds, start)  # furniture against article
    best = np.add.reduceat(np.abs(odds), start)  # each line its own way
    size = np.diff(np.r_[start, len(doc)])
    free = (size == 1) | (best - np.abs(whole) > mixed * 2)
    return np.where(np.repeat(free, size), odds > 0, np.repeat(whole > 0, size))


def _trees(model: GBTClassificationModel) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(weight, feature, threshold, children, value) of every tree, read from its nodes."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        feature, threshold, children, value = [], [], [], []

        def walk(node) -> int:
            at = len(feature)
            feature.append(0), threshold.append(np.inf), children.append([at, at]), value.append(node.prediction())
            if node.subtreeDepth() > 0:
                feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
                children[at] = [walk(node.leftChild()), walk(node.rightChild())]
            return at

        walk(tree._java_obj.rootNode())
        out.append((float(weight), np.array(feature), np.array(threshold), np.array(children), np.array(value)))
    return out


def _log_odds(trees: list, x: np.ndarray, depth: int) -> np.ndarray:
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for weight, feature, threshold, children, value in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            at = children[at, (x[rows, feature[at]] > threshold[at]).astype(np.int64)]
        total += weight * value[at]
    return 2 * total


def fit_furniture(docs: DataFrame, shares: Broadcast, sample_docs: int = SAMPLE_DOCS, trees: int = 24, depth: int = 4) -> tuple[float, list]:
    """(odds without features, trees) of a classifier of lines, fitted on at most ``sample_docs`` documents.

    ``docs`` has source, title, body and known shares.  The labels are the
    seeds that repetition and wording give; what they leave open is not trained
    on, and no seed has a say once the trees are fitted.  Labels of one kind
    give that kind's odds for every line, no labels even odds.
    """

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = Pages(shares.value, details=True)
        for batch in batches:
            doc, _, x, lines = pages.of(batch)
            if not len(doc):
                continue
            label = seed_labels(doc, x, lines)
            # Half of the time the words that gave a seed away are hidden, so that its place has to tell.
            hide = (np.arange(len(doc)) * 2654435761 % 97) < 48
            x[hide, COL["seed"]] = 0
            known = label >= 0
            if not known.any():
                continue
            yield pd.DataFrame({"label": label[known].astype(float), "x": list(x[known].astype(float))})

    total = docs.count()
    sampled = docs.where(F.xxhash64("body") % 1_000_003 < F.lit(1_000_003 * min(1.0, sample_docs / max(total, 1)) * 2 - 1_000_003)).limit(sample_docs)
    rows = stash(sampled.repartition(4).mapInPandas(examples, "label double, x array<double>")).select("label", array_to_vector("x").alias("features"))
    kinds = [r.label for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return (5.0 if kinds == [1.0] else -5.0 if kinds else 0.0), []
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32, subsamplingRate=0.7).fit(rows)
    return 0.0, _trees(model)


def furniture_lines(docs: DataFrame, key: str = "id", source: str = "veiculo_id", title: str = "titulo", body: str = "corpo", sample_docs: int = SAMPLE_DOCS, trees: int = 24, depth: int = 4) -> DataFrame:
    """(key, linha): the lines of each body that are not article text.

    ``linha`` counts from 1 over all pieces split at line ends; empty lines are
    never listed.  Null bodies and empty tables give no rows; a null title or
    source is allowed; rows repeated under one key are decoded one by one;
    other columns are not read.
    """
    picked = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("long").alias("source"), F.col(title).alias("title"), F.col(body).alias("body")).where(F.col("body").isNotNull())
    sc = docs.sparkSession.sparkContext
    counted = known_shares(docs, source, body)
    shares = sc.broadcast(counted.held())
    picked = counted.beside(picked)
    model = sc.broadcast(fit_furniture(picked, shares, sample_docs, trees, depth))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = Pages(shares.value, details=True)
        alone, fitted = model.value
        for batch in batches:
            for a in range(0, len(batch), 2_000):
                part = batch.iloc[a : a + 2_000]
                doc, linha, x, _ = pages.of(part)
                if not len(doc):
                    continue
                gone = decode(doc, blocks(doc, x)[0], alone + _log_odds(fitted, x, depth))
                yield pd.DataFrame({"key": part["key"].to_numpy()[doc[gone]], "linha": linha[gone]})

    return picked.mapInPandas(find, "key long, linha int")
