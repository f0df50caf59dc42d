"""Lines and blocks of lines repeated across the documents of one source.

Suffix arrays over line identifiers: the lines of every document are its text,
cut where a line stands in no other document of the source.  Each suffix knows
from which length on it is new in its document, so that the common prefixes of
sorted neighbours give every repeated block with the number of distinct
documents that hold it.  Those numbers alone decide what is repeated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.text import hash64, line_key
from corvina.session import hinted, stash

#: Lines of a block, at most; longer blocks come out as overlapping pieces, their lines all the same.
BLOCK_LINES = 64
#: Distinct suffixes a task counts before it hands them on.
HELD_SUFFIXES = 200_000


def document_lines(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(rid, key, source, linhas, lines): the lines of each document as 64-bit identifiers.

    ``linhas`` counts from 1 over all pieces split at line ends; lines with
    nothing but digits, spacing and closing punctuation are left out.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            linhas, lines = [], []
            for body in batch["text"]:
                at, of = [], []
                for i, piece in enumerate(body.split("\n"), 1):
                    if piece and (name := line_key(piece)):
                        if (h := known.get(name)) is None:
                            h = hash64(name)
                            if len(name) < 300 and len(known) < 200_000:
                                known[name] = h
                        at.append(i), of.append(h)
                linhas.append(at), lines.append(of)
            yield batch.drop(columns="text").assign(linhas=linhas, lines=lines)

    picked = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(source).cast("long").alias("source"), F.col(text).alias("text"))
    return picked.where(F.col("text").isNotNull()).mapInPandas(read, "rid long, key long, source long, linhas array<int>, lines array<long>")


def common_prefix(x: tuple, y: tuple) -> int:
    n = 0
    for a, b in zip(x, y, strict=False):
        if a != b:
            break
        n += 1
    return n


def new_suffixes(runs: list[list[int]], block: int = BLOCK_LINES) -> Iterator[tuple[tuple, int]]:
    """(suffix, length from which it is new) of one document, whose sorted suffixes share shorter prefixes with the one before."""
    suffixes = sorted({tuple(run[i : i + block]) for run in runs for i in range(len(run))})
    if suffixes:
        yield suffixes[0], 1
    for before, suffix in pairwise(suffixes):
        yield suffix, common_prefix(before, suffix) + 1


def suffix_array(lines: DataFrame, floor: DataFrame) -> DataFrame:
    """(source, least, suffix, since, weight), sorted by source and suffix within ranges of them.

    ``lines`` comes from :func:`document_lines`, ``floor`` is (source, least).
    Lines that stand in one document only part its text; that bound can't
    decide anything, as ``least`` is two or more.  Equal suffixes of many
    documents are one row.
    """
    places = lines.select("rid", "source", F.explode(F.arrays_zip("linhas", "lines")).alias("at")).select("rid", "source", F.col("at.linhas").alias("linha"), F.col("at.lines").alias("line"))
    shared = lines.select("source", F.explode(F.array_distinct("lines")).alias("line")).groupBy("source", "line").agg(F.count("*").alias("n")).where("n > 1").select(F.col("source").alias("s_"), F.col("line").alias("l_"))
    marked = places.join(shared, F.col("source").eqNullSafe(F.col("s_")) & (F.col("line") == F.col("l_")), "left")
    texts = marked.groupBy("rid", "source").agg(F.sort_array(F.collect_list(F.struct("linha", "line", F.col("l_").isNull().alias("gap")))).alias("at")).select("source", F.col("at.line").alias("line"), F.col("at.gap").alias("gap"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flush() -> pd.DataFrame:
            found = pd.DataFrame([(s, list(x), since, n) for (s, x, since), n in held.items()], columns=["source", "suffix", "since", "weight"]).astype({"source": "Int64"})
            held.clear()
            return found

        for batch in batches:
            for src, line, gap in zip(batch["source"], batch["line"], batch["gap"], strict=True):
                src = None if pd.isna(src) else int(src)
                runs, run = [], []
                for x, g in zip(line.tolist(), gap.tolist(), strict=True):
                    if g:
                        runs.append(run)
                        run = []
                    else:
                        run.append(x)
                runs.append(run)
                held.update((src, suffix, since) for suffix, since in new_suffixes(runs))
            if len(held) >= HELD_SUFFIXES:
                yield flush()
        if held:
            yield flush()

    counted = texts.mapInPandas(expand, "source long, suffix array<long>, since int, weight long").groupBy("source", "suffix", "since").agg(F.sum("weight").alias("weight"))
    sized = stash(counted.join(hinted(floor.select(F.col("source").alias("s_"), "least")), F.col("source").eqNullSafe(F.col("s_"))).select("source", "least", "suffix", "since", "weight"))
    # Ranges, so that one line that begins a third of all suffixes is no single task.
    return sized.repartitionByRange("source", "suffix").sortWithinPartitions("source", "suffix")


def repeated_blocks(suffixes: DataFrame) -> DataFrame:
    """(source, block, n_docs): maximal blocks of lines in at least ``least`` documents of a source.

    ``suffixes`` comes from :func:`suffix_array`.  A stack over the common
    prefixes of neighbours counts each block once, at its full length; prefixes
    that reach over the border of a range come out in parts, which are added up.
    """

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[int, Counter]] = []  # prefixes of the suffix before that may still grow: length, documents by since
        last: tuple = ()
        src = least = None
        first: tuple | None = None  # the first suffix of the range, its source, and how many documents share its prefixes
        first_src, head, leads = None, Counter(), True
        out: list[tuple] = []

        def close(common: int) -> None:
            while stack and stack[-1][0] > common:
                length, docs = stack.pop()
                n = sum(docs.values())
                if n >= least and not (src == first_src and last[:length] == first[:length]):
                    out.append((src, list(last[:length]), least, n, True))
                below = max(common, stack[-1][0] if stack else 0)
                if below:
                    kept = Counter({f: w for f, w in docs.items() if f <= below})
                    if stack and stack[-1][0] == below:
                        stack[-1][1].update(kept)
                    else:
                        stack.append((below, kept))

        def table() -> pd.DataFrame:
            found = pd.DataFrame(out, columns=["source", "block", "least", "n_docs", "whole"]).astype({"source": "Int64"})
            out.clear()
            return found

        for batch in batches:
            for s, suffix, at_least, since, weight in zip(batch["source"], batch["suffix"], batch["least"], batch["since"], batch["weight"], strict=True):
                s, suffix = None if pd.isna(s) else int(s), tuple(suffix.tolist())
                if first is None:
                    first, first_src, head_least = suffix, s, at_least
                close(common_prefix(last, suffix) if s == src else 0)
                src, last, least = s, suffix, at_least
                shared = common_prefix(first, suffix) if leads and s == first_src else 0
                leads = shared > 0
                for m in range(since, shared + 1):
                    head[m] += weight
                if since <= len(suffix):
                    if stack and stack[-1][0] == len(suffix):
                        stack[-1][1][since] += weight
                    else:
                        stack.append((len(suffix), Counter({since: weight})))
            if out:
                yield table()
        if first is None:
            return
        both = common_prefix(first, last) if leads else 0
        out += [(first_src, list(first[:m]), head_least, head[m], False) for m in range(both + 1, len(first) + 1)]
        for m in range(1, len(last) + 1):
            out.append((src, list(last[:m]), least, sum(w for length, docs in stack if length >= m for f, w in docs.items() if f <= m), False))
        yield table()

    found = stash(suffixes.mapInPandas(intervals, "source long, block array<long>, least long, n_docs long, whole boolean"))
    parts = found.where(~F.col("whole")).groupBy("source", "block", "least").agg(F.sum("n_docs").alias("n_docs")).where("n_docs >= least")
    blocks = found.where("whole").select("source", "block", "n_docs").unionByName(parts.select("source", "block", "n_docs"))
    # A part that always goes on alike is no maximal block.
    longer = blocks.where(F.size("block") > 1).select(F.col("source").alias("s_"), F.expr("slice(block, 1, size(block) - 1)").alias("b_"), F.col("n_docs").alias("n_")).distinct()
    return blocks.join(longer, F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")) & (F.col("n_docs") == F.col("n_")), "left_anti")


def repeated_lines(docs: DataFrame, key: str = "id", source: str = "veiculo_id", text: str = "corpo", share: float = 0.05, least: int = 5) -> DataFrame:
    """(key, source, linha, line): lines of repeated blocks, at each place where they stand.

    A line is repeated if its text (letter case, spacing, digits and closing
    punctuation aside) stands in at least ``least`` (two or more) rows of its
    source and in at least ``share`` of the source's rows.  ``linha`` counts
    from 1 over all pieces of the text split at line ends.  Null texts and
    empty tables give no rows; a null source is a source of its own; rows
    repeated under one key are listed once each; other columns of ``docs`` are
    not read.
    """
    lines = stash(document_lines(docs, key, source, text))
    rows = docs.groupBy(F.col(source).cast("long").alias("source")).agg(F.count("*").alias("n_rows"))
    floor = rows.select("source", F.greatest(F.lit(max(least, 2)), F.ceil(F.col("n_rows") * F.lit(float(share)))).cast("long").alias("least"))
    blocks = repeated_blocks(suffix_array(lines, floor))
    covered = blocks.select(F.col("source").alias("s_"), F.explode("block").alias("l_")).distinct()
    places = lines.select("key", "source", F.explode(F.arrays_zip("linhas", "lines")).alias("at")).select("key", "source", F.col("at.linhas").alias("linha"), F.col("at.lines").alias("line"))
    return places.join(hinted(covered), F.col("source").eqNullSafe(F.col("s_")) & (F.col("line") == F.col("l_")), "left_semi")


def without_lines(docs: DataFrame, places: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with the lines at ``places`` (key, linha) taken out of ``text``; other columns stay."""
    gone = places.groupBy(F.col("key").alias("key_")).agg(F.collect_set("linha").alias("gone_"))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("gone_", i + 1)), "\n")
    joined = docs.join(gone, docs[key] == F.col("key_"), "left")
    return joined.select(*[F.when(F.col("gone_").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns])
