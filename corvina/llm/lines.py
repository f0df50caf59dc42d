"""How often each line stands in the documents of its source.

One pass splits the texts and counts lines inside the task, so that furniture
that stands in thousands of documents leaves the task as one row; only then are
the counts shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.text import hash64, line_keys

#: Distinct lines a task holds before it hands its counts on.
HELD_LINES = 400_000


def line_counts(docs: DataFrame, source: str, text: str) -> DataFrame:
    """(source, line, n_docs): rows of each source in which a line stands.

    ``line`` is the 64-bit hash of the line without letter case, spacing,
    digits and closing punctuation.  Null texts and lines with nothing else are
    left out; a line that stands twice in one document counts once; a null
    source is a source of its own (null).
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: defaultdict[int | None, Counter] = defaultdict(Counter)
        for batch in batches:
            for src, body in zip(batch["source"], batch["text"], strict=True):
                src = None if pd.isna(src) else int(src)
                held[src].update(set(line_keys(body)) - {""})
            if sum(map(len, held.values())) >= HELD_LINES:
                yield counted(held)
                held.clear()
        if held:
            yield counted(held)

    def counted(held: dict[int | None, Counter]) -> pd.DataFrame:
        return pd.DataFrame({
            "source": pd.array([s for s, counts in held.items() for _ in counts], dtype="Int64"),
            "line": [hash64(k) for counts in held.values() for k in counts],
            "n_docs": [n for counts in held.values() for n in counts.values()],
        })

    return (
        docs.select(F.col(source).cast("long").alias("source"), F.col(text).alias("text"))
        .where(F.col("text").isNotNull())
        .mapInPandas(count, "source long, line long, n_docs long")
        .groupBy("source", "line")
        .agg(F.sum("n_docs").alias("n_docs"))
    )


def frequent_lines(docs: DataFrame, source: str, text: str, share: float, least: int) -> DataFrame:
    """(source, line, n_docs, n_rows) of lines in at least ``least`` and ``share`` of a source's rows.

    A source has at most (mean lines a row) / ``share`` such lines, however
    many rows it has.  The share counts all rows of the source, null texts too.
    """
    rows = docs.groupBy(F.col(source).cast("long").alias("source_")).agg(F.count("*").alias("n_rows"))
    counts = line_counts(docs, source, text).where(F.col("n_docs") >= least)
    return (
        counts.join(rows, F.col("source").eqNullSafe(F.col("source_")))
        .where(F.col("n_docs") >= F.col("n_rows") * F.lit(float(share)))
        .select("source", "line", "n_docs", "n_rows")
    )
