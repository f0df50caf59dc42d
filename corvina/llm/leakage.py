"""Evaluation passages inside a training corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corvina.llm.text import window_hashes, word_hash, word_spans, words
from corvina.session import small, stash

#: Windows of the items that every worker holds, some 200 bytes each; more are joined.
HELD_WINDOWS = 200_000


def _grams(texts: list[str | None], n: int) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and of all windows inside one text: hash, text number, first word."""
    split = [words(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    flat = np.fromiter((word_hash(w) for ws in split for w in ws), np.uint64, int(sizes.sum()))
    of = np.repeat(np.arange(len(split)), sizes)
    starts = np.cumsum(sizes) - sizes
    h = window_hashes(flat, n)
    inside = of[: len(h)] == of[n - 1 : n - 1 + len(h)] if len(h) else np.empty(0, bool)
    at = np.flatnonzero(inside)
    return split, h[at], of[at], at - starts[of[at]]


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "texto", n: int = 12) -> DataFrame:
    """(doc_key, item_key, first_word, n_windows): documents with at least ``n`` consecutive words of an item.

    Letter case, accents, punctuation and spacing aside.  The hashed windows of
    the items are held by every worker up to a checked size and looked up by
    each document's windows; beyond it both sides are joined on the hash.
    Every hit is compared word by word.  Null texts, texts shorter than ``n``
    words and empty tables give no rows; an item that leaks in several places
    of a document comes out once with all its windows counted; rows repeated
    under one key are one document; other columns are not read.
    """
    hits = leaked_windows(docs, items, doc_key, text, item_key, item_text, n)
    return (
        hits.groupBy("doc", "item")
        .agg(F.min("first_word").alias("first_word"), F.countDistinct("first_word").alias("n_windows"))
        .select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "first_word", "n_windows")
    )


def leaked_windows(docs: DataFrame, items: DataFrame, doc_key: str, text: str, item_key: str, item_text: str, n: int, held_windows: int = HELD_WINDOWS) -> DataFrame:
    """(doc, item, first_word): every window of ``n`` words that a document shares with an item."""
    docs_ = docs.select(F.col(doc_key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    items_ = items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    schema = "doc long, item long, first_word int"

    def item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split, h, of, first = _grams(batch["text"].tolist(), n)
            keys = batch["item"].to_numpy()
            if not len(h):
                continue
            yield pd.DataFrame({"h": h.view(np.int64), "item": keys[of], "gram": [" ".join(split[d][f : f + n]) for d, f in zip(of, first, strict=True)]})

    grams = stash(items_.mapInPandas(item_grams, "h long, item long, gram string").distinct())
    if small(grams, held_windows):
        table: dict[int, list[tuple[int, str]]] = {}
        for r in grams.toLocalIterator():
            table.setdefault(r.h, []).append((r.item, r.gram))
        held = docs.sparkSession.sparkContext.broadcast((np.sort(np.fromiter(table, np.int64, len(table))), table))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, where = held.value
            for batch in batches:
                keys, out = batch["doc"].to_numpy(), []
                split, h, of, first = _grams(batch["text"].tolist(), n)
                h = h.view(np.int64)
                if len(known) and len(h):
                    at = np.searchsorted(known, h)
                    for i in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h):
                        gram = " ".join(split[of[i]][first[i] : first[i] + n])
                        out += [(keys[of[i]], item, first[i]) for item, g in where[int(h[i])] if g == gram]
                yield pd.DataFrame(out, columns=["doc", "item", "first_word"])

        return docs_.mapInPandas(scan, schema)

    def doc_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split, h, of, first = _grams(batch["text"].tolist(), n)
            keys = batch["doc"].to_numpy()
            if not len(h):
                continue
            yield pd.DataFrame({"h": h.view(np.int64), "doc": keys[of], "first_word": first, "gram": [" ".join(split[d][f : f + n]) for d, f in zip(of, first, strict=True)]})

    seen = docs_.mapInPandas(doc_grams, "h long, doc long, first_word int, gram string")
    return seen.join(grams, ["h", "gram"]).select("doc", "item", "first_word")


def without_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "texto", n: int = 12, whole: bool = False) -> DataFrame:
    """``docs`` without the leaked passages (or, if ``whole``, without the documents that hold one), with n_words and n_removed.

    A passage is every run of windows of ``n`` words that stands in an item;
    its words go, with the signs between them; the rest of the text stays as
    it is.  Null texts stay null with no words; rows repeated under one key
    lose the passages of each other only where they hold them themselves.
    """
    found = leaked_windows(docs, items, doc_key, text, item_key, item_text, n)
    starts = found.groupBy("doc").agg(F.array_sort(F.collect_set("first_word")).alias("starts_"))
    joined = docs.join(starts, docs[doc_key] == F.col("doc"), "left").drop("doc")
    if whole:
        joined = joined.where(F.col("starts_").isNull()).withColumn("starts_", F.lit(None).cast("array<int>"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for t, starts in zip(batch[text], batch["starts_"], strict=True):
                if starts is None or not t:
                    texts.append(t), counts.append(len(words(t)) if t else 0), gone.append(0)
                    continue
                at = word_spans(t)
                drop = {i for s in starts for i in range(s, min(s + n, len(at)))}
                kept, last = [], 0
                for i in sorted(drop):
                    if i - 1 not in drop:
                        kept.append(t[last : at[i][0]])
                    last = at[i][1]
                texts.append("".join(kept) + t[last:])
                counts.append(len(at)), gone.append(len(drop))
            yield batch.drop(columns="starts_").assign(**{text: texts, "n_words": counts, "n_removed": gone})

    schema = StructType([*docs.schema.fields, StructField("n_words", IntegerType()), StructField("n_removed", IntegerType())])
    return joined.mapInPandas(cut, schema)


def leak_report(found: DataFrame, items: DataFrame, item_key: str = "item_id", group: str = "conjunto", doc_key: str = "doc_id") -> DataFrame:
    """(group, items, leaked_items, documents): how much of each test set leaked; sets without a leak stand with 0."""
    per_item = found.groupBy(item_key).agg(F.countDistinct(doc_key).alias("n_documents"))
    return (
        items.select(item_key, group).distinct().join(per_item, item_key, "left").groupBy(group)
        .agg(F.count(item_key).alias("items"), F.count("n_documents").alias("leaked_items"), F.coalesce(F.sum("n_documents"), F.lit(0)).alias("documents"))
    )
