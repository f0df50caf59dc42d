"""Articles and queue rows as they arrive: streams of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into ``path``, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_seen(stream: DataFrame, unique: str, at: str, late: str = "30 days") -> DataFrame:
    """``stream`` with each value of ``unique`` once, remembered for as long as rows may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([unique])


def outlet_counts(stream: DataFrame, at: str, outlet: str = "veiculo_id", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, outlet, n, clickbait): articles of each outlet in windows of time, closed when no row can be late any more."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width), outlet).agg(F.count("*").alias("n"), F.avg("score_clickbait").alias("clickbait"))
    return w.select(F.col("window.start").alias("start"), outlet, "n", F.round("clickbait", 4).alias("clickbait"))


def anchored_counts(stream: DataFrame, at: str, key: str, days: int = 5, late: str = "7 days") -> DataFrame:
    """(key, start, end, n, late): articles of each key in windows that begin at the first day not covered, as each closes.

    A window is closed by a day beyond it, or by the watermark when nothing
    more comes.  Rows before the window that is open are counted as late in a
    row of their own day, those behind the watermark are dropped; null days and
    keys are left out.
    """

    def count(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        out = []
        if state.hasTimedOut:
            yield pd.DataFrame([(name[0], start, start + days, n, False)], columns=["key", "start", "end", "n", "late"])
            state.remove()
            return
        seen = sorted(int(d) for batch in batches for d in batch["day_"])
        for d in seen:
            if start is not None and d < start:
                out.append((name[0], d, d, 1, True))
            elif start is None or d > start + days:
                if start is not None:
                    out.append((name[0], start, start + days, n, False))
                start, n = d, 1
            else:
                n += 1
        state.update((start, n))
        state.setTimeoutTimestamp(max((start + days + 1) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "start", "end", "n", "late"])

    placed = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.unix_date(F.col(at).cast("date")).alias("day_"), at)
    done = placed.groupBy("key").applyInPandasWithState(count, "key string, start int, end int, n long, late boolean", "start int, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(F.col("key").alias(key), F.date_from_unix_date("start").alias("start"), F.date_from_unix_date("end").alias("end"), "n", "late")


def admit(stream: DataFrame, path: str, checkpoint: str, settle: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Appends to the table at ``path`` what ``settle(old, new)`` keeps of each batch, and stops when all files are read.

    A batch that is run again after a failure overwrites its own folder, so
    nothing is appended twice.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != number).select(*batch.columns)
        except AnalysisException:  # the first batch finds no table
            old = batch.limit(0)
        settle(old, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
