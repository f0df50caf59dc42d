"""One unambiguous form for timestamps written in many.

All valid readings of a value are generated as an array.  Where a value has
two, the reading is chosen by Viterbi over the record order of its source:
changing the order of day and month costs, and so does a moment that lies
before the one in front of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions.timestamps import iso_text, with_interpretations
from corvina.session import hinted, stash

#: The states of the path: which part of a slashed date comes first.
ORDERS = ("day_first", "month_first")
#: Cost of a change of order, of a value that the order can't read, and the most that one jump back costs.
SWITCH, UNREADABLE, BACK = 1_000.0, 5.0, 3.0
#: Rows after which a stretch of one source is closed, so that no task holds more.
STRETCH = 200_000


def long_values(tables: list[tuple[str, DataFrame, str, str, Column, list[tuple[str, Column]]]]) -> DataFrame:
    """(tabela, campo, id, source, at, value, local) of fields of several tables.

    Each entry is (name, rows, key column, source column, order, fields); a
    field is (column, zone of values that have none).
    """
    parts = []
    for name, df, key, source, order, fields in tables:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("value"), zone.alias("local")) for c, zone in fields]))
        parts.append(
            df.select(F.lit(name).alias("tabela"), F.col(key).cast("long").alias("id"), F.col(source).cast("long").alias("source"), order.cast("long").alias("at"), cells.alias("cell"))
            .select("tabela", "cell.campo", "id", "source", "at", "cell.value", "cell.local")
            .where(F.col("value").isNotNull())
        )
    return reduce(DataFrame.unionByName, parts)


def _jump(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cost of a moment that lies more than a day before the one in front of it; 0 where one is unknown."""
    back = np.nan_to_num(np.maximum(before - after, 0) / 86_400)
    return np.minimum(BACK, np.log1p(back) / 2) * (back > 1)


def _path(first: np.ndarray, last: np.ndarray, read: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs [start, end] of the best paths through a stretch and their states [value, start, end].

    ``read`` [value, state]: seconds of each reading (nan where there is none);
    ``before``: the moment in front of each value where that has one reading
    only.  Where it is nan, the value in front is one of the path's own, and
    the jump back is charged between the readings that the path gives the two.
    """
    n, k = read.shape
    emit = np.where(np.isnan(read), UNREADABLE, 0.0) + _jump(before[:, None], read)
    change = SWITCH * (1 - np.eye(k))
    cost = np.where(np.eye(k, dtype=bool), emit[0], np.inf) if n else np.where(np.eye(k, dtype=bool), 0.0, np.inf)
    came = np.zeros((n, k, k), np.int8)
    for i in range(1, n):
        step = cost[:, :, None] + change[None]
        if np.isnan(before[i]):
            step = step + _jump(read[i - 1][:, None], read[i][None])[None]
        came[i] = step.argmin(axis=1)
        cost = step.min(axis=1) + emit[i]
    states = np.zeros((n, k, k), np.int8)
    for s in range(k):
        for e in range(k):
            now = e
            for i in range(n - 1, -1, -1):
                states[i, s, e] = now
                now = came[i, s, now]
    return cost, states


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths of the ambiguous values of each stretch, for every state at its start and end."""
    columns = ["tabela", "campo", "id", "source", "stretch", "first_at", "states", "cost"]
    held: list[pd.DataFrame] = []
    number = 0

    def close() -> pd.DataFrame | None:
        nonlocal held, number
        if not held:
            return None
        part, held = pd.concat(held, ignore_index=True), []
        number += 1
        single = part["single"].to_numpy(float)
        idx = np.where(np.isnan(single), -1, np.arange(len(part)))
        ahead = np.concatenate([[-1], np.maximum.accumulate(idx)[:-1]])
        before = np.where(ahead >= 0, single[ahead], np.nan)
        pick = part["slashed"].to_numpy(bool)
        if not pick.any():
            return None
        # What stands in front of a slashed value is the last single one only if no slashed one came since.
        slash = np.concatenate([[-1], np.maximum.accumulate(np.where(pick, np.arange(len(part)), -1))[:-1]])
        before = np.where(ahead > slash, before, np.nan)
        mine = part[pick]
        read = mine[["day_first", "month_first"]].to_numpy(float)
        cost, states = _path(read[0], read[-1], read, before[pick])
        k = len(ORDERS)
        return pd.DataFrame({
            "tabela": mine["tabela"], "campo": mine["campo"], "id": mine["id"], "source": mine["source"].astype("Int64"), "stretch": f"{part['pid'].iloc[0]}-{number}",
            "first_at": int(mine["at"].fillna(0).iloc[0]), "states": list(states.reshape(len(mine), k * k).astype(int)), "cost": [cost.reshape(-1)] + [None] * (len(mine) - 1),
        })[columns]

    last = object()
    for batch in batches:
        starts = [0, *np.flatnonzero(batch["source"].fillna(-1).to_numpy()[1:] != batch["source"].fillna(-1).to_numpy()[:-1]) + 1, len(batch)]
        for a, b in zip(starts, starts[1:], strict=False):
            if a == b:
                continue
            source = batch["source"].iloc[a]
            source = None if pd.isna(source) else source
            if source != last or sum(map(len, held)) >= STRETCH:
                if (done := close()) is not None:
                    yield done
                last = source
            held.append(batch.iloc[a:b])
    if (done := close()) is not None:
        yield done


def _end_states(stretches: pd.DataFrame) -> pd.DataFrame:
    """The best states at start and end of each stretch of one source, in order."""
    stretches = stretches.sort_values(["first_at", "stretch"])
    k, change = len(ORDERS), SWITCH * (1 - np.eye(len(ORDERS)))
    best, came = np.zeros(k), []
    for i, c in enumerate(stretches["cost"]):
        cost = np.asarray(c, float).reshape(k, k)
        enter = best[:, None] + (change if i else np.zeros((k, k)))
        at_start, via = enter.min(axis=0), enter.argmin(axis=0)
        total = at_start[:, None] + cost
        came.append((total.argmin(axis=0), via))
        best = total.min(axis=0)
    end, out = int(best.argmin()), []
    for start_of, via in reversed(came):
        start = int(start_of[end])
        out.append(start * k + end)
        end = int(via[start])
    return pd.DataFrame({"stretch": stretches["stretch"], "pair": out[::-1]})


def normalise_timestamps(values: DataFrame) -> DataFrame:
    """(tabela, campo, id, source, form, normal) of every value that names a real day or moment.

    ``values`` is what :func:`long_values` gives.  Rows are range-partitioned by
    source and record order, so a source of any size is split over many tasks;
    each task solves its stretches for every state at their two ends, and only
    one small matrix a stretch is joined to choose among them.  A slashed date
    that the chosen order can't read is impossible and left out, like null,
    relative, cut off and impossible values.  Ties go to the day first.
    Sources without any slashed date need no path.
    """
    parsed = with_interpretations(values, "value", "local").select("tabela", "campo", "id", "source", "at", "read")
    seconds = lambda r: F.coalesce(r["seconds"], r["days"].cast("long") * 86400)
    slashed = F.exists("read", lambda r: r["form"].isin(*ORDERS))
    of = lambda order: seconds(F.get(F.filter("read", lambda r: r["form"] == order), F.lit(0))).cast("double").alias(order)
    # Written before it is filtered: the filter would be pushed below, and there repeat every expression.
    parsed = stash(parsed.withColumn("slashed", slashed)).where(F.size("read") > 0)
    ordered = (
        parsed.select("tabela", "campo", "id", "source", "at", "slashed", F.when(~F.col("slashed"), seconds(F.get("read", F.lit(0)))).cast("double").alias("single"), *[F.when(F.col("slashed"), of(o)).alias(o) for o in ORDERS])
        .repartitionByRange("source", "at")
        .sortWithinPartitions("source", "at", "tabela", "id", "campo")
        .withColumn("pid", F.spark_partition_id())
    )
    paths = stash(ordered.mapInPandas(_stretches, "tabela string, campo string, id long, source long, stretch string, first_at long, states array<int>, cost array<double>"))
    ends = paths.where(F.col("cost").isNotNull()).groupBy("source").applyInPandas(lambda pdf: _end_states(pdf), "stretch string, pair int")
    chosen = paths.join(hinted(ends), "stretch").select("tabela", "campo", "id", F.element_at(F.array(*map(F.lit, ORDERS)), F.element_at("states", F.col("pair") + 1) + 1).alias("order"))
    keys = ["tabela", "campo", "id"]
    clear = parsed.where(~F.col("slashed")).withColumn("pick", F.get("read", F.lit(0)))
    dated = parsed.where("slashed").join(chosen.distinct(), keys).withColumn("pick", F.get(F.filter("read", lambda r: r["form"] == F.col("order")), F.lit(0)))
    both = clear.select(*keys, "source", "pick").unionByName(dated.select(*keys, "source", "pick")).where(F.col("pick").isNotNull())
    return both.select(*keys, "source", F.col("pick.form").alias("form"), iso_text(F.col("pick.days"), F.col("pick.seconds")).alias("normal")).distinct()
