"""Reading of written timestamps: forms, zones, clock changes, and the order of day and month."""

import pytest
from pyspark.sql import functions as F

from corvina.functions.timestamps import iso_text, with_interpretations
from corvina.operators.timestamps import long_values, normalise_timestamps

SP = "America/Sao_Paulo"
ONE = [
    ("2016-03-10", SP, "2016-03-10"), ("20180108020331", "UTC", "2018-01-08T02:03:31Z"), ("202207110048", "UTC", "2022-07-11T00:48:00Z"), ("20181004063912674", "UTC", "2018-10-04T06:39:12Z"),
    ("20240130T214155Z", "UTC", "2024-01-30T21:41:55Z"), ("1556252166000", SP, "2019-04-26T04:16:06Z"), ("1723246773", SP, "2024-08-09T23:39:33Z"), (" 20210124220258\n", "UTC", "2021-01-24T22:02:58Z"),
    ("Sat, 18 Feb 2017 21:22:47 -0400", SP, "2017-02-19T01:22:47Z"), ("Mon, 02 Mar 2015 16:10:01 GMT", SP, "2015-03-02T16:10:01Z"), ("Tue, 30 Dec 2025 07:10 BRT", SP, "2025-12-30T10:10:00Z"), ("Tue, 10 Nov 2015 07:28 BRST", SP, "2015-11-10T09:28:00Z"),
    ("2018-07-08T19:09:11-03", SP, "2018-07-08T22:09:11Z"), ("2017-10-13T17:34:40.597203-0400", SP, "2017-10-13T21:34:40Z"), ("2020-09-26T13:25:51", "America/Manaus", "2020-09-26T17:25:51Z"), ("23 out. 2023 - 13:33", SP, "2023-10-23T16:33:00Z"),
    ("28 de julho de 2017, às 12h28", SP, "2017-07-28T15:28:00Z"), ("Sábado, 22 de Abril de 2023 15h49", SP, "2023-04-22T18:49:00Z"), ("3 de março de 2023", SP, "2023-03-03"), ("26/06/2021 10:20 PM", SP, "2021-06-27T01:20:00Z"),
    # an hour that is skipped keeps the offset before the change, an hour that comes twice is the first
    ("2018-11-04 00:30:00", SP, "2018-11-04T03:30:00Z"), ("2018-02-17 23:30:00", SP, "2018-02-18T01:30:00Z"),
]
NONE = ["", " ", "-", "Invalid Date", "há 3 horas", "ontem às 16h07", "14h55", "2022022", "Thu, 04 Ma", "0000-00-00", "2021-02-30T11:19:58", "2018-13-30", "31/04/2023", "2020-01-01 25:00", "00000000000000", None, "x" * 100_000]


def test_forms(spark):
    df = spark.createDataFrame([(v, z, w) for v, z, w in ONE], "v string, z string, w string")
    got = with_interpretations(df, "v", "z").select("v", "w", iso_text(F.col("read")[0]["days"], F.col("read")[0]["seconds"]).alias("n"))
    assert not [r for r in got.collect() if r.n != r.w]


def test_no_moment(spark):
    df = spark.createDataFrame([(v, SP) for v in NONE], "v string, z string")
    assert with_interpretations(df, "v", "z").where(F.size("read") > 0).count() == 0


def test_ambiguous_has_both_readings(spark):
    row = with_interpretations(spark.createDataFrame([("03/04/2020", SP)], "v string, z string"), "v", "z").first()
    assert [r.form for r in row.read] == ["day_first", "month_first"]


def _values(spark, rows):
    df = spark.createDataFrame(rows, "id long, veiculo_id long, quando string, criado_em timestamp, read string, source string")
    return long_values([("t", df, "id", "veiculo_id", F.unix_seconds("criado_em"), [("quando", F.lit(SP))])])


def test_order_is_one_throughout_a_source(spark):
    stamp = lambda m, d: __import__("datetime").datetime(2020, m, d, 12)
    rows = [(1, 1, "01/02/2020", stamp(1, 3), "x", "y"), (2, 1, "01/25/2020", stamp(1, 26), "x", "y"), (3, 1, "02/03/2020", stamp(2, 4), "x", "y"), (4, 2, "01/02/2020", stamp(2, 2), None, None), (5, 2, "25/02/2020", stamp(2, 26), None, None), (6, 2, "02/25/2020", stamp(2, 27), None, None)]
    got = {r.id: r.normal for r in normalise_timestamps(_values(spark, rows)).collect()}
    assert got == {1: "2020-01-02", 2: "2020-01-25", 3: "2020-02-03", 4: "2020-02-01", 5: "2020-02-25"}


def test_record_order_decides_without_evidence(spark):
    """No day above 12: the reading that doesn't jump back in time wins."""
    stamp = lambda m, d: __import__("datetime").datetime(2020, m, d, 12)
    rows = [(1, 1, "2020-03-01", stamp(3, 1), "", ""), (2, 1, "03/04/2020", stamp(3, 4), "", ""), (3, 1, "2020-03-05", stamp(3, 5), "", ""), (4, 1, "03/06/2020", stamp(3, 6), "", ""), (5, 1, "2020-06-01", stamp(6, 1), "", ""), (6, 1, "06/02/2020", stamp(6, 2), "", "")]
    got = {r.id: r.normal for r in normalise_timestamps(_values(spark, rows)).collect()}
    assert got[6] == "2020-06-02"


def test_empty_null_and_repeated_rows(spark):
    assert normalise_timestamps(_values(spark, [])).count() == 0
    rows = [(1, None, "2020-01-01", None, None, None), (1, None, "2020-01-01", None, None, None), (2, None, None, None, None, None)]
    assert [(r.id, r.normal) for r in normalise_timestamps(_values(spark, rows)).collect()] == [(1, "2020-01-01")]


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_match_brute_force(seed):
    import itertools

    import numpy as np

    from corvina.operators.timestamps import BACK, SWITCH, UNREADABLE, _path

    rng = np.random.default_rng(seed)
    read = rng.integers(0, 50, (7, 2)) * 86_400.0
    read[rng.random((7, 2)) < 0.3] = np.nan
    before = rng.integers(0, 50, 7) * 86_400.0
    before[rng.random(7) < 0.4] = np.nan
    cost, states = _path(read[0], read[-1], read, before)

    def price(path):
        total = 0.0
        for i, s in enumerate(path):
            total += SWITCH * (i > 0 and path[i - 1] != s)
            if np.isnan(read[i, s]):
                total += UNREADABLE
                continue
            front = before[i] if not np.isnan(before[i]) else read[i - 1, path[i - 1]] if i else np.nan
            if (back := (front - read[i, s]) / 86_400) > 1:
                total += min(BACK, np.log1p(back) / 2)
        return total

    for a, b in itertools.product((0, 1), repeat=2):
        paths = [p for p in itertools.product((0, 1), repeat=7) if p[0] == a and p[-1] == b]
        assert cost[a, b] == pytest.approx(min(map(price, paths)))
        assert price(tuple(states[:, a, b])) == pytest.approx(cost[a, b])


def test_order_of_a_source_with_slashed_dates_only(spark):
    """Nothing but the jumps between the dates themselves tells the order."""
    days = [(d, m) for m in (1, 2, 3, 4) for d in range(1, 13, 2)]
    rows = [(i, 1, f"{m:02d}/{d:02d}/2020", None, None, None) for i, (d, m) in enumerate(days)]
    got = {r.id: r.normal for r in normalise_timestamps(_values(spark, rows)).collect()}
    assert got == {i: f"2020-{m:02d}-{d:02d}" for i, (d, m) in enumerate(days)}
