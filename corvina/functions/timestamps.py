"""Reading written dates and times.

Each form is recognised by one pattern and rewritten to the same seven fields,
so one rule set checks days, hours and zones for all of them.  Everything stays
in Spark's own expressions and is independent of the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by their first letters, Portuguese, Spanish and English.
MONTHS = {
    "jan": 1, "ene": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12, "dic": 12,
}
# Offsets in minutes of the zones that stand as letters.
ZONES = {"z": 0, "utc": 0, "gmt": 0, "brt": -180, "brst": -120}

_ZONE = r"(z|utc|gmt|brt|brst|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
_CLOCK = r"(\d{1,2})[:h](\d{2})(?:[:m](\d{2})(?:[.,]\d+)?s?)?"
_AT = r"(?:,?\s*(?:-\s*)?(?:[àa]s\s+)?" + _CLOCK + r"\s*(am|pm|a\.m\.|p\.m\.)?\s*" + _ZONE + r")?"
_WEEKDAY = r"(?:[a-zà-ú]+(?:-feira)?\.?,?\s+)?"
#: (form, pattern on the lower-case value, its fields: year|month|day|hour|minute|second|half|zone).
FORMS = [
    ("iso", r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[t\s]\s*" + _CLOCK + r"\s*" + _ZONE + r")?$", "$1|$2|$3|$4|$5|$6||$7"),
    ("ymd_slash", r"^(\d{4})/(\d{1,2})/(\d{1,2})" + _AT + "$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:[t\s]?(\d{2})(\d{2})(?:(\d{2})(?:[.,]?\d{3,6})?)?\s*" + _ZONE + r")?$", "$1|$2|$3|$4|$5|$6||$7"),
    ("day_first", r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})" + _AT + "$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    ("named", r"^" + _WEEKDAY + r"(\d{1,2})[ºo°]?\s*(?:de\s+|-)?([a-zç]{3})[a-zç]*\.?\s*(?:de\s+|-)?(\d{4})" + _AT + "$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    ("month_first_named", r"^" + _WEEKDAY + r"([a-zç]{3})[a-zç]*\.?\s+(\d{1,2}),?\s+(\d{4})" + _AT + "$", "$3|$1|$2|$4|$5|$6|$7|$8"),
]
EPOCH = r"^(\d{10})(?:\d{3}|\d{6})?$"


def _reading(df: DataFrame, name: str, form: Column, month: str, day: str) -> DataFrame:
    """Adds struct(form, days, seconds): seconds since 1970 in UTC, null for a day only; null if there is no such moment."""
    y, m, d = F.col("year_"), F.col(month), F.col(day)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    good = (y >= 1000) & m.between(1, 12) & (d >= 1) & (d <= longest)
    df = df.withColumn("days_", F.when(good, F.datediff(F.to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))))
    df = df.withColumn("wall_", F.when(F.col("clock_ok_"), F.col("days_").cast("long") * 86400 + F.col("clock_")))
    unzoned = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("wall_"), F.col("local_")))
    df = df.withColumn("seconds_", F.when(F.col("zone_") == "", unzoned).otherwise(F.when(F.abs("offset_") <= 14 * 60, F.col("wall_") - F.col("offset_") * 60)))
    found = F.col("days_").isNotNull() & (F.col("day_only_") | F.col("seconds_").isNotNull())
    out = F.when(found, F.struct(form.alias("form"), F.col("days_").alias("days"), F.when(~F.col("day_only_"), F.col("seconds_")).alias("seconds")))
    return df.withColumn(name, out).drop("days_", "wall_", "seconds_")


def with_interpretations(df: DataFrame, value: str, local: str) -> DataFrame:
    """``df`` with ``read``, array<struct<form, days, seconds>>: all valid readings of a written date or moment.

    ``local`` names the zone of values that have none (UTC where null).  Dates
    in digits with slashes are read with the day and with the month first;
    everything else has one reading at most.  Null, cut off, relative and
    impossible values have none.
    """
    kept = df.columns
    df = df.withColumn("v_", F.lower(F.regexp_replace(value, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", ""))).withColumn("local_", F.coalesce(local, F.lit("UTC")))
    form = F.when(F.col("v_").rlike(EPOCH), "epoch")
    for name, pattern, _ in FORMS:
        form = form.when(F.col("v_").rlike(pattern), name)
    df = df.withColumn("form_", form)
    pieces = F.when(F.col("form_") == "epoch", F.regexp_replace("v_", EPOCH, "$1"))
    for name, pattern, order in FORMS:
        pieces = pieces.when(F.col("form_") == name, F.regexp_replace("v_", pattern, order))
    df = df.withColumn("fields_", F.split(pieces, r"\|"))
    field = lambda i: F.get("fields_", F.lit(i))
    number = lambda i: field(i).try_cast("int")
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    dated = F.col("form_") != "epoch"
    df = df.withColumns({
        "since_": F.when(~dated, field(0).try_cast("long")),
        "year_": F.when(dated, number(0)),
        "month_": F.when(dated, F.coalesce(number(1), F.try_element_at(months, field(1)))),
        "day_": F.when(dated, number(2)),
        "hour_": number(3), "minute_": number(4), "second_": F.coalesce(number(5), F.lit(0)),
        "day_only_": F.coalesce(field(3) == "", F.lit(True)), "half_": field(6), "zone_": F.coalesce(field(7), F.lit("")),
    })
    df = df.withColumn("year_", F.when(F.col("year_") < 100, F.col("year_") + 2000).otherwise(F.col("year_"))).withColumn(
        "hour_", F.when(F.col("half_") == "", F.col("hour_")).when(F.col("hour_").between(1, 12), F.col("hour_") % 12 + F.when(F.col("half_").startswith("p"), 12).otherwise(0))
    )
    df = df.withColumns({
        "clock_ok_": F.col("hour_").between(0, 23) & F.col("minute_").between(0, 59) & F.col("second_").between(0, 59),
        "clock_": F.col("hour_") * 3600 + F.col("minute_") * 60 + F.col("second_"),
        "digits_": F.regexp_replace("zone_", "[^0-9]", ""),
    })
    minutes = F.substring("digits_", 1, 2).try_cast("int") * 60 + F.coalesce(F.substring("digits_", 3, 2).try_cast("int"), F.lit(0))
    named = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    df = df.withColumn("offset_", F.coalesce(F.try_element_at(named, F.col("zone_")), F.when(F.col("zone_").startswith("-"), -minutes).otherwise(minutes)))
    df = _reading(df, "first_", F.col("form_"), "month_", "day_")
    df = _reading(df, "second_first_", F.lit("month_first"), "day_", "month_")
    epoch = F.when(F.col("since_").isNotNull(), F.struct(F.lit("epoch").alias("form"), F.floor(F.col("since_") / 86400).cast("int").alias("days"), F.col("since_").alias("seconds")))
    swapped = F.when(F.col("form_") == "day_first", F.col("second_first_"))
    return df.select(*[F.col(c) for c in kept], F.array_compact(F.array(epoch, F.when(dated, F.col("first_")), swapped)).alias("read"))


def iso_text(days: Column, seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``, or ``YYYY-MM-DD`` where seconds are null."""
    day = lambda n: F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int")).cast("string")
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    rest = F.pmod(seconds, F.lit(86400))
    full = F.concat(day(F.floor(seconds / 86400)), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("Z"))
    return F.when(seconds.isNull(), day(days)).otherwise(full)
