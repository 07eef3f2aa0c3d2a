"""Timestamp notations as Catalyst expressions: text to calendar fields, fields to microseconds.

Nothing here depends on the session time zone, and no value makes a job fail: text that denotes no instant gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcorpus.session import fresh

_ZONE = r"(Z|UTC|GMT|CEST|CET|[+-]\d{2}(?::?\d{2})?)?"
#: One pattern for each family of notations, with its groups as year-month-day|hour:minute:second|fraction|zone.
_FAMILIES = (
    (
        r"(?iu)^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:(?:T| +)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? *" + _ZONE + r"(?:\[[A-Za-z_/+-]+\])?)?$",
        "$1-$2-$3|$4:$5:$6|$7|$8",
    ),
    (r"(?iu)^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?" + _ZONE + "$", "$1-$2-$3|$4:$5:$6|$7|$8"),
    (
        r"(?iu)^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:(?:T|,? +)(?:kl\.? *)?(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)? *" + _ZONE + ")?$",
        "$3-$2-$1|$4:$5:$6|$7|$8",
    ),
    (
        r"(?iu)^(?:\p{L}{2,9}\.?,? +)?(?:den +)?(\d{1,2})\.? +(\p{L}{3,9})\.?,? +(\d{4})(?:,? +(?:kl\.? *)?(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)? *" + _ZONE + ")?$",
        "$3-$2-$1|$4:$5:$6|$7|$8",
    ),
)
_NUMBER = r"^-?\d{6,14}$"
#: Month names by their first three letters, Danish and English.
_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "maj": 5, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "dec": 12}
#: Minutes east of UTC of the zone abbreviations.
_ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120}
#: Bare numbers from this size on are milliseconds.
_MILLIS_FROM = 100_000_000_000


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` evaluated once (an expression used many times would be copied into each use)."""
    return F.transform(F.array(value), body)[0]


def _fields(text: Column) -> Column:
    """Date, clock time, fraction and zone by the first family that matches; null where none does."""
    out = F.lit(None).cast("array<string>")
    for pattern, groups in reversed(_FAMILIES):
        out = F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, groups), r"\|")).otherwise(out)
    return out


def _offset(zone: Column) -> Column:
    """Minutes east of UTC of a zone's text; null where it is empty."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.when(F.length(digits) == 4, F.substring(digits, 3, 2)).otherwise(F.lit("0")).cast("int")
    return F.when(zone == "", F.lit(None).cast("int")).when(zone.rlike("^[A-Z]"), F.try_element_at(_literal_map(_ABBREVIATIONS), zone)).when(zone.startswith("-"), -minutes).otherwise(minutes)


def _date(text: Column) -> Column:
    """Year-month-day with the month as a number."""
    name = F.split_part(text, F.lit("-"), F.lit(2))
    number = F.try_element_at(_literal_map({k: str(v) for k, v in _MONTHS.items()}), F.lower(F.substring(name, 1, 3)))
    return F.when(name.rlike("^[0-9]"), text).otherwise(F.concat_ws("-", F.split_part(text, F.lit("-"), F.lit(1)), number, F.split_part(text, F.lit("-"), F.lit(3))))


def _seconds(date: Column, clock: Column) -> Column:
    """Seconds of a date and clock time as if it were UTC, null where there is no such time; 24:00 ends its day."""
    full = F.when(clock == "::", "0:0:0").when(clock.endswith(":"), F.concat(clock, F.lit("0"))).otherwise(clock)
    late = full.rlike("^24:0+:0+$")
    at = F.concat(date, F.lit(" "), F.when(late, "0:0:0").otherwise(full)).try_cast("timestamp_ntz")
    return F.when(~date.startswith("0000"), (at - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("long") + F.when(late, 86_400).otherwise(0))


def _instant(parts: Column) -> Column:
    """``struct<wall, off>`` of what ``_fields`` gives, null where the date, the time or the zone does not exist."""
    micros = F.rpad(F.substring(parts[2], 1, 6), 6, "0").cast("int")
    both = F.struct((_seconds(_date(parts[0]), parts[1]) * 1_000_000 + micros).alias("wall"), _offset(F.upper(parts[3])).alias("off"))
    return _let(both, lambda c: F.when(c["wall"].isNotNull() & (c["off"].isNull() | (F.abs(c["off"]) <= 18 * 60)), c))


def delivered(text: Column) -> Column:
    """``struct<wall, off>`` of a delivered timestamp, null for text that denotes no instant.

    ``wall``: microseconds of the clock time as if it were UTC (bare Unix numbers: the instant itself).
    ``off``: minutes east of UTC, null where the text names no zone.
    """
    number = lambda t: F.when(t.rlike(_NUMBER), t).cast("long")
    unix = lambda n: F.struct(F.when(F.abs(n) < _MILLIS_FROM, n * 1_000_000).otherwise(n * 1_000).alias("wall"), F.lit(0).alias("off"))
    of_text = lambda t: F.when(t.rlike(_NUMBER), _let(number(t), unix)).otherwise(_let(_fields(t), lambda p: F.when(p.isNotNull(), _instant(p))))
    return _let(strip(text), of_text)


def parse_instants(df: DataFrame, source: str, wall: str, offset: str) -> DataFrame:
    """Add the two fields of ``delivered`` as columns ``wall`` and ``offset``, without deciding about missing zones.

    Null in, null out; blank texts, words and impossible dates give nulls; other columns pass through untouched.
    """
    both = fresh("delivered")
    out = df.withColumn(both, delivered(F.col(source).cast("string")))
    return out.withColumns({wall: F.col(both)["wall"], offset: F.col(both)["off"]}).drop(both)


def to_utc(wall: Column, offset: Column, zone: str) -> Column:
    """Microseconds UTC of a clock time; without an offset it is local time of ``zone``.

    A repeated hour means its first pass and a skipped hour is read with the offset before the change.
    """
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))
    return F.when(offset.isNull(), local).otherwise(wall - offset.cast("long") * 60_000_000)
