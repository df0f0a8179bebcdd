"""Texts that denote a point in time, in any of the usual forms, as one instant. Pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fixloom.functions.let import let

# Zone abbreviations that fix an offset (fixed values).
OFFSETS = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "ut": "+00:00", "wet": "+00:00", "west": "+01:00", "bst": "+01:00", "cet": "+01:00",
    "cest": "+02:00", "eet": "+02:00", "eest": "+03:00", "msk": "+03:00", "ist": "+05:30", "jst": "+09:00", "kst": "+09:00", "awst": "+08:00",
    "acst": "+09:30", "acdt": "+10:30", "aest": "+10:00", "aedt": "+11:00", "nzst": "+12:00", "nzdt": "+13:00", "nst": "-03:30", "ndt": "-02:30",
    "ast": "-04:00", "adt": "-03:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00",
    "pst": "-08:00", "pdt": "-07:00", "akst": "-09:00", "akdt": "-08:00", "hst": "-10:00",
}
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_REST = r"\s*(.*)$"
# Pattern, and where in it year, month, day, hour, minute, second, fraction, am/pm and zone stand (0: nowhere).
_FORMS = [
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[Tt\s]+{_CLOCK}{_REST}", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_REST}", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})[Tt,\s]+{_CLOCK}{_REST}", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[-\s]([A-Za-z]{{3}})[a-z]*[-\s](\d{{4}}),?\s+{_CLOCK}{_REST}", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    (rf"^([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),\s*(\d{{4}}),?\s+{_CLOCK}\s*([AaPp])\.?[Mm]\.?{_REST}", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (rf"^([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),\s*(\d{{4}}),?\s+{_CLOCK}{_REST}", (3, 1, 2, 4, 5, 6, 7, 0, 8)),
    (rf"^(?:[A-Za-z]{{3}},?\s+)?([A-Za-z]{{3}})\s+(\d{{1,2}})\s+{_CLOCK}\s+(\d{{4}}){_REST}", (7, 1, 2, 3, 4, 5, 6, 0, 8)),
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})()$", (1, 2, 3, 4, 4, 4, 4, 0, 4)),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})()$", (3, 2, 1, 4, 4, 4, 4, 0, 4)),
]
_EPOCH = r"^(-?)(\d{9,19})(?:\.(\d+))?(?:\s+[+-]\d{2}:?\d{2})?$"


def _epoch(t: Column) -> Column:
    sign, digits, part = (F.regexp_extract(t, _EPOCH, i) for i in (1, 2, 3))
    n, size = digits.try_cast("bigint"), F.length(digits)
    us = (
        F.when(size <= 11, n * 1_000_000 + F.rpad(F.substring(part, 1, 6), 6, "0").try_cast("bigint"))
        .when(size <= 14, n * 1000 + F.rpad(F.substring(part, 1, 3), 3, "0").try_cast("bigint"))
        .when(size <= 17, n)
        .otherwise(F.substring(digits, 1, size - 3).try_cast("bigint"))
    )
    return F.when(t.rlike(_EPOCH), F.when(sign == "-", -us).otherwise(us))


def _fields(parts: Column, t: Column) -> Column:
    year, month, day, hour, minute, second, fraction, half, zone = (F.get(parts, F.lit(i)) for i in range(9))
    number = lambda c: F.when(c == "", F.lit("0")).otherwise(c).try_cast("int")
    place = F.instr(F.lit(_MONTHS), F.lower(month))
    month = F.coalesce(month.try_cast("int"), F.when(place % 3 == 1, ((place + 2) / 3).cast("int")))
    h = number(hour)
    h = F.when(half == "", h).when((h < 1) | (h > 12), F.lit(None)).otherwise(h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    s = number(second)
    exact = F.concat(F.when(s < 60, s).cast("string"), F.lit("."), F.rpad(F.substring(F.coalesce(fraction, F.lit("")), 1, 6), 6, "0"))
    wall = F.try_make_timestamp_ntz(year.try_cast("int"), month, day.try_cast("int"), h, number(minute), exact.try_cast("decimal(16,6)"))
    return F.struct(_epoch(t).alias("epoch_us"), wall.alias("wall"), let(F.lower(F.trim(zone)), lambda low: _zone(zone, low)).alias("zone"))


def read_instant(text: Column) -> Column:
    """A text as ``struct<epoch_us, wall, zone>``: a count since 1970, or a wall time and the zone it names.

    ``wall`` is NULL for dates and times that do not exist and for texts of more than 200 characters; ``zone`` is
    NULL if none is named, ``?`` if unknown.
    """

    def parts(t: Column) -> Column:
        out = None
        for pattern, at in _FORMS:
            row = F.split(F.regexp_replace(t, pattern, "|".join(f"${i}" if i else "" for i in at)), r"\|")
            out = F.when(t.rlike(pattern), row) if out is None else out.when(t.rlike(pattern), row)
        return out

    clean = F.regexp_replace(F.when(F.length(text) <= 200, text), r"^[\s\u00a0]+|(?:\s*\([^)]*\))?[\s\u00a0]*$", "")
    return let(clean, lambda t: let(parts(t), lambda p: _fields(p, t)))


def _zone(z: Column, low: Column) -> Column:
    offset = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?(?:\s*\[.*\])?$"
    name = F.regexp_replace(F.trim(z), r"^\[|\]$", "")
    known = sorted(str(x) for x in SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in str(x))
    fixed = F.create_map(*(F.lit(x) for kv in OFFSETS.items() for x in kv))
    minutes = F.when(F.regexp_extract(low, offset, 3) == "", F.lit("00")).otherwise(F.regexp_extract(low, offset, 3))
    hours = F.lpad(F.regexp_extract(low, offset, 2), 2, "0")
    return (
        F.when(low == "", F.lit(None))
        .when(low.rlike(offset) & (hours <= "17") & (minutes <= "59"), F.concat(F.regexp_extract(low, offset, 1), hours, F.lit(":"), minutes))
        .when(fixed[low].isNotNull(), fixed[low])
        .when(name.isin(known), name)
        .otherwise(F.lit("?"))
    )


def utc_micros(text: Column, local_zone: Column) -> Column:
    """Microseconds since 1970 UTC; NULL if ``text`` denotes no instant.

    A zone in the text holds, else ``local_zone``. A wall time that occurs twice is the earlier one, one that the
    clock skips is later by the skipped span.
    """

    def instant(r: Column) -> Column:
        zone = F.coalesce(r["zone"], local_zone)
        utc = F.convert_timezone(F.when(zone != "?", zone).otherwise("UTC"), F.lit("UTC"), r["wall"])
        return F.coalesce(r["epoch_us"], F.when(zone != "?", F.timestamp_diff("MICROSECOND", F.expr(EPOCH), utc)))

    return let(read_instant(text), instant)
