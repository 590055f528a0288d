"""Display sizes, natural name order and version order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown_bytes(size: Column, largest: str = "") -> Column:
    """A size in steps of 1024: a decimal below 10 units, none from 10 on; whole bytes; null of null.

    Halves go to the even digit, as with printf. If a ``largest`` unit is named, what is larger is told in it, always with a decimal.
    """
    units = ["B", "KB", "MB", "GB", "TB"]
    last = units.index(largest) if largest else len(units) - 1
    step = sum(((size >= 1024**k).cast("int") for k in range(1, last + 1)), F.lit(0))
    value = size / F.pow(F.lit(1024.0), step)  # exact, as a power of 2 divides it
    unit = F.element_at(F.array(*[F.lit(u) for u in units]), step + 1)
    decimal = (step > 0) & ((value < 10) | ((step == last) & F.lit(bool(largest))))
    number = F.when(decimal, F.format_string("%.1f", F.bround(value, 1))).otherwise(F.format_string("%.0f", F.bround(value, 0)))
    return F.when(size.isNotNull(), F.concat_ws(" ", number, unit))


def natural_key(name: Column) -> Column:
    """A name with its digit runs padded, for collation without case and accents: file2 before file10."""
    runs = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0))
    padded = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0")).otherwise(r))
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")


def version_key(version: Column) -> Column:
    """A semantic version as an array that sorts in its order; null if it is none."""
    clean = F.regexp_replace(F.trim(version), "^v|[+].*$", "")
    core = F.split(F.regexp_extract(clean, r"^([0-9.]+)", 1), "[.]")
    before = F.regexp_extract(clean, r"^[0-9.]+-(.+)$", 1)
    # a number sorts before a word, a shorter list of equal beginning first, and a release after all of its pre-releases
    part = lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p))
    numbers = F.transform(core, lambda n: F.lpad(n, 20, "0"))
    pre = F.when(before == "", F.array(F.lit("2"))).otherwise(F.transform(F.split(before, "[.]"), part))
    return F.when(clean.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?$"), F.concat(numbers, pre))


def iso_utc(text: Column) -> Column:
    """An ISO 8601 date or time as UTC, ``2024-05-06T07:08:09.123Z``; null if it is none.

    A date alone is its midnight in UTC; a time needs its offset (``Z`` or ``+hh:mm``), as what it means
    without depends on the place. Seconds and up to nine digits of their fraction may be missing; finer than a
    thousandth is cut off. Offsets go up to 23:59, and a month's days and a day's hours are looked at.
    """
    bare = F.trim(text)
    day = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(bare, F.lit("T00:00:00Z")))
    full = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d([.]\d{1,9})?)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"), bare)
    parts = lambda k: F.regexp_extract(F.coalesce(day, full), r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2})(?::(\d{2}))?(?:[.](\d{1,3}))?\d*(Z|[+-]\d{2}:\d{2})$", k)
    # of the clock's time as UTC the offset is taken off, so the session's time zone has no part in it
    clock = F.try_to_timestamp(F.concat(parts(1), F.lit(" "), parts(2), F.lit(":"), F.rpad(parts(3), 2, "0"), F.lit("."), F.rpad(parts(4), 3, "0"), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ss.SSSxxx"))
    zone = parts(5)
    minutes = F.when(zone == "Z", 0).otherwise(F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")))
    millis = F.unix_millis(clock) - minutes.cast("long") * 60_000
    days, rest = F.floor(millis / 86_400_000), F.pmod(millis, F.lit(86_400_000))
    digits = lambda n, size: F.lpad(n.cast("string"), size, "0")
    hours = F.concat_ws(":", digits(F.floor(rest / 3_600_000), 2), digits(F.floor(rest / 60_000) % 60, 2), digits(F.floor(rest / 1000) % 60, 2))
    return F.concat(F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd"), F.lit("T"), hours, F.lit("."), digits(rest % 1000, 3), F.lit("Z"))
