"""Dates and durations as column expressions. Naive dates mean UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import WS, empty_if_null, file_stem, let, strip

_DAY = "(?i:mon|tue|wed|thu|fri|sat|sun)"
_MON = "(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_HMS = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
_YMD = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
_ZONE = r"[+-][0-9]{2}:?[0-9]{2}"

# Shape of the text, then the patterns to try on it, in order. The shape is checked
# first, so a parse that would fail is hardly ever started.
SHAPES = [
    (rf"\A{_YMD}T{_HMS}\z", ["yyyy-M-d'T'H:m:s"]),
    (rf"\A{_YMD}T{_HMS}\.[0-9]{{1,6}}\z", ["yyyy-M-d'T'H:m:s.SSSSSS"]),
    (rf"\A{_YMD} {_HMS}\z", ["yyyy-M-d H:m:s"]),
    (rf"\A{_YMD}\z", ["yyyy-M-d"]),
    (r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z", ["d/M/yyyy", "M/d/yyyy"]),
    (r"\A[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\z", ["d-M-yyyy", "M-d-yyyy"]),
    (rf"\Aweekday [0-9]{{1,2}} {_MON} [0-9]{{4}} {_HMS}\z", ["'weekday' d MMM yyyy H:m:s"]),
    (rf"\A[0-9]{{1,2}} {_MON} [0-9]{{4}}\z", ["d MMM yyyy"]),
    (rf"\A{_MON} [0-9]{{1,2}}, [0-9]{{4}}\z", ["MMM d, yyyy"]),
]
ZONED_SHAPES = [
    (rf"\Aweekday [0-9]{{1,2}} {_MON} [0-9]{{4}} {_HMS} ({_ZONE}|Z)\z",
     "'weekday' d MMM yyyy H:m:s Z"),
    (rf"\A{_YMD} {_HMS}({_ZONE}|Z)\z", "yyyy-M-d H:m:sZ"),
]


# The formats that count for recency.
RECENCY_PATTERNS = ["yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d",
                    "'weekday' d MMM yyyy H:m:s"]


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def _naive(text: Column, pattern: str) -> Column:
    # The zone is part of the text, so the session zone plays no role.
    return F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(pattern + " Z"))


def parse_timestamp(c: Column) -> Column:
    """Timestamp of a date in any of the known formats, else null."""
    def without_iso_tail(text: Column) -> Column:
        iso_tail = F.contains(text, F.lit("T")) & (
            F.endswith(text, F.lit("Z")) | F.rlike(text, F.lit(_ZONE + r"\z")))
        return F.when(
            iso_tail,
            strip(F.regexp_replace(strip(F.replace(text, F.lit("Z"), F.lit(""))),
                                   _ZONE + r"\z", "")),
        ).otherwise(text)

    text = let(F.translate(strip(c), "­​", ""), without_iso_tail)
    text = F.regexp_replace(text, f"{WS}+", " ")
    # A weekday stands only before a day of the month with a time of day.
    bare = let(text, lambda t: F.regexp_replace(
        t, rf"\A{_DAY}, (?=[0-9]{{1,2}} {_MON} [0-9]{{4}} {_HMS})", "weekday "))
    return let(bare, _parse_known)


def _parse_known(bare: Column) -> Column:
    out = None
    for shape, patterns in SHAPES:
        value = F.coalesce(*[_naive(bare, p) for p in patterns])
        cond = F.rlike(bare, F.lit(shape))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    for shape, pattern in ZONED_SHAPES:
        zoned = F.regexp_replace(
            F.regexp_replace(bare, r"([+-][0-9]{2}):([0-9]{2})\z", "$1$2"), r"Z\z", "+0000")
        out = out.when(F.rlike(bare, F.lit(shape)), F.try_to_timestamp(zoned, F.lit(pattern)))
    return out


def epoch_from_date(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(epoch(parse_timestamp(c)), F.lit(default))


def date_to_iso(c: Column) -> Column:
    """ISO text of a date; "" for an empty one, the epoch for an unknown one."""
    def written(seconds: Column) -> Column:
        micros = F.round((seconds - F.floor(seconds)) * 1e6).cast("long")
        text = F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(micros == 0, text).otherwise(F.concat(text, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))

    return F.when(strip(empty_if_null(c)) == "", "").otherwise(let(epoch_from_date(c), written))


def _ymd_epoch(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, month, day)
    return F.coalesce(epoch(_naive(text, "yyyy-M-d")), F.lit(0.0))


def epoch_from_pdf(c: Column) -> Column:
    """Day of a ``D:YYYYMMDD…`` stamp."""
    digits = F.regexp_extract(strip(empty_if_null(c)), r"\AD:([0-9]{8})", 1)
    return F.when(
        digits != "",
        _ymd_epoch(F.substring(digits, 1, 4), F.substring(digits, 5, 2),
                   F.substring(digits, 7, 2)),
    ).otherwise(0.0)


def epoch_from_filename(c: Column) -> Column:
    """Day named in a file stem as YYYY-MM-DD or YYYY_MM_DD."""
    pattern = r"([0-9]{4})[-_]([0-9]{2})[-_]([0-9]{2})"
    stem = file_stem(empty_if_null(c))
    return F.when(
        F.rlike(stem, F.lit(pattern)),
        _ymd_epoch(*[F.regexp_extract(stem, pattern, i) for i in (1, 2, 3)]),
    ).otherwise(0.0)


def epoch_from_published(c: Column) -> Column:
    """A date text, or a JSON array that starts with year, month and day."""
    parts = F.from_json(c, "array<string>")
    is_list = F.startswith(F.ltrim(c), F.lit("["))
    from_list = F.when(F.size(parts) >= 3, _ymd_epoch(parts[0], parts[1], parts[2]))
    return F.coalesce(F.when(is_list, from_list).otherwise(epoch_from_date(c)), F.lit(0.0))


def clock_to_seconds(c: Column) -> Column:
    """``HH:MM:SS.mmm`` to seconds. The part after the point counts milliseconds."""
    pattern = r"\A\s*([0-9]+)\s*:\s*([0-9]+)\s*:\s*([0-9]+)\s*(?:\.\s*([0-9]+)\s*(?:\..*)?)?\z"
    part = [F.regexp_extract(c, pattern, i) for i in range(1, 5)]
    millis = F.coalesce(part[3].try_cast("double"), F.lit(0.0))
    total = (part[0].try_cast("double") * 3600 + part[1].try_cast("double") * 60
             + part[2].try_cast("double") + millis / 1000.0)
    return F.when(F.rlike(c, F.lit(pattern)), total).otherwise(0.0)


def seconds_to_clock(c: Column) -> Column:
    """Seconds to ``HH:MM:SS``, fraction cut, never negative."""
    s = F.greatest(F.lit(0).cast("long"), c.cast("long"))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("long")
    return F.concat(
        F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), F.lit(":"),
        two(F.floor((s % 3600) / 60).cast("long")), F.lit(":"), two(s % 60))


def iso_duration_seconds(c: Column) -> Column:
    """``PT1H2M3S`` to seconds; 0 for anything else."""
    pattern = r"\APT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?"
    h, m, s = [F.coalesce(F.regexp_extract(c, pattern, i).try_cast("long"), F.lit(0))
               for i in (1, 2, 3)]
    return F.when(F.rlike(c, F.lit(pattern)), h * 3600 + m * 60 + s).otherwise(0).cast("long")


def human_duration(c: Column) -> Column:
    """Seconds to ``1h 2m 3s``, leaving out parts that are zero."""
    def written(s: Column) -> Column:
        hours, minutes, secs = (F.floor(s / 3600).cast("long"),
                                F.floor((s % 3600) / 60).cast("long"), s % 60)
        return F.concat_ws(
            " ",
            F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))),
            F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"))),
            F.when(secs > 0, F.concat(secs.cast("string"), F.lit("s"))))

    return let(let(F.floor(c).cast("long"), written), lambda text: F.when(text == "", "0s").otherwise(text))


def decay(age_days: Column, scale: float) -> Column:
    """exp(-age/scale), held between 0.1 and 1; null for an unknown age."""
    held = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.exp(-age_days / scale)))
    return F.when(age_days.isNotNull(), held)


def recency_bonus(date_text: Column, as_of: str, scale: float) -> Column:
    """Recency weight of a date text, 0.0 when it cannot be read.

    Only five formats count here, and a zone in the text is ignored.
    """
    def bonus(local: Column) -> Column:
        parsed = F.coalesce(
            *[F.when(F.rlike(local, F.lit(shape)), _naive(local, patterns[0]))
              for shape, patterns in SHAPES if patterns[0] in RECENCY_PATTERNS])
        at = F.lit(as_of).cast("timestamp_ntz").cast("timestamp")
        return decay(F.floor((epoch(at) - epoch(parsed)) / 86400.0), scale)

    text = F.regexp_replace(strip(date_text), f"{WS}+", " ")
    local = F.regexp_replace(text, rf"\A{_DAY}, ", "weekday ")
    local = F.regexp_replace(local, r"\A(weekday .*) ([+-][0-9]{2}:?[0-9]{2}|Z)\z", "$1")
    return F.coalesce(let(local, bonus), F.lit(0.0))
