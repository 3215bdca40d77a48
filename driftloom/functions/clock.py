"""Time and number expressions: corpus dates, the model clock, labels, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_UNITS = ("hour", "instance")
# Fixed values of the corpus date format and of the synthetic clock.
ZONE_TOKEN = " PDT "
SYNTHETIC_START = "2009-06-01 00:00:00"


def has_zone_token(date: Column) -> Column:
    return date.contains(ZONE_TOKEN)


def corpus_timestamp(date: Column) -> Column:
    """`Mon Apr 06 22:19:45 PDT 2009` as wall-clock time, zone dropped."""
    plain = F.regexp_replace(date, r"^\w{3} (.*?) PDT (\d{4})$", "$1 $2")
    return F.to_timestamp_ntz(plain, F.lit("MMM dd HH:mm:ss yyyy"))


def model_time(ts: Column, idx: Column, unit: str = "hour") -> Column:
    """The model clock: hours since the epoch (UTC), or the instance index."""
    if unit == "hour":
        micros = F.unix_micros(ts.cast("timestamp"))
        return micros.cast("double") / F.lit(3.6e9)
    if unit == "instance":
        return idx.cast("double")
    raise ValueError(f"time unit {unit!r} is not one of {TIME_UNITS}")


def synthetic_timestamp(idx: Column) -> Column:
    """One row per second from the synthetic start."""
    start = F.lit(SYNTHETIC_START).cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), idx)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def from_iso_text(text: Column) -> Column:
    return F.to_timestamp_ntz(text)


def binary_label(raw: Column) -> Column:
    """Corpus label 4 is positive (1); anything else is 0."""
    return (raw == 4).cast("byte")


def flip_label(label: Column, condition: Column) -> Column:
    return F.when(condition, 1 - label).otherwise(label).cast("byte")


def percent(x: Column) -> Column:
    return F.format_string("%.1f", x * 100)


def mean_spread(mean: Column, spread: Column, runs: Column) -> Column:
    """`71.0 ± 1.0` in percent; the plain value for a single run."""
    return F.when(runs == 1, percent(mean)).otherwise(
        F.concat(percent(mean), F.lit(" ± "), percent(spread)))
