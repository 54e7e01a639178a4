"""Number parsing, timestamps and printed numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

# Sums of doubles vary in the last bits with the order in which tasks finish.
# Values this close to a rounding tie are printed as the tie, so a report does
# not change from run to run.
_TIE_NUDGE = 1.0 + 1e-12


def parse_float_lenient(text: Column) -> Column:
    """Leading number of a text as a double; NaN where there is none."""
    number = F.regexp_extract(text, fv.NUMBER_PREFIX, 1).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(number, F.lit(float("nan"))))


def epoch_seconds(text: Column) -> Column:
    """Epoch seconds of an ISO 8601 text, read as UTC when it names no zone."""
    ending = (
        F.when(text.endswith("Z"), "")
        .when(F.octet_length(text) == len("2024-01-01"), "T00:00:00Z")
        .when(text.rlike(fv.OFFSET_ENDING), "")
        .otherwise("Z")
    )
    return F.unix_seconds(F.concat(text, ending).try_cast("timestamp"))


def interval_bounds(interval: Column) -> tuple[Column, Column]:
    """Start and end texts of ``start/end``."""
    return F.substring_index(interval, "/", 1), F.substring_index(interval, "/", -1)


def is_interval(interval: Column) -> Column:
    """Whether a text has exactly two parts."""
    start, end = interval_bounds(interval)
    return F.octet_length(start) + 1 + F.octet_length(end) == F.octet_length(interval)


def utc_seconds(moment: Column) -> Column:
    """Whole epoch seconds of a zone-less timestamp that holds UTC wall time."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment)


def utc_date(moment: Column) -> Column:
    return F.substring(moment.cast("string"), 1, 10)


def utc_iso(moment: Column) -> Column:
    """``2024-01-01T00:00:00+00:00`` of a zone-less UTC timestamp."""
    text = moment.cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("+00:00"))


def significant(value: Column, digits: int) -> Column:
    """``value`` with that many significant digits and no exponent or padding; null stays null.

    Not a number and both infinities have names; from 1e38 on the plain text of the number stands.
    """
    scientific = F.format_string(f"%.{digits - 1}e", value * _TIE_NUDGE)
    small = F.regexp_replace(scientific.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    large = scientific.try_cast("decimal(38,0)").cast("string")
    infinity = F.lit(float("inf"))
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(value), F.lit("NaN"))
        .when(value == infinity, F.lit("Infinity"))
        .when(value == -infinity, F.lit("-Infinity"))
        .otherwise(F.coalesce(small, large, value.cast("string")))
    )


def fixed(value: Column, decimals: int, width: int = 0) -> Column:
    """``value`` with a fixed number of decimals, padded on the left."""
    pad = str(width) if width else ""
    return F.format_string(f"%{pad}.{decimals}f", value * _TIE_NUDGE)


def round_half_up(value: Column) -> Column:
    return F.floor(value * _TIE_NUDGE + F.lit(0.5))


def plural(count: Column) -> Column:
    return F.when(count == 1, F.lit("")).otherwise(F.lit("s"))


def capitalise(text: str) -> str:
    """Upper-case the first letter only."""
    return text[:1].upper() + text[1:]
