"""Column functions shared by the collectors: code maps, defaults, time and log-position arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Numeric codes of the metric catalogue.
STATUS_UP = "u"
STATUS_DOWN = "d"
ROLE_PRIMARY = "p"
MODE_CODES = {"s": 1.0, "r": 2.0, "c": 3.0, "n": 4.0}
REPLICATION_STATE_CODES = {"streaming": 1.0, "catchup": 2.0, "backup": 3.0}
SYNC_STATE_CODES = {"sync": 2.0, "async": 1.0, "potential": 0.5}
UNKNOWN = "unknown"

BYTES_PER_MB = 1024 * 1024


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def or_unknown(col: Column | str) -> Column:
    """NULL becomes ``unknown``; an empty string stays."""
    return F.coalesce(_c(col), F.lit(UNKNOWN))


def blank_or_unknown(col: Column | str) -> Column:
    """NULL and the empty string become ``unknown``."""
    return F.coalesce(F.nullif(_c(col), F.lit("")), F.lit(UNKNOWN))


def lookup(col: Column | str, codes: Mapping[str, float], default: float = 0.0, null: float | None = None) -> Column:
    """Case-insensitive code map as a ``CASE`` chain, so it stays inside generated code."""
    key = F.lower(_c(col))
    out = F.when(key.isNull(), F.lit(float(default if null is None else null)))
    for code, number in codes.items():
        out = out.when(key == code, F.lit(float(number)))
    return out.otherwise(F.lit(float(default)))


def status_code(col: Column | str) -> Column:
    return lookup(col, {STATUS_UP: 1.0})


def role_code(col: Column | str) -> Column:
    return lookup(col, {ROLE_PRIMARY: 1.0}, default=2.0)


def mode_code(col: Column | str) -> Column:
    return lookup(col, MODE_CODES, default=0.0, null=4.0)


def replication_state_code(col: Column | str) -> Column:
    return lookup(col, REPLICATION_STATE_CODES)


def sync_state_code(col: Column | str) -> Column:
    return lookup(col, SYNC_STATE_CODES)


def scope_tag(content: Column | str) -> Column:
    """Log shipping of content -1 belongs to the master, of any other content to a segment."""
    return F.when(_c(content) == -1, F.lit("master")).otherwise(F.lit("segment"))


def metric_name(name: str, subsystem: str | None = None, namespace: str = "fleet") -> str:
    return "_".join(part for part in (namespace, subsystem, name) if part)


def elapsed_us(later: Column | str, earlier: Column | str) -> Column:
    """Microseconds between two instants, exact."""
    return F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))


def elapsed_s(later: Column | str, earlier: Column | str) -> Column:
    """Seconds between two instants as a double."""
    return elapsed_us(later, earlier) / F.lit(1_000_000.0)


def to_bigint_half_even(col: Column | str) -> Column:
    """The source database rounds a double half to even when it becomes a bigint; a Spark cast truncates."""
    return F.bround(_c(col)).cast("long")


def whole_seconds(later: Column | str, earlier: Column | str) -> Column:
    return to_bigint_half_even(elapsed_s(later, earlier))


def dead_ratio(live: Column | str, dead: Column | str) -> Column:
    total = _c(live) + _c(dead)
    return F.when(total > 0, _c(dead).cast("double") / total).otherwise(F.lit(0.0))


def round_half_up(col: Column | str, digits: int = 1) -> Column:
    """Half rounds toward plus infinity (Spark's ``round`` goes away from zero on negatives)."""
    scale = float(10**digits)
    return F.floor(_c(col) * scale + 0.5) / F.lit(scale)


# A log position is two hexadecimal halves of up to 32 bits each; any other text is no position.
_POSITION = "^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"
MAX_LAG = 2**63 - 1


def num_to_lsn(col: Column | str) -> Column:
    """Log position text of a non-negative bigint."""
    n = _c(col)
    return F.concat(F.hex(F.shiftright(n, 32)), F.lit("/"), F.hex(n.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def lsn_halves(col: Column | str) -> Column:
    """Log position as a struct of its two halves, each a bigint; both NULL where the text is no position."""
    text = _c(col)
    half = lambda side: F.when(text.rlike(_POSITION), F.conv(F.substring_index(text, "/", side), 16, 10).cast("long"))
    return F.struct(half(1).alias("high"), half(-1).alias("low"))


def halves_lag(sent: Column, reached: Column) -> Column:
    """Bytes between two positions given as halves; NULL and negative differences are 0.

    A difference that a bigint cannot hold, as one broken position makes, is the greatest bigint, so the row of that one shipper
    looks absurd and every other row stays as it is.
    """
    high = sent["high"] - reached["high"]
    diff = high * F.lit(2**32) + (sent["low"] - reached["low"])
    zero = F.lit(0).cast("long")
    return (
        F.when(high.isNull() | (high < 0), zero)
        .when(high >= 2**31, F.lit(MAX_LAG).cast("long"))
        .otherwise(F.greatest(F.coalesce(diff, zero), zero))
    )


def lag_bytes(sent: Column | str, reached: Column | str) -> Column:
    """Bytes still to go from ``reached`` to ``sent``; NULL and negative differences are 0."""
    return halves_lag(lsn_halves(sent), lsn_halves(reached))


# Fixed value: compact text timestamp of the backup history.
COMPACT_FORMAT = "yyyyMMddHHmmss"


def compact_epoch(col: Column | str) -> Column:
    """Epoch seconds of a compact text timestamp; NULL when it does not parse."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(_c(col), 1, 14), F.lit(COMPACT_FORMAT)))


def bloat_state(actual_pages: Column | str, expected_pages: Column | str) -> Column:
    """0 none, 1 above 4 times the expected pages, 2 above 10 times or nothing expected.

    Comparing products instead of a quotient keeps it in exact integers and needs no zero guard.
    """
    actual, expected = _c(actual_pages), _c(expected_pages)
    return (
        F.when(expected == 0, F.lit(2))
        .when(actual > expected * 10, F.lit(2))
        .when(actual > expected * 4, F.lit(1))
        .otherwise(F.lit(0))
    )


def cpu_limit_label(col: Column | str) -> Column:
    return F.when(_c(col) > 0, _c(col).cast("string")).otherwise(F.lit("unlimited"))


def flag(col: Column | str) -> Column:
    return F.when(_c(col), F.lit(1.0)).otherwise(F.lit(0.0))


def epoch_with_millis(col: Column | str) -> Column:
    return F.unix_millis(_c(col).cast("timestamp")) / F.lit(1000.0)


def value_or_nan(col: Column | str) -> Column:
    return F.coalesce(_c(col).cast("double"), F.lit(float("nan")))


def value_or_zero(col: Column | str) -> Column:
    return F.coalesce(_c(col).cast("double"), F.lit(0.0))


def zero_if_null(col: Column | str) -> Column:
    """Integer columns read NULL as 0."""
    return F.coalesce(_c(col), F.lit(0))


def value_text(col: Column | str, texts: Mapping[float, str]) -> Column:
    """Display text of a numeric code; the number itself where no text is mapped."""
    out = None
    for number, text in texts.items():
        test = _c(col) == F.lit(float(number))
        out = F.when(test, F.lit(text)) if out is None else out.when(test, F.lit(text))
    plain = _c(col).cast("string")
    return plain if out is None else out.otherwise(plain)


class NoSuchColumn(KeyError, ValueError):
    """A frame has none of the columns that could hold a figure."""


def either_column(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-null of those columns that exist: newer and older names of the same source column."""
    present = [F.col(n) for n in names if n in df.columns]
    if not present:
        raise NoSuchColumn(f"none of {list(names)} in {df.columns}")
    return F.coalesce(*present) if len(present) > 1 else present[0]
