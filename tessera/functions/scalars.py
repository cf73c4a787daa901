"""Column functions with the missing-value, rounding and date rules of data-frame analytics; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_as_null(c) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(col(c)), col(c))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(col(c)) & (F.abs(col(c)) != float("inf")), col(c))


def is_missing_text(c) -> Column:
    return col(c).isNull() | (F.trim(col(c)) == "")


def safe_div(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0))


def half_even(c, digits: int) -> Column:
    return F.bround(col(c), digits)


def to_number(c) -> Column:
    """The text as a double, NULL where it is no plain number (Spark alone would take '5d')."""
    text = col(c).cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def clip(c, low=None, high=None) -> Column:
    """Bounded below and above; NULL stays NULL."""
    out = col(c)
    if low is not None:
        out = F.when(col(c).isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(col(c).isNotNull(), F.least(out, F.lit(high)))
    return out


def row_sum(*cs) -> Column:
    """Sum over columns, missing as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(col(c), F.lit(0)) for c in cs))


def flag(condition: Column) -> Column:
    """1 or 0; unknown is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def equals_ignoring_case(c, value: str) -> Column:
    return flag(F.upper(col(c)) == value.upper())


def mapped(c, values: dict) -> Column:
    """Dictionary lookup; an unknown key gives NULL."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.try_element_at(pairs, col(c))


def truncate_int(c) -> Column:
    return col(c).cast("int")


def canonical_category(c, dtype: str) -> Column:
    """Integral numbers without a point, texts trimmed."""
    if dtype == "string":
        return F.trim(col(c))
    return F.when(col(c) == F.floor(col(c)), col(c).cast("bigint").cast("string")).otherwise(col(c).cast("string"))


def whole_days(later, earlier) -> Column:
    """Days between two times, rounded down (also below zero)."""
    return F.floor(F.timestamp_diff("SECOND", col(earlier), col(later)) / 86400).cast("bigint")


def weekday(c) -> Column:
    """Monday is 0."""
    return F.weekday(col(c)).cast("int")


def is_weekend(c) -> Column:
    return flag(F.weekday(col(c)) >= 5)


def quarter_of_month(month) -> Column:
    return (F.floor((col(month) - 1) / 3) + 1).cast("int")


def calendar(c, prefix: str) -> dict[str, Column]:
    """year, month, quarter, day of week and weekend flag of a time."""
    return {f"{prefix}_year": F.year(col(c)), f"{prefix}_month": F.month(col(c)), f"{prefix}_quarter": F.quarter(col(c)), f"{prefix}_day_of_week": weekday(c), f"{prefix}_is_weekend": is_weekend(c)}


def day_first_time(c) -> Column:
    """A time written as day-month-year hours:minutes; NULL where it is none."""
    return F.try_to_timestamp(col(c), F.lit("dd-MM-yyyy HH:mm")).cast("timestamp_ntz")


def strict_time(c, name: str = "time") -> Column:
    """An ISO time; a text that is none fails the job, and NULL stays NULL."""
    read = col(c).try_cast("timestamp_ntz")
    bad = F.raise_error(F.concat(F.lit(f"{name} is no time: "), col(c).cast("string"))).cast("timestamp_ntz")
    return F.when(col(c).isNull() | read.isNotNull(), read).otherwise(bad)


def new_id() -> Column:
    """A random UUID, another one each time a row is computed."""
    return F.uuid()


def iso_utc(c) -> Column:
    """ISO 8601 with microseconds and Z; the session's zone is UTC."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def expiry(c, days: int) -> Column:
    return col(c) + F.make_interval(days=F.lit(days))


def sha256_hex(c) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def canonical_json(**fields) -> Column:
    """JSON of the fields in order of their names, nulls kept."""
    return F.to_json(F.struct(*[col(v).alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def hmac_sha256(key: bytes, message) -> Column:
    """HMAC of a text, composed of SHA-256 over the padded key."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    digest = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), col(message).cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), digest), 256)


def status(value: Column, warn: float, critical: float) -> Column:
    """0 ok, 1 warning, 2 critical; the thresholds belong to the worse side."""
    return F.when(value >= critical, 2).when(value >= warn, 1).otherwise(0)


def status_name(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("critical")), rank + 1)
