"""Scalar functions: saturating arithmetic, units, number decoding, time formats, network text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)
# Unit prefixes.
SI = (("", 1), ("k", 10**3), ("M", 10**6), ("G", 10**9), ("T", 10**12))
BINARY = (("B", 1), ("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30), ("TB", 1 << 40))
SECONDS = (("ns", 1), ("us", 10**3), ("µs", 10**3), ("ms", 10**6), ("s", 10**9))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x).cast("long")


def saturated_add(a, b) -> Column:
    """a + b, clamped to the range of long."""
    a, b = _c(a), _c(b)
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.when(a > 0, F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))))


def saturated_subtract(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.coalesce(F.try_subtract(a, b), F.when(a.isNotNull() & b.isNotNull(), F.when(b < 0, F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))))


def saturated_multiply(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.coalesce(F.try_multiply(a, b), F.when(a.isNotNull() & b.isNotNull(), F.when((a > 0) == (b > 0), F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))))


def _small_first(c: Column, units, last_label: str, places: int) -> Column:
    """The number in the largest unit that it reaches."""
    out = None
    for name, size in units:
        text = F.concat(F.regexp_replace(F.format_string(f"%.{places}f", c / F.lit(float(size))), r"\.?0+$", ""), F.lit(f" {name}{last_label}".rstrip()))
        out = text if out is None else F.when(F.abs(c) >= size, text).otherwise(out)
    return out


def with_prefix(c, unit: str = "") -> Column:
    """1500 -> '1.5 k'."""
    return _small_first(_c(c).cast("double"), SI, unit, 3)


def data_size(c) -> Column:
    """2048 -> '2 KB'."""
    return _small_first(_c(c).cast("double"), BINARY, "", 3)


def data_speed(c) -> Column:
    return F.concat(data_size(c), F.lit("/s"))


def duration(c) -> Column:
    """Nanoseconds -> '200 ms'."""
    return _small_first(_c(c).cast("double"), tuple(u for u in SECONDS if u[0] != "us"), "", 3)


def percent(c) -> Column:
    return F.concat(F.format_string("%.2f", _c(c).cast("double") * 100), F.lit(" %"))


def decode_number(c) -> Column:
    """0x.., 0.. (octal) and decimal text, signed, as long; null if it is none."""
    text = F.trim(_c(c))
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    body = F.regexp_replace(text, r"^[+-]", "")
    lower = F.lower(body)
    base16 = F.when(lower.rlike("^(0x|#)[0-9a-f]{1,15}$"), F.conv(F.regexp_replace(lower, "^(0x|#)", ""), 16, 10))
    base8 = F.when(lower.rlike("^0[0-7]{1,20}$"), F.conv(lower, 8, 10))
    base10 = F.when(lower.rlike("^(0|[1-9][0-9]{0,18})$"), lower)
    return F.coalesce(base16, base8, base10).try_cast("long") * sign


def parse_number(text: str) -> float | int | None:
    """A literal of the filter language: integers of any base, decimals, and decimals with a unit (in the base unit)."""
    text = text.strip()
    m = re.fullmatch(r"([+-]?)(?:(?:0x|0X|#)([0-9a-fA-F]+)|0([0-7]+)|([0-9]+))", text)
    if m:
        value = int(m[2], 16) if m[2] else int(m[3], 8) if m[3] else int(m[4])
        return -value if m[1] == "-" else value
    m = re.fullmatch(r"([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*([A-Za-zµ]*)", text)
    if not m:
        return None
    sizes = dict(SECONDS) | {k: v for k, v in BINARY if k != "B"} | {k: v for k, v in SI if k}
    if m[2] and m[2] not in sizes:
        return None
    return float(m[1]) * sizes.get(m[2], 1)


def radix(c, base: int) -> Column:
    """An integer as text in base 2, 8, 10 or 16."""
    c = _c(c)
    return {2: F.concat(F.lit("0b"), F.bin(c)), 8: F.concat(F.lit("0"), F.conv(c.cast("string"), 10, 8)), 10: c.cast("string"), 16: F.concat(F.lit("0x"), F.lower(F.hex(c)))}[base]


def lookup(c, labels: dict, default: str | None = None) -> Column:
    """Value to label."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), _c(c)), F.lit(default))


def ranged_label(c, ranges: list[tuple[int, int, str]]) -> Column:
    """The label of the closed range that holds a value."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(ranges):
        out = F.when(_c(c).between(low, high), label).otherwise(out)
    return out


def format_ns(c, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Nanoseconds since 1970 as 'date time.milli micro nano'."""
    c = _c(c)
    second = F.floor(c / 1_000_000_000)
    rest = c - second * 1_000_000_000
    digits = F.lpad(rest.cast("string"), 9, "0")
    return F.concat(F.date_format(F.timestamp_seconds(second), pattern), F.lit("."), F.substring(digits, 1, 3), F.lit(" "), F.substring(digits, 4, 3), F.lit(" "), F.substring(digits, 7, 3))


def ipv4(c) -> Column:
    """An unsigned 32-bit integer as a dotted address."""
    c = _c(c)
    return F.concat_ws(".", *[F.shiftright(c, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)])


def mac(c) -> Column:
    """Six bytes as text."""
    text = F.lower(F.hex(_c(c)))
    return F.concat_ws(":", *[F.substring(text, 1 + 2 * k, 2) for k in range(6)])


def unboxed(c, kind: str) -> Column:
    """A state value where code needs a number: null is -1 for integers, NaN for doubles."""
    return F.coalesce(_c(c).cast("double"), F.lit(float("nan"))) if kind == "double" else F.coalesce(_c(c).cast("long"), F.lit(-1))
