"""Text forms of times and sizes, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def div(a: Column, b: int | Column) -> Column:
    """Integer division that rounds to minus infinity (as Spark's ``div`` does not)."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
    second = F.hour(ts) * 3600 + F.minute(ts) * 60
    return day + second.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def utc_text(ts_ns: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` in UTC, cut to milliseconds."""
    day = F.date_format(F.date_from_unix_date(div(ts_ns, 86_400 * SECOND).cast("int")), "yyyy-MM-dd")
    ms = div(F.pmod(ts_ns, F.lit(86_400 * SECOND)), 1_000_000)
    return F.format_string("%s %02d:%02d:%02d.%03d", day, div(ms, 3_600_000), F.pmod(div(ms, 60_000), F.lit(60)), F.pmod(div(ms, 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def srt_time(ns: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    ms = div(ns, 1_000_000)
    return F.format_string("%02d:%02d:%02d,%03d", div(ms, 3_600_000), F.pmod(div(ms, 60_000), F.lit(60)), F.pmod(div(ms, 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def ass_time(ns: Column) -> Column:
    """``H:MM:SS.cc``."""
    cs = div(ns, 10_000_000)
    return F.format_string("%d:%02d:%02d.%02d", div(cs, 360_000), F.pmod(div(cs, 6000), F.lit(60)), F.pmod(div(cs, 100), F.lit(60)), F.pmod(cs, F.lit(100)))


def duration_text(seconds: Column) -> Column:
    """Whole seconds as seconds, minutes or hours, whichever suits; hundredths round half up."""

    def as_unit(size: int, unit: str) -> Column:
        hundredths = div(seconds.cast("long") * 100 + size // 2, size)
        return F.format_string(f"%d.%02d {unit}", div(hundredths, 100), F.pmod(hundredths, F.lit(100)))

    return F.when(seconds < 60, as_unit(1, "s")).when(seconds < 3600, as_unit(60, "min")).otherwise(as_unit(3600, "h"))


def bytes_text(n: Column) -> Column:
    """Whole bytes in binary units; hundredths round to nearest, exact halves to even (``format_string`` would round them up)."""
    n = n.cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        bits = 10 * power
        rest = n.bitwiseAND(F.lit(2**bits - 1)) * 100
        # Just under a half more, and one more where the last digit is odd.
        near = F.shiftright(rest + (2 ** (bits - 1) - 1) + F.shiftright(rest, bits).bitwiseAND(F.lit(1)), bits)
        hundredths = F.shiftright(n, bits) * 100 + near
        text = F.concat(F.call_function("div", hundredths, F.lit(100)).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))
        out = F.when(n >= 2**bits, text).otherwise(out)
    return out
