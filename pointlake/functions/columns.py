"""Column helpers: rounding, clamping and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(value: Column) -> Column:
    """The nearest integer, halves away from zero, as a long."""
    return F.when(value >= 0, F.floor(value + 0.5)).otherwise(F.ceil(value - 0.5)).cast("long")


def clamp(value: Column, low: int, high: int) -> Column:
    """Clamped to low ... high and then cut to an integer."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value.cast("double"))).cast("int")


def u8(value: Column) -> Column:
    return clamp(value, 0, 255)


def u16(value: Column) -> Column:
    return clamp(value, 0, 65535)


def i8(value: Column) -> Column:
    return clamp(value, -128, 127)


def single(value: float) -> float:
    """The value as a 32-bit float holds it."""
    import struct

    return struct.unpack("f", struct.pack("f", value))[0]


def cell(value: Column, step: float) -> Column:
    """floor(value / step) as a long."""
    return F.floor(value / F.lit(float(step))).cast("long")


def morton(x: Column, y: Column, levels: int) -> Column:
    """Bits of the cells x and y interleaved, x in the even places: the index within a quadtree level."""
    out = F.lit(0).cast("long")
    for b in range(levels):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), 2 * b))
        out = out.bitwiseOR(F.shiftleft(F.shiftright(y.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), 2 * b + 1))
    return out


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is zero."""
    a, b = a.cast("double"), b.cast("double")
    return F.try_divide(a - b, a + b)
