"""64-bit signatures as longs: distances, hex forms, bands, difference hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def to_hex(sig: Column) -> Column:
    """16 lower-case hex digits, also of signatures with bit 63 set."""
    return F.lpad(F.lower(F.hex(sig)), 16, "0")


def from_hex(digits: Column) -> Column:
    return F.conv(digits, 16, -10).cast("long")


def band(sig: Column, i: Column | int) -> Column:
    """Byte i of the signature, lowest first."""
    return F.call_function("shiftrightunsigned", sig, F.lit(8) * i).bitwiseAND(255)


def informative(sig: Column, low: int = 8, high: int = 56) -> Column:
    """Signatures with too few or too many set bits look alike without being alike."""
    return F.bit_count(sig).between(low, high)


def difference_hash(pixels: Column, size: int = 8) -> Column:
    """Bit (row, col), row by row from bit 0, is set where a pixel is larger than the one to its right.

    ``pixels`` is an array of size rows of size + 1 grey values; null pixels set no bit.
    """
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(size * size - 1)),
        lambda b: F.when(
            F.get(pixels, b + F.floor(b / size).cast("int")) > F.get(pixels, b + F.floor(b / size).cast("int") + 1),
            F.call_function("shiftleft", F.lit(1).cast("long"), b),
        ).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def sign_hash(values: Column, width: int = 64) -> Column:
    """Bit i is set where value i is larger than the next one (the last is followed by the first)."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.when(F.get(values, i) > F.get(values, (i + 1) % width), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


#: Least width over height of each shape; flatter ones come first. Fixed values.
ASPECTS = (("pano_wide", 2.2), ("wide", 1.45), ("landscape", 1.15), ("square", 0.87), ("portrait", 0.69), ("tall", 0.45))


def aspect_bucket(w: Column, h: Column) -> Column:
    """Shape class; ``unknown`` where a side is null or zero."""
    out = F.when(w.isNull() | h.isNull() | (w == 0) | (h == 0), "unknown")
    for name, least in ASPECTS:
        out = out.when(w / h >= least, name)
    return out.otherwise("pano_tall")
