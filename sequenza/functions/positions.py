"""Word positions packed into a long: page 24 bits, position 20, version 8, range 12. Fields aren't masked: keep to the limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMITS = {"page": 1 << 23, "position": 1 << 20, "version": 1 << 8, "range": 1 << 12}


def pack(page: Column, position: Column, version: Column, range_: Column) -> Column:
    shifted = [F.shiftleft(c.cast("long"), bits) for c, bits in ((page, 40), (position, 20), (version, 12))]
    return shifted[0].bitwiseOR(shifted[1]).bitwiseOR(shifted[2]).bitwiseOR(range_.cast("long"))


def unpack(packed: Column) -> dict[str, Column]:
    field = lambda shift, bits: F.shiftrightunsigned(packed, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return {"page": F.shiftright(packed, 40).cast("int"), "position": field(20, 20), "version": field(12, 8), "range": field(0, 12)}


def within_limits(page: Column, position: Column, version: Column, range_: Column) -> Column:
    """Whether packing loses nothing."""
    checks = [(c >= 0) & (c < LIMITS[n]) for n, c in zip(LIMITS, (page, position, version, range_))]
    return checks[0] & checks[1] & checks[2] & checks[3]
