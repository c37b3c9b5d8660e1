"""96-bit z-order key of signed chunk coordinates.

One BIGINT cannot hold it, so the key is a struct of two BIGINTs that sorts like
the interleaved 96-bit number: the high 16 bits of each lane, then the low 16.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# shift/mask steps spreading 16 bits to every third position.
_SPREAD = ((32, 0x00FF00000000FFFF), (16, 0x00FF0000FF0000FF), (8, 0xF00F00F00F00F00F),
           (4, 0x30C30C30C30C30C3), (2, 0x9249249249249249))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _spread(bits: Column) -> Column:
    out = bits.cast("bigint")
    for shift, mask in _SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(_signed(mask)).cast("bigint"))
    return out


def _interleave(x: Column, y: Column, z: Column) -> Column:
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def morton_key(x: str = "cx", y: str = "cy", z: str = "cz") -> Column:
    """Struct (hi, lo), ordered like the 96-bit z-order number."""
    lanes = [F.col(c).cast("bigint") + F.lit(1 << 31) for c in (x, y, z)]
    high = _interleave(*[F.shiftright(c, 16) for c in lanes])
    low = _interleave(*[c.bitwiseAND(F.lit(0xFFFF)) for c in lanes])
    return F.struct(high.alias("hi"), low.alias("lo"))
