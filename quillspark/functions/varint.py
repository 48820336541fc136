"""Variable-length integers: seven bits a byte, the lowest first, and the high bit where more follow.

Negative numbers count as unsigned ones of their width, so they take the most bytes (5 of 32 bits, 10 of 64).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(value: Column, bits: int = 32) -> Column:
    """Bytes that a number takes."""
    out = F.when(value < 0, -(-bits // 7))
    for n in range(1, -(-bits // 7)):
        out = out.when(value < (1 << 7 * n), n)
    return out.otherwise(-(-bits // 7))


def encode(values: Iterable[int], bits: int = 32) -> bytes:
    out = bytearray()
    for v in values:
        v &= (1 << bits) - 1
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def decode(data: bytes, bits: int = 32) -> Iterator[int]:
    """All numbers; an end within one, or one that is too long, is an error."""
    v = shift = 0
    for byte in data:
        v |= (byte & 127) << shift
        if byte & 128:
            shift += 7
            if shift >= bits:
                raise ValueError("a number is too long")
            continue
        v &= (1 << bits) - 1
        yield v - (1 << bits) if v >> bits - 1 else v
        v = shift = 0
    if shift:
        raise EOFError("the data end within a number")
