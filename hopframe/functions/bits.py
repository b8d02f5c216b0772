"""Big-endian integers and bit fields, most significant bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_int(data: Column, start: Column | int, n: int) -> Column:
    """Unsigned big-endian integer of n <= 7 bytes from the 1-based byte start; null past the end."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.conv(F.hex(F.substring(data, start, F.lit(n))), 16, 10).cast("long")


def le_int(data: Column, start: Column | int, n: int) -> Column:
    """Unsigned little-endian integer of n <= 7 bytes."""
    start = start if isinstance(start, Column) else F.lit(start)
    return sum((be_int(data, start + k, 1) * (1 << (8 * k)) for k in range(n)), F.lit(0))


def be_bytes(value: Column, n: int) -> Column:
    """The low n bytes of value, big-endian."""
    return F.unhex(F.lpad(F.right(F.hex(value.cast("long")), F.lit(2 * n)), 2 * n, "0"))


def pack(fields: list[tuple[Column, int]]) -> Column:
    """One integer of the fields' low bits, the first field highest; 63 bits in all at most."""
    if sum(bits for _, bits in fields) > 63:
        raise ValueError("more than 63 bits")
    out = F.lit(0).cast("long")
    for value, bits in fields:
        out = F.shiftleft(out, bits).bitwiseOR(value.cast("long").bitwiseAND(F.lit((1 << bits) - 1)))
    return out


def unpack(packed: Column, widths: list[int]) -> list[Column]:
    """The fields of pack()."""
    left = sum(widths)
    out = []
    for bits in widths:
        left -= bits
        out.append(F.shiftright(packed, left).bitwiseAND(F.lit((1 << bits) - 1)))
    return out


class BitReader:
    """Reads bit fields of bytes; past the end every bit is 0."""

    def __init__(self, data: bytes):
        self._value, self._left = int.from_bytes(data, "big"), 8 * len(data)

    def get(self, n: int) -> int:
        self._left -= n
        if self._left >= 0:
            return self._value >> self._left & (1 << n) - 1
        return self._value << -self._left & (1 << n) - 1


class BitWriter:
    """Writes bit fields; the last byte is padded with zeros."""

    def __init__(self) -> None:
        self._value, self.bits = 0, 0

    def put(self, value: int, n: int) -> None:
        self._value, self.bits = self._value << n | value & (1 << n) - 1, self.bits + n

    def bytes(self, size: int | None = None) -> bytes:
        """All bits so far, as size bytes if given."""
        n = -(-self.bits // 8)
        out = (self._value << 8 * n - self.bits).to_bytes(n, "big")
        return out if size is None else out.ljust(size, b"\0")
