"""Bit strings and variable-length integers, as columns and as bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_bits(value: Column, width: int) -> Column:
    """The lowest ``width`` bits of an integer, most significant first, as a string of 0 and 1."""
    return F.substring(F.lpad(F.bin(value), 64, "0"), 65 - width, width)


def get_bit(value: Column, place: int, width: int = 8) -> Column:
    """Bit ``place`` of a ``width``-bit integer, counted from the most significant one."""
    return F.shiftright(value, width - 1 - place).bitwiseAND(F.lit(1))


def pack_bits(bits: str) -> bytes:
    """A bit string as bytes, most significant bit first, the last byte filled up with zeros."""
    if not bits:
        return b""
    size = -(-len(bits) // 8)
    return int(bits.ljust(size * 8, "0"), 2).to_bytes(size, "big")


def unpack_bits(data: bytes, n: int | None = None) -> str:
    bits = f"{int.from_bytes(data, 'big'):0{len(data) * 8}b}" if data else ""
    return bits if n is None else bits[:n]


class BitWriter:
    """Collects bits of single values or of byte strings."""

    def __init__(self):
        self.parts: list[str] = []

    def write(self, data: bytes, n: int, skip: int = 0) -> None:
        """``n`` bits of ``data`` from bit ``skip`` on."""
        self.parts.append(unpack_bits(data)[skip : skip + n])

    def write_str(self, bits: str) -> None:
        self.parts.append(bits)

    def bits(self) -> str:
        return "".join(self.parts)

    def getvalue(self) -> bytes:
        return pack_bits(self.bits())


class BitReader:
    """Reads bits in order; reading past the end is an error."""

    def __init__(self, data: bytes):
        self.bits, self.at = unpack_bits(data), 0

    def read(self, n: int) -> str:
        if self.at + n > len(self.bits):
            raise EOFError("no more bits")
        out = self.bits[self.at : self.at + n]
        self.at += n
        return out

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def encode_varint(n: int) -> bytes:
    """Seven bits a byte, lowest first; the top bit marks that more follow. At most 28 bits."""
    if not 0 <= n < 1 << 28:
        raise ValueError("a length must have at most 28 bits")
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number and the place after it."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at
