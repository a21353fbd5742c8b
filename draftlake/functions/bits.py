"""Bit-level values of drawing records: serial reader and writer, and column forms.

Most significant bit first. Reading past the end raises `BitsExhausted`, which
the record decoders turn into an error row.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


class BitsExhausted(ValueError):
    """The record ends before the value does."""


class BitReader:
    """Cursor over the bits of one record; `unicode` says how its strings are stored."""

    def __init__(self, data: bytes, unicode: bool = True, at: int = 0):
        self.data, self.size, self.at, self.unicode = data, 8 * len(data), at, unicode

    def bits(self, n: int) -> int:
        if self.at + n > self.size:
            raise BitsExhausted(f"{n} bits at {self.at} of {self.size}")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[first:last], "big")
        self.at += n
        return (word >> (8 * last - self.at)) & ((1 << n) - 1)

    def raw(self, n: int) -> bytes:
        return self.bits(8 * n).to_bytes(n, "big") if n else b""

    def remaining(self) -> int:
        return self.size - self.at

    def align(self) -> None:
        self.at = (self.at + 7) & ~7

    # raw values, little-endian
    def RC(self) -> int:
        return self.bits(8)

    def RS(self) -> int:
        return int.from_bytes(self.raw(2), "little")

    def RL(self) -> int:
        return int.from_bytes(self.raw(4), "little")

    def RD(self) -> float:
        return struct.unpack("<d", self.raw(8))[0]

    # tagged values
    def B(self) -> bool:
        return bool(self.bits(1))

    def BB(self) -> int:
        return self.bits(2)

    def B3(self) -> int:
        out = 0
        for _ in range(3):
            bit = self.bits(1)
            out = out << 1 | bit
            if not bit:
                break
        return {0: 0, 2: 2, 6: 6, 7: 7}[out]

    def BSu(self) -> int:
        tag = self.bits(2)
        return self.RS() if tag == 0 else self.RC() if tag == 1 else 0 if tag == 2 else 256

    def BS(self) -> int:
        v = self.BSu()
        return v - 0x10000 if v > 0x7FFF else v

    def BLu(self) -> int:
        tag = self.bits(2)
        if tag == 3:
            raise ValueError("tag 3 of a long")
        return self.RL() if tag == 0 else self.RC() if tag == 1 else 0

    def BL(self) -> int:
        v = self.BLu()
        return v - (1 << 32) if v > 0x7FFFFFFF else v

    def BLL(self) -> int:
        return int.from_bytes(self.raw(self.B3()), "little")

    def BD(self) -> float:
        tag = self.bits(2)
        if tag == 3:
            raise ValueError("tag 3 of a double")
        return self.RD() if tag == 0 else 1.0 if tag == 1 else 0.0

    def MC(self) -> int:
        """Signed modular number: seven bits a byte, low first; the last byte has a sign bit and six bits."""
        out = shift = 0
        while True:
            b = self.RC()
            if b & 0x80:
                out |= (b & 0x7F) << shift
                shift += 7
                if shift > 63:
                    raise ValueError("modular number without an end")
                continue
            out |= (b & 0x3F) << shift
            return -out if b & 0x40 else out

    def MS(self) -> int:
        """Modular number of fifteen bits a word, low word first."""
        out = shift = 0
        while True:
            w = self.RS()
            out |= (w & 0x7FFF) << shift
            if not w & 0x8000:
                return out
            shift += 15
            if shift > 45:
                raise ValueError("modular short without an end")

    def H(self) -> dict:
        code, counter = self.bits(4), self.bits(4)
        if counter > 8:
            raise ValueError(f"handle of {counter} bytes")
        value = int.from_bytes(self.raw(counter), "big")
        return {"code": code, "counter": counter, "value": value - (1 << 64) if value >> 63 else value}

    def TV(self) -> str:
        n = self.BSu()
        text = self.raw(2 * n).decode("utf-16-le", "replace") if self.unicode else self.raw(n).decode("utf-8", "replace")
        return text[:-1] if text.endswith("\0") else text

    def BE(self) -> tuple[float, float, float]:
        return (0.0, 0.0, 1.0) if self.B() else (self.BD(), self.BD(), self.BD())

    def BT(self) -> float:
        return 0.0 if self.B() else self.BD()


class BitWriter:
    """Counterpart of `BitReader`; chooses the shortest tagged form."""

    def __init__(self, unicode: bool = True):
        self.word, self.size, self.unicode = 0, 0, unicode
        self.parts: list[bytes] = []

    def bits(self, v: int, n: int) -> None:
        self.word = self.word << n | (v & ((1 << n) - 1))
        self.size += n

    def raw(self, data: bytes) -> None:
        if data:
            self.bits(int.from_bytes(data, "big"), 8 * len(data))

    def bytes(self) -> bytes:
        pad = -self.size % 8
        return (self.word << pad).to_bytes((self.size + pad) // 8, "big")

    def RC(self, v: int) -> None:
        self.bits(v, 8)

    def RS(self, v: int) -> None:
        self.raw((v & 0xFFFF).to_bytes(2, "little"))

    def RL(self, v: int) -> None:
        self.raw((v & 0xFFFFFFFF).to_bytes(4, "little"))

    def RD(self, v: float) -> None:
        self.raw(struct.pack("<d", v))

    def B(self, v: bool) -> None:
        self.bits(int(bool(v)), 1)

    def BB(self, v: int) -> None:
        self.bits(v, 2)

    def B3(self, v: int) -> None:
        if v not in (0, 2, 6, 7):
            raise ValueError(f"{v} has no three-bit form")
        self.bits({0: 0, 2: 2, 6: 6, 7: 7}[v], {0: 1, 2: 2, 6: 3, 7: 3}[v])

    def BSu(self, v: int) -> None:
        v &= 0xFFFF
        if v == 0:
            self.bits(2, 2)
        elif v == 256:
            self.bits(3, 2)
        elif v < 256:
            self.bits(1, 2)
            self.RC(v)
        else:
            self.bits(0, 2)
            self.RS(v)

    BS = BSu

    def BLu(self, v: int) -> None:
        v &= 0xFFFFFFFF
        if v == 0:
            self.bits(2, 2)
        elif v < 256:
            self.bits(1, 2)
            self.RC(v)
        else:
            self.bits(0, 2)
            self.RL(v)

    BL = BLu

    def BLL(self, v: int) -> None:
        n = (v.bit_length() + 7) // 8
        n = next((k for k in (0, 2, 6, 7) if k >= n), None)
        if n is None:
            raise ValueError("more than 56 bits")
        self.B3(n)
        self.raw(v.to_bytes(n, "little"))

    def BD(self, v: float) -> None:
        if v == 1.0:
            self.bits(1, 2)
        elif v == 0.0:
            self.bits(2, 2)
        else:
            self.bits(0, 2)
            self.RD(v)

    def MC(self, v: int) -> None:
        n, out = abs(v), []
        while n > 0x3F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n | (0x40 if v < 0 else 0))
        self.raw(bytes(out))

    def MS(self, v: int) -> None:
        while v > 0x7FFF:
            self.RS(v & 0x7FFF | 0x8000)
            v >>= 15
        self.RS(v)

    def H(self, v: dict) -> None:
        value = v["value"] & (2**64 - 1)
        n = max(v.get("counter") or 0, (value.bit_length() + 7) // 8)
        self.bits(v["code"], 4)
        self.bits(n, 4)
        self.raw(value.to_bytes(n, "big"))

    def TV(self, v: str) -> None:
        data = v.encode("utf-16-le") if self.unicode else v.encode()
        self.BSu(len(data) // 2 if self.unicode else len(data))
        self.raw(data)

    def BE(self, v: tuple[float, float, float]) -> None:
        plain = tuple(v) == (0.0, 0.0, 1.0)
        self.B(plain)
        if not plain:
            for x in v:
                self.BD(x)

    def BT(self, v: float) -> None:
        self.B(v == 0.0)
        if v != 0.0:
            self.BD(v)


# Column forms


def short_bits(v: Column) -> Column:
    """Bits of a tagged short."""
    return F.when(v.isin(0, 256), 2).when(v.between(1, 255), 10).otherwise(18)


def long_bits(v: Column) -> Column:
    """Bits of a tagged long."""
    return F.when(v == 0, 2).when(v.between(1, 255), 10).otherwise(34)


def double_bits(v: Column) -> Column:
    """Bits of a tagged double; minus zero is written as zero."""
    return F.when((v == 0.0) | (v == 1.0), 2).otherwise(66)


def is_soft_owner(h: Column) -> Column:
    return h["code"] == 2


def is_hard_owner(h: Column) -> Column:
    return h["code"] == 3


def is_absolute(h: Column) -> Column:
    return h["code"].between(2, 5)


def is_offset(h: Column) -> Column:
    return h["code"].isin(6, 8, 10, 12)
