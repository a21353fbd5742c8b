"""Codecs, ciphers and checksums of drawing containers: column expressions where SQL can fold them, Arrow functions else."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StructType

# Fixed values of the container format.
MAGIC_LENGTH, LCG_FACTOR, LCG_STEP = 108, 0x343FD, 0x269EC3
PAGE_MASK = 0x4164536B
ADLER_MOD, ADLER_CHUNK = 0xFFF1, 0x15B0
LOCATOR_SEEDS = {3: 0xA598, 4: 0x8101, 5: 0x3CC4, 6: 0x8461}
RS_POLYNOMIAL, RS_PARITY, RS_MESSAGE = 0x11D, 16, 239
SECTION_SEED = 0xC0C1

#: Largest output of a decompression, and longest back reference.
MAX_OUTPUT, MAX_REFERENCE = 256 << 20, 1 << 20


@lru_cache(maxsize=1)
def magic() -> bytes:
    """The byte sequence that masks the encrypted header."""
    seed, out = 1, bytearray()
    for _ in range(MAGIC_LENGTH):
        seed = (seed * LCG_FACTOR + LCG_STEP) & 0xFFFFFFFF
        out.append(seed >> 16 & 0xFF)
    return bytes(out)


def xor(data: bytes, mask: bytes) -> bytes:
    return bytes(a ^ b for a, b in zip(data, mask))


def page_mask(offset: int) -> int:
    return PAGE_MASK ^ (offset & 0xFFFFFFFF)


def mask_words(data: bytes, offset: int) -> bytes:
    """Little-endian words of a page header, masked or unmasked."""
    key = page_mask(offset).to_bytes(4, "little")
    return xor(data, key * (len(data) // 4 + 1))


def rotate_windows(data: bytes, by: int) -> bytes:
    """Each whole window of 7 bytes as a 56-bit number rotated left by `by` bits; a rest stays."""
    by %= 56
    whole = len(data) // 7 * 7
    out = bytearray()
    for i in range(0, whole, 7):
        v = int.from_bytes(data[i : i + 7], "little")
        out += ((v << by | v >> (56 - by)) & (2**56 - 1)).to_bytes(7, "little")
    return bytes(out) + data[whole:]


class Lz77Error(ValueError):
    """A compressed stream that is no such, or exceeds a limit."""


def lz77_decompress(data: bytes, max_output: int = MAX_OUTPUT, max_reference: int = MAX_REFERENCE) -> bytes:
    at, out = 0, bytearray()

    def byte() -> int:
        nonlocal at
        if at >= len(data):
            raise Lz77Error(f"stream ends at {at}")
        at += 1
        return data[at - 1]

    def run(start: int) -> int:
        total = start
        while True:
            b = byte()
            total += b or 0xFF
            if total > max_output:
                raise Lz77Error("length over the limit")
            if b:
                return total

    def literal_length() -> int:
        nonlocal at
        b = byte()
        if b == 0:
            return run(0x0F) + 3
        if b & 0xF0:
            at -= 1
            return 0
        return b + 3

    def literals(n: int) -> None:
        nonlocal at
        if at + n > len(data):
            raise Lz77Error(f"{n} literals at {at} of {len(data)}")
        if len(out) + n > max_output:
            raise Lz77Error("output over the limit")
        out.extend(data[at : at + n])
        at += n

    def far() -> tuple[int, int]:
        a, b = byte(), byte()
        return a >> 2 | b << 6, a & 3

    def extended(op: int, bits: int) -> int:
        return (op & bits or run(bits)) + 2

    literals(literal_length())
    while True:
        op = byte()
        if op == 0x11:
            return bytes(out)
        if op >= 0x40:
            length, offset, lits = (op >> 4) - 1, (byte() << 2 | op >> 2 & 3) + 1, op & 3
        elif op >= 0x20:
            length = run(0) + 0x21 if op == 0x20 else extended(op, 0x1F)
            offset, lits = far()
            offset += 1
        elif op >= 0x10:
            length, high = (run(0) + 9, 0) if op == 0x10 else (extended(op, 7), (op & 8) << 11)
            offset, lits = far()
            offset = (offset | high) + 0x4000
        else:
            raise Lz77Error(f"opcode {op:#x} at {at - 1}")
        if offset > len(out) or offset == 0:
            raise Lz77Error(f"reference {offset} back of {len(out)}")
        if length > max_reference or len(out) + length > max_output:
            raise Lz77Error("reference over the limit")
        start = len(out) - offset
        if offset >= length:
            out += out[start : start + length]
        else:
            piece = bytes(out[start:])
            out += (piece * (length // offset + 1))[:length]
        literals(lits or literal_length())


def lz77_compress(data: bytes) -> bytes:
    """A stream of one run of literals; 1 to 3 bytes can't be written so."""
    if not data:
        return b"\x11"
    if len(data) < 4:
        raise Lz77Error("1 to 3 bytes have no literal form")
    n = len(data) - 3
    if n <= 0x0F:
        head = bytes([n])
    else:
        n -= 0x0F
        zeros = (n - 1) // 0xFF
        head = bytes(1 + zeros) + bytes([n - 0xFF * zeros])
    return head + data + b"\x11"


@lru_cache(maxsize=1)
def crc16_table() -> tuple[int, ...]:
    """Table of the reflected 16-bit polynomial 0xA001."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xA001 if i & 1 else 0)
        out.append(i)
    return tuple(out)


def crc16(data: bytes, seed: int = 0) -> int:
    table = crc16_table()
    for b in data:
        seed = seed >> 8 ^ table[(seed ^ b) & 0xFF]
    return seed & 0xFFFF


def crc32(data: bytes, seed: int = 0) -> int:
    import zlib

    return zlib.crc32(data, seed)


def page_checksum(data: bytes, seed: int = 0) -> int:
    """Adler-like sum of a page, reduced in chunks."""
    low, high = seed & 0xFFFF, seed >> 16
    for i in range(0, len(data), ADLER_CHUNK):
        for b in data[i : i + ADLER_CHUNK]:
            low += b
            high += low
        low %= ADLER_MOD
        high %= ADLER_MOD
    return high << 16 | low


def rotate_add(data: bytes, seed: int = 0) -> int:
    """Rotate left by one bit, then add a byte, in 32 bits."""
    for b in data:
        seed = ((seed << 1 | seed >> 31) + b) & 0xFFFFFFFF
    return seed


# Reed-Solomon (255, 239) over GF(256)


@lru_cache(maxsize=1)
def _field() -> tuple[list[int], list[int]]:
    exp, log, x = [0] * 512, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = x << 1 ^ (RS_POLYNOMIAL if x & 0x80 else 0)
    for i in range(255, 512):
        exp[i] = exp[i - 255]
    return exp, log


def _mul(a: int, b: int) -> int:
    exp, log = _field()
    return exp[log[a] + log[b]] if a and b else 0


@lru_cache(maxsize=1)
def _generator() -> list[int]:
    exp, _ = _field()
    g = [1]
    for i in range(1, RS_PARITY + 1):
        g = [a ^ b for a, b in zip(g + [0], [0] + [_mul(c, exp[i]) for c in g])]
    return g


def rs_encode(message: bytes) -> bytes:
    """A message of 239 bytes with its 16 bytes of parity."""
    if len(message) != RS_MESSAGE:
        raise ValueError(f"a message has {RS_MESSAGE} bytes")
    rest = list(message) + [0] * RS_PARITY
    g = _generator()
    for i in range(RS_MESSAGE):
        if rest[i]:
            for k in range(1, len(g)):
                rest[i + k] ^= _mul(g[k], rest[i])
    return message + bytes(rest[RS_MESSAGE:])


def rs_syndromes(word: bytes) -> list[int]:
    exp, _ = _field()
    out = []
    for i in range(1, RS_PARITY + 1):
        s = 0
        for b in word:
            s = _mul(s, exp[i]) ^ b
        out.append(s)
    return out


def rs_correct(word: bytes) -> tuple[bytes, int]:
    """(message, corrected bytes) of a code word with up to 8 wrong bytes; raises beyond."""
    exp, log = _field()
    synd = rs_syndromes(word)
    if not any(synd):
        return bytes(word[:RS_MESSAGE]), 0
    # Berlekamp-Massey
    loc, old, shift, base, size = [1], [1], 1, 1, 0
    for n in range(RS_PARITY):
        d = synd[n]
        for i in range(1, min(size, len(loc) - 1) + 1):
            d ^= _mul(loc[i], synd[n - i])
        if d == 0:
            shift += 1
            continue
        ratio = _mul(d, exp[255 - log[base]])
        scaled = [0] * shift + [_mul(ratio, c) for c in old]
        new = [a ^ b for a, b in zip(loc + [0] * (len(scaled) - len(loc)), scaled + [0] * (len(loc) - len(scaled)))]
        if 2 * size <= n:
            old, base, size, shift = loc, d, n + 1 - size, 1
        else:
            shift += 1
        loc = new
    while loc and not loc[-1]:
        loc.pop()
    value = lambda poly, x: _horner(poly[::-1], x)
    where = [i for i in range(255) if value(loc, exp[(255 - i) % 255]) == 0]
    if len(where) != len(loc) - 1 or len(where) > RS_PARITY // 2:
        raise ValueError("more errors than the code corrects")
    omega = [0] * RS_PARITY
    for i, a in enumerate(synd):
        for k, b in enumerate(loc):
            if i + k < RS_PARITY:
                omega[i + k] ^= _mul(a, b)
    out = bytearray(word)
    for i in where:
        inv = exp[(255 - i) % 255]
        slope = 0
        for k in range(1, len(loc), 2):
            slope ^= _mul(loc[k], exp[(log[inv] * (k - 1)) % 255] if inv else 0)
        error = _mul(value(omega, inv), exp[255 - log[slope]])
        out[len(word) - 1 - i] ^= error
    if any(rs_syndromes(bytes(out))):
        raise ValueError("more errors than the code corrects")
    return bytes(out[:RS_MESSAGE]), len(where)


def _horner(poly: list[int], x: int) -> int:
    v = 0
    for c in poly:
        v = _mul(v, x) ^ c
    return v


# The same for many code words at once: the code is linear, so its sums are looked up by place and byte.

#: Words that are worked on at once, which bounds the memory beside the input.
RS_CHUNK = 4096


@lru_cache(maxsize=1)
def _products() -> np.ndarray:
    """Products of all pairs of the field."""
    exp, log = map(np.array, _field())
    out = exp[log[:, None] + log].astype(np.uint8)
    out[0] = out[:, 0] = 0
    return out


def _by_place(factors: np.ndarray) -> np.ndarray:
    """(places, sums) of factors as a table (places, 256 bytes, sums) of what a byte adds to each sum."""
    return np.ascontiguousarray(_products()[factors].transpose(0, 2, 1))


@lru_cache(maxsize=1)
def _rs_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a byte adds by its place: to the parity of a message, to the syndromes of a word, to the values of a locator at all places (from the last)."""
    exp = np.array(_field()[0])
    rest, g = [_generator()[1:]], _generator()[1:]
    for _ in range(RS_MESSAGE - 1):
        top, *low = rest[-1]
        rest.append([a ^ _mul(top, b) for a, b in zip([*low, 0], g)])
    syndromes = exp[np.arange(254, -1, -1)[:, None] * np.arange(1, RS_PARITY + 1) % 255]
    values = exp[np.arange(RS_PARITY + 1)[:, None] * (255 - np.arange(255)) % 255]
    return _by_place(np.array(rest[::-1])), _by_place(syndromes), _by_place(values)


def _summed(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The sums of rows of bytes by a table of `_by_place`."""
    wide = table.view(np.uint64) if table.shape[2] % 8 == 0 else table
    out = np.zeros((len(data), wide.shape[2]), wide.dtype)
    for at in range(len(wide)):
        out ^= wide[at].take(data[:, at], axis=0)
    return out.view(np.uint8)


def rs_encode_all(messages: np.ndarray) -> np.ndarray:
    """`rs_encode` of rows of 239 bytes."""
    out = np.empty((len(messages), RS_MESSAGE + RS_PARITY), np.uint8)
    out[:, :RS_MESSAGE] = messages
    for at in range(0, len(messages), RS_CHUNK):
        out[at : at + RS_CHUNK, RS_MESSAGE:] = _summed(_rs_tables()[0], messages[at : at + RS_CHUNK])
    return out


def rs_correct_all(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(messages, corrected bytes) of rows of 255 bytes as by `rs_correct`; -1 where that raises."""
    messages, corrected = words[:, :RS_MESSAGE].copy(), np.zeros(len(words), np.int32)
    for start in range(0, len(words), RS_CHUNK):
        synd = _summed(_rs_tables()[1], words[start : start + RS_CHUNK])
        at = np.flatnonzero(synd.any(1))
        if len(at):
            mended, corrected[start + at] = _rs_mended(words[start + at], synd[at])
            messages[start + at] = mended[:, :RS_MESSAGE]
    return messages, corrected


def _rs_mended(words: np.ndarray, synd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, corrected bytes or -1) of words with syndromes that aren't all zero."""
    products, n = _products(), len(words)
    exp, log = map(np.array, _field())
    inverse = exp[255 - log].astype(np.uint8)
    # Berlekamp-Massey; `old` is moved by one place a round, which never moves a coefficient out
    loc, old = np.zeros((2, n, RS_PARITY + 1), np.uint8)
    loc[:, 0] = old[:, 1] = 1
    base, size = np.ones(n, np.uint8), np.zeros(n, np.int64)
    for i in range(RS_PARITY):
        d = synd[:, i].copy()
        for k in range(1, i + 1):
            d ^= products[loc[:, k], synd[:, i - k]]
        new = loc ^ products[products[d, inverse[base]][:, None], old]
        grown = (d != 0) & (2 * size <= i)
        old = np.where(grown[:, None], loc, old)
        old[:, 1:], old[:, 0] = old[:, :-1].copy(), 0
        base, size, loc = np.where(grown, d, base), np.where(grown, i + 1 - size, size), new
    degree = RS_PARITY - (loc[:, ::-1] != 0).argmax(1)
    roots = _summed(_rs_tables()[2], loc) == 0
    count = roots.sum(1)
    sound = (count == degree) & (count <= RS_PARITY // 2)
    omega = np.zeros((n, RS_PARITY), np.uint8)
    for k in range(RS_PARITY):
        omega[:, k:] ^= products[synd[:, : RS_PARITY - k], loc[:, k : k + 1]]
    row, place = np.nonzero(roots & sound[:, None])
    power = lambda k: exp[(255 - place) * k % 255]
    value, slope = np.zeros((2, len(row)), np.uint8)
    for k in range(RS_PARITY):
        value ^= products[omega[row, k], power(k)]
    for k in range(1, RS_PARITY + 1, 2):
        slope ^= products[loc[row, k], power(k - 1)]
    out = words.copy()
    out[row, 254 - place] ^= products[value, inverse[slope]]
    sound &= ~_summed(_rs_tables()[1], out).any(1)
    return out, np.where(sound, count, -1)


# Column forms


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text as an array of numbers; an empty text gives an empty array."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("bigint"))


def page_checksum_of(numbers: Column, seed: int = 0) -> Column:
    """`page_checksum` of an array of bytes, in one fold: reductions commute with the sums."""
    zero = F.struct(F.lit(seed & 0xFFFF).cast("bigint").alias("low"), F.lit(seed >> 16).cast("bigint").alias("high"))
    step = lambda a, b: F.struct(((a["low"] + b) % ADLER_MOD).alias("low"), ((a["high"] + a["low"] + b) % ADLER_MOD).alias("high"))
    return F.aggregate(numbers, zero, step, lambda a: a["high"] * 65536 + a["low"])


def rotate_add_of(numbers: Column, seed: int = 0) -> Column:
    """`rotate_add` of an array of bytes."""
    step = lambda s, b: (F.shiftleft(s, 1).bitwiseAND(0xFFFFFFFF).bitwiseOR(F.shiftrightunsigned(s, 31)) + b).bitwiseAND(0xFFFFFFFF)
    return F.aggregate(numbers, F.lit(seed).cast("bigint"), step)


def crc16_of(numbers: Column, seed: int = 0) -> Column:
    """`crc16` of an array of bytes."""
    table = F.array(*[F.lit(x).cast("bigint") for x in crc16_table()])
    step = lambda s, b: F.shiftrightunsigned(s, 8).bitwiseXOR(F.element_at(table, (s.bitwiseXOR(b).bitwiseAND(255) + 1).cast("int")))
    return F.aggregate(numbers, F.lit(seed).cast("bigint"), step)


def mask_of(offset: Column) -> Column:
    return F.lit(PAGE_MASK).cast("bigint").bitwiseXOR(offset.cast("bigint"))


def rs_words(length: Column) -> Column:
    """Code words that a message of so many bytes takes."""
    return F.ceil(length / RS_MESSAGE)


@pandas_udf(StructType().add("data", "binary").add("status", "string"))
def lz77_decompressed(data: pd.Series) -> pd.DataFrame:
    """Decompressed bytes and 'ok', or null and what is wrong; null gives null."""
    out = []
    for d in data:
        try:
            out.append((None, None) if d is None else (lz77_decompress(bytes(d)), "ok"))
        except Lz77Error as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["data", "status"])


@pandas_udf(BinaryType())
def lz77_compressed(data: pd.Series) -> pd.Series:
    """The literal-only stream; null for null and for 1 to 3 bytes."""
    return data.map(lambda d: None if d is None or 0 < len(d) < 4 else lz77_compress(bytes(d)))


def _rows_of(data: list[bytes], size: int) -> np.ndarray:
    """Rows of so many bytes of all data together."""
    return np.frombuffer(b"".join(data), np.uint8).reshape(-1, size)


@pandas_udf(BinaryType())
def rs_encoded(data: pd.Series) -> pd.Series:
    """Code words of the bytes, the last message filled up with zeros."""
    filled = [b"" if d is None else bytes(d) + bytes(-len(d) % RS_MESSAGE) for d in data]
    words, at, out = rs_encode_all(_rows_of(filled, RS_MESSAGE)), 0, []
    for d, f in zip(data, filled):
        n = len(f) // RS_MESSAGE
        out.append(None if d is None else words[at : at + n].tobytes())
        at += n
    return pd.Series(out, dtype=object)


@pandas_udf(StructType().add("data", "binary").add("corrected", "integer").add("status", "string"))
def rs_decoded(words: pd.Series) -> pd.DataFrame:
    """Messages of the code words, corrected bytes, and 'ok' or what is wrong."""
    whole = [d is not None and len(d) % 255 == 0 for d in words]
    messages, corrected = rs_correct_all(_rows_of([bytes(d) for d, w in zip(words, whole) if w], 255))
    at, out = 0, []
    for d, w in zip(words, whole):
        if not w:
            out.append((None, None, None if d is None else "no whole code words"))
            continue
        own = slice(at, at := at + len(d) // 255)
        if (corrected[own] < 0).any():
            out.append((None, None, "more errors than the code corrects"))
        else:
            out.append((messages[own].tobytes(), int(corrected[own].sum()), "ok"))
    return pd.DataFrame(out, columns=["data", "corrected", "status"])


def embed(data: bytes, at: int, value: int, size: int) -> bytes:
    """`data` with a little-endian checksum in its slot."""
    return data[:at] + value.to_bytes(size, "little") + data[at + size :]


def words(data: bytes, n: int) -> tuple[int, ...]:
    return struct.unpack_from(f"<{n}I", data)
