"""Bits of a byte string, lowest first, and prefix codes over them."""

from __future__ import annotations

import heapq

from .errors import CodecError


class BitReader:
    """Reads past the end raise BitStreamError; peeks past it see zeros."""

    __slots__ = ("at", "data", "end")

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise CodecError("BitStreamError")

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.skip(n)
        return out


class BitWriter:
    def __init__(self):
        self.out, self.word, self.n = bytearray(), 0, 0

    def write(self, value: int, n: int) -> None:
        self.word |= value << self.n
        self.n += n
        if self.n >= 64:
            k = self.n >> 3
            self.out += (self.word & ((1 << 8 * k) - 1)).to_bytes(k, "little")
            self.word >>= 8 * k
            self.n -= 8 * k

    def done(self) -> bytes:
        return bytes(self.out) + (self.word.to_bytes((self.n + 7) >> 3, "little") if self.n else b"")


def reversed_bits(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


def codes_of(lengths: list[int]) -> list[int]:
    """Canonical codes (by length, then symbol), each with its bits in stream order."""
    out, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = reversed_bits(code, n)
        code += 1
    return out


class PrefixCode:
    """A complete prefix code as one table over its longest code; a single symbol takes no bits."""

    __slots__ = ("bits", "single", "table")

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.single = used[0] if len(used) == 1 else None
        if self.single is not None:
            return
        if not used or sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
            raise CodecError("HuffmanError")
        self.bits = max(lengths)
        self.table = [(0, 0)] * (1 << self.bits)
        for s, (n, code) in enumerate(zip(lengths, codes_of(lengths), strict=True)):
            if n:
                self.table[code :: 1 << n] = [(s, n)] * (1 << (self.bits - n))

    @classmethod
    def of(cls, *symbols: int) -> PrefixCode:
        """One symbol, or two of one bit each: the first is bit 0."""
        out = cls.__new__(cls)
        out.single = symbols[0] if len(symbols) == 1 else None
        if len(symbols) == 2:
            out.bits, out.table = 1, [(symbols[0], 1), (symbols[1], 1)]
        return out

    def read(self, r: BitReader) -> int:
        if self.single is not None:
            return self.single
        s, n = self.table[r.peek(self.bits)]
        r.skip(n)
        return s


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Lengths of an optimal code; counts are flattened until none is longer than ``limit``. Fewer than two symbols: all zero."""
    counts = list(counts)
    while True:
        heap = [(n, s, (s,)) for s, n in enumerate(counts) if n]
        out = [0] * len(counts)
        if len(heap) < 2:
            return out
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(out) <= limit:
            return out
        counts = [(n + 1) // 2 for n in counts]
