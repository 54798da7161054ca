"""The boolean arithmetic coder of VP8: bits with a probability of 0 in 256ths."""

from __future__ import annotations

from .errors import CodecError


class BoolDecoder:
    """Zeros stand in for a little beyond the end; reading further is an error."""

    __slots__ = ("at", "data", "have", "range", "value")

    def __init__(self, data: bytes):
        if not data:
            raise CodecError("NotEnoughInitData")
        self.data, self.at, self.range = data, 0, 255
        self.value, self.have = 0, -8  # ``value`` holds ``have`` + 8 bits
        self._fill()

    def _fill(self) -> None:
        part = self.data[self.at : self.at + 6]
        if not part and self.at > len(self.data) + 2:
            raise CodecError("BitStreamError")
        self.at += 6 if len(part) == 6 else max(len(part), 1)
        n = max(len(part), 1)
        self.value = self.value << 8 * n | int.from_bytes(part, "big")
        self.have += 8 * n

    def bit(self, probability: int = 128) -> int:
        split = 1 + ((self.range - 1) * probability >> 8)
        if self.have < 0:
            self._fill()
        big = split << self.have
        if self.value >= big:
            self.value -= big
            self.range -= split
            out = 1
        else:
            self.range = split
            out = 0
        if self.range < 128:
            shift = 8 - self.range.bit_length()
            self.range <<= shift
            self.have -= shift
        return out

    def literal(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def optional(self, n: int) -> int:
        """0, or n bits of magnitude and a sign (1: negative)."""
        if not self.bit():
            return 0
        size = self.literal(n)
        return -size if self.bit() else size

    def tree(self, tree: tuple[int, ...], probabilities, start: int = 0) -> int:
        """A leaf: entries above 0 lead on, others are leaves' negatives; a pair of entries has one probability."""
        i = start
        while (i := tree[i + self.bit(probabilities[i >> 1])]) > 0:
            pass
        return -i


class BoolEncoder:
    def __init__(self):
        self.out, self.low, self.range, self.left = bytearray(), 0, 255, 24

    def bit(self, value: int, probability: int = 128) -> None:
        split = 1 + ((self.range - 1) * probability >> 8)
        if value:
            self.low += split
            self.range -= split
        else:
            self.range = split
        while self.range < 128:
            self.range <<= 1
            if self.low & 1 << 31:  # a carry runs back over full bytes
                k = len(self.out) - 1
                while k >= 0 and self.out[k] == 255:
                    self.out[k] = 0
                    k -= 1
                self.out[k] += 1
            self.low = self.low << 1 & 0xFFFFFFFF
            self.left -= 1
            if not self.left:
                self.out.append(self.low >> 24)
                self.low &= 0xFFFFFF
                self.left = 8

    def literal(self, value: int, n: int) -> None:
        for k in range(n - 1, -1, -1):
            self.bit(value >> k & 1)

    def optional(self, value: int, n: int) -> None:
        self.bit(value != 0)
        if value:
            self.literal(abs(value), n)
            self.bit(value < 0)

    def tree(self, tree: tuple[int, ...], probabilities, leaf: int, start: int = 0) -> None:
        path: list[tuple[int, int]] = []

        def find(i: int) -> bool:
            for b in (0, 1):
                t = tree[i + b]
                if (t <= 0 and -t == leaf) or (t > 0 and find(t)):
                    path.append((b, i >> 1))
                    return True
            return False

        find(start)
        for b, p in reversed(path):
            self.bit(b, probabilities[p])

    def done(self) -> bytes:
        for _ in range(32):
            self.bit(0)
        return bytes(self.out)
