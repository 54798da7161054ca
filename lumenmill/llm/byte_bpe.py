"""Byte-level BPE, encoded exactly in linear time by backtracking over longest matches.

A piece's bytes become a Latin-1 string, so that an Aho-Corasick automaton of all tokens finds,
in one pass, the longest token at each position. The encoder appends the longest token that is
compatible with the one before it; else it tries that token's longest proper prefix; else it
steps back and marks the position as a dead end, so no position is tried twice with the same
token. Two adjacent tokens are compatible if undoing their merges in order of rank never meets a
merge across their border that BPE would have made first. Compatibility is memoised by pair of
tokens, and finished pieces by their text, both in tables of bounded size.

Defined results: null text is empty, and an empty text has no tokens (the digests are those of
no bytes); repeated rows each get a row; a text of any length is one pass.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Finished pieces and pairs that a worker keeps at most; a full table is emptied, and results stay the same.
PIECES, PAIRS, LONGEST_KEPT = 250_000, 150_000, 48


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class Pieces(dict):
    """Finished pieces by their text, as little-endian 32-bit ids; what is missing is encoded, and kept if it is short."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, text: str) -> bytes:
        ids = self.encode(text.encode("utf-8"))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= LONGEST_KEPT:
            if len(self) >= PIECES:
                self.clear()
            self[text] = out
        return out


class ByteBPE:
    """An encoder and decoder for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {r: t for t, r in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for byte {missing[0]}")
        self.auto = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.auto.add_word(t.decode("latin-1"), r)
        self.auto.make_automaton()
        self.prefix: dict[int, int] = {}
        for t, r in ranks.items():
            for n in range(len(t) - 1, 0, -1):
                if (p := ranks.get(t[:n])) is not None:
                    self.prefix[r] = p
                    break
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self.encode_piece)

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a single byte."""
        if t in self.halves:
            return self.halves[t]
        parts = [bytes([b]) for b in self.token[t]]
        if len(parts) == 1:
            return None
        while len(parts) > 2:  # plain merging, below t's own rank
            rank, i = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and r < t)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.halves[t] = out = (self.ranks[parts[0]], self.ranks[parts[1]])
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE of left's and right's bytes together leaves the border between them alone."""
        key = left << 32 | right
        if (known := self.pairs.get(key)) is not None:
            return known
        a, b, limit, out = left, right, 1 << 62, None
        while out is None:
            both = self.ranks.get(self.token[a] + self.token[b])
            if both is not None and both < limit:
                out = False
                break
            # Undo the latest merge that touches the border; a tie was made on the left first.
            sa, sb = len(self.token[a]) > 1, len(self.token[b]) > 1
            if not sa and not sb:
                out = True
            elif sa and (not sb or a > b):
                limit, a = a, self.split(a)[1]
            else:
                limit, b = b + 1, self.split(b)[0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def encode_piece(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        n = len(raw)
        longest = [0] * n
        lengths = self.lengths
        for end, t in self.auto.iter(raw.decode("latin-1")):
            longest[end + 1 - lengths[t]] = t  # later ends are longer
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, t = 0, longest[0]
        while True:
            end = at + lengths[t]
            if alive[end] and (not out or self.fits(out[-1], t)):
                out.append(t)
                at = end
                if at == n:
                    return out
                t = longest[at]
            elif (shorter := self.prefix.get(t)) is not None:
                t = shorter
            else:
                alive[at] = 0
                t = out.pop()
                at -= lengths[t]

    @property
    def lengths(self) -> list[int]:
        if not hasattr(self, "_lengths"):
            self._lengths = [0] * (max(self.token) + 1)
            for r, t in self.token.items():
                self._lengths[r] = len(t)
        return self._lengths

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[tuple, ByteBPE] = {}


def encoder(raw_ranks: bytes, pattern: str) -> ByteBPE:
    """This worker's encoder for a rank file; built once for each task."""
    key = (hashlib.sha256(raw_ranks).digest(), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(read_ranks(raw_ranks), pattern)
    return _made[key]


def forget() -> None:
    """Drop this worker's encoder and its tables at the end of a task, as Spark keeps workers for whatever comes next."""
    _made.clear()


def tokenize(docs: DataFrame, raw_ranks: bytes, pattern: str, text: str = "text", key: str = "doc_id", decode: bool = True) -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit) and, with ``decode``, decoded (binary) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(raw_ranks)  # a rank file: its size does not depend on the data

    def run(batches):
        bpe = encoder(shared.value, pattern)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            at, size = 0, 0
            ids: list[bytes] = []
            back: list[bytes] = []
            for i, t in enumerate(texts):
                one = bpe.encode(t.as_py() or "")
                ids.append(one)
                back.append(bpe.decode(one) if decode else b"")
                size += len(one) + len(back[-1])
                if size > 4 << 20 or i == len(texts) - 1:
                    cols = [keys.slice(at, len(ids)), pa.array(ids, pa.binary())] + ([pa.array(back, pa.binary())] if decode else [])
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "ids", "decoded"][: len(cols)])
                    at, size, ids, back = i + 1, 0, [], []
        forget()

    kind = docs.select(key).schema[0].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids binary" + ", decoded binary" * decode)
    return out.withColumnRenamed("key", key)


def digests(docs: DataFrame, raw_ranks: bytes, pattern: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 (and ids, if kept), made inside one pass so that no decoded text leaves the worker."""
    shared = docs.sparkSession.sparkContext.broadcast(raw_ranks)
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches):
        bpe = encoder(shared.value, pattern)
        for b in batches:
            keys, at, size = b.column(0), 0, 0
            n, a, d, kept = [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
                    size += len(ids)
                if size > 4 << 20 or i == b.num_rows - 1:
                    columns = [keys.slice(at, len(n)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names=names)
                    at, size = i + 1, 0
                    n, a, d, kept = [], [], [], []
        forget()

    kind = docs.select(key).schema[0].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
    return out.withColumnRenamed("key", key)


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """The bytes of a public rank file and its splitting pattern, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_ranks())
