"""Shared pieces: flat text buffers, vectorised word hashing, small Spark helpers.

Everything here works on whole texts; a batch is only cut between rows, so that the numpy
temporaries stay bounded by ``MAX_BYTES`` or by the longest single text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy block takes; a longer text makes a block of its own.
MAX_BYTES = 1 << 18

#: Words are maximal runs of anything but these: \x20 and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE = mix(np.arange(256, dtype=U) + U(77))
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, MAX_BYTES + 1), base, U)
        a[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(a, out=a)
        if n > 4 * MAX_BYTES:  # not kept: one very long text must not hold memory for ever
            return a
        _powers[base] = have = a
    return have


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the n + 1 offsets of its rows. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    bufs = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(texts: pa.Array, max_bytes: int = MAX_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive blocks of whole rows."""
    data, off = flat(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words_of(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and first[i]: the index of row i's first word (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~breaks[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]  # a word never crosses two rows
    begin[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes (under ``table``) give equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, U)
    n = len(data)
    with np.errstate(over="ignore"):
        acc = table[data]
        acc *= powers(BASE, n)[:n]
        total = np.zeros(n + 1, U)
        np.cumsum(acc, out=total[1:])
        h = (total[ends] - total[starts]) * powers(BASE_INV, n + 1)[starts]
        return mix(h + mix((ends - starts).astype(U)))


def shingles_of(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, row by row, and first[] for them. A row with 1..k-1 words has one shingle: all its words."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    index = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(first[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    with np.errstate(over="ignore"):
        out = mix(size.astype(U))
        for j in range(k):
            live = size > j
            nxt = mix(out * U(3) + hashes[np.minimum(index + j, max(len(hashes) - 1, 0))]) if len(hashes) else out
            out = np.where(live, nxt, out)
    return out, at


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def documents(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes in an Arrow batch. Spark's own default, 64 MB, is much for several Python workers beside a small heap.
ARROW_BYTES, ARROW_KEY, ARROW_DEFAULT = "4194304", "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64MB")


def small_batches(spark) -> None:
    """Lower the session's limit of bytes in an Arrow batch, unless the session has one of its own."""
    if spark.conf.get(ARROW_KEY, ARROW_BYTES) in ARROW_DEFAULT:
        spark.conf.set(ARROW_KEY, ARROW_BYTES)


def shared_folder(spark) -> str:
    """The folder for what lies between steps: spark.checkpoint.dir, which all machines share. Only one machine may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


class Scratch:
    """Tables of one run in a folder of its own below the shared one: written, read by column, and deleted as soon as they are spent."""

    def __init__(self, spark, name: str):
        self.spark, self.top, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df):
        """``df`` as a written table, so that what made it is neither needed nor run again."""
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, *tables) -> None:
        for t in tables:
            self.delete(t.kept_at)

    def delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of at most six numbers that are broadcast: about 3 MB as a hash table. Beyond it, they are joined by a shuffle.
BROADCAST_ROWS = 20_000


def small(df):
    """``df`` (a written table of narrow rows), marked for a broadcast if it has at most BROADCAST_ROWS rows; else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: A key with more than this share of all rows is hot, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def joined(left, right, keys: list[str], weight: str, total: int, how: str = "inner"):
    """``left`` joined with ``right`` (a written table with one row for each of ``keys``, and ``weight``: the rows of ``left`` that have them).

    A right side of at most BROADCAST_ROWS is broadcast. Else its hot keys are, fewer than 1 / HOT_SHARE of them, and only
    rows with other keys are dealt out by key: so no key brings more than that share of all rows to a task.
    ``how``: inner or left.
    """
    from pyspark.sql import functions as F

    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), keys, how)
    hot = right.where(F.col(weight) > HOT_SHARE * total).drop(weight)
    tagged = left.join(F.broadcast(hot.select(*keys, F.lit(True).alias("is_hot"))), keys, "left")
    first = tagged.where("is_hot").drop("is_hot").join(F.broadcast(hot), keys, "inner")
    rest = tagged.where("is_hot is null").drop("is_hot").join(right.where(F.col(weight) <= HOT_SHARE * total).drop(weight), keys, how)
    return first.unionByName(rest)
