"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of 512 bytes that overlap by half, from the first byte to the last.
Learned filters slide over the embedded bytes of a chunk (16 bytes wide, 8 apart; a byte that
repeats what stands a few bytes earlier has an embedding of its own) and are max-pooled in it; a
hidden layer reads each chunk, its units are max-pooled over all chunks of the text and combined
into one probability. So both a telling passage and a chunk that lacks what prose has count,
wherever they are. Chunks are processed in segments of bounded size: per 512 bytes only the pooled
values stay.

The network is fitted on the driver, on at most ``ROWS`` labelled texts (whole ones, chosen by
hash of doc_id among rows whose crc32 mod 3 is not 1). Labels, language, source and ids are
never inputs.

Defined results: a null or empty text is one chunk of padding alone and gets that score; repeated rows
each get a row (a labelled doc_id with several texts is learnt from the smallest); without labelled rows of both kinds every score is the share of good rows (0.5
without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches, text_column

ROWS, EPOCHS, BATCH, RATE = 2000, 12, 24, 0.01
STEP, DIM, FILTERS, HIDDEN = 8, 8, 32, 12
#: Ids: a byte, padding, or a byte that repeats what stands a few bytes before it.
PAD, PAD_NEXT, IDS, LAGS = 256, np.uint16(257), 513, 24
#: Rows of STEP bytes in half a chunk, and half chunks in one segment.
HALF, SEGMENT = 32, 256


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids in rows of STEP, every text from a row's start and with a row of padding at its end; first row of each text."""
    size = np.diff(off)
    rows = np.maximum((size + STEP - 1) // STEP, 1) + 1
    first = np.zeros(len(off), np.int64)
    np.cumsum(rows, out=first[1:])
    ids = np.full(int(first[-1]) * STEP, PAD, np.uint16)
    if len(data):
        ids[np.arange(len(data)) + np.repeat(first[:-1] * STEP - off[:-1], size)] = data + PAD_NEXT * echoes(data, off)
    return ids.reshape(-1, STEP), first


def echoes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """1 for each byte that ends four bytes which stand the same way up to LAGS bytes earlier in the text."""
    place = np.minimum(np.arange(len(data)) - np.repeat(off[:-1], np.diff(off)), 255).astype(np.uint8)
    out = np.zeros(len(data), bool)
    for d in range(1, LAGS + 1):
        if len(data) < d + 4:
            break
        same = data[d:] == data[:-d]
        four = same[3:] & same[2:-1] & same[1:-2] & same[:-3]
        out[d + 3 :] |= four & (place[d + 3 :] >= d + 3)
    return out.astype(np.uint16)


class Net:
    """The parameters and both passes."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (rng.standard_normal((IDS, DIM)) * 0.5).astype(np.float32), "W": f(2 * STEP * DIM, FILTERS), "b": np.zeros(FILTERS, np.float32), "V": f(FILTERS, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "u": f(HIDDEN), "d": np.zeros(1, np.float32)}
        self.p["E"][PAD] = 0
        self.constant: float | None = None

    def halves(self, ids: np.ndarray, first: np.ndarray, where: bool = False):
        """Each filter's maximum in each half chunk, the first half of each text, and with ``where`` the rows at which the maxima lie."""
        e, w, width = self.p["E"], self.p["W"], STEP * DIM
        rows = np.diff(first)
        count = -(-rows // HALF)
        begin = np.zeros(len(first), np.int64)
        np.cumsum(count, out=begin[1:])
        start = np.repeat(first[:-1], count) + HALF * (np.arange(begin[-1]) - np.repeat(begin[:-1], count))
        start = np.append(start, first[-1])
        last = first[1:] - 1  # a text's last row is padding and starts no window
        out = np.empty((begin[-1], self.p["W"].shape[1]), np.float32)
        at = np.zeros(out.shape, np.int64) if where else None
        for k in range(0, len(out), SEGMENT):
            k2 = min(k + SEGMENT, len(out))
            a, b = int(start[k]), int(start[k2])
            x = e[ids[a : b + 1]].reshape(-1, width)
            act = x[: b - a] @ w[:width]
            act[: len(x) - 1] += x[1:] @ w[width:]
            act[last[np.searchsorted(last, a) : np.searchsorted(last, b)] - a] = -np.inf
            cuts = start[k:k2] - a
            out[k:k2] = np.maximum.reduceat(act, cuts, axis=0)
            if where:
                for i, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], b - a], strict=True)):
                    at[k + i] = act[lo:hi].argmax(0) + lo + a
        return out, begin, at

    def chunks(self, half: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima of each chunk (two neighbouring halves; a text of one half is one chunk), the halves they start with, and the first chunk of each text."""
        n = np.maximum(np.diff(begin) - 1, 1)
        first = np.zeros(len(begin), np.int64)
        np.cumsum(n, out=first[1:])
        left = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(begin[:-1], n)
        right = np.minimum(left + 1, np.repeat(begin[1:] - 1, n))
        return np.maximum(half[left], half[right]), np.stack([left, right]), first

    def head(self, pool: np.ndarray, first: np.ndarray):
        h = np.maximum(pool + self.p["b"], 0)
        z = np.tanh(h @ self.p["V"] + self.p["c"])
        top = np.maximum.reduceat(z, first[:-1], axis=0)
        return h, z, top, 1 / (1 + np.exp(-np.clip(top @ self.p["u"] + self.p["d"][0], -30, 30)))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        half, begin, _ = self.halves(*padded(data, off))
        pool, _, first = self.chunks(half, begin)
        return self.head(pool, first)[3].astype(np.float64)

    def gradients(self, ids, first, y, weight) -> dict[str, np.ndarray]:
        half, begin, at = self.halves(ids, first, True)
        pool, sides, chunk = self.chunks(half, begin)
        h, z, top, p = self.head(pool, chunk)
        g = ((p - y) * weight / weight.sum()).astype(np.float32)
        dz = np.zeros_like(z)
        for t, (lo, hi) in enumerate(zip(chunk[:-1], chunk[1:], strict=True)):
            arg = z[lo:hi].argmax(0) + lo
            units = np.arange(z.shape[1])
            dz[arg, units] = g[t] * self.p["u"] * (1 - z[arg, units] ** 2)
        live = np.flatnonzero(dz.any(1))  # chunks that decide some unit
        dz, h, left, right = dz[live], h[live], sides[0][live], sides[1][live]
        row = np.where(half[left] >= half[right], at[left], at[right])
        dh = dz @ self.p["V"].T * (h > 0)
        seen = ids[np.stack([row, np.minimum(row + 1, len(ids) - 1)], -1)].reshape(*row.shape, -1)  # chunks x filters x 16
        x = self.p["E"][seen].reshape(*row.shape, -1)
        de = np.zeros_like(self.p["E"])
        dx = (dh[:, :, None] * self.p["W"].T[None]).reshape(-1, DIM)
        flat = seen.reshape(-1)
        for k in range(DIM):
            de[:, k] = np.bincount(flat, dx[:, k], minlength=IDS)
        de[PAD] = 0
        return {"E": de, "W": np.einsum("df,dfk->kf", dh, x, optimize=True), "b": dh.sum(0), "V": h.T @ dz, "c": dz.sum(0), "u": top.T @ g, "d": np.array([g.sum()], np.float32)}


def fit(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Net:
    """Adam on balanced classes; a fixed order for a fixed seed, so that refits agree."""
    net = Net(seed)
    y = y.astype(np.float32)
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())).astype(np.float32)
    packed = []
    for t in texts:
        raw = np.frombuffer(t, np.uint8)
        packed.append(padded(raw, np.array([0, len(raw)]))[0])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    n = 0
    total = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick = order[i : i + BATCH]
            ids = np.concatenate([packed[k] for k in pick])
            first = np.concatenate([[0], np.cumsum([len(packed[k]) for k in pick])])
            n += 1
            rate = RATE * (1 - 0.9 * n / total)
            for k, g in net.gradients(ids, first, y[pick], weight[pick]).items():
                g = g + 1e-4 * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)
            net.p["E"][PAD] = 0
    return net


def labelled(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """At most ``rows`` labelled texts that may be learnt from, half of each kind where there are enough."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pick = [lab.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for q in (0, 1)]
    some = F.broadcast(pick[0].unionByName(pick[1]))  # at most ``rows`` small rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(some, "doc_id")
    return texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one text for each label, however often its row is repeated


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Net:
    got = sorted({(r["doc_id"], r["text"] or "", r["quality"]) for r in labelled(docs, labels, rows).toLocalIterator()})
    return fit([t.encode() for _, t, _ in got], np.array([q for _, _, q in got]))


def score_documents(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for b in batches:
            parts = [net.score(data, off) for _, _, data, off in blocks(text_column(b))]
            score = np.round(np.concatenate(parts), 6) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.select('doc_id').schema[0].dataType.simpleString()}, score double")


def op1_quality_net(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, train(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
