"""Quality rules: statistics of whole texts, judged by an isolation forest.

Each document is reduced to counts (one Arrow pass, numpy inside). Ratios of these counts go to
an isolation forest: random axis-parallel splits, where few splits isolate a point that lies
apart. The trees are grown on labelled rows that are marked good, so a short path means "unlike
good text"; each tree draws its ``LEAF_SAMPLE`` rows from all of them, as the method has it. Means,
ranges and the threshold are those of all labelled rows that may be learnt from, and are found in
Spark; then every document is scored.

Defined results: null text counts as empty; without words all counts are 0 and ``base_failed``
is true; repeated rows each get their own row; nulls in other columns pass through; with no
labelled rows the forest rejects nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE, U, Scratch, blocks, mix, shingles_of, small_batches, span_hashes, text_column, words_of

TREES, LEAF_SAMPLE, DEPTH = 100, 256, 12
#: Words of average good text that each text is counted with, and the share of repeated words that is no anomaly.
SHRINK, TOLERATED = 200.0, 0.25
#: At most this share of the labelled good rows may lie beyond the threshold.
MAX_LOST = 0.001
#: Rows that are numbered in one bucket, on average, and bins of scores in the search for a quantile.
NUMBERED, BINS = 5000, 4096

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT[list(b"!\"'(),-./:;?@[\\]^_`{}~+=")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_bangs", "n_distinct")
COUNT_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _dup_lines(raw: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    seen, lines, dups = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    return dups, lines


def _repeats(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more in their row."""
    if not len(keys):
        return np.zeros(0, bool)
    with np.errstate(over="ignore"):
        salted = mix(keys ^ mix(row.astype(U) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(salted)
    s = salted[order]
    same = s[1:] == s[:-1]
    dup = np.zeros(len(s), bool)
    dup[1:] |= same
    dup[:-1] |= same
    out = np.zeros(len(s), bool)
    out[order] = dup
    return out


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for _, _, data, off in blocks(texts):
        starts, ends, first = words_of(data, off)
        n_words = np.diff(first)
        row = np.repeat(np.arange(len(off) - 1), n_words)
        hashes = span_hashes(data, starts, ends, BYTE)
        grams, at = shingles_of(hashes, first, 3)
        grow = np.repeat(np.arange(len(off) - 1), np.diff(at))
        full = n_words[grow] >= 3
        hit = np.flatnonzero(_repeats(grams[full], grow[full]))
        covered = np.zeros(len(starts) + 3, bool)
        if len(hit):
            where = (np.arange(len(grams)) - at[:-1][grow] + first[:-1][grow])[full][hit]
            for j in range(3):
                covered[where + j] = True
        covered = covered[: len(starts)]
        code_point = (data & 0xC0) != 0x80
        in_words = code_point & ~np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
        raw = data.tobytes()
        lines = [_dup_lines(raw[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
        dup, n_lines = (np.array(x, np.int64) for x in zip(*lines, strict=True))
        distinct = np.zeros(len(off) - 1, np.int64)
        if len(hashes):
            with np.errstate(over="ignore"):
                key = mix(hashes ^ mix(row.astype(U)))
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            distinct = np.bincount(row[order][new], minlength=len(off) - 1).astype(np.int64)
        got = {
            "n_words": n_words, "word_chars": _per_row(in_words, off), "n_symbols": _per_row(SYMBOLS[data], off), "n_dup_lines": dup,
            "n_repeat_words": np.bincount(row[covered], minlength=len(off) - 1), "n_lines": n_lines, "n_upper": _per_row(_UPPER[data], off),
            "n_punct": _per_row(_PUNCT[data], off), "n_bangs": _per_row(data == 33, off), "n_distinct": distinct,
        }
        for c in COUNTS:
            parts[c].append(got[c].astype(np.int64))
    return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in parts.items()}


def features(c: dict[str, np.ndarray], prior: tuple[float, ...] | None = None) -> np.ndarray:
    """Ratios that do not depend on a text's length, one row per text.

    Ratios of short texts vary more; with ``prior`` (the mean ratios of good rows) each text is
    counted as if SHRINK words of average good text were added. Repeats count beyond TOLERATED.
    """
    add = 0.0 if prior is None else SHRINK
    prior = prior or (0.0,) * 4
    words, chars = c["n_words"] + add, c["word_chars"] + add * 5.0
    cols = (
        (c["n_symbols"] + add * prior[0]) / np.maximum(words, 1), np.maximum((c["n_repeat_words"] + add * prior[1]) / np.maximum(words, 1) - TOLERATED, 0),
        (c["n_upper"] + add * 5.0 * prior[2]) / np.maximum(chars, 1), (c["n_punct"] + add * prior[3]) / np.maximum(words, 1),
    )
    return np.stack([np.asarray(x, np.float64) for x in cols], 1)


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split, left child (right = left + 1), path length at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    norm: float
    threshold: float
    prior: tuple[float, ...] | None = None

    def scores(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        return self.score(features(counts, self.prior)) if len(counts["n_words"]) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): higher is stranger."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH + 1):
                f = self.feature[at]
                go = f >= 0
                if not go.any():
                    break
                at = np.where(go, self.left[at] + (x[rows, np.maximum(f, 0)] >= self.split[at]), at)
            total += self.depth[at]
        return 2.0 ** (-(total / len(self.roots)) / self.norm)


def _unsplit(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def draws(n: int, seed: int = 7) -> list[np.ndarray]:
    """The rows, of n, that each tree is grown on."""
    rng = np.random.default_rng((seed, 1))
    return [rng.choice(n, min(LEAF_SAMPLE, n), replace=False) for _ in range(TREES)]


def grow(picks: list[np.ndarray], low: np.ndarray, high: np.ndarray, seed: int = 7) -> Forest:
    """An isolation tree on each of ``picks``. Splits are drawn a little beyond the range seen, so points outside it are isolated early. ``low``, ``high``: the range of all rows."""
    rng = np.random.default_rng(seed)
    feature, split, left, depth, roots = [], [], [], [], []
    size = len(picks[0])
    span = np.maximum(high - low, 1e-3)
    for pick in picks:
        roots.append(len(feature))
        todo = [(pick, 0, len(feature))]
        for a in (feature, split, left, depth):
            a.append(0)
        while todo:
            pts, d, at = todo.pop()
            f = int(rng.integers(len(span)))
            if d >= DEPTH or len(pts) <= 1:
                feature[at], split[at], left[at], depth[at] = -1, 0.0, 0, d + _unsplit(len(pts))
                continue
            lo, hi = pts[:, f].min() - span[f] * 0.25, pts[:, f].max() + span[f] * 0.25
            s = float(rng.uniform(lo, hi))
            feature[at], split[at], left[at], depth[at] = f, s, len(feature), 0.0
            for part in (pts[pts[:, f] < s], pts[pts[:, f] >= s]):
                todo.append((part, d + 1, len(feature)))
                for a in (feature, split, left, depth):
                    a.append(0)
    return Forest(np.array(feature), np.array(split), np.array(left), np.array(depth, float), np.array(roots), max(_unsplit(size), 1.0), 1.0)


def fit(x: np.ndarray, good: np.ndarray) -> Forest | None:
    """Grow on the good rows and set the threshold; None without good rows.

    The threshold separates the two kinds best (balanced accuracy) but never loses more than
    MAX_LOST of the good rows; without bad rows it lies just beyond the good ones.
    """
    if not good.any():
        return None
    own = x[good]
    forest = grow([own[p] for p in draws(len(own))], own.min(0), own.max(0))
    s = forest.score(x)
    forest.threshold = threshold(s[good], s[~good])
    return forest


def threshold(ok: np.ndarray, bad: np.ndarray) -> float:
    """The threshold for these scores of good and bad rows."""
    ok, bad = np.sort(ok), np.sort(bad)
    floor = ok[_rank(len(ok))]
    cuts = np.unique(ok[ok >= floor])
    at = np.searchsorted(bad, cuts, "right")
    return _best_cut(cuts, np.searchsorted(ok, cuts, "right"), len(ok), len(bad) - at, len(bad), np.append(bad, np.inf)[at])


def _rank(n: int) -> int:
    """The place, of n ascending scores of good rows, below which the threshold must not lie."""
    return math.ceil((n - 1) * (1 - MAX_LOST))


def _best_cut(cuts: np.ndarray, kept: np.ndarray, n_ok: int, caught: np.ndarray, n_bad: int, above: np.ndarray) -> float:
    """Of the scores of good rows ``cuts``: the good rows not above each, the bad ones above it, and the least score of these.

    No other cut is better: between two scores of good rows, the lower one catches the most.
    """
    if not n_bad:
        return float(cuts[0]) + 0.02
    best = int(np.argmax(caught / n_bad + kept / n_ok))
    return float(cuts[best] if not caught[best] else cuts[best] + 0.5 * (above[best] - cuts[best]))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good and COUNTS of all labelled rows that may be learnt from (crc32 of doc_id mod 3 is not 1); good ones that fail the base rules are left out.

    Texts are counted where they lie; only the counts are shuffled. One text counts for each label, however often its row is repeated.
    """
    free = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(free & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def run(batches):
        for b in batches:
            got = text_counts(text_column(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(got[c]) for c in COUNTS)], names=["doc_id", "mark", *COUNTS])  # numbers only

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")).where(free)
    counted = rows.mapInArrow(run, f"doc_id long, mark long, {COUNT_SCHEMA}").groupBy("doc_id").agg(F.min(F.struct("mark", *COUNTS)).alias("c"))
    fails = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.join(lab, "doc_id").select("doc_id", (F.col("quality") == 1).alias("good"), "c.*").drop("mark").where(~(F.col("good") & fails))


def train(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """The forest and its threshold from all labelled rows that may be learnt from; None without good rows."""
    scratch = Scratch(docs.sparkSession, "quality_rules")
    rows = scratch.keep(labelled(docs, labels))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    ratios = (F.col("n_symbols") / words, F.greatest(F.col("n_repeat_words") / words - TOLERATED, F.lit(0.0)), F.col("n_upper") / chars, F.col("n_punct") / words)
    # Decimals: their sum does not depend on the order of rows.
    total = rows.where("good").agg(F.count("*").alias("n"), *[F.sum(r.cast("decimal(30,15)")).alias(f"r{i}") for i, r in enumerate(ratios)]).first()
    if not total["n"]:
        scratch.drop(rows)
        return None
    prior = tuple(float(total[f"r{i}"]) / total["n"] for i in range(len(ratios)))
    names = [f"f{i}" for i in range(len(ratios))]

    def measured(batches):
        for b in batches:
            x = features({c: b.column(b.schema.get_field_index(c)).to_numpy() for c in COUNTS}, prior)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[:, i]) for i in range(len(names)))], names=["doc_id", "good", *names])

    x = scratch.keep(rows.mapInArrow(measured, "doc_id long, good boolean, " + ", ".join(f"{f} double" for f in names)))
    own = x.where("good").drop("good")
    span = own.agg(*[F.min(f) for f in names], *[F.max(f) for f in names]).first()
    picks = draws(total["n"])
    wanted, at = np.unique(np.concatenate(picks), return_inverse=True)
    drawn = _rows_at(own, total["n"], wanted, names)
    sizes = np.cumsum([len(p) for p in picks])[:-1]
    forest = grow([drawn[p] for p in np.split(at, sizes)], np.array(span[: len(names)]), np.array(span[len(names) :]))
    forest.prior = prior

    def scored(batches):
        for b in batches:
            value = forest.score(np.stack([b.column(2 + i).to_numpy() for i in range(len(names))], 1))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(value)], names=["good", "score"])

    scores = scratch.keep(x.mapInArrow(scored, "good boolean, score double"))
    forest.threshold = _threshold(scores, total["n"])
    scratch.drop(rows, x, scores)
    return forest


def _rows_at(own: DataFrame, n: int, wanted: np.ndarray, names: list[str]) -> np.ndarray:
    """The rows with these numbers (ascending; at most TREES x LEAF_SAMPLE), where all n rows are numbered by buckets of doc_id's hash."""
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // NUMBERED))))
    sizes = sorted((r.bucket, r.n) for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).collect())
    first = np.cumsum([0] + [k for _, k in sizes])
    spark = own.sparkSession
    where = np.searchsorted(first, wanted, "right") - 1
    places = spark.createDataFrame([(int(sizes[b][0]), int(w - first[b] + 1), int(w)) for b, w in zip(where, wanted, strict=True)], "bucket long, k int, number long")
    numbered = dealt.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")))
    got = numbered.join(F.broadcast(places), ["bucket", "k"]).select("number", *names).toPandas().sort_values("number")
    return got[names].to_numpy()


def _threshold(scores: DataFrame, n_ok: int) -> float:
    """``threshold`` of a table (good, score): only the thousandth of good scores from the floor on, and their bin, come to the driver."""
    ok, bad = scores.where("good"), scores.where("not good")
    edge = F.floor(F.col("score") * BINS)
    bins = sorted((r.bin, r.n) for r in ok.groupBy(edge.alias("bin")).agg(F.count("*").alias("n")).collect())
    ends = np.cumsum([k for _, k in bins])
    b = int(np.searchsorted(ends, _rank(n_ok), "right"))
    below = int(ends[b] - bins[b][1])
    top = sorted((r.score, r.n) for r in ok.where(edge >= bins[b][0]).groupBy("score").agg(F.count("*").alias("n")).collect())
    cuts, kept = np.array([c for c, _ in top]), below + np.cumsum([k for _, k in top])
    some = kept > _rank(n_ok)
    cuts, kept = cuts[some], kept[some]

    def place(batches):
        for batch in batches:
            score = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, score, "left")), batch.column(0)], names=["at", "score"])

    # Bad rows by how many cuts lie below them: those above cut i have more than i.
    count, least = np.zeros(len(cuts) + 1, np.int64), np.full(len(cuts) + 1, np.inf)
    for r in bad.select("score").mapInArrow(place, "at long, score double").groupBy("at").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():
        count[r["at"]], least[r["at"]] = r["n"], r["least"]
    caught = np.cumsum(count[::-1])[::-1][1:]
    above = np.minimum.accumulate(least[::-1])[::-1][1:]
    return _best_cut(cuts, kept, n_ok, caught, int(count.sum()), above)


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The statistics and the verdict of every row: doc_id, COUNTS, base_failed, score, kept."""

    def run(batches):
        for b in batches:
            c = text_counts(text_column(b))
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            score = forest.scores(c) if forest is not None else np.zeros(len(failed))
            kept = ~failed & (score <= forest.threshold if forest is not None else True)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c[k]) for k in COUNTS), pa.array(failed), pa.array(score), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {COUNT_SCHEMA}, base_failed boolean, score double, kept boolean")


def filter_documents(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; counting and cutting happen in one pass over the texts."""

    def run(batches):
        for b in batches:
            c = text_counts(text_column(b))
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            ok = ~failed
            if forest is not None:
                ok &= forest.scores(c) <= forest.threshold
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, train(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))
