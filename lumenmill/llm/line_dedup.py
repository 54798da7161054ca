"""Line dedup by winnowing: later repeats of runs of ``MIN_WORDS`` words or more are deleted.

A run may begin and end inside lines and be broken into lines anywhere (``unit="word"``, what the
query and the pipeline use). A window is ``MIN_WORDS`` words in a row; its smallest hash of half as
many words in a row is a selected fingerprint, so two texts that share a run of that many words
share a fingerprint. Consecutive windows with one fingerprint are a group, and the words that a
group spans are hashed as a whole.

Fingerprints met once are done with. Around the others the match is extended both ways. A group
which stands earlier elsewhere is deleted whole. At the ends of a run, where groups differ though
they share windows, the windows themselves are compared: those of the first group of each kind,
only, as every window of the others stands in these. So are those of a group that has its fingerprint
in several places, for it may repeat inside itself. So a word goes if, and only if, a window that
holds it stands earlier elsewhere. Earlier means a smaller doc_id, then a smaller place; a run that
overlaps its own first place loses only what lies beyond it. Lines that lose all their words go
(``n_removed``), and blank lines inside a run with them; other lines keep the rest of their words.

With ``unit="line"`` only whole lines count, compared after trimming white space: a window is the
shortest run of lines with that many words that starts at a line, or that ends at one, its
fingerprint the smallest line hash, and the windows are compared with the first place of the same
lines.

Only minima and counts are aggregated for a hash, and what is joined by a hash is either broadcast,
if it is small, or has its hot keys broadcast (``common.joined``); so a passage in a third of all
texts is no burden to one task, and no group is collected. A row's ranges are bounded by its own words.

Defined results: a null text stays null, an empty one empty; shorter repeats stay; rows with equal
doc_id and text are one document and come out alike; a null doc_id comes after all others; an
empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import BASE, BASE_INV, BYTE, HOT_SHARE, IS_SPACE, U, Scratch, blocks, joined, mix, powers, small_batches, span_hashes, text_column, words_of

MIN_WORDS = 50
#: Buckets of windows by hash, in the search for hot ones: about eight times as many as there can be hot ones.
WINDOW_BUCKETS = 8192
BYTE_2 = mix(BYTE + U(12345))
LAST = (1 << 63) - 1


def lines_of(data: np.ndarray, off: np.ndarray):
    """Of the lines with a word, in order: row, line number in its row, first and end byte without outer white space, number of words."""
    ends = np.flatnonzero(data == 10)
    row_of = np.searchsorted(off, ends, "right") - 1
    n_rows = len(off) - 1
    per = np.bincount(row_of, minlength=n_rows) + 1  # lines of each row; an empty text has one
    first = np.zeros(n_rows + 1, np.int64)
    np.cumsum(per, out=first[1:])
    row = np.repeat(np.arange(n_rows), per)
    number = np.arange(first[-1]) - np.repeat(first[:-1], per)
    stop = np.empty(first[-1], np.int64)
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    stop[is_last] = off[1:]
    stop[~is_last] = ends
    start = np.empty_like(stop)
    start[first[:-1]] = off[:-1]
    start[~np.isin(np.arange(len(stop)), first[:-1])] = ends + 1
    word = ~IS_SPACE[data] if len(data) else np.zeros(0, bool)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    if len(data):
        edge = start[start < len(data)]
        begins[edge] = word[edge]
    at = np.flatnonzero(begins)
    words = np.searchsorted(at, stop) - np.searchsorted(at, start)
    some = np.flatnonzero(words)
    letters = np.flatnonzero(word)
    lo = letters[np.searchsorted(letters, start[some])]
    hi = letters[np.searchsorted(letters, stop[some]) - 1] + 1
    return row[some], number[some], lo, hi, words[some]


def windows_of(data: np.ndarray, off: np.ndarray, least: int = MIN_WORDS):
    """All windows: row, first and last line number, fingerprint, two hashes; and of the distinct fingerprints of each row: row, fingerprint, places."""
    row, number, lo, hi, words = lines_of(data, off)
    none = np.zeros(0, np.int64)
    if not len(row):
        return none, none, none, none, none, none, (none, none, none)
    total = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words, out=total[1:])
    left, right = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")  # the row's lines
    each = np.arange(len(row))
    j = np.searchsorted(total, total[each] + least, "left")  # forwards: lines each .. j - 1
    ok = j <= right
    i = np.searchsorted(total, total[each + 1] - least, "right") - 1  # backwards: lines i .. each
    back = (i >= left) & (total[each + 1] - least >= 0)
    a, b = np.concatenate([each[ok], i[back]]), np.concatenate([j[ok], each[back] + 1])
    pair = np.unique(a * (len(row) + 1) + b)
    a, b = pair // (len(row) + 1), pair % (len(row) + 1)
    if not len(a):
        return none, none, none, none, none, none, (none, none, none)
    one, two = span_hashes(data, lo, hi, BYTE), span_hashes(data, lo, hi, BYTE_2)
    cuts = np.stack([a, b], 1).reshape(-1)
    low = np.minimum.reduceat(np.append(one, U(0xFFFFFFFFFFFFFFFF)), cuts)[::2]
    whole = []
    n = len(row)
    with np.errstate(over="ignore"):
        for h in (one, two):
            acc = np.zeros(n + 1, U)
            np.cumsum(h * powers(BASE, n)[:n], out=acc[1:])
            whole.append(mix((acc[b] - acc[a]) * powers(BASE_INV, n + 1)[a] + mix((b - a).astype(U))).view(np.int64))
    # How often a fingerprint's line stands in its row: lines of other windows count too, which only keeps more.
    with np.errstate(over="ignore"):
        of_line, of_window = mix(one ^ mix(row.astype(U))), mix(low ^ mix(row[a].astype(U)))
    kinds, times = np.unique(of_line, return_counts=True)
    _, pick = np.unique(of_window, return_index=True)
    found = row[a][pick], low[pick].view(np.int64), times[np.searchsorted(kinds, of_window[pick])]
    return row[a], number[a], number[b - 1], low.view(np.int64), whole[0], whole[1], found


def _lists(row: np.ndarray, n: int, *columns: tuple[np.ndarray, type]) -> list[pa.ListArray]:
    """Lists by row of the given columns."""
    order = np.argsort(row, kind="stable")
    cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(cuts, pa.array(x[order].astype(t))) for x, t in columns]


def windows(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """id, mark, the windows' fp, w1, w2, lo, hi and the fingerprints' mine, places (lists) of every row of docs (id, mark, text)."""

    def run(batches):
        for b in batches:
            at = 0
            for _, _, data, off in blocks(text_column(b)):
                n = len(off) - 1
                row, lo, hi, fp, w1, w2, found = windows_of(data, off, least)
                lists = _lists(row, n, (fp, np.int64), (w1, np.int64), (w2, np.int64), (lo, np.int32), (hi, np.int32)) + _lists(found[0], n, (found[1], np.int64), (found[2], np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), *lists], names=["id", "mark", "fp", "w1", "w2", "lo", "hi", "mine", "places"])
                at += n

    return docs.select("id", "mark", "text").mapInArrow(run, "id long, mark long, fp array<long>, w1 array<long>, w2 array<long>, lo array<int>, hi array<int>, mine array<long>, places array<int>")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(id, mark, lo, hi): the line ranges of each document that stand earlier elsewhere."""
    scratch = Scratch(docs.sparkSession, "line_dedup")
    made = scratch.keep(windows(keyed(docs), least).where(F.size("fp") > 0))
    # Fingerprints that stand in more than one place.
    places = made.select(F.explode(F.arrays_zip("mine", "places")).alias("p")).select(F.col("p.mine").alias("fp"), "p.places")
    often = scratch.keep(places.groupBy("fp").agg(F.sum("places").alias("n"), F.sum("places").alias("weight")).where("n > 1").drop("n"))
    each = made.select("id", "mark", F.explode(F.arrays_zip("fp", "w1", "w2", "lo", "hi")).alias("w")).select("id", "mark", "w.*")
    near = scratch.keep(joined(each, often, ["fp"], "weight", places.agg(F.sum("places")).first()[0] or 0).select("id", "mark", "w1", "w2", "lo", "hi"))
    first = near.groupBy("w1", "w2").agg(F.min(F.struct("id", "mark", "lo", "hi")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.keep(first)
    later = joined(near, first, ["w1", "w2"], "n", near.count()).where(~((F.col("id") == F.col("first.id")) & (F.col("mark") == F.col("first.mark")) & (F.col("lo") == F.col("first.lo"))))
    own = (F.col("id") == F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    begin = F.when(own, F.greatest("lo", F.col("first.hi") + 1)).otherwise(F.col("lo"))
    out = scratch.keep(later.select("id", "mark", begin.alias("lo"), "hi").where("lo <= hi"))
    scratch.drop(made, often, near, first)
    return out


def cut(text: str, ranges: list) -> tuple[str, int]:
    """The text without the lines in ``ranges`` ((first, last), any order), and how many lines went."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for lo, hi in ranges:
        gone[lo] += 1
        gone[hi + 1] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return "\n".join([x for x, k in zip(lines, keep, strict=True) if k]), int((~keep).sum())


class Words:
    """The words of a block of rows, and hashes of any runs of them."""

    def __init__(self, data: np.ndarray, off: np.ndarray, least: int):
        starts, ends, self.first = words_of(data, off)
        n, self.least, k = len(starts), least, (least + 1) // 2
        self.n, self.inverse = n, powers(BASE_INV, n + 1)[: n + 1]
        one = span_hashes(data, starts, ends)
        with np.errstate(over="ignore"):
            self.one, self.two = (np.concatenate([np.zeros(1, U), np.cumsum(h * powers(BASE, n)[:n], dtype=U)]) for h in (one, mix(one)))
        last = np.arange(n)
        low = gram = self.hashes(self.one, last, np.minimum(last + k, n))
        span, width = 1, least - k + 1  # minima over span grams, doubled up to the window's
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low, low[np.minimum(last + step, n - 1)]) if n else low
            span += step
        self.gram, self.wide = gram, width
        self.low = low  # of the window that starts at a word; only those inside a row count

    def hashes(self, total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((total[b] - total[a]) * self.inverse[a] + mix((b - a).astype(U)))

    def groups(self):
        """Row, fingerprint, hash, first and last word (in its row) of each group, and in how many places it has the fingerprint."""
        per = np.maximum(np.diff(self.first) - self.least + 1, 0)
        row = np.repeat(np.arange(len(per)), per)
        at = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + self.first[row]
        low = self.low[at]
        new = np.ones(len(row), bool)
        new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row))[: len(begin)] - 1
        a, b = at[begin], at[end] + self.least
        own = self.first[row[begin]]
        size = end - begin + self.wide
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        same = self.gram[at] == np.repeat(low[begin], size)
        places = np.add.reduceat(same.astype(np.int64), np.cumsum(size) - size) if len(size) else size
        return row[begin], low[begin].view(np.int64), self.hashes(self.two, a, b).view(np.int64), a - own, b - 1 - own, places

    def windows(self, row: int, spans: list):
        """Fingerprint, hash and first word of each window inside spans (first and last word) of a row."""
        at = np.concatenate([np.arange(x["lo"], x["hi"] - self.least + 2) for x in spans]) + self.first[row]
        return self.low[at].view(np.int64), self.hashes(self.two, at, at + self.least).view(np.int64), at - self.first[row]


def word_groups(docs: DataFrame, least: int) -> DataFrame:
    """id, mark and the groups' fp, g, lo, hi, places (lists) of every row of docs (id, mark, text)."""

    def run(batches):
        for b in batches:
            at = 0
            for _, _, data, off in blocks(text_column(b)):
                n = len(off) - 1
                row, fp, g, lo, hi, places = Words(data, off, least).groups()
                lists = _lists(row, n, (fp, np.int64), (g, np.int64), (lo, np.int32), (hi, np.int32), (places, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), *lists], names=["id", "mark", "fp", "g", "lo", "hi", "places"])
                at += n

    return docs.select("id", "mark", "text").mapInArrow(run, "id long, mark long, fp array<long>, g array<long>, lo array<int>, hi array<int>, places array<int>")


def word_windows(docs: DataFrame, least: int) -> DataFrame:
    """A row (id, mark, fp, w, lo) for each window inside the ``spans`` of docs (id, mark, text, spans)."""

    def run(batches):
        for b in batches:
            at = 0
            for _, _, data, off in blocks(text_column(b)):
                words = Words(data, off, least)
                n = len(off) - 1
                fp, w, lo = zip(*(words.windows(r, b.column(3)[at + r].as_py()) for r in range(n)), strict=True)
                take = pa.array(np.repeat(np.arange(at, at + n), [len(x) for x in lo]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(np.concatenate(x).astype(t)) for x, t in ((fp, np.int64), (w, np.int64), (lo, np.int32)))], names=["id", "mark", "fp", "w", "lo"])
                at += n

    return docs.select("id", "mark", "text", "spans").mapInArrow(run, "id long, mark long, fp long, w long, lo int")


def _lists_of(ranges: DataFrame, name: str) -> DataFrame:
    """id, mark and the list of ranges (lo, hi) of each document in ``ranges``. A list is bounded by its document's own words."""
    return ranges.groupBy("id", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias(name))


def _hot_windows(windows: DataFrame, place: list[str]) -> DataFrame:
    """fp, w and the first place of the windows that stand in more than HOT_SHARE of all rows (and in two).

    A hot key lies in a bucket with no fewer rows, so only rows of such buckets are counted by key: the sizes of buckets are
    few numbers, and most windows, which have a hash of their own, are not shuffled for this.
    """
    bucket = F.pmod(F.hash("fp", "w"), F.lit(WINDOW_BUCKETS))
    sizes = windows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()
    least = max(1, int(HOT_SHARE * sum(r.n for r in sizes)))
    rows = windows.where(bucket.isin([r.bucket for r in sizes if r.n > least]))  # fewer than 2 / HOT_SHARE buckets
    return rows.groupBy("fp", "w").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where(F.col("n") > least).drop("n")


def word_repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(id, mark, lo, hi): the ranges of words of each document that stand earlier elsewhere. A written table."""
    scratch = Scratch(docs.sparkSession, "line_dedup")
    texts = keyed(docs)
    made = scratch.keep(word_groups(texts, least).where(F.size("fp") > 0))
    places = made.select(F.explode(F.arrays_zip("fp", "places")).alias("x")).select("x.*")
    often = scratch.keep(places.groupBy("fp").agg(F.sum("places").alias("n"), F.count("*").alias("weight")).where("n > 1").drop("n"))
    each = made.select("id", "mark", F.explode(F.arrays_zip("fp", "g", "lo", "hi", "places")).alias("x")).select("id", "mark", "x.*")
    near = scratch.keep(joined(each, often, ["fp"], "weight", places.count()))
    scratch.drop(made, often)
    place = ["id", "mark", "lo"]
    first = scratch.keep(near.groupBy("fp", "g").agg(F.min(F.struct(*place, "hi")).alias("first"), F.max("places").alias("p"), F.count("*").alias("n")))
    beyond = F.when((F.col("id") == F.col("first.id")) & (F.col("mark") == F.col("first.mark")), F.greatest("lo", F.col("first.lo") + least)).otherwise(F.col("lo"))

    def later(both: DataFrame) -> DataFrame:
        """The rows that repeat the ``first`` of their kind, as far as they lie beyond it."""
        return both.where(~(F.struct(*place) == F.struct("first.id", "first.mark", "first.lo"))).select("id", "mark", beyond.alias("lo"), "hi").where("lo <= hi")

    # Fingerprints with groups of several kinds, or with one that may repeat inside itself: windows of the first of each kind.
    mixed = scratch.keep(first.groupBy("fp").agg(F.count("*").alias("weight"), F.max("p").alias("most")).where("weight > 1 or most > 1").drop("most"))
    open_ = scratch.keep(joined(first.select("fp", "first"), mixed, ["fp"], "weight", first.count()).select("first.id", "first.mark", "first.lo", "first.hi"))
    windows = made_windows = scratch.keep(word_windows(texts.join(_lists_of(open_, "spans"), ["id", "mark"]), least))
    again = scratch.keep(first.where("n > 1").drop("p"))
    windows = windows.withColumn("hi", (F.col("lo") + (least - 1)).cast("int"))
    # A window has one of many hashes: hot ones, of which there are few, are told their first place, the others find it among themselves.
    hot = _hot_windows(made_windows, place)
    told = windows.join(F.broadcast(hot), ["fp", "w"], "left").withColumn("part", F.when(F.col("first").isNotNull(), F.pmod(F.xxhash64(*place), F.lit(1009))).otherwise(-1))
    among = F.min(F.struct(*place)).over(Window.partitionBy("fp", "w", "part"))  # rows that were told are only spread out
    placed = told.withColumn("first", F.coalesce("first", among)).drop("part")
    found = scratch.keep(later(joined(near, again, ["fp", "g"], "n", near.count())).unionByName(later(placed)))
    scratch.drop(near, first, mixed, open_, made_windows, again)
    return found


def cut_words(text: str, ranges: list) -> tuple[str, int]:
    """The text without the words in ``ranges`` ((first, last), any order), and how many lines went for it."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words_of(data, np.array([0, len(data)]))
    n = len(starts)
    lo, hi = np.array(ranges, np.int64).reshape(-1, 2).T
    level = lambda size, a, b: np.cumsum(np.bincount(a, minlength=size + 1) - np.bincount(b, minlength=size + 1))[:size] > 0
    gone, inside = level(n, lo, hi + 1), level(n, lo, hi)  # inside: the word and the next one are in one range
    breaks = np.flatnonzero(data == 10)
    begin, stop = np.append(0, breaks + 1), np.append(breaks, len(data))
    line = np.searchsorted(breaks, starts)
    total, kept = np.bincount(line, minlength=len(begin)), np.bincount(line[~gone], minlength=len(begin))
    before = np.searchsorted(starts, begin) - 1
    drop = (kept == 0) & ((total > 0) | (before >= 0) & inside[before])
    # In other lines a word goes with the space up to the next; what trails the last one kept goes too.
    out = np.flatnonzero(gone & (kept[line] > 0))
    final = np.append(line[1:] != line[:-1], True)
    upto = np.where(final, stop[line], np.append(starts[1:], len(data)))
    stay = np.flatnonzero(~gone)
    tail = stay[np.append(line[stay][1:] != line[stay][:-1], True)[: len(stay)] & ~final[stay]]
    a, b = [starts[out], ends[tail], begin[drop]], [upto[out], stop[line[tail]], np.minimum(stop[drop] + 1, len(data))]
    left = np.flatnonzero(~drop)
    if len(left) and left[-1] < len(begin) - 1:  # the break before lines that went at the end
        a.append(stop[left[-1:]])
        b.append(stop[left[-1:]] + 1)
    return data[~level(len(data), np.concatenate(a), np.concatenate(b))].tobytes().decode(), int(drop.sum())


def deduplicated(docs: DataFrame, least: int = MIN_WORDS, unit: str = "line") -> DataFrame:
    """``row`` (the columns of ``docs``), new_text, n_lines, n_removed. ``unit``: line or word, what a run is made of."""
    find, cut_out = (word_repeats, cut_words) if unit == "word" else (repeats, cut)
    ranges = _lists_of(find(docs, least), "ranges")
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("mark"))
    both = rows.join(ranges, ["id", "mark"], "left")

    def without(batches):  # runs for the rows that lose something, only; in the same workers as all else here
        for b in batches:
            done = [cut_out(t, [(r["lo"], r["hi"]) for r in gone]) for t, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["row", "new_text", "n_removed"])

    own = F.col("row.text").cast("string")
    # A line more than there are line feeds.
    lines = (F.length(own) - F.length(F.replace(own, F.lit("\n"), F.lit(""))) + 1).cast("long")
    schema = StructType([rows.schema["row"], StructField("new_text", StringType()), StructField("n_removed", LongType())])
    hit = both.where("ranges is not null").select("row", own.alias("text"), "ranges").mapInArrow(without, schema)
    kept = both.where("ranges is null").select("row", own.alias("new_text"), F.lit(0).cast("long").alias("n_removed"))
    return kept.unionByName(hit).select("row", "new_text", F.coalesce(lines, F.lit(0)).alias("n_lines"), "n_removed")


def filter_documents(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later repeated runs; a document that loses all its words goes. n_chars follows the text."""
    done = deduplicated(docs, least, "word").where("n_removed = 0 or new_text rlike '[^ \\\\t-\\\\r]'")
    made = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return done.select(*[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    done = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), unit="word")
    return done.select("row.doc_id", "n_lines", "n_removed", F.col("new_text").alias("text"))
