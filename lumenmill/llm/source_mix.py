"""Mixing sources to target weights, in DataFrame functions only.

Every source is a stream of words: its documents in a fixed order, packed end to end into blocks
of ``BLOCK`` words. Output shards have a fixed number of slots; each slot draws a source, so a
shard's source counts are one multinomial draw. Draws beyond a source's quota are handed to the
sources that fell short, so each quota is met exactly. A slot's rank among its source's slots
goes through that source's pseudorandom permutation of block indices (a new one each time the
source starts over), and blocks are joined by index. No source is read more than
``MAX_REPEAT`` times, so no document exceeds that many times its size.

Positions in a source are prefix sums in two steps: within (source, chunk), where a chunk is a
hash bucket of rows, and over the chunk sums. So a source with a third of all rows is spread
over all tasks. Sources are rows of a table (rank, sizes, targets, quotas), of any number; only
sums over all of them reach the driver. What is looked up by source is broadcast if there are few
(``common.BROADCAST_ROWS``), else joined with hot sources apart.

Defined results: a null text has size 0 and takes nothing; a null source is a source, the last
one; repeated rows are rows of their own; an empty table gives an empty result; only doc_id,
text and source are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, joined, small

BLOCK, SLOTS, ROUNDS, SEED = 128, 4096, 16, 20_240_601
MAX_REPEAT, SHARE, WEIGHTS = 2, 1.5, (5, 2, 1)
#: Rows of (source, chunk) that one window task sorts, about; and chunks at least.
CHUNK_ROWS, CHUNKS = 4000, 256
SLOTS_A_TASK = 50_000


def permuted(x: Column, n: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 at x, chosen by ``salt`` (a swap-or-not shuffle)."""

    def step(at, i):
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), i, *salt), n) - at, n)
        swap = F.xxhash64(F.greatest(at, partner), i, F.lit(SEED + 1), *salt) % 2 == 0
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def located(points: DataFrame, at: str, ends: DataFrame, n: int) -> DataFrame:
    """``points`` with the columns of the interval (lo <= at < hi) of ``ends`` that holds ``at``; the intervals are a partition of 0..n-1.

    The range is cut into equal bins, two for each interval, so a point meets the few intervals of its bin only.
    """
    width = max(1, -(-n // (2 * max(ends.count(), 1))))
    bins = ends.where("lo < hi").withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    bins = small(bins)
    placed = points.withColumn("bin", F.floor(F.col(at) / width)).join(bins, "bin")
    return placed.where((F.col("lo") <= F.col(at)) & (F.col(at) < F.col("hi"))).drop("bin")


def with_targets(sources: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """Adds src (rank in code point order, null last), weight and target to rows (source, size).

    Sources share ``share`` of all sizes by weight; a target stops at ``most`` times its size and
    the excess is shared again, until none is above. Each round is one small aggregate.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    made = sources.withColumn("src", rank.cast("int"))
    made = made.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("src") % len(weights))).withColumn("cap", F.col("size") * most)
    whole = made.agg(F.sum("size").alias("s"), F.sum("weight").alias("w")).first()
    rest, total, full = share * (whole["s"] or 0), whole["w"] or 0, 0
    while True:
        goal = F.lit(rest) * F.col("weight") / F.lit(max(total, 1))
        over = (goal > F.col("cap")) if total else F.lit(True)
        now = made.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if now["n"] == full or not total:
            return made.withColumn("target", F.when(over, F.col("cap").cast("double")).otherwise(goal)).drop("cap")
        full, rest, total = now["n"], share * whole["s"] - (now["cap"] or 0), now["w"] or 0


class Mix:
    """A mix of ``docs``: the quotas, the positions of documents, the drawn slots, and what each document gives."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, slots: int = SLOTS):
        self.spark, self.block = docs.sparkSession, block
        self.scratch = Scratch(self.spark, "source_mix")
        base = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("mark"))
        self.sized = self.scratch.keep(base)  # a few numbers for each row; the texts are read once
        per = self.scratch.keep(self.sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
        made = with_targets(per).withColumn("blocks", F.ceil(F.col("size") / block))
        quota = F.least(MAX_REPEAT * F.col("blocks"), F.bround(F.col("target") * F.col("blocks") / F.col("size")).cast("long"))
        made = made.withColumn("quota", F.when(F.col("size") > 0, quota).otherwise(0).cast("long"))
        before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
        self.table = self.scratch.keep(made.withColumn("hi", F.sum("quota").over(before)).withColumn("lo", F.col("hi") - F.col("quota")))
        whole = self.table.agg(F.sum("quota").alias("quota"), F.sum("n").alias("n")).first()
        self.n, self.n_rows = whole["quota"] or 0, whole["n"] or 0
        self.slots = max(slots, -(-self.n // 50_000))

    def positions(self) -> DataFrame:
        """Each row with its source's figures and ``at``: the words before it in its source."""
        chunks = max(CHUNKS, -(-self.n_rows // CHUNK_ROWS))
        key = {"name": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()}
        figures = self.scratch.keep(self.table.select(*[c.alias(k) for k, c in key.items()], "src", F.col("size").alias("source_size"), "target", "n"))
        rows = joined(self.sized.withColumns(key), figures, list(key), "n", self.n_rows).select("doc_id", "mark", "size", "src", "source", "source_size", "target", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(chunks)).alias("chunk"))
        order = Window.partitionBy("src", "chunk").orderBy("doc_id", "mark", "size")
        inner = rows.withColumn("inner", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        sums = rows.groupBy("src", "chunk").agg(F.sum("size").alias("words"))
        before = sums.select(F.col("src").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
        return inner.join(before, (F.col("src") == F.col("s")) & (F.col("chunk") == F.col("c"))).withColumn("at", F.coalesce("inner", F.lit(0)) + F.col("outer")).drop("s", "c", "inner", "outer", "chunk")

    def drawn(self) -> DataFrame:
        """The slots: shard, src, rank among the source's slots, and the block that it takes."""
        n = self.n
        if n == 0:
            return self.spark.createDataFrame([], "shard long, src int, rank long, block long")
        slot = self.spark.range(n).select((F.col("id") / self.slots).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(n)).alias("u"))
        counts = located(slot, "u", self.table.select("src", "lo", "hi"), n).groupBy("shard", "src").agg(F.count("*").alias("n"))
        counts = self.scratch.keep(counts)  # shards x sources; read twice
        # For each source: what it has drawn, and where what it has too much or too little stands among that of all sources.
        have = self.table.select("src", "quota", "blocks").join(counts.groupBy("src").agg(F.sum("n").alias("have")), "src", "left").withColumn("have", F.coalesce("have", F.lit(0)))
        upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
        gap = {"extra": F.greatest(F.lit(0), F.col("have") - F.col("quota")), "lack": F.greatest(F.lit(0), F.col("quota") - F.col("have"))}
        have = have.withColumns(gap).withColumns({"first_extra": F.sum("extra").over(upto) - F.col("extra"), "hi": F.sum("lack").over(upto)}).withColumn("lo", F.col("hi") - F.col("lack"))
        have = self.scratch.keep(have)
        total = have.agg(F.sum("lack")).first()[0]
        order = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).join(small(have.select("src", "quota", "blocks", "first_extra")), "src").withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("before"))))
        # Each row becomes up to SLOTS rows, so the few rows are dealt out first.
        tasks = max(8, -(-n // SLOTS_A_TASK))
        inside = ranked.where("kept > 0").repartition(tasks, "shard", "src").select("shard", "src", F.explode(F.sequence("before", F.col("before") + F.col("kept") - 1)).alias("rank"))
        # Draws beyond a quota (about the square root of all draws) are numbered through all sources and handed to those that lack some.
        start = F.col("first_extra") + F.greatest(F.lit(0), F.col("before") - F.col("quota"))
        spare = ranked.where("kept < n").select("shard", F.explode(F.sequence(start, start + F.col("n") - F.col("kept") - 1)).alias("g"))
        moved = located(spare, "g", have.select("src", "have", "lo", "hi"), max(total, 1)).select("shard", "src", (F.col("have") + F.col("g") - F.col("lo")).alias("rank"))
        out = inside.unionByName(moved).join(small(have.select("src", "blocks")), "src")
        return out.select("shard", "src", "rank", permuted(F.col("rank") % F.col("blocks"), F.col("blocks"), F.col("src"), (F.col("rank") / F.col("blocks")).cast("long")).alias("block"))

    def pieces(self) -> DataFrame:
        """Each row cut at block borders, with ``times``: how often the mix takes that block (rows without words: one piece of no words)."""
        pos = self.positions()
        last = F.floor((F.col("at") + F.col("size") - 1) / self.block)
        cut = pos.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / self.block), last))))
        low, high = F.greatest("at", F.col("block") * self.block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * self.block)
        cut = cut.withColumn("lo", F.coalesce(low - F.col("at"), F.lit(0))).withColumn("hi", F.coalesce(high - F.col("at"), F.lit(0)))
        times = self.drawn().groupBy("src", "block").agg(F.count("*").alias("times"))
        return cut.join(times, ["src", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def taken(self) -> DataFrame:
        """One row for each row of the documents: doc_id, source, size, source_size, target, taken."""
        keys = ["doc_id", "mark", "src", "at", "size", "source", "source_size", "target"]
        cut = self.pieces()
        # Rows without words share their position with others; a number keeps repeated ones apart.
        some = cut.where("size > 0").groupBy(*keys).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
        none = cut.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
        return some.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``.

    A document that the mix reads p times has p rows at most; row number k holds the words whose
    block is taken k times or more, with the white space before each word, in their order.
    """
    mix = Mix(docs)
    runs = mix.pieces().where("times > 0 and hi > lo").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    # A document's pieces for one turn: bounded by its own length over BLOCK.
    keys = ["doc_id", "mark", "src", "at", "size", "turn"]
    runs = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    # Rows that repeat doc_id and text are told apart by a number; all else is joined by doc_id and text.
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = runs.withColumn("k", key).withColumn("copy", F.row_number().over(Window.partitionBy("k", "mark", "turn").orderBy("at"))).select("k", F.col("mark").alias("m"), "turn", "copy", "runs", F.col("size").alias("words"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("key"), F.xxhash64("text").alias("mark"))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("key", "mark").orderBy(F.lit(1))))
    hit = rows.join(runs, (F.col("key") == F.col("k")) & (F.col("mark") == F.col("m"))).where("number = copy")
    # A text that is taken whole stays as it is. Else its words are cut once: they are bound to a variable, lest each run cut them anew.
    cut = F.array(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)))
    part = F.get(F.transform(cut, lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(w, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), "")), F.lit(0))
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"])
    hit = hit.withColumn("new_text", F.when(taken == F.col("words"), F.col("row.text").cast("string")).otherwise(F.regexp_replace(part, r"^[\x20\x09-\x0D]+", "")))
    made = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return hit.select(*[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in names])


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    return Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken().drop("source")
