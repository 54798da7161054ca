"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find grouping.

1. Every whole text becomes its set of word shingles (64-bit hashes of words and shingles; equal hashes count as equal)
   and a SuperMinHash signature: each element ranks the slots by its own permutation, a slot keeps
   its lowest rank and draw, and a text stops as soon as no later rank can lower any slot. Texts
   with equal sets are one node.
2. Bands of the signature meet in buckets. An aggregate finds each bucket's smallest id, its centre;
   every other member becomes a pair with it. All that happens later happens among the members of
   a centre, so a bucket costs its size, not the pairs in it.
3. A pair is a link only if the full sets agree: 100 * intersection >= 80 * union. First members are
   compared with their centre, then those that are still apart with the smallest of them, and at
   last whatever is still apart under a centre pair by pair (``_rest``), except within its largest
   component. So a large group of copies costs its size, and no link is lost to a cap.
4. Links merge components by union-find, or by alternating large and small stars.

A band holds ``ROWS`` of 256 slots, so a pair at 0.8 misses all ``BANDS`` with probability
(1 - 0.8 ** 6) ** 42, about 3e-6. Nothing of a document reaches the driver, only counts. What lies
between the steps is written to the shared folder and deleted once it is spent.

Defined results: a text without words, or null, has an empty set and is linked with nothing; rows
with one doc_id are one document (linked to themselves); a row without doc_id is not compared and
has no component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, U, Scratch, blocks, joined, mix, shingles_of, small, small_batches, span_hashes, text_column, words_of

SLOTS, BANDS, ROWS = 256, 42, 6
BLOCK_BYTES = 1 << 18
#: Documents that an element may stand in to be joined directly in the last round.
RARE = 400
#: Edges that one task merges at once, about 3 MB.
AT_ONCE = 200_000
SIG_SCHEMA = "doc_id long, n int, h1 long, h2 long, bands array<long>"


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes."""
    starts, ends, first = words_of(data, off)
    grams, at = shingles_of(span_hashes(data, starts, ends, LOWER), first, k)
    return [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(elements: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SuperMinHash of consecutive sets with ``size`` elements each: rows of SLOTS values, rank << 32 | draw."""
    sig = np.full((len(size), SLOTS), np.iinfo(np.uint64).max, U)
    flat = sig.reshape(-1)
    row = np.repeat(np.arange(len(size)), size)
    a = mix(elements ^ U(0xA5A5A5A5))
    # An element's permutation of the slots: affine, shift, affine, on 8 bits.
    m1, c1, m2, c2 = ((a >> U(s) & U(255)).astype(np.uint8) for s in (0, 8, 16, 24))
    m1, m2 = m1 | 1, m2 | 1
    for rank in range(SLOTS):
        if not len(row):
            break
        with np.errstate(over="ignore"):
            x = m1 * np.uint8(rank) + c1
            x = x ^ (x >> np.uint8(4))
            x = x * m2 + c2
            draw = mix(a + U(rank) * U(0xD1342543DE82EF95)) >> U(32)
        np.minimum.at(flat, row * SLOTS + x, draw | U(rank << 32))
        # A text is done once every slot holds this rank or a lower one.
        if rank % 4 == 3 or rank < 4:
            done = sig.max(1) < U((rank + 1) << 32)
            live = ~done[row]
            if not live.all():
                row, a, m1, c1, m2, c2 = (v[live] for v in (row, a, m1, c1, m2, c2))
    return sig


def banded(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
        out = np.broadcast_to(mix(np.arange(BANDS, dtype=U) + U(1000)), (len(sig), BANDS)).copy()
        for j in range(ROWS):
            out = mix(out * U(5) + v[:, :, j])
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """SIG_SCHEMA for every row; empty sets have n = 0 and no bands."""

    def run(batches):
        for b in batches:
            at = 0
            for _, _, data, off in blocks(text_column(b), BLOCK_BYTES):
                sets = shingle_sets(data, off, k)
                n = np.array([len(s) for s in sets], np.int64)
                keys = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
                rows = banded(signatures(np.concatenate(sets), n))[n > 0].view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))
                columns = [b.column(0).slice(at, len(n)), pa.array(n.astype(np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h1", "h2", "bands"])
                at += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIG_SCHEMA)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """id and its whole shingle set (sorted 64-bit hashes) for the rows of ``docs`` (id, text)."""

    def run(batches):
        for b in batches:
            at = 0
            for _, _, data, off in blocks(text_column(b), BLOCK_BYTES):
                sets = [s.tobytes() for s in shingle_sets(data, off, k)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.array(sets, pa.binary())], names=["id", "elements"])
                at += len(sets)

    return docs.select("id", "text").mapInArrow(run, "id long, elements binary").withColumn("n", F.expr("cast(length(elements) / 8 as int)"))


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, a, b) whose full sets a and b agree: 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([s, t]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def union_find(edges: DataFrame) -> DataFrame:
    """(u, v): within each partition of ``edges`` (u, v), every node that is not the smallest it is connected to, and that smallest."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p] if p in parent else p
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = find(u), find(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, scratch: Scratch, at_once: int | None = None) -> DataFrame:
    """(u, root): for every node of ``edges`` (u, v) that is not itself the smallest of its component, the smallest. A table of ``scratch``.

    Union-find compresses the edges of each partition to a forest. Forests of at most ``at_once``
    edges are merged by one task; larger ones by alternating stars: a large star hands a node's
    larger neighbours to its smallest, a small star its smaller ones. Only minima are aggregated
    there, so a node with very many neighbours is no burden to a task.
    """
    e = scratch.keep(union_find(edges.where("u <> v")))
    n = e.count()
    if n <= (AT_ONCE if at_once is None else at_once):
        out = scratch.keep(union_find(e.coalesce(1)).select("u", F.col("v").alias("root")))
        scratch.drop(e)
        return out
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small_star = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = scratch.keep(small_star.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        m = after.count()
        same = m == n and after.join(e, ["u", "v"], "left_anti").isEmpty()  # both are sets of edges
        scratch.drop(e)
        if same:
            out = after.withColumnRenamed("v", "root")
            out.kept_at = after.kept_at
            return out
        e, n = after, m


def candidates(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, id): every member of a bucket of two or more with its centre, the bucket's smallest id. Each pair once; a table of ``scratch``."""
    keys = nodes.select("id", F.explode("bands").alias("bucket"))
    met = keys.groupBy("bucket").agg(F.min("id").alias("c"), F.max("id").alias("hi"), F.count("*").alias("size")).where("c < hi").drop("hi")
    met = scratch.keep(met)
    pairs = joined(keys, met, ["bucket"], "size", BANDS * nodes.count()).where("id <> c")
    out = scratch.keep(pairs.select("c", "id").distinct())
    scratch.drop(met)
    return out


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "near_dedup")
    sig = scratch.keep(signed(docs, k))
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    # Equal sets have equal bands, so any will do; they are merged before they are dealt out.
    nodes = scratch.keep(sig.where(some).groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    near = candidates(nodes, scratch)
    ids = scratch.keep(near.select("id").unionByName(near.select(F.col("c").alias("id"))).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = scratch.keep(full_sets(texts.join(ids, "id").distinct(), k))
    label = ids.select("id", F.col("id").alias("comp"))
    spent = [ids]
    # The members of each centre, itself included.
    under = near.unionByName(near.select("c", F.col("c").alias("id")).distinct())
    for turn in ("centre", "smallest apart", "rest"):
        if turn == "centre":
            tries = near.select(F.col("c").alias("u"), F.col("id").alias("v"))
        else:
            members = scratch.keep(under.join(label, "id"))
            apart = members.groupBy("c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("weight")).where("lo < hi").select("c", "weight")
            apart = scratch.keep(apart.join(label.select(F.col("id").alias("c"), F.col("comp").alias("own")), "c"))
            here = scratch.keep(joined(members, apart, ["c"], "weight", members.count()))
            spent += [members, apart, here]
            if turn == "rest":
                tries = _rest(here, sets, percent, scratch, spent)
            else:
                second = here.groupBy("c").agg(F.min(F.when(F.col("comp") != F.col("own"), F.col("id"))).alias("second"), F.count("*").alias("weight"))
                second = scratch.keep(second.join(label.select(F.col("id").alias("second"), F.col("comp").alias("its")), "second"))
                spent.append(second)
                tries = joined(here, second, ["c"], "weight", here.count()).where("comp <> its and id <> c").select(F.least("id", "second").alias("u"), F.greatest("id", "second").alias("v")).distinct()
        a, b = sets.select(F.col("id").alias("u"), F.col("elements").alias("a")), sets.select(F.col("id").alias("v"), F.col("elements").alias("b"))
        # Written first: checked and merged in one stage, each task would hold two Python workers.
        good = scratch.keep(linked(tries.join(b, "v").join(a, "u"), percent))
        spent.append(good)
        lu, lv = label.select(F.col("id").alias("u"), F.col("comp").alias("cu")), label.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
        merged = components(good.join(lu, "u").join(lv, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")), scratch)
        label = scratch.keep(label.join(merged, F.col("comp") == F.col("u"), "left").select("id", F.coalesce("root", "comp").alias("comp")))
        scratch.drop(*spent, merged)
        spent = [label]
    # Only sets that several documents have, or that are linked, are looked up; every other document is a group of its own.
    comps = nodes.select("h1", "h2", "id", "copies").join(label, "id", "left").select("h1", "h2", "copies", F.coalesce("comp", "id").alias("comp"), "id")
    named = scratch.keep(comps.where("copies > 1 or comp <> id").select("h1", "h2", "copies", "comp"))
    scratch.drop(nodes, near, sets, label)
    rows = sig.select("doc_id", "n", "h1", "h2")
    alone = rows.where(~some | F.col("n").isNull()).withColumn("comp", F.lit(None).cast("long"))
    both = joined(rows.where(some), named, ["h1", "h2"], "copies", rows.count(), "left").unionByName(alone)
    return both.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def _elements(known: DataFrame) -> DataFrame:
    """A row (id, comp, s, n, e) for each element of the sets ``known`` (id, comp, s, n, elements)."""

    def run(batches):
        for b in batches:
            for i, x in enumerate(b.column(4)):
                e = np.frombuffer(x.as_buffer(), np.int64)
                same = b.slice(i, 1).select([0, 1, 2, 3]).take(pa.array(np.zeros(len(e), np.int32)))
                yield pa.RecordBatch.from_arrays([*same.columns, pa.array(e)], names=["id", "comp", "s", "n", "e"])

    return known.select("id", "comp", "s", "n", "elements").mapInArrow(run, "id long, comp long, s long, n int, e long")


def _rest(here: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, spent: list) -> DataFrame:
    """All pairs (u, v) under one centre, in different components, that may still link: whoever is outside a centre's largest component, with all others.

    ``here``: c, id, comp of all members of the centres that have several components.
    A pair that links shares at least one of the first n - 0.8 n + 1 elements of either, whatever the
    order of all elements. Here those that stand in one component only come first (they are in no
    intersection), then the others by the number of documents they stand in. Pairs that share a
    rare one of the first (in at most RARE documents) are joined by it. All other pairs share no rare
    element and have as many common ones as a link needs: only such documents are paired by centre.
    Heavily edited copies, whose edits are their own, are thereby out at once instead of in pairs
    with all of their group, and no pair that may link is lost.
    """
    count = here.groupBy("c", "comp").agg(F.count("*").alias("size"))
    main = scratch.keep(count.groupBy("c").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("weight")))
    who = scratch.keep(here.select("id", "comp").distinct())
    known = sets.join(who, "id").select("id", "comp", F.xxhash64("elements").alias("s"), "n", "elements")  # s tells the sets of one id apart
    # The elements that stand in several components, with the number of documents they stand in.
    each = scratch.keep(_elements(known))
    stands = scratch.keep(each.groupBy("e").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("e", F.col("df").alias("weight"), "df"))
    found = scratch.keep(joined(each, stands, ["e"], "weight", each.count()))
    per = scratch.keep(found.groupBy("id", "s", "n").agg(F.count("*").alias("shared"), F.count_if(F.col("df") > RARE).alias("usable")))
    spent += [main, who, each, stands, found, per]
    need = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    rank = F.row_number().over(Window.partitionBy("id", "s").orderBy("df", "e"))  # a document's own elements
    rare = found.where(F.col("df") <= RARE).join(per.select("id", "s", "shared"), ["id", "s"]).withColumn("rank", rank).where(F.col("rank") <= F.col("shared") - need + 1)
    rare = scratch.keep(rare.select("id", "comp", "e", "n"))
    spent.append(rare)
    a, b = rare.alias("a"), rare.alias("b")
    sizes = lambda x, y: 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
    sharing = a.join(b, (F.col("a.e") == F.col("b.e")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.comp") != F.col("b.comp")) & sizes("a", "b")).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    able = here.join(per.where(100 * F.col("usable") >= percent * F.col("n")).select("id", "n", "usable"), "id").select("c", "id", "comp", "n", "usable")
    stray = joined(able, main, ["c"], "weight", here.count()).where("comp <> main").drop("main").alias("x")
    mates = stray.join(able.alias("y"), (F.col("x.c") == F.col("y.c")) & (F.col("x.comp") != F.col("y.comp")) & sizes("x", "y") & _room(percent)).select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v"))
    return mates.unionByName(sharing).distinct()


def _room(percent: int) -> Column:
    """Whether the common elements of x and y leave room for a link."""
    most = F.least("x.usable", "y.usable")
    return 100 * most >= percent * (F.col("x.n") + F.col("y.n") - most)


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the smallest doc_id, with all columns of ``docs``; of rows that repeat a doc_id, one stays. Rows without doc_id stay.

    Only the ids that lose rows are looked up: those that go, and those that repeat, of which the row with the smallest hash of its text stays.
    """
    scratch = Scratch(docs.sparkSession, "near_dedup")
    per = groups(docs, k, percent).where("doc_id is not null").groupBy(F.col("doc_id").alias("row_id")).agg(F.min("component_id").alias("low"), F.count("*").alias("times"))
    lost = scratch.keep(per.where("low <> row_id or times > 1").select("row_id", (F.col("low") != F.col("row_id")).alias("goes"), "times"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("row_id"))
    rows = rows.join(small(lost.select("row_id", "goes")), "row_id", "left").where(~F.coalesce("goes", F.lit(False)))
    # Repeats of one doc_id are few; the window sorts them, not groups of copies.
    again = rows.where("goes is not null").withColumn("turn", F.row_number().over(Window.partitionBy("row_id").orderBy(F.xxhash64("row.text")))).where("turn = 1")
    return rows.where("goes is null").select("row.*").unionByName(again.select("row.*"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
