import collections
import random

import numpy as np
import pytest

from lumenmill.llm import common, line_dedup, near_dedup
from lumenmill.llm.common import Scratch
from tests.llm.conftest import prose


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("k,limit", [(2, 20_000), (5, 20_000), (2, 0)])
def test_groups_match_all_pairs(spark, monkeypatch, k, limit):
    """``limit`` 0: nothing is broadcast for its size, and every key that is no hot one is shuffled."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    rng = random.Random(k)
    rows, base = [], [prose(rng, 120).split() for _ in range(4)]
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 3, 6, 10, 25])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, None), (202, "one"), (203, "ONE"), (204, "one two three"), (205, "One  two\tthree")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()}
    assert got == brute(rows, k)


def test_odd_rows(spark, odd, empty):
    got = near_dedup.groups(odd, 2).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[15] == {4} and by[3] == {3} and by[13] == {13} and by[12] == {12} and by[None] == {None}
    kept = near_dedup.deduplicated(odd, 2)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == odd.columns and ids.count(3) == 1 and 15 not in ids and ids.count(None) == 2
    assert near_dedup.groups(empty, 2).count() == 0


def test_stars_and_union_find_agree(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    scratch = Scratch(spark, "test")
    one = {tuple(r) for r in near_dedup.components(df, scratch).collect()}
    assert one == {tuple(r) for r in near_dedup.components(df, scratch, at_once=0).collect()}


def test_signatures_estimate_resemblance():
    rng = np.random.default_rng(0)
    pairs, want = [], 0.6
    for _ in range(60):
        x = rng.integers(0, 2**63, 250, dtype=np.uint64)
        pairs += [x[:200], x[50:]]
    sig = near_dedup.signatures(np.concatenate(pairs), np.full(120, 200))
    est = (sig[::2] == sig[1::2]).mean(1)
    assert abs(est.mean() - want) < 0.01 and est.std() < np.sqrt(want * (1 - want) / near_dedup.SLOTS)


def lines_brute(rows, least=50):
    seen, gone, windows = {}, collections.defaultdict(set), []
    for i, t in rows:
        ls = [(k, x.strip(" \t\n\x0b\x0c\r"), len(x.encode().split())) for k, x in enumerate(t.split("\n"))]
        ls = [x for x in ls if x[2]]
        spans = set()
        for a in range(len(ls)):
            for step in (1, -1):
                total, b = 0, a
                while 0 <= b < len(ls):
                    total += ls[b][2]
                    if total >= least:
                        spans.add((min(a, b), max(a, b)))
                        break
                    b += step
        windows += [(i, ls[a][0], ls[b][0], tuple(x[1] for x in ls[a : b + 1])) for a, b in spans]
    for i, lo, hi, key in sorted(windows, key=lambda w: w[:3]):
        if key in seen:
            j, _, end = seen[key]
            gone[i].update(range(max(lo, end + 1) if i == j else lo, hi + 1))
        else:
            seen[key] = (i, lo, hi)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_lines_match_brute_force(spark):
    rng, rows = random.Random(5), []
    for i in range(250):
        ls = [rng.choice(["", "  ", " ".join(f"w{rng.randrange(3)}" for _ in range(rng.choice([1, 24, 26, 50]))), " ".join([f"c{rng.randrange(4)}"] * rng.choice([10, 30, 60])), f" c{rng.randrange(2)} " * 55]) for _ in range(rng.randrange(10))]
        rows.append((i, "\n".join(ls)))
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "new_text").collect()
    assert {r.doc_id: r.new_text for r in got} == lines_brute(rows)


def words_brute(rows, least=50):
    """The lines of words that stay, by comparing all windows of words."""
    first, gone, texts = {}, collections.defaultdict(set), []
    for i, t in rows:
        texts.append((i, [(k, w) for k, x in enumerate(t.split("\n")) for w in x.encode().split()]))
    for i, ws in texts:
        for a in range(len(ws) - least + 1):
            key = tuple(w for _, w in ws[a : a + least])
            j, b = first.setdefault(key, (i, a))
            if (i, a) != (j, b):
                gone[i].update(range(max(a, b + least) if i == j else a, a + least))
    out = {}
    for i, ws in texts:
        lines = collections.defaultdict(list)
        for a, (k, w) in enumerate(ws):
            if a not in gone[i]:
                lines[k].append(w)
        out[i] = [lines[k] for k in sorted(lines)]
    return out


def test_runs_inside_lines_match_brute_force(spark):
    rng, rows = random.Random(6), []
    passages = [[f"p{k}_{j}" for j in range(rng.randrange(45, 130))] for k in range(8)] + [["c"] * 60, ["a", "b", "c"] * 40]
    for i in range(220):
        words = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(20)])
            words += p[a : len(p) - rng.choice([0, 0, rng.randrange(20)])] if rng.random() < 0.6 else [f"x{rng.randrange(99)}" for _ in range(rng.randrange(70))]
        if i % 5 == 0:  # repeats inside this text, only
            words += [f"u{i}_{j % (1, 3, 40)[i % 3]}" for j in range(150)] + [f"v{i}_{j % (1 + i % 70)}" for j in range(160)]
        rows.append((i, "".join(w + rng.choice([" "] * 8 + ["\n", " \n\n", "  "]) for w in words)))
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), unit="word").select("row.doc_id", "new_text").collect()
    lines = {r.doc_id: [x.encode().split() for x in r.new_text.split("\n") if x.split()] for r in got}
    want = words_brute(rows)
    assert lines == want and sum(len(x) for v in want.values() for x in v) < sum(len(t.split()) for _, t in rows)


def test_passage_inside_longer_lines(spark, tmp_path):
    p = [f"p{k}" for k in range(54)]
    rows = [(1, "one two " + " ".join(p) + " three"), (2, "  four " + " ".join(p[:20]) + " \n\n" + " ".join(p[20:40]) + "\n" + " ".join(p[40:]) + "  five é\nsix")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 1, 0), 2: ("  four\nfive é\nsix", 5, 2)}


def test_lines_odd_rows(spark, odd, empty):
    out = line_dedup.filter_documents(odd)
    got = out.collect()
    assert out.columns == odd.columns and any(r.text is None for r in got) and any(r.text == "" for r in got)
    assert 15 not in {r.doc_id for r in got} and sum(r.doc_id == 3 for r in got) == 2
    assert line_dedup.filter_documents(empty).count() == 0


def test_hot_windows_without_shuffling_the_others(spark, tmp_path):
    """Only rows of buckets that are full enough to hold a hot window are shuffled; before, all 50 000 windows were."""
    from lumenmill.llm import line_dedup
    from lumenmill.llm.common import Scratch

    rows = spark.range(50_000).selectExpr("id", "id * 3 mark", "if(id % 400 = 7, 5, xxhash64(id, 1)) fp", "if(id % 400 = 7, 6, xxhash64(id, 2)) w", "cast(id % 11 as int) lo")
    windows = Scratch(spark, "hot").keep(rows)
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda: sum(x.shuffleWriteRecords() for x in (lambda s: [s.apply(i) for i in range(s.size())])(stages()))
    before = written()
    hot = line_dedup._hot_windows(windows, ["id", "mark", "lo"]).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert [(r.fp, r.w, tuple(r["first"])) for r in hot] == [(5, 6, (7, 21, 7))]
    assert written() - before < 40_000
