import collections
import hashlib
import html
import math
import os
import random
import re
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenmill.llm import bm25_search, html_text, quality_rules, source_mix
from tests.llm.conftest import SF, prose
from tests.llm.test_dedup import brute as groups_brute
from tests.llm.test_dedup import words_brute
from tests.llm.test_mix_scan_bpe import targets


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bm25_search, "SHARD_DOCS", 60)
    monkeypatch.setattr(bm25_search, "QUERY_BYTES", 4000)
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(0, 200)) + f" Rare{i % 9}") for i in range(300)] + [(300, None), (301, ""), (302, "zzz zzz"), (303, "ZZZ zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = docs.where("doc_id % 20 = 0 or doc_id > 298").select(F.col("doc_id").alias("query_id"), "text")
    got = collections.defaultdict(list)
    for r in bm25_search.search(docs, queries, 10).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    tf = {i: collections.Counter((t or "").encode().lower().split()) for i, t in rows}
    mean, df = sum(sum(c.values()) for c in tf.values()) / len(rows), collections.Counter(w for c in tf.values() for w in c)
    for q, _ in rows:
        if q % 20 and q <= 298:
            continue
        scores = {}
        for i, c in tf.items():
            s = sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in tf[q] if w in c)
            if s > 0:
                scores[i] = round(s, 6)
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert [d for _, d, _ in sorted(got[q])] == [d for d, _ in want]
        assert all(abs(a[2] - b[1]) < 2e-6 for a, b in zip(sorted(got[q]), want, strict=True))


def test_search_makes_shards_ready_once_for_several_blocks(spark, monkeypatch):
    """Same answers, in a fourth of the jobs, each of which unpacks all shards."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, rng.randrange(1, 90)) + f" Rare{i % 7}") for i in range(120)], "doc_id long, text string").repartition(2)
    queries = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "text")
    want = sorted(tuple(r) for r in bm25_search.search(docs, queries, 5).collect())
    jobs, answers = [], bm25_search._answers
    monkeypatch.setattr(bm25_search, "_answers", lambda *a: jobs.append(1) or answers(*a))
    monkeypatch.setattr(bm25_search, "QUERY_BYTES", 600)
    assert sorted(tuple(r) for r in bm25_search.search(docs, queries, 5).collect()) == want
    terms = bm25_search.query_terms(queries).selectExpr("sum(size(terms))").first()[0]
    blocks = -(-12 * terms // 600)
    assert blocks > 4 and len(jobs) <= -(-blocks // 4)


def test_search_odd_rows(spark, odd, empty):
    ask = lambda d: d.select(F.col("doc_id").alias("query_id"), "text")
    got = bm25_search.search(odd, ask(odd), 3).collect()
    assert {r.query_id for r in got} >= set(range(12)) and all(r["rank"] <= 3 for r in got)
    assert bm25_search.search(empty, ask(empty)).count() == 0
    assert bm25_search.search(odd, ask(empty)).count() == 0


@pytest.fixture(scope="module")
def net():
    return html_text.train(400, 6)


def test_labels_on_held_out_pages(net):
    rng = random.Random(77)
    made = [html_text.training_page(rng) for _ in range(150)]
    made = [(b, y) for b, y in made if b]
    out = net.label([html_text.vectors(b) for b, _ in made])
    right = sum(((p >= 0.5) == (y > 0.5)).sum() for p, (_, y) in zip(out, made, strict=True))
    assert right / sum(len(y) for _, y in made) > 0.97


def test_blocks():
    texts = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert texts("<p>a &amp; b&nbsp;<b>c</b>\n\n d<br>e<p>f</p><script>var x='</p>'</script><!-- no --><style>p{}</style>g") == ["a & b c d e", "f", "g"]
    assert texts("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == ["one", "two", "x", "y"]
    assert texts("") == texts("<p") == texts("<script>alert(1)") == []
    assert texts("a < b and <a href='x>y'>link</a") == ["a < b and link"]
    paths = [b.path for b in html_text.blocks_of('<div class="side-bar top"><p>x</div>y')]
    assert paths == [("<div", "side", "bar", "top", "<p"), ()]


def test_quotes_that_open_no_value():
    texts = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert texts('<article><p class="a"">Lost words here</p><p>next <a href="x">link</a></p></article>') == ["Lost words here", "next link"]
    assert texts("""<p title=it's>one</p><p data-x='>">'>two<p "a" b = ">" c>three""") == ["one", "two", "three"]
    assert texts('<p class="open>one</p><p>two</p>') == ["one", "two"]


def test_long_pages_in_strips(net):
    """Strips with carried state give what one pass gives; deep nesting costs its size."""
    page = "".join(f'<div class="c{i % 7}"><p>some words {i} here</p>' + "</div>" * (i % 3 == 0) for i in range(900))
    blocks = html_text.blocks_of(page)
    whole, strips = net.label([html_text.vectors(blocks)])[0], net.label_long(blocks, 64)
    assert len(blocks) == 900 and abs(whole - strips).max() < 1e-5
    deep = html_text.blocks_of("<div>x" * 30_000)
    assert len(deep) == 30_000 and len(deep[-1].path) == 30_000 and html_text.vectors(deep[-3:], 29_997, 30_000).shape[0] == 3
    assert len(html_text.extract(["<article>" + "<p>A sentence of the story goes on here.</p>" * 5000 + "</article>"], net)[0].split("\n")) > 4000


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_articles_of_the_table(spark, net):
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()
    got = html_text.extract([r.html for r in rows], net)
    right = 0
    for r, text in zip(rows, got, strict=True):
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        right += text == "\n".join(x for x in want if x)
    assert right / len(rows) > 0.97


def test_pages_odd_rows(spark, net):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "<p>", 3), (None, "u", "<article><h1>Title here</h1><p>Some plain text of the story goes here.</p></article>" * 2, 4), (5, "u", "<li>" * 3000 + "x" * 100_000, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract_pages(df, net).collect()
    assert len(got) == 5 and all(r.text is not None for r in got)
    assert html_text.extract_pages(df.limit(0), net).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_by_brute_force(spark):
    """Each stage on the real rows against plain Python; mixing, which draws, by what its rows may hold; the last by decoding."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "byte_bpe"]
    made, words = [], lambda t: t.encode().split()
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF).cache()
        made.append(out.collect())
        assert i == 4 or out.columns == docs.columns
        docs = out
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    verdict = {r.doc_id: r.kept for r in quality_rules.op4_quality_rules(spark, SF).collect()}
    assert {r.doc_id: r.text for r in made[0]} == {i: t for i, t in first.items() if verdict[i]}
    left = words_brute(sorted((r.doc_id, r.text) for r in made[0]))
    assert {r.doc_id: [words(x) for x in r.text.split("\n") if words(x)] for r in made[1]} == {i: x for i, x in left.items() if x}
    assert all(r.n_chars == len(r.text) for r in made[1])
    alone = {i for i, (_, root) in groups_brute([(r.doc_id, r.text) for r in made[1]], 5).items() if i == root}
    assert {r.doc_id: r.text for r in made[2]} == {r.doc_id: r.text for r in made[1] if r.doc_id in alone}
    whole, size, source, taken = {r.doc_id: r.text for r in made[2]}, collections.Counter(), {r.doc_id: r.source for r in made[2]}, collections.Counter()
    for i, t in whole.items():
        size[source[i]] += len(words(t))
    for r in made[3]:
        own, rest = words(r.text), iter(words(whole[r.doc_id]))
        assert own and all(w in rest for w in own) and r.n_chars == len(r.text)
        taken[r.source] += len(own)
    names = sorted(size, key=lambda x: (x is None, x))
    goal = dict(zip(names, targets([size[n] for n in names]), strict=True))
    assert all(abs(taken[n] - goal[n]) <= source_mix.BLOCK for n in names)
    assert max(collections.Counter(r.doc_id for r in made[3]).values()) <= 2
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted((r.doc_id, r.decoded_sha256) for r in made[4]) == sorted((r.doc_id, sha(r.text.encode())) for r in made[3])
    assert all(r.ids_sha256 == sha(bytes(r.ids)) and len(r.ids) == 4 * r.n_tokens for r in made[4])
    again = P.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in again) == sorted((r.doc_id, r.ids_sha256) for r in made[4])


def test_pipeline_odd_rows(spark, odd, tmp_path):
    """Nulls, repeats, empty and very long texts, and columns with clashing names go through all stages; so does an empty table."""
    import corpus_pipeline as P

    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(12)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = P.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(got) == (name == "odd") and all(r.n_tokens > 0 for r in got)


def test_a_shard_is_built_in_little_memory():
    """Bytes at the peak for each posting, of the index and of a shard that answers: 38 and 30, before 67 and 69."""
    rng = np.random.default_rng(3)
    builder = bm25_search.ShardBuilder()
    for _ in range(40):
        text = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.2, 400), 40_000)).encode() for _ in range(50)]
        builder.add(np.arange(50), np.frombuffer(b"".join(text), np.uint8), np.cumsum([0] + [len(t) for t in text]))
    postings = sum(len(x) for x in builder.terms)
    tracemalloc.start()
    try:
        raw = builder.done()[2]
        made = tracemalloc.get_traced_memory()[1] / postings
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        terms = bm25_search.unpack(raw)[2]
        bm25_search.Shard([raw], 400.0, terms, np.ones(len(terms)))
        answers = (tracemalloc.get_traced_memory()[1] - before) / postings
    finally:
        tracemalloc.stop()
    assert made < 50 and answers < 50, (made, answers)


class Here:
    """In place of a table of shards: gives what an executor would run on it."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_parts_of_a_shard(monkeypatch):
    """Texts of three languages and of mixed ones, in parts of few documents: all that brute force finds, with few calls for each query (15; before 185)."""
    monkeypatch.setattr(bm25_search, "PART", 128, raising=False)
    rng = random.Random(6)
    draw = lambda t, n: [f"{t}{int(500 * rng.random() ** 3)}" for _ in range(n)]
    texts = [draw(rng.choice("xyz"), rng.randrange(1, 120)) + draw(rng.choice("xyz"), rng.choice([0, 0, 0, 9])) for _ in range(900)]
    texts[7:10], texts[20] = [texts[7]] * 3, []
    builders = [bm25_search.ShardBuilder(), bm25_search.ShardBuilder()]
    for b, some in zip(builders, (range(500), range(500, 900)), strict=True):
        raw = [" ".join(texts[i]).encode() for i in some]
        b.add(np.array(some), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    made = [b.done() for b in builders]
    mean, df = sum(m[1] for m in made) / 900, collections.Counter(w for t in texts for w in set(t))
    # Queries as search() deals them: all terms by rank, and their weights.
    data = sorted(df)
    raw = [w.encode() for w in data]
    rows, hashes, _, _ = bm25_search.term_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    of = {data[r]: h for r, h in zip(rows, hashes, strict=True)}
    kinds = np.sort(hashes)
    idf = {w: math.log(1 + (900 - df[w] + 0.5) / (df[w] + 0.5)) for w in data}
    weights = np.zeros(len(kinds))
    for w in data:
        weights[np.searchsorted(kinds, of[w])] = idf[w]
    asked = [sorted(set(t)) for t in texts[:400] if t]
    place = np.searchsorted(kinds, np.array([of[w] for q in asked for w in q])).astype(np.uint32)
    n = len(asked)
    block = bm25_search.pack(np.arange(n), np.arange(n), np.array([len(q) for q in asked], np.int32), kinds, weights, place)
    run = bm25_search._answers(Here(), type("Shared", (), {"value": block}), mean, 10)
    table = pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[2] for m in made], pa.binary())], names=["n", "shard"])
    calls = collections.Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        got = list(run([table]))
    finally:
        sys.setprofile(None)
    found = collections.defaultdict(list)
    for b in got:
        for q, _, d, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found[q].append((-s, d))
    tf = [collections.Counter(t) for t in texts]
    norm = [1.2 * (0.25 + 0.75 * len(t) / mean) for t in texts]
    for q, words in enumerate(asked):
        scores = [(-round(sum(idf[w] * c[w] * 2.2 / (c[w] + norm[d]) for w in words if w in c), 6), d) for d, c in enumerate(tf)]
        want = sorted(x for x in scores if x[0] < 0)[:10]
        assert [d for _, d in sorted(found[q])] == [d for _, d in want]
        assert all(abs(a[0] - b[0]) < 2e-6 for a, b in zip(sorted(found[q]), want, strict=True))
    assert (calls["call"] + calls["c_call"]) / n < 40, calls
