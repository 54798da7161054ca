import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmill.llm import byte_bpe, common, license_scan, secret_scan, source_mix
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, weights=(5, 2, 1), most=2):
    """Shares by weight, with what is beyond twice a size shared again, as a plain loop."""
    w, cap, full = [weights[i % 3] for i in range(len(sizes))], [most * s for s in sizes], set()
    while True:
        rest, total = share * sum(sizes) - sum(cap[i] for i in full), sum(w[i] for i in range(len(w)) if i not in full)
        goal = [float(cap[i]) if i in full else rest * w[i] / total for i in range(len(w))]
        over = {i for i in range(len(w)) if i not in full and goal[i] > cap[i]}
        if not over:
            return goal
        full |= over


def test_targets(spark):
    rng = random.Random(7)
    for sizes in ([100, 100, 100], [0, 10], [1], [5, 5, 5, 5], [0, 0], [rng.randrange(1000) ** 2 for _ in range(40)], []):
        names = [f"s{i:03}" for i in range(len(sizes))]
        if len(sizes) > 3:
            names[-1] = None  # the last one
        got = source_mix.with_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")).orderBy("src").collect()
        assert [r.source for r in got] == names and [r.target for r in got] == pytest.approx(targets(sizes) if sizes else [])


def test_located(spark):
    cuts = [0, 0, 3, 4, 4, 90, 91, 100]
    ends = spark.createDataFrame([(i, a, z) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))], "src int, lo long, hi long")
    got = {r.u: r.src for r in source_mix.located(spark.range(100).withColumnRenamed("id", "u"), "u", ends, 100).collect()}
    assert got == {u: next(i for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if a <= u < z) for u in range(100)}


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(source_mix.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1).cast("long"))).collect()]
    assert sorted(got) == list(range(n)) and (n < 100 or got != list(range(n)))


@pytest.mark.parametrize("limit", [20_000, 0])
def test_mix_sums(spark, monkeypatch, limit):
    """Quotas are met, nothing is read too often, the texts hold the words that are counted, and reruns agree."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(0, 900)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)] + [(500, prose(rng, 9000), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.Mix(docs, slots=64).taken().collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    sizes = {s: sum(len(WORD.findall(t)) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    assert {r.source: (r.source_size, round(r.target, 6)) for r in got} == {s: (n, round(t, 6)) for (s, n), t in zip(sizes.items(), targets(list(sizes.values())), strict=True)}
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= source_mix.BLOCK
    assert all(r.taken <= 2 * r["size"] and r["size"] == len(WORD.findall(text[r.doc_id])) for r in got)
    if not limit:
        return
    again = source_mix.Mix(docs.repartition(5), slots=64).taken().collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    taken = collections.Counter()
    mixed = source_mix.mixed_documents(docs).collect()
    for r in mixed:
        words, own = iter(WORD.findall(text[r.doc_id])), WORD.findall(r.text)
        assert own and all(w in words for w in own)  # words of the text, in their order
        assert r.n_chars == len(r.text) if "n_chars" in r else True
        taken[r.doc_id] += len(own)
    assert max(collections.Counter(r.doc_id for r in mixed).values()) <= 2
    assert taken == {r.doc_id: r.taken for r in source_mix.Mix(docs).taken().collect() if r.taken}


def test_mix_odd_rows(spark, odd, empty):
    got = source_mix.Mix(odd).taken().collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if not r["size"])
    out = source_mix.mixed_documents(odd)
    words = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
    assert out.columns == odd.columns and words(out.collect()) == sum(r.taken for r in got)
    assert source_mix.Mix(empty).taken().count() == 0 and source_mix.mixed_documents(empty).count() == 0


def spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        found += [(m.start(), rank, kind, m.end()) for m in re.compile(pattern, re.A).finditer(text) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(found))


SECRETS = [
    "token = abcdef", "Token:'abc' token=secret=abcdefgh", "é🙂 api_key: \"ABCdef123\" API-KEY=zzzzzzzz apikey=qqqqqq1", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 12, "AKIAshort", "x" + "0af" * 8 + "g" + "b" * 23,
    "token:token:abcdefgh", "password='" + "e" * 30 + "'", "", "secret=\nabcdef", "-----BEGIN RSA PRIVATE KEY-----", "ſecret=abcdefg", "toKen=abcdefg",
]


def test_secret_spans(spark):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(100, SECRETS[0]), (101, None), (None, SECRETS[0])]
    found, entries = secret_scan.scan_history(spark.createDataFrame(rows, "path long, text string"))
    got = {r.path: r.s for r in found.select("path", secret_scan.digest(F.col("found"), True).alias("s")).collect()}
    assert len(got) == len(rows) and all(got[i] == spans(t or "") for i, t in rows if i is not None)
    assert entries.select("blob", "rule").distinct().count() == entries.count()


def test_secrets_of_rows_without_a_path(spark):
    rows = [(None, SECRETS[0]), (None, SECRETS[0]), (None, SECRETS[3]), (None, None), (1, SECRETS[5]), (None, SECRETS[5]), (2, "clean")]
    versions = spark.createDataFrame(rows, "path long, text string")
    found, entries = secret_scan.scan_history(versions)
    got = sorted((r.path or 0, r.s) for r in found.select("path", secret_scan.digest(F.col("found"), True).alias("s")).collect())
    assert got == sorted((i or 0, spans(t or "")) for i, t in rows) and spans(SECRETS[0]) and spans(SECRETS[3])
    keys = [(r.blob, r.rule) for r in entries.select("blob", "rule").collect()]
    assert len(set(keys)) == len(keys) == len({t or "" for _, t in rows}) * len(secret_scan.RULES)
    again, new = secret_scan.scan_history(versions, entries)
    assert new.count() == 0 and sorted((r.path or 0, r.s) for r in again.select("path", secret_scan.digest(F.col("found"), True).alias("s")).collect()) == got


def test_ledger_scans_only_what_is_new(spark):
    old = spark.createDataFrame([(1, "token=abcdef1")], "path long, text string")
    first, entries = secret_scan.scan_history(old, rules=secret_scan.RULES[:2])
    both = spark.createDataFrame([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, "hello " + "a" * 24)], "path long, text string")
    found, new = secret_scan.scan_history(both, entries, secret_scan.RULES[:3])
    fresh = {(r.blob, r.rule) for r in new.collect()}
    one, three = (hashlib.sha256(t.encode()).hexdigest() for t in ("token=abcdef1", "hello " + "a" * 24))
    assert fresh == {(one, "hex"), (three, "assign"), (three, "access"), (three, "hex")}
    got = {r.path: [f.kind for f in r.found] for r in found.collect()}
    assert got == {1: ["assign"], 2: ["assign"], 3: ["hex"]}


def test_query_scans_each_pair_once(spark, tmp_path):
    """The query's two runs over one ledger give what one scan gives; the second finds nothing to scan twice. Long lists of matches are whole."""
    rows = [(i, SECRETS[i % len(SECRETS)] + f" {i % 31}") for i in range(120)] + [(None, SECRETS[3]), (500, None), (501, "secret=abcdef " * 1500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = secret_scan.op8_secret_scan(spark, str(tmp_path)).collect()
    want = {i: spans(t or "") for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(f"{k}:") for s in base.split(",")) for k in ("assign", "access", "hex"))
    versions = spark.createDataFrame(rows, "path long, text string")
    first = secret_scan.scan_history(versions.where("path % 3 = 0"))[1].collect()
    second = secret_scan.scan_history(versions, spark.createDataFrame(first, secret_scan.LEDGER_SCHEMA))[1].collect()
    pairs = collections.Counter((e.blob, e.rule) for e in [*first, *second])
    assert first and second and set(pairs.values()) == {1} and len(pairs) == len({t or "" for _, t in rows}) * len(secret_scan.RULES)


def test_secrets_odd_rows(spark, odd, empty):
    view = lambda d: d.select(F.col("doc_id").alias("path"), "text", "key", "id")
    assert secret_scan.scan_history(view(odd))[0].count() == odd.count()
    assert secret_scan.scan_history(view(empty))[0].count() == 0


def test_licenses_against_all_windows(spark):
    rng, library = random.Random(3), license_scan.Library()
    texts = []
    for _ in range(60):
        w = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randrange(2 + len(w) // 25)):
            w[rng.randrange(len(w))] = "zzz"
        body = prose(rng, rng.randrange(1, 300)).split(" ")
        k = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:k] + w + body[k:]))
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    assert library.scan(data, off) == library.scan(data, off, banded=False)
    whole = " ".join(["hello"] + [license_scan.TEMPLATES[0][1]] + ["bye"])
    got = license_scan.scan_documents(spark.createDataFrame([(1, whole), (2, None), (3, "")], "doc_id long, text string")).collect()
    found = {r.doc_id: [(m.license, whole[m.start : m.stop]) for m in r.matches] for r in got}
    assert found[1][0] == ("Apache-2.0", license_scan.TEMPLATES[0][1]) and not found[2] and not found[3]


def test_licenses_by_plain_containment(spark, odd, empty, tmp_path):
    """Planted notices against plain sets of word shingles: each whole or nearly whole one is found where it stands, texts without any have none."""
    rng, library = random.Random(12), license_scan.Library()
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    rows, want = [], {}
    for i in range(400):
        t = rng.randrange(len(license_scan.TEMPLATES))
        name, notice = license_scan.TEMPLATES[t]
        body = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 900))]
        k = rng.randrange(len(body) + 1)
        planted = i % 4 < 3
        own = notice.split()
        if planted and i % 4 == 1 and len(library.sets[t]) >= 60:  # one word changed: five shingles of sixty and more
            own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(body[:k] + (own if planted else []) + body[k:])))
        want[i] = name if planted else None
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in license_scan.op9_license_scan(spark, str(tmp_path)).collect()}
    assert all((name in got[i].licenses.split(",")) if name else got[i].n_matches == 0 for i, name in want.items())
    for i, text in rows[:60]:
        for m in filter(None, got[i].spans.split(",")):
            name, a, z = m.rsplit(":", 2)
            span = words(text[int(a) : int(z)])
            grams = {tuple(span[j : j + 5]) for j in range(len(span) - 4)} or {tuple(span)}
            sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for w in (words(x) for n, x in license_scan.TEMPLATES if n == name)]
            assert any(len(grams & s) >= 0.8 * len(s) for s in sets)
    assert license_scan.scan_documents(odd).count() == odd.count() and license_scan.scan_documents(empty).count() == 0
    twice = license_scan.scan_documents(spark.createDataFrame([(1, (license_scan.TEMPLATES[0][1] + " ") * 40)] * 2, "doc_id long, text string")).collect()
    assert twice[0] == twice[1] and twice[0].matches


def test_short_notices_are_never_missed():
    """Notices of few shingles at the start of a text stand in one window only."""
    rng, library = random.Random(8), license_scan.Library()
    for t in (i for i, (_, x) in enumerate(license_scan.TEMPLATES) if len(library.sets[i]) <= 8):
        raw = [" ".join([license_scan.TEMPLATES[t][1], *(f"w{rng.randrange(10**9)}" for _ in range(60))]).encode() for _ in range(1500)]
        data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        found = library.scan(data, off)
        assert {r for r, i, *_ in found if i == t} == set(range(1500)), license_scan.TEMPLATES[t]
    for i, s in enumerate(library.sets):  # the stated bound, for all others
        w = 2 << next(k for k, v in library.classes.items() if i in v)
        assert i in library.exact or (1 - 0.8 * len(s) / (w + 0.2 * len(s))) ** license_scan.BANDS <= 3e-6


def test_bpe_equals_the_library(spark, odd, empty):
    tiktoken = pytest.importorskip("tiktoken")
    raw, pattern = byte_bpe.public_ranks()
    bpe = byte_bpe.encoder(raw, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(raw), special_tokens={})
    rng = random.Random(1)
    texts = ["", "<|endoftext|>", "a" * 20_000, " " * 9999, "\x00\xff é中🙂" * 50] + ["".join(rng.choice(rng.choice(["abcdef", "0123", " \n\t", "aAé中🙂 ", "!?=-_", "etaoin shrdlu"])) for _ in range(rng.randrange(200))) for _ in range(400)]
    for t in texts:
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and bpe.decode(ids) == t.encode()
    got = byte_bpe.digests(odd, raw, pattern, keep_ids=True).collect()
    want = sorted((r.doc_id is None, r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in odd.select("doc_id", "text").collect())
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in got) == want and all(len(r.ids) == 4 * r.n_tokens for r in got)
    assert byte_bpe.tokenize(odd, raw, pattern).count() == odd.count() and byte_bpe.digests(empty, raw, pattern).count() == 0
