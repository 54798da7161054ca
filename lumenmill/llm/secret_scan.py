"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A version of a file is (path, text). Its blob is the SHA-256 of the text. Only pairs of blob and
rule version that the ledger lacks are scanned, each distinct blob once, however many paths or
versions hold it; findings are then joined back to every path by blob. The new ledger entries are
returned (and can be appended to a stored ledger), so a later run with one more rule scans with
that rule alone.

Spans are code points, end exclusive. Built from what lies between matches: ``split`` gives the
gaps and ``regexp_extract_all`` the matches of the same pattern, so running sums of their lengths
are the positions.

Defined results: null text counts as empty (no findings); repeated rows and copies each get the
findings of their blob; a null path stays a row and its text is scanned like any other; an empty ledger or None means that nothing has
been scanned yet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class Rule:
    """``pattern``: one leftmost, non-overlapping search. A match stays if its ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    base: bool = True


#: In the order in which kinds are listed. The first three are the base.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same spans as [0-9a-f]+ of 24 or more: runs are maximal either way
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1, base=False),
    Rule("vcs_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, base=False),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 34, base=False),
)

#: Tasks among which the paths of one blob are dealt.
SALTS = 32
#: Matches of one text that are gathered in one list before it joins the others.
PART = 256

LEDGER_SCHEMA = "blob string, rule string, version int, spans array<struct<start: int, stop: int>>"


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, stop>> of a rule's matches in ``text``."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    none = F.array().cast("array<struct<start: int, stop: int>>")

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["hit"])
        value = F.regexp_extract(pair["hit"], rule.pattern, rule.group) if rule.group else pair["hit"]
        one = F.when(F.length(value) >= rule.least, F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(none)
        return F.struct(stop.alias("at"), F.concat(acc["out"], one).alias("out"))

    pairs = F.transform(found, lambda hit, i: F.struct(F.get(gaps, i).alias("gap"), hit.alias("hit")))

    def part(pairs, acc, k):
        """PART matches more. Lists grow by copying, so matches are gathered in parts and the parts put together."""
        inner = F.aggregate(F.slice(pairs, k * PART + 1, PART), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), 0)

    def positions(pairs):
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start: int, stop: int>>>").alias("out"))
        parts = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PART).cast("int"))
        return F.aggregate(parts, state, lambda acc, k: part(pairs, acc, k), lambda acc: F.flatten(acc["out"]))

    # The pairs are bound to a variable, lest each part search the text anew.
    return F.when(F.size(found) > 0, F.get(F.transform(F.array(pairs), positions), 0)).otherwise(none)


def _ranked(found: Column, rank: int, rule: Rule) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["stop"].alias("stop"), F.lit(rule.base).alias("base")))


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings for each row of ``versions`` (path, text), and the ledger entries that this run adds.

    Findings: path, blob, found array<struct<start, rank, kind, stop, base>> ordered by start, then
    by the rules' order. New entries: LEDGER_SCHEMA, also for pairs without any span.
    """
    rows = versions.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("path", F.sha2("text", 256).alias("blob"))
    # One path of each blob stands for its text. The text itself is shuffled once, by path, rather than carried through an aggregate.
    # A blob that only rows without a path hold is taken from those; they are rare, and repeated ones are one again below.
    stand_in = keyed.groupBy("blob").agg(F.min("path").alias("path"))
    names = [r.kind for r in rules]
    if ledger is None:
        stand_in = stand_in.withColumn("seen", F.lit(None).cast("array<string>"))
        old = None
    else:
        current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
        old = ledger.where(F.col("rule").isin(names) & (F.col("version") == F.try_element_at(current, F.col("rule")))).dropDuplicates(["blob", "rule"])
        seen = old.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # at most one entry for each rule
        # Known before any text is shuffled: the text of a blob that all rules have seen is not needed.
        stand_in = stand_in.join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(names))
    named = rows.where("path is not null").withColumn("blob", F.sha2("text", 256)).join(stand_in.where("path is not null"), ["path", "blob"]).select("blob", "text", "seen")
    nameless = rows.where("path is null").select(F.sha2("text", 256).alias("blob"), "text").dropDuplicates(["blob"])
    todo = named.unionByName(nameless.join(stand_in.where("path is null").select("blob", "seen"), "blob").select("blob", "text", "seen"))
    none = F.array().cast("array<struct<start: int, stop: int>>")
    done = lambda r: F.coalesce(F.array_contains("seen", r.kind), F.lit(False))
    # Repeated (path, text) rows bring a blob's text more than once; its entries are the same, so one is enough.
    wide = todo.select("blob", *[F.when(done(r), F.lit(None)).otherwise(spans(F.col("text"), r)).alias(r.kind) for r in rules])
    fresh = wide.groupBy("blob").agg(*[F.first(r.kind).alias(r.kind) for r in rules])
    entries = fresh.select("blob", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules])).alias("e")).select("blob", "e.*").where("spans is not null")
    if old is not None:
        known = old.groupBy("blob").agg(*[F.first(F.when(F.col("rule") == r.kind, F.col("spans")), ignorenulls=True).alias(r.kind) for r in rules])
        fresh = fresh.select("blob", *[F.col(r.kind).alias(f"new_{r.kind}") for r in rules]).join(known, "blob", "full").select("blob", *[F.coalesce(f"new_{r.kind}", r.kind).alias(r.kind) for r in rules])
    ranked = [_ranked(F.coalesce(F.col(r.kind), none), i, r) for i, r in enumerate(rules)]
    found = fresh.select("blob", F.array_sort(F.concat(*ranked)).alias("found")).where(F.size("found") > 0)
    empty = F.array().cast("array<struct<start: int, rank: int, kind: string, stop: int, base: boolean>>")
    # Copies of one blob may be a third of all paths, so a blob with findings goes to SALTS tasks.
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = keyed.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return paths.join(salted, ["blob", "salt"], "left").select("path", "blob", F.coalesce("found", empty).alias("found")), entries


def digest(found: Column, base_only: bool) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kept = F.filter(found, lambda s: s["base"]) if base_only else found
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: a first load of some versions, then the whole history, in which only what the ledger lacks is scanned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    first = docs.where(F.crc32(F.col("path").cast("string").cast("binary")) % 3 == 0)
    ledger = Scratch(spark, "secret_ledger").keep(scan_history(first)[1])
    found, _ = scan_history(docs, ledger)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(digest(F.col("found"), True), 256).alias("base_sha256"), digest(F.col("found"), False).alias("spans"),
    )
