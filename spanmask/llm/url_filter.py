"""URL rules by a Bloom filter cascade (DataFrame functions only).

The key universe is every (host suffix, path prefix) key of the corpus.  The
first filter encodes the listed keys, the next one the keys of the universe
that the first passes wrongly, and so on in turn until none is left; a key is
listed exactly if the first filter that rejects it has an even number.  The
filters stand in the expression as constants, so judging a URL needs no join.

Size bound: the first filter's false positive rate is chosen so that it lets
about as many unlisted keys pass as there are listed ones; all levels together
then take O(listed * log(universe / listed)) bits.  Lists longer than
``MAX_KEYS`` are dealt into shards by key hash, one pass each, so the constants
of a pass stay bounded and the result exact.

Cases: a null url or one without ``://`` has empty host and path and fits no
rule; no rules or no rows are allowed; equal rules count once, and of two rules
with one key and different verdicts block wins; other columns are ignored.
"""
from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize

MAX_KEYS = 2_000_000


@dataclass
class Level:
    number: int
    bits: int
    hashes: int
    words: list[int]

    def positions(self, key: Column) -> list[Column]:
        a, b = F.xxhash64(F.lit(self.number), key), F.hash(key, F.lit(self.number)).cast("long")
        return [F.pmod(a + F.lit(i) * b, F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")     # folded into a constant
        hit = F.lit(True)
        for p in self.positions(key):
            word = F.element_at(words, (F.floor(p / 64) + 1).cast("int"))
            # each bit is tested by its own mask
            hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))) != 0)
        return hit


def make_level(number: int, keys: DataFrame, count: int, rate: float) -> Level:
    hashes = max(1, min(24, round(-math.log2(rate))))
    level = Level(number, max(64, math.ceil(count * hashes / math.log(2) / 64) * 64), hashes, [])
    rows = (keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
            .groupBy(F.floor(F.col("p") / 64).alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("v"))
            .collect())                         # bits / 64 rows at most, bounded by the list
    level.words = [0] * (level.bits // 64)
    for r in rows:
        level.words[r.w] = r.v
    return level


def build_cascade(marked: DataFrame) -> list[Level]:
    """``marked``: one row per key of the universe (key, listed boolean)."""
    counts = {r.listed: r["count"] for r in marked.groupBy("listed").count().collect()}
    levels: list[Level] = []
    left = {True: counts.get(True, 0), False: counts.get(False, 0)}
    if not left[True]:
        return levels
    rest = marked
    side = True
    while left[side]:
        wrong = max(1, left[not side])
        rate = min(0.5, max(1e-6, 1.41 * left[side] / wrong)) if not levels else 0.1
        level = make_level(len(levels) + 1, rest.where(F.col("listed") == side), left[side], rate)
        levels.append(level)
        rest = rest.where((F.col("listed") == side) | level.passes(F.col("key")))
        side = not side
        left[side] = rest.where(F.col("listed") == side).count()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Exact membership for every key of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.passes(key), F.lit(level.number % 2 == 0)).otherwise(out)
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key that could fit: host suffixes times path prefixes of the rules' lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.filter(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                    lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), lambda s: s != "")
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths] or [F.lit(None).cast("string")]),
                        lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", max_keys: int = MAX_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict; ``rules``: (rule 'host/path', verdict allow or block).

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule wins, of equally long ones the alphabetically last.  URLs
    that fit no rule get ``default``.
    """
    rules = materialize(rules.where(F.instr("rule", "/") > 0)
                        .groupBy(F.col("rule").alias("key")).agg(F.max("verdict").alias("verdict")), "rules")
    # at most as many lengths as a path has characters
    lengths = sorted(r.n for r in rules.select((F.length("key") - F.instr("key", "/") + 1).alias("n")).distinct().collect())
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.select("*", candidate_keys(F.col("host"), F.col("path"), lengths).alias("keys"))
    universe = urls.select(F.explode("keys").alias("key")).distinct()
    marked = materialize(universe.select("key", F.lit(None).cast("string").alias("verdict"), F.lit(True).alias("seen"))
                         .unionByName(rules.select("key", "verdict", F.lit(False).alias("seen")))
                         .groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("seen").alias("seen"))
                         .where("seen").select("key", "verdict", F.col("verdict").isNotNull().alias("listed")), "universe")
    shards = max(1, math.ceil(rules.count() / max_keys))
    urls = urls.select("*", F.array().cast("array<struct<n:int,key:string,verdict:string>>").alias("hits"))
    for s in range(shards):
        own = lambda k: F.pmod(F.hash(k), F.lit(shards)) == s
        part = marked.where(own(F.col("key")))
        listed = build_cascade(part.select("key", "listed"))
        if not listed:
            continue
        blocked = build_cascade(part.where("listed").select("key", (F.col("verdict") == "block").alias("listed")))
        found = F.filter("keys", lambda k: own(k) & member(listed, k))
        urls = urls.withColumn("hits", F.concat("hits", F.transform(found, lambda k: F.struct(
            F.length(k).alias("n"), k.alias("key"),
            F.when(member(blocked, k), "block").otherwise("allow").alias("verdict")))))
        if shards > 1:
            urls = materialize(urls, "judged")
    won = F.array_max("hits")
    return urls.select("page_id", "host", "path", won["key"].alias("rule"),
                       F.coalesce(won["verdict"], F.lit(default)).alias("verdict"))
