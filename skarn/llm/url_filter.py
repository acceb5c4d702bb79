"""URL verdicts by Bloom filter cascades: exact membership over the corpus's keys, without joins at query time.

A url's keys are each suffix of its host at a dot with each prefix of its path of a length that a rule has. Level 0 of a
cascade is a Bloom filter over the listed keys; level 1 one over the other keys of the corpus that level 0 takes for
listed; level 2 one over the listed keys that level 1 takes for unlisted; and so on, until a level errs on no key. As
the corpus's keys are all there is to ask, the answer of the first level that says no is exact. A cascade takes bits in
proportion to the listed keys (level 0 errs on about as many others as are listed), not to the corpus; its size is
checked before it is put in the plan. One cascade holds the blocking rules, one the allowing ones; a url that no rule
fits is in neither list, and is allowed.

DataFrame expressions only.

Defined results: a null url, or one without "://", has an empty host and path, which no rule fits; of two rules the
longer wins, of two equally long the one with the longer host, and of one key in both lists the block; repeated rows get
equal verdicts; without rules all is allowed; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import materialise, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of all levels of a cascade together, 32 MB.
MOST_BITS = 1 << 28


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, verdict) of rules such as ("net/", "block")."""
    rows = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("verdict")) for k, v in rules)) if rules else F.expr("array(named_struct('key', cast(null as string), 'verdict', ''))")
    return spark.range(1).select(F.inline(rows)).where(F.col("key").isNotNull())


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (key, host part) that a rule could bear, the longest first."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    cuts = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.struct(F.concat(s, F.substring(path, F.lit(1), n)).alias("key"), F.length(s).alias("h")))))
    sized = F.transform(pairs, lambda p: F.struct((-F.length(p["key"])).alias("a"), (-p["h"]).alias("b"), p["key"].alias("key")))
    return F.transform(F.sort_array(sized), lambda p: p["key"])


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: dict[int, int]

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed + j)), F.lit(self.bits)) for j in range(self.hashes)]

    def has(self, key: Column) -> Column:
        n = -(-self.bits // 64)
        table = F.split(F.lit(",".join(str(self.words.get(i, 0)) for i in range(n))), ",").cast("array<bigint>")  # folded to a literal
        hit = lambda p: F.get(table, F.shiftright(p, 6).cast("int")).bitwiseAND(_single(F.pmod(p, F.lit(64)).cast("int"))) != 0
        return F.forall(F.array(*self._places(key)), hit)  # the table stands in the plan once, not once a hash


def _single(bit: Column) -> Column:
    """The 64-bit word with only this bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def _level(keys: DataFrame, n: int, miss: float, seed: int) -> Level:
    """A Bloom filter over column key; the set words, as many as bits / 64 at most, come to the driver."""
    hashes = max(1, round(math.log2(1 / miss)))
    bits = max(64, 64 * math.ceil(n * hashes / math.log(2) / 64))
    if bits > MOST_BITS:
        raise ValueError(f"a level of {bits} bits for {n} keys exceeds the bound of {MOST_BITS} on what is broadcast")
    level = Level(bits, hashes, seed, {})
    places = keys.select(F.explode(F.array(*level._places(F.col("key")))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(_single(F.pmod("p", F.lit(64)).cast("int"))).alias("bits"))
    level.words = {r["w"]: r["bits"] for r in words.collect()}
    return level


@dataclass
class Cascade:
    levels: list[Level]

    def has(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def marked(keys: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """(key, one boolean a list): the different keys that are asked for, and which lists hold each. keys, lists: (key); one shuffle for all."""
    every = keys.select("key", F.lit(True).alias("asked"), *(F.lit(False).alias(n) for n in lists))
    for name, listed in lists.items():
        every = every.unionByName(listed.select("key", F.lit(False).alias("asked"), *(F.lit(n == name).alias(n) for n in lists)))
    held = every.groupBy("key").agg(F.bool_or("asked").alias("asked"), *(F.bool_or(n).alias(n) for n in lists))
    return held.where("asked").drop("asked")


def cascades(universe: DataFrame, seeds: dict[str, int]) -> dict[str, Cascade]:
    """A cascade for each list, with the seed of its hashes. universe: as ``marked`` makes it, in a written table, as every level reads it."""
    sizes = universe.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(name)).alias(f"n_{name}") for name in seeds)).collect()[0]
    return {name: _cascade(universe.where(name), universe.where(~F.col(name)), sizes[f"n_{name}"], sizes["n"] - sizes[f"n_{name}"], seed) for name, seed in seeds.items()}


def _cascade(inside: DataFrame, outside: DataFrame, n_in: int, n_out: int, seed: int) -> Cascade:
    levels: list[Level] = []
    while n_in:
        miss = 0.5 if levels else min(0.5, max(1e-9, math.sqrt(0.5) * n_in / max(1, n_out)))
        level = _level(inside, n_in, miss, seed + 1000 * len(levels))
        levels.append(level)
        inside, outside = outside.where(level.has(F.col("key"))), inside
        n_in = inside.count()
    return Cascade(levels)


def build(universe: DataFrame, listed: DataFrame, seed: int = 0) -> Cascade:
    """universe, listed: (key), repeats allowed. Keys that are listed but not of the universe are never asked for."""
    held = materialise(marked(universe, {"listed": listed}), "keys")
    made = cascades(held, {"listed": seed})["listed"]
    release(held)
    return made


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row. rules: (key, verdict), with "allow" or "block"."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    parted = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    spans = rules.select((F.length("key") - F.instr("key", "/") + 1).alias("n")).distinct().orderBy("n").collect()  # lengths of rules' paths
    lengths = [r["n"] for r in spans]
    keys = keys_of(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")
    lists = {v: rules.where(F.col("verdict") == v).select("key") for v in ("block", "allow")}
    universe = materialise(marked(parted.select(F.explode(keys).alias("key")), lists), "universe")
    found = cascades(universe, {"block": 1, "allow": 500_001})
    release(universe)
    block, allow = found["block"], found["allow"]
    fit = F.filter(keys, lambda k: block.has(k) | allow.has(k))
    ruled = parted.select("id", "host", "path", F.explode_outer(F.array(F.get(fit, F.lit(0)))).alias("rule"))
    verdict = F.when(F.col("rule").isNull(), "allow").when(block.has(F.col("rule")), "block").otherwise("allow")
    return ruled.withColumn("verdict", verdict)
