"""URL rules held in Bloom filter cascades, with DataFrame functions alone.

A rule is a host and a path prefix, written together ("example.org/en/").  It fits its host and all subdomains; of the
rules that fit, the longest wins (of equal lengths the longer host), and block wins over allow for the same rule.

A cascade holds a list exactly over all keys the corpus asks for: level 1 is a Bloom filter of the listed keys,
level 2 one of the other corpus keys that pass level 1, level 3 one of the listed keys that pass level 2, and so on,
until no key passes wrongly.  A key is looked up level by level, without a join.  The filters are literals of the plan;
their size follows the list, not the corpus, and is checked against ``MOST_BITS``.

Defined results: a null url, or one without "://", has an empty host and path, which no rule fits; a url that no rule
fits is in no list and is allowed; hosts end at "/", "?" or "#" and keep ports and user names; rows are judged one by
one; input columns called as a result column are replaced; empty rules and empty tables give empty or ruleless results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import col
from tabscope.llm.common import others, replaced
from tabscope.plans.stored import stored

MOST_BITS = 1 << 26
MOST_LEVELS = 64


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def passes(self, key: Column) -> Column:
        """Whether all bits of ``key`` are set."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded into one literal
        found = F.lit(True)
        for place in _places(key, self.number, self.hashes, self.bits):
            found &= F.getbit(words[F.shiftright(place, 6).cast("int")], place.bitwiseAND(F.lit(63)).cast("int")) == 1
        return found


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether ``key`` is listed; exact for the keys of the universe the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def _places(key: Column, number: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(number), F.lit(j), key), F.lit(bits)) for j in range(hashes)]


def bloom(keys: DataFrame, number: int, rate: float) -> Level:
    """A Bloom filter of the column ``key`` with about the given rate of false positives."""
    n = keys.count()
    bits = 64 * max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
    if bits > MOST_BITS:
        raise ValueError(f"{n} keys need {bits} bits, more than the {MOST_BITS} that are sent to every task")
    hashes = max(1, round(math.log2(1 / rate)))
    place = F.explode(F.array(*_places(F.col("key"), number, hashes, bits))).alias("place")
    # at most MOST_BITS / 64 rows, however many keys there are
    words = keys.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("held")).collect()
    held = {r["word"]: r["held"] for r in words}
    return Level(number, bits, hashes, tuple(held.get(w, 0) for w in range(bits // 64)))


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade of the listed keys over ``universe``; both have one column ``key``, which may repeat."""
    inside = stored(listed.where("key IS NOT NULL").distinct(), "listed")
    n = inside.count()
    if not n:
        return Cascade(())
    size = universe.agg(F.approx_count_distinct("key")).first()[0] + n
    levels = [bloom(inside, 1, min(0.5, max(2.0 ** -20, math.sqrt(n / (2 * size)))))]
    # the few keys that pass are all that is compared with the list itself
    outside = stored(universe.where(levels[0].passes(F.col("key"))).distinct().join(inside, "key", "left_anti"), "passing")
    while not outside.isEmpty():
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("the cascade does not end")
        levels.append(bloom(outside, len(levels) + 1, 0.5))
        inside, outside = outside, stored(inside.where(levels[-1].passes(F.col("key"))), "passing")
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    whole = F.coalesce(F.regexp_extract(after, r"^([^?#]*)", 1), F.lit(""))
    host = F.regexp_extract(whole, r"^([^/]*)", 1)
    path = F.substring(whole, F.length(host) + 1, F.length(whole))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidates(host: Column, path: Column, rules: list[str]) -> Column:
    """Keys a url asks for: the ends of its host of as many labels, and the starts of its path of as many characters, as some rule has."""
    shapes = sorted({(r.partition("/")[0].count(".") + 1, len(r) - r.index("/")) for r in rules})
    keys = []
    for labels, length in shapes:
        end = F.substring_index(host, ".", -labels)
        keys.append(F.when(F.length(path) >= length, F.concat(end, F.substring(path, 1, length))))
    return F.array_distinct(F.filter(F.array(*keys), F.isnotnull)) if keys else F.array().cast("array<string>")


def judge(df: DataFrame, allow: list[str], block: list[str], url: str = "url") -> DataFrame:
    """``df`` with host, path, rule (the longest that fits, else null) and verdict (allow or block)."""
    spark = df.sparkSession
    host, path = host_and_path(col(url))
    own = replaced(df, host=host, path=path)
    own = own.withColumn("__keys", candidates(F.col("host"), F.col("path"), [*allow, *block]))
    universe = own.select(F.explode("__keys").alias("key"))
    held = {}
    for name, rules in (("allow", allow), ("block", block)):
        held[name] = cascade(spark.createDataFrame([(r,) for r in rules], "key string"), universe)
    listed = F.filter("__keys", lambda k: held["allow"].holds(k) | held["block"].holds(k))
    best = F.array_max(F.transform(listed, lambda k: F.struct(F.length(k).alias("length"), F.length(F.substring_index(k, "/", 1)).alias("of_host"), k.alias("key"))))
    ruled = own.withColumn("__rule", best["key"])
    verdict = F.when(held["block"].holds(F.col("__rule")), "block").otherwise("allow")
    return ruled.select(*others(ruled, ("rule", "verdict", "__rule", "__keys")), F.col("__rule").alias("rule"), verdict.alias("verdict"))
