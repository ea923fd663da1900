"""URL filters: host and path rules, and a Bloom filter cascade for a list of keys.

The cascade holds a list exactly, for all keys of the corpus: level 1 encodes the listed
keys, level 2 the corpus keys outside the list that level 1 takes for listed, level 3 the
listed keys that level 2 takes for unlisted, and so on until none is left.  A key of the
corpus is judged by the first level that rejects it, with no join to the list.

Built and asked with DataFrame operations only.  A level is an array of 64-bit words.
Where all levels of all shards together stay below ``literal_words`` words (8 MB by
default), they reach the scan as scalar values, with no join at all; beyond that, keys are
dealt to hash shards of ``SHARD_WORDS`` words each, and rows meet the row that holds all
levels of their shard in one join by shard number (never the list itself).

Defined cases: null urls and urls without ``://`` have empty host and path and match no
rule; their key is the empty string, as any other key; repeated rows keep one result row
each; extra columns are ignored; an empty table or an empty list gives verdicts ``allow``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_WORDS = 8192
LITERAL_WORDS = 1 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def first_rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


@dataclass
class Level:
    bits: int
    hashes: int
    words: DataFrame  # shard, words


def _position(level: int, hash_: int, key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1009 * level + hash_), key), F.lit(bits))


class Cascade:
    """Exact membership of corpus keys in a list."""

    def __init__(self, keys: DataFrame, literal_words: int = LITERAL_WORDS) -> None:
        """keys: distinct rows (key, listed) of all keys of the corpus."""
        keys = written(keys.select("key", "listed"), "url-keys")
        listed = keys.where("listed").select("key")
        others = keys.where("not listed").select("key")
        n = {r.listed: r.n for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        inside, outside = n.get(True, 0), n.get(False, 0)
        self.levels: list[Level] = []
        # about 8 bits a listed key at level 1, and 3 for all later levels
        self.shards = 1
        if inside * 12 / 64 > literal_words:
            self.shards = math.ceil(inside * 12 / 64 / SHARD_WORDS)
        members, rest, count = listed, others, inside
        while count:
            p = min(0.5, inside * math.sqrt(0.5) / max(1, outside)) if not self.levels else 0.5
            hashes = max(1, math.ceil(-math.log2(p)))
            bits = max(64, -(-math.ceil(hashes * count / self.shards / math.log(2)) // 64) * 64)
            self.levels.append(Level(bits, hashes, written(self._words(members, len(self.levels), hashes, bits), "url-level")))
            passed = self._asked(rest, len(self.levels) - 1, F.col("key")).where("_in").select("key")
            passed = written(passed, "url-false")
            members, rest = passed, members
            count = passed.count()

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(5), key), F.lit(self.shards)).cast("int")

    def _words(self, members: DataFrame, level: int, hashes: int, bits: int) -> DataFrame:
        """One row a shard: its bits as an array of words."""
        key = F.col("key")
        at = members.select(self._shard(key).alias("shard"), F.explode(F.array(*[_position(level, h, key, bits) for h in range(hashes)])).alias("at"))
        word = at.groupBy("shard", F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        lists = word.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("s"))
        # dense from sparse: runs of zeros before each word and after the last
        zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
        step = lambda x, i: F.concat(zeros(x.word - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("s", i - 1).word + 1)), F.array(x.bits))
        body = F.flatten(F.transform("s", step))
        return lists.select("shard", F.concat(body, zeros(F.lit(bits // 64) - F.size(body))).alias("words"))

    def _in(self, level: int, key: Column, words: Column) -> Column:
        """Whether the level takes the key for one of its own."""
        lv = self.levels[level]
        taken = F.lit(True)
        for h in range(lv.hashes):
            at = _position(level, h, key, lv.bits)
            taken = taken & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return F.coalesce(taken, F.lit(False))

    def _asked(self, rows: DataFrame, level: int, key: Column) -> DataFrame:
        """Adds ``_in``: what one level says."""
        if self.shards == 1:
            return rows.withColumn("_in", self._in(level, key, self.levels[level].words.select("words").scalar()))
        joined = rows.withColumn("_shard", self._shard(key)).join(self.levels[level].words.withColumnRenamed("words", "_words"), F.col("_shard") == F.col("shard"), "left")
        return joined.withColumn("_in", self._in(level, key, F.col("_words"))).drop("shard", "_shard", "_words")

    def judged(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        """Adds whether ``key`` is listed.  Exact for all keys that the cascade was built over.

        With shards, a shard's row holds the words of all levels, and rows meet it in one join.
        """
        n = len(self.levels)
        if self.shards == 1:
            words = [lv.words.select("words").scalar() for lv in self.levels]
        else:
            every = self.levels[0].words.select("shard", F.lit(0).alias("level"), "words")
            for i, lv in enumerate(self.levels[1:], 1):
                every = every.unionByName(lv.words.select("shard", F.lit(i).alias("level"), "words"))
            shards = every.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("level", "words"))).alias("_levels"))
            rows = rows.withColumn("_shard", self._shard(F.col(key))).join(shards, F.col("_shard") == F.col("shard"), "left").drop("shard", "_shard")
            words = [F.col("_levels")[i] for i in range(n)]
        found = F.lit(n % 2 == 1)
        for i in reversed(range(n)):
            found = F.when(~self._in(i, F.col(key), words[i]), F.lit(i % 2 == 1)).otherwise(found)
        return rows.withColumn(out, found).drop("_levels")


def judge_pages(pages: DataFrame, rules: list[Rule], listed, literal_words: int = LITERAL_WORDS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``listed(key)`` marks the keys (host and path) that the block list holds.
    """
    host, path = host_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))
    keys = rows.select("key").distinct().withColumn("listed", F.coalesce(listed(F.col("key")), F.lit(False)))
    rows = Cascade(keys, literal_words).judged(rows, "key", "_listed")
    rows = rows.withColumn("rule", first_rule(F.col("host"), F.col("path"), rules, lambda r: r.host + r.path))
    verdict = F.coalesce(first_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict), F.when(F.col("_listed"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
