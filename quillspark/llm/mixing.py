"""Mixing sources to target weights, with DataFrame operations only.

1. Every source's words form one stream: documents stand one after another in a fixed
   pseudorandom order, and the stream is cut into blocks of ``block_words`` words.
2. The mix is a row of slots in output shards of equal size.  Each shard draws its source
   counts from a multinomial distribution: every slot draws its source (alias method).  Shards
   are drawn in three phases (5/6 of them, 5/6 of those left, the rest); a phase's probabilities
   are what the sources still need, so that later ones make up for the chance in earlier ones.
3. The k-th slot of a source takes block ``permutation(k mod blocks)`` of pass
   ``k div blocks``; the permutation is a swap-or-not shuffle of the source's block indexes,
   another one for each pass, so that no block is taken once more before all are taken.
4. Block counts join the documents' pieces by (source, block index).

Targets: sources in code point order, null last, get the repeating weights; together they
share all words; a target stops at ``max_epochs`` times its source's size and the excess is
shared again by weight.  A source never gets more than ``max_epochs`` passes.

The list of sources is configuration-sized (each has a weight): it is collected, and more
than ``MAX_SOURCES`` raise an error before anything is mixed.  All other steps are keyed
by hash buckets or block indexes, so a source with a third of all rows spreads out.

Defined cases: a null or blank text has size 0 and takes 0; a null source is a source of
its own; sources of size 0 have target 0; repeated rows and null ids keep one result row
each; extra columns are ignored; an empty table gives an empty result.  All draws are
hashes of fixed seeds: reruns agree.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed_prefix, small_table, taken_rows, text_hash, written

WEIGHTS = (5, 2, 1)
MAX_SOURCES = 100_000
#: Slots of a shard: the 64th part of the mix, within these limits.
SHARD_SLOTS = (16, 4096)
ROUNDS = 8
PHASES = 3
_SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """How many words a text has; each word with the space around it becomes one character first."""
    ones = F.regexp_replace(text, rf"[{_SPACE}]*[^{_SPACE}]+[{_SPACE}]*", ".")
    return F.when(text.rlike(rf"[^{_SPACE}]"), F.length(ones)).otherwise(0).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> list[float]:
    """Words wanted of each source: shares by weight, cut at max_epochs times the size, the excess shared again.

    Sources that are full first come first: those of least size for their weight.
    """
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    left, total, out = Fraction(sum(sizes)), sum(s for s, n in zip(share, sizes, strict=True) if n > 0), [0.0] * len(sizes)
    for i in sorted((i for i, n in enumerate(sizes) if n > 0), key=lambda i: (Fraction(sizes[i], share[i]), i)):
        own = min(left * share[i] / total, Fraction(max_epochs * sizes[i]))
        out[i], left, total = float(own), left - own, total - share[i]
    return out


def alias_table(p: list[float]) -> tuple[list[float], list[int]]:
    """Walker's alias method: a cell is kept with its probability, else its alias is taken."""
    n = len(p)
    scaled, keep, other = [x * n for x in p], [1.0] * n, list(range(n))
    small, large = [i for i in range(n) if scaled[i] < 1], [i for i in range(n) if scaled[i] >= 1]
    while small and large:
        a, b = small.pop(), large[-1]
        keep[a], other[a] = scaled[a], b
        scaled[b] -= 1 - scaled[a]
        if scaled[b] < 1:
            small.append(large.pop())
    return keep, other


def permuted(pos: Column, n: Column, *seed: Column) -> Column:
    """A swap-or-not shuffle of 0 .. n-1: in each round, pos and key - pos change places or not, by a hash of the pair."""

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(11), r, *seed), n) - x, n)
        return F.when(F.xxhash64(F.lit(12), r, F.greatest(x, mirror), *seed).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), pos, swap)


def drawn(spark: SparkSession, need: list[float], seed: int) -> DataFrame:
    """sidx, shard and n: each shard's source counts, from one draw a slot."""
    total, least = round(sum(need)), SHARD_SLOTS
    size = max(least[0], min(least[1], total // 64))
    unit = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rest, begin = list(need), 0
    counts = spark.range(0).selectExpr("0 sidx", "id shard", "id n")
    for phase in range(PHASES):
        left = total - begin
        slots = left if phase == PHASES - 1 else left * 5 // 6 // size * size
        if not slots or not sum(rest):
            continue
        keep, other = alias_table([x / sum(rest) for x in rest])
        table = small_table(spark, "cell int, keep double, other int", list(zip(range(len(keep)), keep, other, strict=True)))
        cell = F.least(F.floor(unit(1) * len(keep)).cast("int"), F.lit(len(keep) - 1))
        slot = spark.range(begin, begin + slots, numPartitions=-(-slots // 50_000)).withColumn("cell", cell)
        picked = F.when(unit(2) < F.col("keep"), F.col("cell")).otherwise(F.col("other"))
        named = slot.join(F.broadcast(table), "cell").select(picked.alias("sidx"), F.expr(f"id div {size}").alias("shard"))  # at most MAX_SOURCES cells
        part = written(named.groupBy("sidx", "shard").agg(F.count("*").alias("n")), "mix-draws")
        for r in part.groupBy("sidx").agg(F.sum("n").alias("n")).collect():  # at most MAX_SOURCES rows
            rest[r.sidx] = max(0.0, rest[r.sidx] - r.n)
        counts, begin = counts.unionByName(part), begin + slots
    return counts


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, block_words: int = 64, seed: int = 2024) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target and taken of every document."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), text_hash(text).alias("text_hash"))
    sized = written(sized, "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; weights are given for a list of sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, weights, max_epochs)
    blocks = [-(-n // block_words) for n in sizes]
    # slots that a source needs: its block holds size / blocks words on average
    need = [w * b / n if n else 0.0 for w, b, n in zip(wanted, blocks, sizes, strict=True)]
    root = lambda n: max(1, round(math.sqrt(n)))
    listed = "_source string, sidx int, source_size bigint, target double, _blocks bigint, _buckets bigint"
    rows = [(r.source, i, sizes[i], wanted[i], blocks[i], root(r.n)) for i, r in enumerate(found)]
    sources = F.broadcast(small_table(spark, listed, rows))  # at most MAX_SOURCES rows

    # ordinals of the slots within their source; slots are dealt evenly before each becomes a row
    counts = drawn(spark, need, seed)
    shards = counts.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] + 1
    counts = bucketed_prefix(counts, ["sidx"], ["shard"], "n", "first", F.lit(root(shards)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-round(sum(need)) // 250_000))
    dealt = counts.join(sources.select(F.col("sidx").alias("_s"), "_blocks"), F.col("sidx") == F.col("_s")).repartition(tasks, "sidx", "shard")
    slots = dealt.select("sidx", "_blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))
    slots = slots.where(F.col("k") < max_epochs * F.col("_blocks"))
    epoch, pos = F.expr("k div _blocks"), F.expr("k % _blocks")
    taken = slots.select("sidx", permuted(pos, F.col("_blocks"), F.lit(seed), F.col("sidx"), epoch).alias("block")).groupBy("sidx", "block").agg(F.count("*").alias("times"))

    # documents to blocks
    named = sized.join(sources.drop("_blocks"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = bucketed_prefix(named, ["sidx"], ["doc_id", "text_hash", "size"], "size", "start", F.col("_buckets"))
    span = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    shown = ["doc_id", "source", "text_hash", "size", "source_size", "target"]
    pieces = placed.where("size > 0").select(*shown, "sidx", "_bucket", "_seq", "start", F.explode(span).alias("block"))
    overlap = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size")) - F.greatest(F.col("block") * block_words, F.col("start"))
    joined = pieces.join(taken.hint("merge"), ["sidx", "block"], "left").groupBy("sidx", "_bucket", "_seq", *shown).agg(F.sum(overlap * F.coalesce("times", F.lit(0))).alias("taken"))
    return joined.select(*shown, "taken").unionByName(placed.where("size = 0").select(*shown, F.lit(0).cast("long").alias("taken")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, block_words: int = 64, seed: int = 2024) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mixed(docs, weights, max_epochs, block_words, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, seed: int = 77, **options) -> DataFrame:
    """The rows of docs, all columns as they are, each as often as the mix takes it: whole passes, and one more by chance for a part of a pass."""
    found = mixed(docs, **options)
    passes = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0)
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.floor(passes) + (chance < passes - F.floor(passes)).cast("long")
    wanted = found.groupBy("doc_id", "source", "text_hash").agg(F.sum(times).alias("times"), F.count("*").alias("rows")).where("times > 0")
    keys = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "text_hash": text_hash(F.col("text"))}
    return taken_rows(docs, keys, wanted)
