"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

Every source is a stream of words: its documents in the order of a seeded hash, cut into equal blocks (of BLOCK_WORDS, or fewer if the source
is small). A source's target in words gives its exact quota of block draws; draws take its blocks in the order of a permutation, pass after pass, and the last is cut to the word.
The tree deals all draws out among the output shards: a node's quotas, one for each source, are split between two
halves by conditional hypergeometric draws (inverse cumulative distribution, seeded), down to the leaves. A leaf's quotas are disjoint runs of
its sources' permuted draws; what a document gives to the mix is what of it lies in blocks of those runs, and each shard orders its own by a hash.
There are 16 shards, or more so that each has about SHARD_WORDS words.

Targets: each source's weight, as a share of all words, times the words of all sources; a target above `most` times its source's size
stops there and the excess is dealt out again by weight until none is above.

Cases: sizes count runs of bytes other than [\\x20\\x09-\\x0D] (null: 0); a null source is one of the sources, last in code-point
order; documents without words are never drawn (taken = 0); rows that repeat are each mixed, one after the other in the order;
equal hashes are ordered by size; an empty table gives an empty mix; extra columns are kept by `mix`. A row for each source is gathered in one task: sources are taken to be far fewer than documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.staging import stage

BUCKET_WORDS = 200_000
BLOCK_WORDS, LEAST_BLOCKS = 4096, 1024
SHARD_WORDS = 50_000_000
ROUNDS = 32


def word_count(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes: source, source_size. Adds the source's target; a fold over sources in order of size to weight, as those with the least reach their limit first."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * float(most))
    # Sources sorted by limit/weight: each in turn gets min(limit, its share of what is left); once one isn't limited, no later one is.
    one = weighed.groupBy().agg(F.array_sort(F.collect_list(F.struct((F.col("limit") / F.col("weight")).alias("at"), F.col("weight"), F.col("limit"), "source", "source_size"))).alias("s"), F.sum("source_size").cast("double").alias("words"), F.sum("weight").alias("weights"))

    def step(acc: Column, x: Column) -> Column:
        share = F.when(acc["weights"] > 1e-9, acc["left"] * x["weight"] / acc["weights"]).otherwise(F.lit(0.0))
        got = F.least(x["limit"], share)
        return F.struct((acc["left"] - got).alias("left"), (acc["weights"] - x["weight"]).alias("weights"), F.concat(acc["out"], F.array(F.struct(x["source"].alias("source"), x["source_size"].alias("source_size"), got.alias("target")))).alias("out"))

    empty = F.filter(F.transform("s", lambda x: F.struct(x["source"].alias("source"), x["source_size"].alias("source_size"), x["limit"].alias("target"))), lambda x: F.lit(False))
    done = one.where("words is not null").select(F.aggregate("s", F.struct(F.col("words").alias("left"), F.col("weights").alias("weights"), empty.alias("out")), step)["out"].alias("out"))
    return done.select(F.inline("out"))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.pmod(F.xxhash64(*keys), F.lit(2**52)) + 0.5) / float(2**52)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total`, of which `marked` are marked, are marked: the value at which the cumulative
    distribution passes u. Ratios of neighbouring probabilities give it, over 12 standard deviations either side of the mean."""
    lo, hi = F.greatest(F.lit(0), drawn + marked - total), F.least(drawn, marked)
    mean = F.floor(drawn.cast("double") * marked / F.greatest(total, F.lit(1)))
    spread = F.ceil(12 * F.sqrt(F.greatest(mean, F.lit(1)).cast("double")) + 12).cast("long")
    first, last = F.least(F.greatest(lo, mean - spread), hi), F.greatest(F.least(hi, mean + spread), lo)

    def climb(log: Column, k: Column) -> Column:
        """The logarithm of the next value's probability from this one's (the first counts as 0)."""
        up = (F.log((marked - k).cast("double")) + F.log((drawn - k).cast("double"))) - (F.log((k + 1).cast("double")) + F.log((total - marked - drawn + k + 1).cast("double")))
        return log + F.coalesce(up, F.lit(0.0))

    steps = F.when(last > first, F.sequence(first, last - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))

    def weigh(acc: Column, k: Column) -> Column:
        """sum: probabilities so far over that of the likeliest, whose logarithm is top."""
        here = climb(acc["log"], k)
        higher = here > acc["top"]
        return F.struct(here.alias("log"), F.greatest(acc["top"], here).alias("top"), F.when(higher, acc["sum"] * F.exp(acc["top"] - here) + 1).otherwise(acc["sum"] + F.exp(here - acc["top"])).alias("sum"))

    whole = F.aggregate(steps, F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum")), weigh)

    def pick(w: Column) -> Column:
        """Values at which the cumulative distribution hasn't yet passed u."""
        start = F.struct(F.lit(0.0).alias("log"), (F.exp(-w["top"]) / w["sum"]).alias("sum"), F.lit(0).cast("long").alias("n"))

        def on(acc: Column, k: Column) -> Column:
            here = climb(acc["log"], k)
            return F.struct(here.alias("log"), (acc["sum"] + F.exp(here - w["top"]) / w["sum"]).alias("sum"), (acc["n"] + F.when(acc["sum"] <= u, 1).otherwise(0)).alias("n"))

        return F.aggregate(steps, start, on)["n"]

    return first + F.get(F.transform(F.array(whole), pick), F.lit(0))


def _halve(level: int, seed: int) -> Callable[[Column, Column], Column]:
    """A fold's step: how many of a source's draws go to the left half, given what the sources before it have left."""

    def step(acc: Column, x: Column) -> Column:
        got = hypergeometric(acc["total"], x["n"], acc["left"], uniform(F.lit(seed), F.lit(level), acc["shard"], x["source"]))
        return F.struct((acc["total"] - x["n"]).alias("total"), (acc["left"] - got).alias("left"), acc["shard"].alias("shard"), F.concat(acc["out"], F.array(F.struct(x["source"].alias("source"), got.alias("n")))).alias("out"))

    return step


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: source (not null), draws. Splits them level by level; returns shard (2**levels of them), source, n, from (draws of the source in shards before)."""
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", F.col("draws").alias("n")))).alias("q")).withColumn("shard", F.lit(0).cast("long"))
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        start = F.struct(total.alias("total"), F.floor(total / 2).alias("left"), F.col("shard"), F.filter("q", lambda x: F.lit(False)).alias("out"))
        half = node.withColumn("l", F.aggregate("q", start, _halve(level, seed))["out"])
        rest = F.transform(F.arrays_zip("q", "l"), lambda z: F.struct(z["q"]["source"].alias("source"), (z["q"]["n"] - z["l"]["n"]).alias("n")))
        both = F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("l").alias("q")), F.struct((F.col("shard") * 2 + 1).alias("shard"), rest.alias("q"))))
        node = stage(half.select(both.alias("x")).select("x.*"), f"split-{level}")  # 2**level rows
    flat = node.select("shard", F.inline("q"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has `most` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1) -> DataFrame:
    """docs with _size (words), _key (the seeded hash that orders them) and _s (the source; never null)."""
    tagged = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))
    return docs.withColumns({"_size": word_count(F.col(text)), "_key": F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), "_s": tagged})


def aims(measured: DataFrame, source: str, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """A row for each source: _s, _source_size, _target, and its exact quota: its words in _blocks blocks of _width, which are drawn _quota times in all,
    _blocks draws a pass in the order of a permutation (see `position`), with the last _cut words of the last draw's block left out."""
    per_source = measured.groupBy("_s").agg(F.first(source).alias("source"), F.sum("_size").alias("source_size"))
    aimed = targets(per_source.select("source", "source_size"), weights, most)
    tagged = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = aimed.select(tagged.alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    size = F.greatest("_source_size", F.lit(1).cast("long"))
    rows = rows.withColumn("_width", F.least(F.lit(BLOCK_WORDS).cast("long"), F.ceil(size / LEAST_BLOCKS))).withColumn("_blocks", F.ceil(size / F.col("_width")))
    rows = rows.withColumn("_passes", F.floor(F.col("_target") / size)).withColumn("_rest", F.round(F.col("_target") - F.col("_passes") * size).cast("long"))
    # of the pass that isn't whole: the last of the blocks is `_short` words short, and has its place among the others
    rows = rows.withColumn("_short", F.col("_width") * F.col("_blocks") - size).withColumn("_at_short", position(F.col("_blocks") - 1, F.col("_blocks"), seed))
    part = F.when(F.col("_rest") <= F.col("_at_short") * F.col("_width"), F.ceil(F.col("_rest") / F.col("_width"))).otherwise(F.greatest(F.col("_at_short") + 1, F.ceil((F.col("_rest") + F.col("_short")) / F.col("_width"))))
    rows = rows.withColumn("_part", part).withColumn("_cut", F.col("_part") * F.col("_width") - F.when(F.col("_part") > F.col("_at_short"), F.col("_short")).otherwise(0) - F.col("_rest"))
    rows = rows.withColumn("_quota", F.when(F.col("_source_size") > 0, F.col("_passes") * F.col("_blocks") + F.col("_part")).otherwise(0))
    return stage(rows.select("_s", "_source_size", "_target", "_width", "_blocks", "_quota", "_cut"), "aims")


def position(block: Column, blocks: Column, seed: int) -> Column:
    """The place of a block in the order of drawing, a permutation of any number of blocks that depends on the seed.

    Swap or not: in each round a block and its partner, which add up to the round's number modulo `blocks`, change places or stay, as a hash of the greater of the two tells.
    """

    def swap(x: Column, k: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), k), blocks) - x, blocks)
        return F.when(F.xxhash64(F.lit(seed), k, F.greatest(x, partner)) < 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), block, swap)


def place(measured: DataFrame, aimed: DataFrame) -> DataFrame:
    """measured with the columns of its source's aims and _at: the words of its source that come before it in the source's order."""
    joined = measured.join(small(aimed), "_s")
    # The order's buckets are ranges of the key, so many that each holds about BUCKET_WORDS words of its source.
    buckets = F.greatest(F.ceil(F.col("_source_size") / BUCKET_WORDS), F.lit(1))
    keyed = joined.withColumn("_bucket", F.shiftright(F.shiftrightunsigned("_key", 33) * buckets, 31))
    sums = keyed.groupBy("_s", "_bucket").agg(F.sum("_size").alias("_words"))
    ahead = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_s", "_bucket", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_s", "_bucket").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    based = keyed.join(base, ["_s", "_bucket"])
    return based.withColumn("_at", F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).drop("_base", "_bucket")


def draws(measured: DataFrame, source: str = "source", seed: int = 1, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, whole: bool = False, levels: int | None = None) -> DataFrame:
    """A row for each drawn block of each document: measured's columns, its source's aims, _draw (its number among the source's draws), _block, _words (of the document, drawn with it) and _shard.

    What is drawn are the runs that the tree's leaves hold. A document that isn't drawn has one row with _words = 0. With `whole` documents aren't cut: each
    is in the block that holds its middle, and a row stands for a copy.
    """
    aimed = aims(measured, source, weights, most, seed)
    if levels is None:
        words = aimed.agg(F.sum("_target")).first()[0] or 0
        levels = max(4, int(words / SHARD_WORDS).bit_length())
    tree = split_tree(aimed.select(F.col("_s").alias("source"), F.col("_quota").alias("draws")), levels, seed)
    # a run is found by the cells of equal length, about as many as shards, over which it lies
    runs = tree.where("n > 0").join(aimed.select(F.col("_s").alias("source"), "_quota"), "source").withColumn("_cells", F.greatest(F.lit(1).cast("long"), F.expr(f"_quota div {2**levels}")))
    runs = stage(runs.select(F.col("source").alias("_s"), "shard", F.col("from").alias("_from"), (F.col("from") + F.col("n")).alias("_to"), F.explode(F.expr("sequence(from div _cells, (from + n - 1) div _cells)")).alias("_cell")), "runs")
    laid = place(measured, aimed)
    at, size = F.col("_at"), F.col("_size")
    if whole:
        laid = laid.withColumn("_block", F.expr("(_at + _size div 2) div _width"))
    else:
        laid = laid.withColumn("_block", F.explode(F.expr("sequence(_at div _width, (_at + greatest(_size, 1) - 1) div _width)")))
    place_of = position(F.col("_block"), F.col("_blocks"), seed)
    times = F.when((size > 0) & (place_of < F.col("_quota")), F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(_quota - 1) div _blocks")), lambda k: k * F.col("_blocks") + place_of))
    laid = laid.withColumn("_draw", F.explode_outer(F.filter(times, lambda d: d < F.col("_quota"))))
    # blocks that aren't drawn lie in no run; they're spread over cells that no run has
    laid = laid.withColumn("_cell", F.coalesce(F.expr(f"_draw div greatest(1, _quota div {2**levels})"), -1 - F.pmod(F.hash("_key", "_block"), F.lit(4096)).cast("long")))
    runs = runs.select(F.col("_s").alias("_rs"), F.col("_cell").alias("_rcell"), "_from", "_to", F.col("shard").alias("_shard"))
    dealt = laid.join(small(runs), (F.col("_s") == F.col("_rs")) & (F.col("_cell") == F.col("_rcell")) & (F.col("_draw") >= F.col("_from")) & (F.col("_draw") < F.col("_to")), "left")
    start = F.col("_block") * F.col("_width")
    end = F.least(start + F.col("_width"), F.col("_source_size")) - F.when(F.col("_draw") == F.col("_quota") - 1, F.col("_cut")).otherwise(0)
    part = F.when(at + F.expr("_size div 2") < end, size).otherwise(0) if whole else F.greatest(F.least(at + size, end) - F.greatest(at, start), F.lit(0))
    return dealt.withColumn("_words", F.when(F.col("_shard").isNull(), 0).otherwise(part).cast("long")).drop("_rs", "_rcell", "_from", "_to", "_cell", "_cut")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, **options) -> DataFrame:
    """The mixed corpus: docs' columns, a row for each copy of a whole document that is taken, dealt out by shard and in a shard's random order."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    measured = measure(named, "_id", "_text", "_source", seed).drop("_text")
    made = draws(measured, "_source", seed, whole=True, **options).where("_words > 0")
    order = F.xxhash64(F.lit(seed), F.col("_shard"), F.col("_key"), F.col("_draw"))
    return made.withColumn("_order", order).repartition("_shard", F.pmod("_order", F.lit(16))).sortWithinPartitions("_shard", "_order").select("_whole.*")
