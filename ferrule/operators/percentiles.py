"""Exact percentiles of any group size: no task sorts or holds a group.

Each wanted place of each group is narrowed down by histograms: its range of values is cut into BINS bins, one aggregation counts all groups' bins at once, and the bin that holds the place
is the next range, from its least value to its greatest. Once a range holds SMALL values or fewer, or one value alone, its values are counted and the place is read off. A bin's least and greatest
values fall into different bins of the next round, so every round makes progress.

Cases: nulls are left out, a group without values has null results; a null group is a group; NaN sorts last, as in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.sources.store import shared_path

BINS, SMALL = 1024, 100_000
MAX_BROADCAST = 200_000


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def values_at(df: DataFrame, by: str, value: str, places: dict[str, str], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """by and, for each name, the group's value at a place from 0 in sorted order, given as SQL of the group's number of values n."""
    rows = df.select(F.col(by).alias("g"), F.col(value).alias("v")).where("v is not null")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(place).cast("long").alias("k")) for name, place in places.items()]))
    open_ = _kept(sizes.select("g", "n", "lo", "hi", F.lit(0).cast("long").alias("below"), wanted.alias("x")).select("g", "n", "lo", "hi", "below", "x.*"), "places")
    while not open_.where(F.col("n") > small).where("lo <> hi").isEmpty():
        wide = open_.where((F.col("n") > small) & (F.col("lo") != F.col("hi")))
        inside = _meet(rows, wide)
        # a range of doubles may overflow: halves of its ends do not
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bin_ = F.when(F.isnan(F.col("v").cast("double")), bins).otherwise(F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(bins - 1)))
        counted = inside.withColumn("bin", bin_).groupBy("g", "name", "k", "below", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("g", "name").orderBy("lo"))
        found = counted.withColumn("upto", F.col("below") + upto).where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
        narrowed = found.select("g", "n", "lo", "hi", (F.col("upto") - F.col("n")).alias("below"), "name", "k")
        done = open_.where((F.col("n") <= small) | (F.col("lo") == F.col("hi")))
        open_ = _kept(done.unionByName(narrowed), "places")
    one = open_.where("lo = hi").select("g", "name", F.col("lo").alias("v"))
    counted = _meet(rows, open_.where("lo <> hi")).groupBy("g", "name", "k", "below", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("g", "name").orderBy("v"))
    rest = counted.withColumn("upto", upto).where("upto > k and upto - n <= k").select("g", "name", "v")
    found = one.unionByName(rest).groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])
    return found.withColumnRenamed("g", by)


def _meet(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The values in each range."""
    ranges = ranges.select(F.col("g").alias("h"), "name", "k", "below", "lo", "hi")
    few = F.broadcast(ranges) if ranges.count() <= MAX_BROADCAST else ranges
    return rows.join(few, F.col("g").eqNullSafe(F.col("h")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """by and, for each name, the interpolated percentile at (n - 1) * share."""
    ends = {f"{name}_{side}": f"{way}((n - 1) * {share}D)" for name, share in shares.items() for side, way in (("a", "floor"), ("b", "ceil"))}
    at = values_at(df, by, value, {**ends}, small, bins)
    sizes = df.groupBy(by).agg(F.count(value).alias("n")).withColumnRenamed(by, "_g")
    both = sizes.join(at, F.col("_g").eqNullSafe(F.col(by)), "left")

    def mixed(name: str, share: float) -> Column:
        place = (F.col("n") - 1) * F.lit(share)
        part = place - F.floor(place)
        a, b = F.col(f"{name}_a").cast("double"), F.col(f"{name}_b").cast("double")
        return F.when(part == 0, a).otherwise(a + (b - a) * part).alias(name)

    return both.select(F.col("_g").alias(by), *[mixed(name, share) for name, share in shares.items()])
