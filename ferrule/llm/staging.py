"""Tables written in the folder that driver and executors share, to cut lineage, and joins by the measured size of a side.

A staged table survives lost executors, and its rows keep the ids they were given.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that may be broadcast (under 20 MB); more are joined by a shuffle.
MAX_BROADCAST = 200_000
_staged: dict[str, dict[str, None]] = {}  # by application, in the order of writing


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset (tests, one machine), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ferrule-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def text_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to 1000 rows: of whole texts, 10,000 rows can be hundreds of MB in the JVM and again in Python."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back."""
    path = f"{shared_dir(df.sparkSession)}/ferrule/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    _staged.setdefault(df.sparkSession.sparkContext.applicationId, {})[path] = None
    return staged


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unstage(staged: DataFrame) -> None:
    """Delete what `stage` wrote; nothing may read it any more."""
    _delete(staged.sparkSession, staged.staged_at)
    _staged.get(staged.sparkSession.sparkContext.applicationId, {}).pop(staged.staged_at, None)


def sweep(spark: SparkSession) -> int:
    """Delete all that this application has staged, and tell how many tables that was. Results that were not written elsewhere can't be read afterwards."""
    paths = _staged.pop(spark.sparkContext.applicationId, {})
    for path in paths:
        _delete(spark, path)
    return len(paths)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A df of a few numbers a row, to be broadcast if it has MAX_BROADCAST rows at most."""
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def keep_rows(docs: DataFrame, doc_id: Column, key: Column, judged: DataFrame) -> DataFrame:
    """The rows of docs to be kept. judged has a row for each: id and key (as the two columns give them), keep, and always.

    Of rows with the same id and key, which are copies of each other, all stay if they're judged `always`, else one if any is to be kept. Only ids and keys of
    dropped and repeated rows are joined with docs, by a broadcast if they are MAX_BROADCAST at most.
    """
    groups = judged.groupBy("id", "key").agg(F.max("keep").alias("keep"), F.max("always").alias("always"), F.count(F.lit(1)).alias("n"))
    odd = stage(groups.where("not always and (not keep or n > 1)").select(F.col("id").alias("_i"), F.col("key").alias("_k"), F.col("keep").alias("_keep")), "odd")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), doc_id.alias("_own"), key.alias("_key"))
    marked = named.join(bounded(odd, odd.count()), F.col("_own").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    out = marked.where("_keep is null").select("_whole.*")
    if odd.where("_keep").isEmpty():
        return out
    one = marked.where("_keep").groupBy("_own", "_key").agg(F.min_by("_whole", F.xxhash64("_whole")).alias("_whole"))
    return out.unionByName(one.select("_whole.*"))
