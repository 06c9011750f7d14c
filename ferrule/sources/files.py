"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with the file each row came from."""
    return spark.read.schema(schema).json(path).withColumn("source_file", F.input_file_name())


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Job rows for files below a folder: path, length, job_id (8 hex digits). Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", F.left(F.md5("path"), F.lit(8)).alias("job_id"))


#: Extensions of files that are taken in.
TAKEN = ["pdf", "docx", "txt", "html", "htm", "md"]


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """`list_files` for the extensions in TAKEN, whatever their case."""
    return list_files(spark, path, "*.{" + ",".join(f"{e},{e.upper()}" for e in TAKEN) + "}")


def read_checked(spark: SparkSession, path: str, schema: str, corrupt: str = "corrupt") -> DataFrame:
    """JSON lines; a line that isn't what the schema says has nulls and itself in `corrupt`."""
    return spark.read.schema(f"{schema}, {corrupt} string").option("columnNameOfCorruptRecord", corrupt).json(path)


def write_reported(df: DataFrame, path: str, drops: dict[str, str]) -> DataFrame:
    """Writes the rows of df that no rule drops, as JSON lines, and returns the report: reason and rows (read, written, and each rule's).

    A row is counted under the first rule (SQL, by reason) that drops it. The counts come with the write itself; nothing is read twice.
    """
    reason = F.coalesce(*[F.when(F.coalesce(F.expr(rule), F.lit(False)), name) for name, rule in drops.items()], F.lit("written"))
    told = Observation()
    marked = df.withColumn("_reason", reason)
    counts = [F.count_if(F.col("_reason") == name).alias(name) for name in (*drops, "written")]
    marked.observe(told, F.count(F.lit(1)).alias("read"), *counts).where("_reason = 'written'").drop("_reason").write.mode("overwrite").json(path)
    return df.sparkSession.createDataFrame([(name, int(n)) for name, n in told.get.items()], "reason string, rows long")


def in_batches(df: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """df with batch: its number, from 0, among the batches of `size` rows into which each group falls in order. What is called once a batch then groups by (by, batch)."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(nth / size))


def flush_points(points: DataFrame, path: str) -> DataFrame:
    """Appends metric points (name, value, dimensions, ts) in one write, a folder a metric, and returns how many of each were written and their sum; a replay of the same day replaces it."""
    dated = points.withColumn("day", F.to_date("ts"))
    told = Observation()
    spark = points.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        dated.observe(told, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("name", "day").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    written = spark.read.parquet(path)
    return written.groupBy("name").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 4).alias("total")).withColumn("flushed", F.lit(int(told.get["n"])))
