"""Sources as a stream: new and changed files are parsed as they arrive, and tables hold the last state of every file.

A file's rows stand under the time of its last change; ``current`` gives those of the newest one.  A micro-batch that is run
again after a failure writes the same rows under its own number, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.parse import read_files


def source_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """id (of the path), path, text, changed: sources below a folder, each again when it changes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").option("maxFilesPerTrigger", per_trigger).load(root)
    return raw.select(F.abs(F.xxhash64("path") % F.lit(1 << 38)).alias("id"), "path", F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("changed"))


def watch(spark: SparkSession, root: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Parses what arrives into tables below ``out``; with ``once`` all that is there now, then it ends."""

    def take(batch: DataFrame, number: int) -> None:
        read = read_files(batch).join(batch.select("path", "changed"), "path")
        read.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = source_stream(spark, root).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The parsed rows of every file as it is now (as ``read_files`` gives them, and the time of its last change)."""
    newest = Window.partitionBy("path").orderBy(F.desc("changed"), F.desc("batch"))
    return spark.read.parquet(out).withColumn("r", F.row_number().over(newest)).filter("r = 1").drop("r", "batch")
