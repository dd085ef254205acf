"""Incremental intake: new Parquet rows or files as a stream, each handled once per checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainfold.functions import paths
from grainfold.operators import intake


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, relative_path, data) of the files that arrive below a folder; hidden names don't."""
    found = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    return found.select(name.alias("path"), F.substring(name, F.lit(len(folder.rstrip("/")) + 2), F.char_length(name)).alias("relative_path"), F.col("content").alias("data"))


def classified_stream(files: DataFrame) -> DataFrame:
    return files.withColumn("c", intake.classified(F.col("relative_path"))).select("path", "relative_path", "data", "c.*")


def link_counts(links: DataFrame, late: str = "30 days", window: str = "30 days") -> DataFrame:
    """(from, to_concept_id, n) of incoming links per window of ``seen_at``; rows later than ``late`` are dropped by the watermark."""
    target = F.coalesce(paths.concept_of_link(F.col("to_concept_id"), paths.directory(F.col("from_concept_id"))), "to_concept_id")
    per = links.withWatermark("seen_at", late).groupBy(F.window("seen_at", window), target.alias("to_concept_id")).agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").alias("start"), "to_concept_id", "n")


def run_once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handle all that has arrived since the last call, then stop."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
