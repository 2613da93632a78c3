"""Popularity of a growing watch list: new files of user:repo lines are read as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watches(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_at_once).text(folder)
    parts = F.split("value", ":")
    return lines.select(parts[0].try_cast("long").alias("user_id"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("repo_id"))


def popularity(stream: DataFrame) -> DataFrame:
    """repo_id and n_watchers so far; a watch counts once however often it comes. For the output modes complete and update."""
    return stream.where("user_id is not null and repo_id is not null").dropDuplicates(["user_id", "repo_id"]).groupBy("repo_id").agg(F.count("*").alias("n_watchers"))
