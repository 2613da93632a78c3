"""What the training-data operators share: written cuts of the lineage, Arrow maps, the memory of workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.materialize import new_path
from orrery.plans.materialize import written as cut
from orrery.plans.ship import ship

__all__ = ["arrow_map", "claim", "cut", "new_path", "ship", "table", "text_or_empty"]

#: Rows that are worked on at a time.
BATCH_ROWS = 128


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One record batch in, one out, of few rows at a time, since a text may have megabytes; Spark bounds the bytes of a batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                yield fn(b.slice(at, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


_CACHES: dict[str, dict] = {}


def claim(name: str, cache: dict) -> dict:
    """cache, after the caches of other operators in this worker were emptied: a worker that is used
    again for another stage doesn't hold what the stage before remembered."""
    for other, held in _CACHES.items():
        if other != name:
            held.clear()
    _CACHES[name] = cache
    return cache


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
