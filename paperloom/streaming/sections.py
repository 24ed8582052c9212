"""An extension: section leaves kept up to date over arriving pages."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.mutate import upserted
from paperloom.operators.sections import leaf_ranges
from paperloom.schema import TABLES


def _snapshots(folder: str) -> list[str]:
    return sorted(x for x in os.listdir(folder) if x.startswith("v")) if os.path.isdir(folder) else []


def latest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest snapshot of a table that is written as numbered folders."""
    found = _snapshots(folder)
    return spark.read.parquet(os.path.join(folder, found[-1])) if found else spark.createDataFrame([], schema)


def _write(df: DataFrame, folder: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(os.path.join(folder, f"v{epoch:012d}-{uuid.uuid4().hex[:8]}"))


def keep_index(spark: SparkSession, incoming: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Reads page files as they arrive; each batch replaces the leaves of the papers it touches. A batch that is run again gives the same snapshot."""
    pages_at, leaves_at = os.path.join(folder, "pages"), os.path.join(folder, "leaves")
    leaf_schema = "paper_id string, leaf_no int, start_page int, end_page int, semantic boolean"

    def apply(batch: DataFrame, epoch: int) -> None:
        pages = upserted(latest(spark, pages_at, TABLES["paper_pages"]), batch.dropDuplicates(["paper_id", "page_no"]), ["paper_id", "page_no"])
        _write(pages, pages_at, epoch)
        touched = batch.select("paper_id").distinct()
        now = latest(spark, pages_at, TABLES["paper_pages"]).join(touched, "paper_id", "left_semi")
        kept = latest(spark, leaves_at, leaf_schema).join(touched, "paper_id", "left_anti")
        _write(kept.unionByName(leaf_ranges(now)), leaves_at, epoch)

    stream = spark.readStream.schema(TABLES["paper_pages"]).parquet(incoming)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
