"""Planned in the reference's design documents: reindexing on events, idempotent and eventually consistent.

Events come as files (a message broker's connector isn't on the class path); each batch keeps the latest version of each
document and merges it into the index. A batch that is run again gives the same index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia.sources.exchange import current_version, save_new_version

EVENTS = "statement_id BIGINT, version BIGINT, deleted BOOLEAN, content STRING"


def latest(events: DataFrame) -> DataFrame:
    """The event of the highest version of each statement; of equal versions, a deletion, then the largest content."""
    order = Window.partitionBy("statement_id").orderBy(F.desc("version"), F.desc(F.coalesce("deleted", F.lit(False))), F.desc("content"))
    return events.where("statement_id IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merged(index: DataFrame, events: DataFrame) -> DataFrame:
    """The index after the events; deletions stay as tombstones, so that late events of older versions change nothing."""
    return latest(index.unionByName(events.select(*index.columns)))


def visible(index: DataFrame) -> DataFrame:
    return index.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def start(spark: SparkSession, events_path: str, index_root: str, checkpoint: str) -> StreamingQuery:
    """Runs over all files that are there, then stops."""

    def apply(batch: DataFrame, _: int) -> None:
        try:
            index = current_version(spark, index_root)
        except Exception as e:  # no index yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            index = spark.createDataFrame([], EVENTS)
        save_new_version(merged(index, batch), index_root)

    stream = spark.readStream.schema(EVENTS).json(events_path)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
