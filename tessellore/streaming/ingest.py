"""New page records as they arrive: each micro-batch is filtered, deduplicated against the store and added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellore.operators import records


def stored_hashes(spark: SparkSession, store: str, except_batch: int) -> DataFrame | None:
    """The hashes of the bodies in the store, without those of one batch; None while there is no store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.parquet(store)
    return rows.filter((F.col("batch") != except_batch) & F.col("body_md").rlike(r"\S")).select("body_hash").distinct()


def add_batch(batch: DataFrame, store: str, batch_id: int = 0) -> None:
    """Add the records whose body the store doesn't have; blank bodies are always kept.

    A batch has a folder of its own, which a replay of the batch replaces: nothing is added twice.
    """
    fresh = records.deduplicated(records.indexable(batch))
    known = stored_hashes(batch.sparkSession, store, batch_id)
    if known is not None:
        fresh = fresh.join(known, "body_hash", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")


def ingest(spark: SparkSession, folder: str, store: str, state: str, schema) -> StreamingQuery:
    """Process all files that are in ``folder`` now, once; ``state`` remembers them for the next call."""
    incoming = spark.readStream.schema(schema).parquet(folder)
    return incoming.writeStream.foreachBatch(lambda batch, number: add_batch(batch, store, number)).option("checkpointLocation", state).trigger(availableNow=True).start()


def manifest_windows(manifest: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Fetches per day and outcome; works on a stream, where rows later than ``late`` are left out, and on a table."""
    timed = manifest.withColumn("at", F.col("fetched_at").cast("timestamp")).withWatermark("at", late)
    counted = records.manifest_status(timed).groupBy(F.window("at", width), "outcome").agg(F.count("*").alias("fetches"))
    return counted.select(F.col("window.start").alias("day"), "outcome", "fetches")
