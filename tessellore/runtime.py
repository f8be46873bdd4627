"""Session-level helpers shared by all operators: checkpoints, table access, sizing."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only where the setting is absent and all work is done on this machine;
    on a cluster, whose executors cannot see such a folder, a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessellore-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back: columns, and partitions, can be pruned then."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards_for(rows: int, rows_per_shard: int, at_least: int = 1) -> int:
    """How many shards hold ``rows`` rows at about ``rows_per_shard`` each."""
    return max(at_least, math.ceil(rows / rows_per_shard))


EVENLY = 1_000  # keys up to which the spread over partitions is looked at; more spread well by their number


def even_partitions(keys: DataFrame, count: int) -> int:
    """Over how many partitions, ``count`` to four times that, the hashes of ``count`` distinct keys spread most evenly.

    For keys that are few but mean much work each: two of them in one partition would take twice the time.
    """
    if count > EVENLY:
        return count
    tried = sorted({count + i * max(1, 3 * count // 50) for i in range(50)})
    numbers = keys.select(F.hash(*keys.columns).alias("hash"), F.explode(F.array(*(F.lit(n) for n in tried))).alias("n"))
    most = numbers.groupBy("n", F.pmod("hash", "n")).count().groupBy("n").agg(F.max("count").alias("most"))
    return most.orderBy("most", "n").first()["n"] if count else 1


#: Every character that counts as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(column: Column) -> Column:
    """Trim every kind of Unicode white space from both ends; looks at the ends only."""
    return F.btrim(column, F.lit(WHITE))


def is_blank(column: Column) -> Column:
    """True for null, empty and white-space-only strings."""
    return F.coalesce(strip(column) == "", F.lit(True))


def fits_in_broadcast(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than one row beyond that."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """Hint a broadcast for a side whose row count was checked, leave it alone beyond the bound."""
    return F.broadcast(df) if fits_in_broadcast(df, most_rows) else df
