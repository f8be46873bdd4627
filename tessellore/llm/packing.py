"""Filling fixed-capacity containers with documents by sum-of-squares packing.

Each item goes where the sum over all residual gaps of (number of open bins with that gap)^2 becomes
smallest; ties go to the tightest bin, a new bin is opened last. Items are packed in shards of a
bounded number of rows. Bins that stay open with too much room are dissolved and their items packed
again in fewer shards, level by level, until one shard is left, so no shard leaves its open bins
behind and no task sees more than one shard.

Only an item above the capacity is split: into pieces of exactly the capacity, which fill containers
of their own, and one rest that is packed like any item. Sizes are tokens of the byte-level
tokenizer (one per UTF-8 byte), so a piece is a range of bytes.

Defined results: a null or empty text has no tokens and comes out with a null container and size 0;
repeated ids are separate items; rows whose id is null are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellore.runtime import checkpoint, even_partitions, shards_for

CAPACITY = 8_192
SHARD_ITEMS = 16_384
NO_ID = -(2**63)

ITEM_SCHEMA = "doc_id bigint, piece int, start_token bigint, n_tokens int, pieces int"
PACKED_SCHEMA = ITEM_SCHEMA + ", container string, fill int"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, items being placed in the order given; all sizes in 1..capacity.

    With n(g) open bins of gap g, moving one from g to g-s changes the sum of squares by
    2(n(g-s) - n(g)) + 2; gap 0 (full) and the whole capacity (unopened) don't count.
    """
    open_bins = np.zeros(capacity + 1, dtype=np.int64)  # by gap; [0] and [capacity] stay 0
    stacks: dict[int, list[int]] = {}
    bins = np.empty(len(sizes), dtype=np.int64)
    opened = 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(sizes):
        here = open_bins[size:capacity]
        place = never
        if here.size:
            cost = np.where(here > 0, 2 * (open_bins[: capacity - size] - here) + 2, never)
            if here[0]:
                cost[0] = 1 - 2 * here[0]  # the bin becomes full
            at = int(cost.argmin())  # the first of equals is the tightest
            place = cost[at]
        fresh = 2 * open_bins[capacity - size] + 1 if size < capacity else 0
        if place <= fresh and place != never:
            gap = at + int(size)
            target = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, target, opened = capacity, opened, opened + 1
        rest = gap - int(size)
        if rest:
            open_bins[rest] += 1
            stacks.setdefault(rest, []).append(target)
        bins[i] = target
    return bins


def _pack_shard(level: int, capacity: int):
    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = batch["n_tokens"].to_numpy()
        bins = sum_of_squares(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int32)
        shard = int(batch["shard"].iloc[0])
        return pd.DataFrame({
            **{c: batch[c].to_numpy() for c in ("doc_id", "piece", "start_token", "n_tokens", "pieces")},
            "container": [f"{level}-{shard}-{b}" for b in bins],
            "fill": fill[bins],
        })

    return pack


def items_of(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """The items of the documents: one per document, several where the text exceeds the capacity."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint")
    sized = df.select(F.col(id_col).cast("bigint").alias("doc_id"), size.alias("size"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    return (
        sized.select("doc_id", "size", pieces.alias("pieces"))
        .select("doc_id", "size", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece").cast("bigint") * capacity).alias("start_token"),
            F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("piece").cast("bigint") * capacity).cast("int").alias("n_tokens"),
            "pieces",
        )
    )


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    shard_items: int = SHARD_ITEMS,
    slack: float = 1 / 256,
) -> DataFrame:
    """Every item with its container and how full that is.

    ``shard_items`` bounds a task's rows; bins with more than ``slack`` of their room unused are
    packed again at the next level.
    """
    items = items_of(df, id_col, text_col, capacity)
    nothing = items.filter(F.col("n_tokens") == 0).select("*", F.lit(None).cast("string").alias("container"), F.lit(0).alias("fill"))
    whole = items.filter(F.col("n_tokens") == capacity).select(
        "*", F.concat(F.lit("full-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-"), F.col("piece"), F.lit("-"), F.monotonically_increasing_id()).alias("container"), F.lit(capacity).alias("fill")
    )
    rest = items.filter(F.col("n_tokens").between(1, capacity - 1))
    parts = [nothing, checkpoint(whole)]  # its containers are named once
    left, level, shards_before = df.count(), 0, 0
    while True:
        shards = shards_for(left, shard_items)
        if level and shards >= shards_before:  # no shard got rid of its items: these bins are final
            parts.append(rest.select(*(x.split()[0] for x in ITEM_SCHEMA.split(", ")), "container", "fill"))
            break
        apart = F.col("container") if level else F.monotonically_increasing_id()  # spreads rows alike in id and size
        shard = F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", apart), F.lit(shards)).cast("int")
        # a null id would turn the whole column into floats on its way through pandas
        sent = rest.withColumn("shard", shard).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
        # few bytes but much work: a fixed number of partitions, which are not merged
        sent = sent.repartition(even_partitions(df.sparkSession.range(shards).select(F.col("id").cast("int")), shards), "shard")
        packed = sent.groupBy("shard").applyInPandas(_pack_shard(level, capacity), PACKED_SCHEMA)
        packed = checkpoint(packed.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))))
        if shards == 1:
            parts.append(packed)
            break
        done = F.col("fill") >= capacity * (1 - slack)
        parts.append(packed.filter(done))
        rest = packed.filter(~done)
        left, level, shards_before = rest.count(), level + 1, shards
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """How many containers there are, the least possible number, and the share of room used."""
    bins = packed.filter(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return bins.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.ceil(F.sum("tokens") / capacity), F.lit(0)).alias("least_containers"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"),
        F.coalesce(F.round(F.sum("tokens") / (F.count("*") * capacity), 4), F.lit(0.0)).alias("used_share"),
    )


def split_documents(packed: DataFrame) -> DataFrame:
    """The documents that had to be split over containers."""
    return packed.filter(F.col("piece") == 1).select("doc_id")

