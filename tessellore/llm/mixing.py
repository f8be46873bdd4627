"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mixture takes the golden-ratio point frac(i * 0.618...) and finds its source in the
cumulative weights; within its source a slot is ranked by position. Each source's documents are
shuffled by a hash, once per repetition, laid end to end and cut into blocks of equal tokens by
prefix sums; block k of a source is joined to its slot of rank k. There are as many slots as blocks and
a few more; a block for which the points gave its source no slot (the last ones of a source, all of a
tiny one) goes to the slot that is evenly spaced for its rank. So every stretch of the mixture holds its
sources in nearly their shares, and no block is lost.

A source gets ``target_share`` of ``total_tokens`` (by default the tokens of all rows whose source
is in the targets), but no more than ``max_repeats`` times its own tokens; `report` shows the
shares reached.

No window runs over a whole source: prefix sums and ranks are taken in buckets of bounded size and
the buckets' sums are summed up by themselves.

Defined results: sources are compared trimmed, in lower case, with ``-`` as ``_``; rows whose source
is null or has no target don't take part; a null or empty text has no tokens and is left out of the
mixture; a target without rows is reported with zero tokens; targets that are null, or repeated
after normalising, are invalid and raise. Equal ids are separate documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellore.runtime import checkpoint, strip

BLOCK_TOKENS = 8_192
BUCKET_TOKENS = 32 * 1024 * 1024
SLOT_CHUNK = 65_536
MOST_TARGETS = 10_000
GOLDEN = (math.sqrt(5) - 1) / 2


def normal_source(column: Column) -> Column:
    """The form in which sources are compared."""
    return F.replace(F.lower(strip(column)), F.lit("-"), F.lit("_"))


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    repeats: int
    tokens: int
    allotted: int
    buckets: int


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The targets on the driver; their number is checked, as one source is one plan constant."""
    rows = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} mixing targets")
    if any(x is None for r in rows for x in r) or len({r["source"] for r in rows}) < len(rows):
        raise ValueError("mixing targets must be complete and name each source once")
    return {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in rows}


def _sized(df: DataFrame, names: list[str], id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        normal_source(F.col(source_col)).alias("source"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("n_tokens"),
    )
    return sized.filter(F.col("source").isin(names)) if names else sized.limit(0)


def allot(df: DataFrame, targets: DataFrame, total_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Source]:
    """What each source can and shall give; one aggregation over the documents' sizes."""
    wanted = _targets(targets)
    sums = {r["source"]: int(r["t"]) for r in _sized(df, list(wanted), id_col, text_col, source_col).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total = sum(sums.values()) if total_tokens is None else total_tokens
    out = []
    for name, (share, repeats) in sorted(wanted.items()):
        own = sums.get(name, 0)
        out.append(Source(name, share, repeats, own, max(0, min(round(share * total), repeats * own)), 1 << max(0, math.ceil(math.log2(max(1, own / BUCKET_TOKENS))))))
    return out


def _by_source(sources: list[Source], value) -> Column:
    """A value of the row's source as one map look-up in the plan."""
    pairs = [F.lit(x) for s in sources for x in (s.name, value(s))]
    return F.element_at(F.create_map(*pairs), F.col("source"))


def blocks(df: DataFrame, sources: list[Source], block_tokens: int = BLOCK_TOKENS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents used, each with its source's block: shuffled, repeated, cut by prefix sums."""
    used = [s for s in sources if s.allotted > 0]
    rows = _sized(df, [s.name for s in used], id_col, text_col, source_col).filter(F.col("n_tokens") > 0)
    if not used:
        return rows.select("*", F.lit(0).alias("repetition"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("block"))
    passes = _by_source(used, lambda s: math.ceil(s.allotted / s.tokens))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("repetition", F.explode(F.sequence(F.lit(0), passes - 1)))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "n_tokens", "repetition", F.lit(seed)))
    per_pass = _by_source(used, lambda s: s.buckets)
    bits = _by_source(used, lambda s: 64 - int(math.log2(s.buckets)))
    within = F.when(per_pass == 1, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", F.col("hash"), F.least(bits, F.lit(63))))
    rows = checkpoint(rows.withColumn("bucket", F.col("repetition") * per_pass.cast("bigint") + within))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("own"))
    before = sums.select("source", "bucket", (F.sum("own").over(W.partitionBy("source").orderBy("bucket")) - F.col("own")).alias("before"))
    inside = W.partitionBy("source", "bucket").orderBy("hash", "doc_id", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, ["source", "bucket"])
    start = F.col("before") + F.col("upto") - F.col("n_tokens")
    return (
        placed.withColumn("start_token", start)
        .filter(F.col("start_token") < _by_source(used, lambda s: s.allotted))
        .withColumn("block", F.floor(F.col("start_token") / block_tokens).cast("bigint"))
        .select("doc_id", "source", "n_tokens", "repetition", "start_token", "block")
    )


def slots_for(sources: list[Source], block_tokens: int = BLOCK_TOKENS) -> int:
    """The number of slots: one for each block, and room for the discrepancy of the points."""
    need = sum(math.ceil(s.allotted / block_tokens) for s in sources)
    return need + math.ceil(4 * math.log2(need + 2)) if need else 0


def schedule(sources: list[Source], spark, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The slots of the mixture: position, source, and the rank of the slot in its source."""
    used = [s for s in sources if s.allotted > 0]
    total = sum(s.allotted for s in used)
    if not used:
        return spark.range(0).select(F.col("id").alias("slot"), F.lit("").alias("source"), F.col("id").alias("block"))
    slots = slots_for(sources, block_tokens)
    point = F.col("slot") * F.lit(GOLDEN)
    point = point - F.floor(point)
    chosen, cumulative = F.lit(used[-1].name), total - used[-1].allotted
    for s in reversed(used[:-1]):
        chosen = F.when(point < F.lit(cumulative / total), F.lit(s.name)).otherwise(chosen)
        cumulative -= s.allotted
    drawn = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / SLOT_CHUNK).cast("bigint").alias("chunk")).withColumn("source", chosen)
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("own"))
    before = counts.select("source", "chunk", (F.sum("own").over(W.partitionBy("source").orderBy("chunk")) - F.col("own")).alias("before"))
    inside = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot"))
    return drawn.withColumn("inside", inside).join(before, ["source", "chunk"]).select("slot", "source", (F.col("before") + F.col("inside") - 1).alias("block"))


def mix(df: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, list[Source]]:
    """The mixture in slots (order by ``slot``, ``start_token``) and what was allotted to each source."""
    sources = allot(df, targets, total_tokens, id_col, text_col, source_col)
    parts = blocks(df, sources, block_tokens, seed, id_col, text_col, source_col)
    placed = parts.join(schedule(sources, df.sparkSession, block_tokens), ["source", "block"], "left")
    if used := [s for s in sources if s.allotted > 0]:
        even = F.floor((F.col("block") + 0.5) * slots_for(sources, block_tokens) / _by_source(used, lambda s: math.ceil(s.allotted / block_tokens)))
        placed = placed.withColumn("slot", F.coalesce("slot", even.cast("bigint")))
    return placed.select("slot", "source", "block", "start_token", "doc_id", "repetition", "n_tokens"), sources


def short_sources(reported: DataFrame) -> DataFrame:
    """The sources whose rows were all used as often as allowed without reaching their share."""
    return reported.filter(F.col("is_short") & (F.col("actual_tokens") == F.col("allotted_tokens"))).select("source")


def report(mixture: DataFrame, sources: list[Source]) -> DataFrame:
    """Target and reached shares of each source, and whether its repetitions fall short of the target.

    ``actual_share`` is taken of the tokens mixed, ``reached_share`` of those asked for.
    """
    total = sum(s.tokens for s in sources)
    asked = max((s.allotted / s.share for s in sources if s.share > 0 and s.allotted < s.repeats * s.tokens), default=total)
    rows = [(s.name, s.share, s.repeats, s.tokens, s.allotted, bool(s.repeats * s.tokens < s.share * total)) for s in sources]
    spark = mixture.sparkSession
    wanted = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, own_tokens bigint, allotted_tokens bigint, is_short boolean")
    drawn = mixture.groupBy("source").agg(F.sum("n_tokens").alias("actual_tokens"), F.max("repetition").alias("last"), F.count("*").alias("documents"))
    joined = wanted.join(drawn, "source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0).cast("bigint")))
    everything = F.sum("actual_tokens").over(W.partitionBy())  # over one row per target
    return joined.select(
        "source",
        "target_share",
        "max_repeats",
        "own_tokens",
        "allotted_tokens",
        "actual_tokens",
        F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"),
        F.coalesce(F.col("last") + 1, F.lit(0)).alias("repeats_used"),
        F.coalesce(F.round(F.try_divide(F.col("actual_tokens"), everything), 6), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.round(F.try_divide(F.col("actual_tokens"), F.lit(float(asked))), 6), F.lit(0.0)).alias("reached_share"),
        "is_short",
    )
