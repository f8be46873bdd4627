"""Page records: filters, deduplication, routing, counters and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellore.functions import text as T
from tessellore.runtime import is_blank, strip

# Fixed values.
DROPPED_TYPE = "custompage"
SPARSE_CHARS = 200
SMOKE_CHARS = 500
ERROR_CHARS = 300
FINGERPRINT_BLOCK = 65_536
LOGIN_MARKS = ("<title>Login</title>", 'class="loginForm"')
PROPS = r'(?s)<script id="ssr-props"[^>]*>(.*?)</script>'


def indexable(records: DataFrame) -> DataFrame:
    """Without custom pages; records of unknown type stay."""
    return records.filter(~F.col("type").eqNullSafe(DROPPED_TYPE))


def copies_by_hash(records: DataFrame) -> DataFrame:
    """body_hash, apart and the survivor of each distinct body: an aggregate of keys that combines before the shuffle.

    Blank bodies are never copies of each other: they are kept apart by their own ids.
    """
    return _hashed(records).groupBy("body_hash", "apart").agg(F.min(F.struct(*_order_keys())).alias("best")).select("body_hash", "apart", F.col("best.page_id").alias("kept_id"))


def _order_keys() -> list[Column]:
    via, body, url = (F.coalesce(F.col(c), F.lit("")) for c in ("discovered_via", "body_md", "url"))
    return [(via != "sidebar").alias("other"), (-F.length(body)).alias("shorter"), url.alias("url"), F.col("page_id")]


def _hashed(records: DataFrame) -> DataFrame:
    return records.withColumn("body_hash", F.sha2(F.coalesce("body_md", F.lit("")), 256)).withColumn("apart", F.when(is_blank(F.col("body_md")), F.col("page_id")))


def deduplicated(records: DataFrame) -> DataFrame:
    """One record per distinct body: the records of the surviving ids, which are joined to their own rows only."""
    kept = copies_by_hash(records).select(F.col("kept_id").alias("page_id"), "body_hash")
    return records.join(kept, "page_id")


def dropped_copies(records: DataFrame) -> DataFrame:
    """page_id of every dropped copy and of the record kept for it."""
    keys = _hashed(records).select("page_id", "body_hash", "apart").filter("apart IS NULL")
    kept = copies_by_hash(records).filter("apart IS NULL").drop("apart")
    return keys.join(kept, "body_hash").filter("page_id <> kept_id").select("page_id", "kept_id", "body_hash")


def has_paths(oas: Column) -> Column:
    """Whether an API document has at least one path."""
    return F.coalesce(F.size(F.json_object_keys(F.get_json_object(oas, "$.paths"))) > 0, F.lit(False))


def text_route(records: DataFrame) -> DataFrame:
    """Where a record's text comes from: `synth`, `body+synth` or `body`."""
    sparse = (F.length(strip(F.coalesce("body_md", F.lit("")))) < SPARSE_CHARS) & has_paths(F.col("oas"))
    route = F.when(F.col("type").eqNullSafe("endpoint"), "synth").when(F.col("type").eqNullSafe("basic") & sparse, "body+synth").otherwise("body")
    return records.withColumn("route", route)


def size_stats(chunks: DataFrame, text_col: str = "page_content") -> DataFrame:
    """Count, least, upper median, 95th by index, and most of the texts' lengths.

    The two order statistics come from a histogram of lengths: its running count is over distinct
    lengths, never over the texts.
    """
    sizes = chunks.filter(F.col(text_col).isNotNull()).groupBy(F.length(text_col).alias("size")).agg(F.count("*").alias("n"))
    upto = W.orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sizes.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy()))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("size")))
    return placed.agg(
        F.coalesce(F.max("all"), F.lit(0)).cast("bigint").alias("chunks"),
        F.min("size").alias("smallest"),
        at(F.floor(F.col("all") / 2)).alias("median"),
        at(F.floor(F.col("all") * 0.95)).alias("p95"),
        F.max("size").alias("largest"),
    )


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(T.or_else(F.col("kind"), F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))


def kind_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.countDistinct(F.nullif(F.col("kind"), F.lit(""))).alias("kinds"))


def manifest_status(manifest: DataFrame) -> DataFrame:
    """Manifest rows with their outcome and a shortened error."""
    outcome = F.when(F.col("error").isNotNull() & F.col("http_status").isNull(), "failed").when(F.col("http_status") != 200, "bad_status").when(F.col("error").isNotNull(), "empty").when(F.col("cache_hit"), "cached").otherwise("fetched")
    return manifest.withColumn("outcome", outcome).withColumn("short_error", F.substring("error", 1, ERROR_CHARS))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest_status(manifest).groupBy(T.or_else(F.col("kind"), F.lit("other")).alias("kind"), "outcome").agg(F.count("*").alias("n"), F.countDistinct("short_error").alias("errors"))


def latest_per_url(manifest: DataFrame) -> DataFrame:
    """The last fetch of each address. The aggregate combines before the shuffle, so no hot address is one task's burden."""
    row = F.struct("fetched_at", "loaded_at", F.coalesce("body_hash", F.lit("")).alias("body_hash"), F.coalesce("http_status", F.lit(-1)).alias("http_status"))
    return manifest.groupBy("url").agg(F.max(row).alias("last"), F.count("*").alias("fetches")).select("url", "fetches", "last.fetched_at", "last.loaded_at", "last.body_hash", "last.http_status")


def text_fingerprints(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(id_col, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("text_hash"))


def corpus_fingerprint(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One hash for the sequence of texts in the order of their ids.

    Hashes of texts are put together in blocks of consecutive ids, the blocks' hashes in their order, so a
    task sees one block at a time; any change of a text, an id or the order changes it. Repeated ids are
    ordered by hash.
    """
    hashed = rows.select((F.floor(F.col(id_col) / FINGERPRINT_BLOCK)).alias("block"), F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("h")).alias("x"))
    lines = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: F.concat_ws(":", x["id"].cast("string"), x["h"])), "\n")
    blocks = hashed.groupBy("block").agg(F.count("*").alias("n"), F.sha2(lines("x"), 256).alias("h"))  # FINGERPRINT_BLOCK ids at most
    blocks = blocks.select("n", F.struct(F.col("block").alias("id"), "h").alias("x"))
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("texts"), F.sha2(lines("x"), 256).alias("fingerprint"))


def dropped_preview(records: DataFrame, n: int = 5) -> DataFrame:
    """The first dropped copies, as a report shows them."""
    return dropped_copies(records).orderBy("page_id").limit(n)


def sentinels(records: DataFrame, slugs: list[str]) -> DataFrame:
    """The first record of each sentinel slug and whether its body is long enough."""
    first = F.row_number().over(W.partitionBy("slug").orderBy("page_id"))
    found = records.filter(F.col("slug").isin(slugs)).withColumn("place", first).filter("place = 1")
    chars = F.length(F.coalesce("body_md", F.lit("")))
    return found.select("slug", "page_id", chars.alias("chars"), (chars >= SMOKE_CHARS).alias("passed"))


def build_stats(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of build counters; records are counted after the filter."""
    kept = indexable(records)
    unique = F.countDistinct(F.when(~is_blank(F.col("body_md")), F.sha2("body_md", 256)))
    blank = F.count_if(is_blank(F.col("body_md")))
    counters = kept.agg(F.count("*").alias("records_loaded"), (unique + blank).alias("records_deduped"))
    return counters.crossJoin(size_stats(chunks))  # one row each


def page_class(html: Column) -> Column:
    """Why a fetched page gave no record."""
    login = html.contains(LOGIN_MARKS[0]) | html.contains(LOGIN_MARKS[1])
    return F.when(html.rlike(PROPS), "no_doc_or_custompage").when(login, "auth_required (login page returned)").otherwise("no_ssr_props")


def embedded_props(html: Column) -> Column:
    """The embedded JSON of a page, null where it is missing or doesn't parse."""
    raw = F.regexp_extract(html, PROPS, 1)
    return F.when(F.try_parse_json(raw).isNotNull() & (raw != ""), raw)
