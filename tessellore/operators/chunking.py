"""Chunks of page records: header, recursive splitting, merging of small pieces.

A record whose text has at most `PAGE_CHARS` characters is one chunk. A longer one is split at the
strongest separator present, pieces are packed up to `CHUNK_CHARS` with an overlap of whole pieces up
to `OVERLAP_CHARS`, then neighbours are merged while one of them is small. Every chunk carries the
header of its record. Blank texts give no chunk.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellore.functions import text as T
from tessellore.runtime import is_blank

# Fixed values.
PAGE_CHARS, CHUNK_CHARS, OVERLAP_CHARS, SMALL_CHARS, MERGED_CHARS = 2000, 1500, 200, 500, 3000
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def parts_of(text: str, separator: str) -> list[str]:
    """The text cut in front of each separator, which stays with the part it begins; no empty parts."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in (head, *(separator + t for t in tail)) if p]


def packed(parts: list[str], limit: int, overlap: int) -> list[str]:
    """Parts joined up to the limit; each join begins with the last parts of the one before, up to the overlap."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for part in parts:
        if held and size + len(part) > limit:
            out.append("".join(held).strip())
            while held and (size > overlap or size + len(part) > limit):
                size -= len(held.pop(0))
        held.append(part)
        size += len(part)
    out.append("".join(held).strip())
    return [x for x in out if x]


def split_text(text: str, limit: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The pieces of a text, each stripped and at most ``limit`` long."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    out: list[str] = []
    short: list[str] = []
    for part in parts_of(text, separators[at]):
        if len(part) < limit:
            short.append(part)
            continue
        if short:
            out += packed(short, limit, overlap)
            short = []
        out += split_text(part, limit, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [part]
    return out + (packed(short, limit, overlap) if short else [])


def merge_small(pieces: Column) -> Column:
    """Neighbours of an array merged while either is small and both together are not too large."""
    last = lambda acc: F.element_at(acc, -1)
    joins = lambda acc, x: (F.size(acc) > 0) & ((F.length(x) < SMALL_CHARS) | (F.length(F.try_element_at(acc, F.lit(-1))) < SMALL_CHARS)) & (F.length(F.try_element_at(acc, F.lit(-1))) + F.length(x) < MERGED_CHARS)
    fold = lambda acc, x: F.when(joins(acc, x), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last(acc), F.lit("\n\n"), x)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(pieces, F.array().cast("array<string>"), fold)


def _pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [t] if t is None or len(t) <= PAGE_CHARS else split_text(t))


def chunk_records(records: DataFrame, text_col: str = "record_text") -> DataFrame:
    """The chunks of records (with page_id, source, url, title, slug, kind, type, breadcrumb)."""
    split = F.pandas_udf(_pieces, "array<string>")
    rows = records.filter(~is_blank(F.col(text_col)))
    pieces = F.when(F.length(text_col) <= PAGE_CHARS, F.array(text_col)).otherwise(merge_small(split(F.col(text_col))))
    listed = rows.withColumn("pieces", pieces).withColumn("total_chunks", F.size("pieces"))
    header = T.chunk_header(F.col("title"), F.col("slug"), F.col("breadcrumb"))
    return listed.select("*", F.posexplode("pieces").alias("chunk_index", "piece")).select(
        "page_id", "source", "url", "title", "slug", "kind", "type", "breadcrumb", "chunk_index", "total_chunks", F.concat(header, "piece").alias("page_content")
    )

