"""Splitting oversized texts into overlapping pieces at natural boundaries.

Every text is worked on in ranges of a fixed grid; one that is no longer than a range is a single one.
Each range comes with a halo on its right that is longer than a piece, so the worker of a range finds
its own first boundary and that of the next range by itself: the boundary tables of neighbours agree
without talking to each other. What a range leaves is stored; its length, number of pieces and longest
unbroken run are stitched by prefix sums to offsets and piece numbers of the whole text, and joined to
the range's pieces. So no worker sees more than a range and its halos, and all that meets in one place
are a few figures per range. A halo of ``overlap`` characters on the left lets the first piece of an
inner range overlap the last piece of the range before, and tells whether a run began before. Texts of a
column are cut this way by character ranges, files by byte ranges.

Pieces are slices [start, end) of the text. Each ends at the strongest boundary in its last part
(blank line, line end, sentence end, then white space); its successor starts exactly ``overlap``
characters before that end. The overlap is shortened only where else a run without white space that
fits into a piece would be broken. A run longer than a piece is cut behind a separator if there is
one in the last fifth, else at the limit. Dropping the overlaps gives back the text. The last piece of a
range ends where the next range begins, so the grid is part of the definition of the pieces.

Defined results: null and empty texts and those within the threshold give no pieces; a null id is
kept; repeated rows give repeated pieces; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellore.runtime import stored

THRESHOLD = 2_000
LIMIT = 1_500
OVERLAP = 200
RANGE = 8_192
HALO = 2 * LIMIT

SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？｡]+[」』”’）]*\s*|[؟۔।]\s*")
BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
BROKEN = re.compile(r"\s+")
SEPARATOR = re.compile(r"[,;&|/、，；]")

PIECES = "piece int, start bigint, end bigint, boundary string, text string"


def last_match(pattern: re.Pattern, text: str, low: int, high: int) -> int:
    """The end of the last match that ends in (low, high]; -1 if there is none."""
    at = -1
    for found in pattern.finditer(text, low, high):
        at = found.end()
    return at if at > low else -1


def last_white(text: str, low: int, high: int) -> int:
    """The end of the last white space in [low, high); -1 if there is none."""
    for i in range(high - 1, low - 1, -1):
        if text[i].isspace():
            return i + 1
    return -1


def cut_at(text: str, low: int, high: int) -> tuple[int, str] | None:
    """The best natural end in (low, high]; boundaries of the last half go first, by strength."""
    half = (low + high) // 2
    for since in (half, low):
        if (at := last_match(BLANK_LINE, text, since, high)) > low:
            return at, "paragraph"
        if (at := text.rfind("\n", since, high) + 1) > low:
            return at, "line"
        if (at := last_match(SENTENCE, text, since, high)) > low:
            return at, "sentence"
        if (at := last_white(text, since, high)) > low:
            return at, "word"
    return None


def cut(text: str, first: int, last: int, limit: int = LIMIT, overlap: int = OVERLAP, lead: int = 0) -> list[tuple[int, int, str]]:
    """The pieces of text[first:last] as (start, end, kind of the boundary at the end); the first one starts ``lead`` before."""
    pieces, start, done = [], first - lead, first  # done: all before it is in some piece
    while True:
        if last - start <= limit:
            pieces.append((start, last, "end"))
            return pieces
        high = start + limit
        if (found := cut_at(text, done, high)) is None:
            # no white space in what is left of this piece: how long is the run?
            broken = BROKEN.search(text, high, min(last, done + limit + 1))
            end = broken.start() if broken else last if last - done <= limit else -1
            if 0 <= end - done <= limit:
                start = max(start, end - limit)
                found = (end, "word" if end < last else "end")
            else:
                mark = last_match(SEPARATOR, text, max(done, high - limit // 5), high)
                found = (mark, "separator") if mark > done else (high, "hard")
        end, kind = found
        pieces.append((start, end, kind))
        if end >= last:
            return pieces
        done, start = end, max(end - overlap, first - lead, start + 1)


def longest_run(text: str, first: int = 0, last: int | None = None) -> int:
    """The length of the longest run without white space that begins in text[first:last], followed beyond ``last``."""
    last = len(text) if last is None else last
    if 0 < first < last and not text[first - 1].isspace():  # the run here began before
        end = BROKEN.search(text, first, last)
        first = end.end() if end else last
    if first >= last:
        return 0
    end = BROKEN.search(text, last)
    own = text[first:last] if text[last - 1].isspace() else text[first : end.start() if end else len(text)]
    return max(map(len, own.split()), default=0)


def range_start(text: str, at: int, halo: int = HALO) -> int:
    """Where an inner range that begins at ``at`` starts: its first natural boundary within the halo."""
    high = min(len(text), at + halo)
    for pattern in (BLANK_LINE, SENTENCE, BROKEN):
        if (found := pattern.search(text, at, high)) and found.end() < high:
            return found.end()
    return min(at, len(text))


def bounds(text: str, is_first: bool, at: int, to: int, halo: int = HALO) -> tuple[int, int]:
    """The stretch of a range's text (with its halos) that is the range's own; it begins at ``at``, the next one at ``to``."""
    first = 0 if is_first else range_start(text, at, halo)
    last = range_start(text, to, halo) if to < len(text) else len(text)
    return first, max(first, last)


def halo_of(limit: int) -> int:
    """How far a range looks for the first boundary of the next one."""
    return max(HALO, 2 * limit)


def _ranges(limit: int, overlap: int, range_chars: int):
    halo = halo_of(limit)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, number, text in zip(batch["doc"], batch["range"], batch["part"]):
                at = min(overlap, number * range_chars)  # the left halo's length
                first, last = bounds(text, number == 0, at, at + range_chars, halo)
                own = cut(text, first, last, limit, overlap, min(overlap, first)) if last > first else []
                base = number * range_chars - at
                pieces = [(i, a + base, b + base, how, text[a:b]) for i, (a, b, how) in enumerate(own)]
                rows.append((doc, number, longest_run(text, first, last), pieces))
            yield pd.DataFrame(rows, columns=["doc", "range", "longest", "pieces"])

    return split


INNER = PIECES.replace(", ", ",").replace(" ", ":")


def _stitched(found: DataFrame, text: list[str], limit: int, sums: dict[str, str]) -> DataFrame:
    """The rows of ranges with cut_kind, number of the first piece, and the sums of what lies before.

    ``text`` are the columns that name a text; only a few figures per range are windowed, the pieces are
    joined to them by range.
    """
    figures = found.select(*text, "range", "longest", F.size("pieces").alias("own"), *(F.col(c) for c in sums))
    before = W.partitionBy(*text).orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    figures = figures.select(
        *text,
        "range",
        F.when(F.max("longest").over(W.partitionBy(*text)) > limit, "hard").otherwise("soft").alias("cut_kind"),
        (F.sum("own").over(before) - F.col("own")).alias("number"),
        *((F.sum(c).over(before) - F.col(c)).alias(name) for c, name in sums.items()),
    )
    return found.select(*text, "range", "pieces").join(figures, [*text, "range"])


def split_texts(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, threshold: int = THRESHOLD, range_chars: int = RANGE) -> DataFrame:
    """The pieces of the texts in ``body`` longer than ``threshold``; df has tbl, row_id and body."""
    if limit <= 2 * overlap or range_chars <= overlap:
        raise ValueError("the overlap must be less than half the limit, and less than a range")
    rows = df.select("tbl", F.col("row_id").cast("bigint").alias("row_id"), "body").filter(F.length("body") > threshold)
    # a text is named by its table, row and content, and a number that tells repeated rows apart
    doc = F.struct("tbl", "row_id", F.monotonically_increasing_id().alias("row"))
    ranged = rows.withColumn("doc", doc).withColumn("range", F.explode(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / range_chars).cast("int"))))
    begin = F.col("range") * range_chars
    left = F.least(begin, F.lit(overlap))
    part = F.substring("body", begin - left + 1, left + range_chars + halo_of(limit))
    ranged = ranged.select(F.to_json("doc", {"ignoreNullFields": "false"}).alias("doc"), "range", part.alias("part"))
    found = ranged.mapInPandas(_ranges(limit, overlap, range_chars), f"doc string, range int, longest int, pieces array<struct<{INNER}>>")
    found = stored(found, "pieces")  # row numbers are fixed from here
    named = F.from_json("doc", "tbl string, row_id bigint")
    whole = _stitched(found, ["doc"], limit, {}).select(named.alias("of"), "cut_kind", "number", F.inline("pieces"))
    return whole.select("of.tbl", "of.row_id", "cut_kind", (F.col("piece") + F.col("number")).cast("int").alias("piece"), "start", "end", "boundary", "text")


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """One row per text that was split."""
    return pieces.filter(F.col("piece") == 0).select("tbl", "row_id", "cut_kind")


# --- files -----------------------------------------------------------------------------------------


def _read(path: str, start: int, size: int) -> bytes:
    import pyarrow.fs as fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    with system.open_input_file(inner) as source:
        return source.read_at(size, start)


def _decode(raw: bytes, first: bool) -> tuple[str, int]:
    """The text, and how many bytes in front belong to a character that began before."""
    skipped = 0
    while not first and skipped < min(3, len(raw)) and raw[skipped] & 0xC0 == 0x80:
        skipped += 1
    cut_off = len(raw)
    for back in range(1, min(4, len(raw) - skipped) + 1):
        byte = raw[-back]
        if byte & 0xC0 != 0x80:
            need = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            if need > back:
                cut_off = len(raw) - back
            break
    return raw[skipped:cut_off].decode("utf-8", "replace"), skipped


def _file_ranges(limit: int, overlap: int, range_bytes: int):
    most = halo_of(limit)
    halo = 4 * (most + limit)  # in bytes

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size, number in zip(batch["path"], batch["length"], batch["range"]):
                low, high = number * range_bytes, min(size, (number + 1) * range_bytes)
                back = min(low, 4 * overlap)  # bytes of the left halo
                both = _read(path, low - back, back + high - low + halo)
                raw = both[back:]
                text, skipped = _decode(raw, low == 0)
                left = _decode(both[: back + skipped], low == back)[0][-overlap:] if back else ""
                to = sum(byte & 0xC0 != 0x80 for byte in raw[skipped : high - low]) if high < size else len(text)
                at, text = len(left), left + text
                first, last = bounds(text, low == 0, at, at + to, most)
                own = cut(text, first, last, limit, overlap, min(overlap, first)) if last > first else []
                pieces = [(i, a - first, b - first, how, text[a:b]) for i, (a, b, how) in enumerate(own)]
                rows.append((path, number, low + skipped + len(text[at:first].encode("utf-8")), last - first, longest_run(text, first, last), pieces))
            yield pd.DataFrame(rows, columns=["path", "range", "start_byte", "chars", "longest", "pieces"])

    return split


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 8 << 20) -> DataFrame:
    """The pieces of UTF-8 files under ``path``, with offsets in characters of the whole file.

    Files are listed with their lengths only; workers read byte ranges, a range of one file each. Character
    offsets and piece numbers come from prefix sums over the ranges' lengths.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    ranged = listed.withColumn("range", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / range_bytes).cast("int"))))
    found = ranged.repartition("path", "range").mapInPandas(_file_ranges(limit, overlap, range_bytes), f"path string, range int, start_byte bigint, chars bigint, longest int, pieces array<struct<{INNER}>>")
    whole = _stitched(stored(found, "file-pieces"), ["path"], limit, {"chars": "base"})
    return whole.select("path", "cut_kind", "base", "number", F.inline("pieces")).select(
        "path", "cut_kind", (F.col("piece") + F.col("number")).cast("int").alias("piece"), (F.col("start") + F.col("base")).alias("start"), (F.col("end") + F.col("base")).alias("end"), "boundary", "text"
    )
