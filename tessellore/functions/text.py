"""Text functions as column expressions; all stay inside the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellore.runtime import is_blank, strip

# The token pattern shared by documents, endpoints and questions.
TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9_]*|\p{Nd}+"
# Link macros, removed blocks and components, and the path segment of each macro.
MACRO = r"\(\s*{kind}:([A-Za-z0-9][A-Za-z0-9._-]*)(#[^)\s]+)?\s*\)"
HTML_BLOCK = r"(?s)\[block:html\].*?\[/block\]"
COMPONENT = r"<([A-Z][A-Za-z0-9]*)\s*/>"
SEGMENTS = {"doc": "docs", "ref": "reference", "changelog": "changelog"}
KINDS = {"docs": "guide", "reference": "reference", "changelog": "changelog"}
PREVIEW_CHARS = 500


def tokens(text: Column) -> Column:
    """The lower-cased tokens in order, repeats kept; null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


def question_tokens(question: str) -> list[str]:
    """The same tokens for a question held by the driver."""
    import regex

    return [t.lower() for t in regex.findall(TOKEN_PATTERN, question)]


def or_else(first: Column, second: Column) -> Column:
    """The first value unless it is null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def joined_breadcrumb(breadcrumb: Column) -> Column:
    """The parts that aren't blank, or `Documentation`."""
    kept = F.filter(F.coalesce(breadcrumb, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return or_else(F.array_join(kept, " > "), F.lit("Documentation"))


def chunk_header(title: Column, slug: Column, breadcrumb: Column) -> Column:
    """The two header lines that go in front of each chunk."""
    named = or_else(strip(title), F.coalesce(slug, F.lit("")))
    return F.concat(F.lit("Title: "), named, F.lit("\nSection: "), joined_breadcrumb(breadcrumb), F.lit("\n\n"))


def rewrite_body(body: Column, base_url: Column, section: Column) -> Column:
    """Macros to absolute links, blocks of raw HTML and self-closing components dropped, blank runs collapsed."""
    base = F.concat(F.regexp_replace(base_url, "/+$", ""), F.lit("/"), section)
    out = F.coalesce(body, F.lit(""))
    for kind, segment in SEGMENTS.items():
        # the address is put in as a literal: it may hold what a replacement would read as a group
        marked = F.regexp_replace(out, MACRO.format(kind=kind), f"(\x01/{segment}/$1$2)")
        out = F.replace(marked, F.lit("\x01"), base)
    out = F.regexp_replace(F.regexp_replace(out, HTML_BLOCK, ""), COMPONENT, "")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def url_cache_key(url: Column) -> Column:
    """The path under which a page is cached: host and query don't count, a trailing slash is an index."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    path = F.regexp_replace(path, "^/+", "")
    return F.when((path == "") | path.endswith("/"), F.concat(path, F.lit("_index"))).otherwise(path)


def preview(content: Column) -> Column:
    return F.substring(content, 1, PREVIEW_CHARS)


def flat_description(text: Column) -> Column:
    """A description fit for a table cell."""
    return strip(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def first_line(text: Column, most: int = 200) -> Column:
    return F.substring(F.element_at(F.split(strip(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), 1), 1, most)


def iso_timestamp(at: Column) -> Column:
    """A time as ISO 8601 in UTC, to seconds."""
    return F.concat(F.date_format(at.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def labelled_lines(parts: Sequence[tuple[str, Column]]) -> Column:
    """Lines ``label: a, b`` of those array columns that hold something."""
    lines = [F.when(F.size(column) > 0, F.concat(F.lit(f"{label}: "), F.array_join(column, ", "))) for label, column in parts]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


__all__ = [
    "tokens", "question_tokens", "or_else", "joined_breadcrumb", "chunk_header", "rewrite_body", "url_cache_key",
    "preview", "flat_description", "first_line", "iso_timestamp", "labelled_lines", "strip", "is_blank",
]
