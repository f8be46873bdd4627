"""Trees of pages and of API collections as flat tables, and the frontier they make.

One tree is one row of JSON. Only its descent is Python, with an explicit stack, so depth and number of
nodes have no limit of the engine's; it gives each node its path and leaves the rest as JSON, which
column expressions read. The position of a node among its siblings, from the root down, is kept as an
array: sorting by it gives the order of the tree. Release notes are a flat list that is folded in the
engine.

Defined results: JSON that is null or does not parse gives no rows (`unreadable` counts it); members of
an unexpected type are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellore.functions import text as T
from tessellore.operators.nested import parsed

# Fixed values.
RELEASE_NOTES = ("Release Notes", "changelog")
CHANGELOG_REFERENCE = r"(?i)\(changelog:([A-Za-z0-9][A-Za-z0-9._-]*)\)"

FRONTIER = "slug string, url string, kind string, title string, category_title string, category_slug string, parent_slug string, breadcrumb array<string>, hidden boolean, deprecated boolean, sidebar_meta map<string,string>, position array<int>"
LEAVES = "name string, folder_path array<string>, request string, position array<int>"


def text_of(value: object) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)


def sidebar_entries(props: dict, base_url: str, section: str, skip_hidden: bool = True) -> Iterator[tuple]:
    """The pages of both sidebars. A hidden page, or one without a slug, takes its whole subtree with it."""
    root = f"{base_url.rstrip('/')}/{section}"
    bars = props.get("sidebars") or {}
    for b, (bar, kind, segment) in enumerate((("docs", "guide", "docs"), ("refs", "reference", "reference"))):
        for c, category in enumerate(bars.get(bar) or []):
            title = category.get("title")
            stack = [(n, [title or ""], None, [b, c, i]) for i, n in reversed(list(enumerate(category.get("pages") or [])))]
            while stack:
                node, crumbs, parent, position = stack.pop()
                slug, hidden = node.get("slug"), bool(node.get("hidden", False))
                if not slug or (hidden and skip_hidden):
                    continue
                named = node.get("title") or slug
                path = [*crumbs, named]
                meta = {k: text_of(v) for k, v in node.items() if k != "pages"}
                yield (slug, f"{root}/{segment}/{slug}", kind, named, title, category.get("slug"), parent, path, hidden, bool(node.get("deprecated", False)), meta, position)
                stack += [(n, path, slug, [*position, i]) for i, n in reversed(list(enumerate(node.get("pages") or [])))]


def _frontier(skip_hidden: bool):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split()[0] for c in FRONTIER.replace("map<string,string>", "map").split(",")]
        for batch in batches:
            rows = []
            for props, base, section in zip(batch["props"], batch["base_url"], batch["section"]):
                found = read_object(props)
                rows += sidebar_entries(found, base, section, skip_hidden) if found else ()
            yield pd.DataFrame(rows, columns=columns)

    return walk


def read_object(text: object) -> dict | None:
    """JSON text as an object; None if it is none."""
    try:
        found = parsed(text) if isinstance(text, str) else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def unreadable(df: DataFrame, column: str) -> DataFrame:
    """How many rows of ``df`` have text in ``column`` that is no JSON."""
    return df.agg(F.count_if(F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull()).alias("unreadable"))


NOTE = "struct<slug:string,title:string,hidden:boolean,meta:map<string,string>,position:array<int>>"


def changelog_rows(props: Column, skip_hidden: bool = True) -> Column:
    """Listed release notes and those their bodies point to, as an array; the first mention of a slug decides.

    A fold over the list that carries the slugs known so far: a note that is known brings nothing, one that
    is hidden only makes itself known.
    """
    key = lambda x, name: F.get_json_object(x, f"$.{name}")
    listed = F.transform(
        F.from_json(F.get_json_object(props, "$.changelogs"), "array<string>"),
        lambda x, i: F.struct(
            key(x, "slug").alias("slug"), F.coalesce(F.nullif(key(x, "title"), F.lit("")), key(x, "slug")).alias("title"), F.coalesce(key(x, "hidden") == "true", F.lit(False)).alias("hidden"),
            F.create_map(F.lit("type"), key(x, "type"), F.lit("updatedAt"), key(x, "updatedAt")).alias("meta"), F.regexp_extract_all(F.coalesce(key(x, "body"), F.lit("")), F.lit(CHANGELOG_REFERENCE), F.lit(1)).alias("mentions"), i.cast("int").alias("i"),
        ),
    )

    def fold(seen: Column, note: Column) -> Column:
        shown = F.lit(True) if not skip_hidden else ~note["hidden"]
        known = F.array_append(seen["known"], note["slug"])
        more = F.array_except(F.when(shown, note["mentions"]).otherwise(F.array().cast("array<string>")), known)
        own = F.array(F.struct(note["slug"].alias("slug"), note["title"].alias("title"), note["hidden"].alias("hidden"), note["meta"].alias("meta"), F.array(F.lit(2), note["i"]).alias("position")).cast(NOTE))
        others = F.transform(more, lambda m, j: F.struct(m.alias("slug"), m.alias("title"), F.lit(False).alias("hidden"), F.create_map().cast("map<string,string>").alias("meta"), F.array(F.lit(2), note["i"], j.cast("int")).alias("position")).cast(NOTE))
        rows = F.concat(seen["rows"], F.when(shown, own).otherwise(F.array().cast(f"array<{NOTE}>")), others)
        new = F.struct(F.concat(known, more).alias("known"), rows.alias("rows"))
        passed = note["slug"].isNull() | (note["slug"] == "") | F.array_contains(seen["known"], note["slug"])
        return F.when(passed, seen).otherwise(new)

    start = F.struct(F.array().cast("array<string>").alias("known"), F.array().cast(f"array<{NOTE}>").alias("rows"))
    return F.aggregate(F.coalesce(listed, F.array()), start, fold, lambda seen: seen["rows"])


def frontier(pages: DataFrame, skip_hidden: bool = True) -> DataFrame:
    """The frontier of pages with props (embedded JSON), base_url and section; order it by ``position``."""
    bars = pages.select("props", "base_url", "section").mapInPandas(_frontier(skip_hidden), FRONTIER)
    notes = pages.select(F.concat_ws("/", F.rtrim("base_url", F.lit("/")), "section").alias("root"), F.inline(changelog_rows(F.col("props"), skip_hidden)))
    nothing, (heading, slug) = F.lit(None).cast("string"), (F.lit(x) for x in RELEASE_NOTES)
    return bars.unionByName(
        notes.select(
            "slug", F.concat_ws("/", "root", slug, "slug").alias("url"), slug.alias("kind"), "title", heading.alias("category_title"), slug.alias("category_slug"),
            nothing.alias("parent_slug"), F.array(heading, "title").alias("breadcrumb"), "hidden", F.lit(False).alias("deprecated"), F.col("meta").alias("sidebar_meta"), "position",
        )
    )


# --- API collections -------------------------------------------------------------------------------


def members(listed: Column) -> Column:
    """The members of a JSON array as JSON texts (strings without quotes); none if it is no array."""
    return F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))


def keys_of(listed: Column, blanks: bool = False) -> Column:
    """The ``key`` of each object of a JSON array; the blank ones only if asked for."""
    keys = F.transform(F.filter(members(listed), lambda x: x.startswith("{")), lambda x: F.coalesce(F.get_json_object(x, "$.key"), F.lit("")))
    return keys if blanks else F.filter(keys, lambda k: k != "")


def joined(listed: Column, by: str) -> Column:
    """A JSON array of texts put together; any other text as it is."""
    parts = F.from_json(listed, "array<string>")
    return F.coalesce(F.array_join(parts, by), listed, F.lit(""))


def rendered_url(url: Column, whole: Column) -> Column:
    """A request's address: the text it is, its raw form, or its host and path; ``whole`` is the JSON object, if it is one."""
    part = lambda name: F.get_json_object(whole, f"$.{name}")
    built = F.btrim(F.concat_ws("/", joined(part("host"), "."), joined(part("path"), "/")), F.lit("/"))
    return F.when(whole.isNull(), F.coalesce(url, F.lit(""))).otherwise(F.coalesce(F.nullif(part("raw"), F.lit("")), built))


def body_keys(body: Column) -> Column:
    """The field names of a request body: of a form, or of the first object of a JSON text."""
    part = lambda name: F.get_json_object(body, f"$.{name}")
    raw = F.btrim(part("raw"))
    first = F.when(raw.startswith("["), F.get_json_object(raw, "$[0]")).otherwise(raw)
    names = F.when(F.try_parse_json(raw).isNotNull() & first.startswith("{"), F.array_distinct(F.json_object_keys(first)))
    form = F.when(part("mode") == "urlencoded", keys_of(part("urlencoded"), blanks=True)).when(part("mode") == "formdata", keys_of(part("formdata"), blanks=True))
    return F.coalesce(form, F.when(part("mode") == "raw", names), F.array().cast("array<string>"))


def path_variables(whole: Column) -> Column:
    """Declared variables, then the named segments of the path."""
    segments = F.filter(members(F.get_json_object(whole, "$.path")), lambda s: s.startswith(":"))
    return F.concat(keys_of(F.get_json_object(whole, "$.variable")), F.transform(segments, lambda s: F.substring(s, F.lit(2), F.length(s))))


def collection_leaves(collection: dict) -> Iterator[tuple]:
    """The requests of an API collection in the order of its tree, as JSON; an item with `item` is a folder."""
    stack = [(x, [], [i]) for i, x in reversed(list(enumerate(collection.get("item") or [])))]
    while stack:
        node, folders, position = stack.pop()
        if not isinstance(node, dict):
            continue
        name = str(node.get("name") or "")
        if "item" in node:
            stack += [(x, [*folders, name], [*position, i]) for i, x in reversed(list(enumerate(node["item"] or [])))]
        elif isinstance(node.get("request"), dict):
            yield name, folders, json.dumps(node["request"], ensure_ascii=False), position


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.strip().split()[0] for c in LEAVES.split(",")]
    for batch in batches:
        yield pd.DataFrame([leaf for text in batch["collection"] for leaf in collection_leaves(read_object(text) or {})], columns=columns)


def api_entries(collections: DataFrame) -> DataFrame:
    """The requests of API collections (JSON in ``collection``) with the text they are searched by and its tokens."""
    leaves = collections.select("collection").filter("collection IS NOT NULL").mapInPandas(_leaves, LEAVES)
    part = lambda name: F.get_json_object("request", f"$.{name}")
    # an address is an object if its JSON type says so: texts may begin with a brace as well
    is_object = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col("request")), "$.url", "variant")).startswith("OBJECT")
    whole = F.when(is_object, part("url"))
    rows = leaves.select(
        "name",
        F.upper(F.coalesce(F.nullif(part("method"), F.lit("")), F.lit("GET"))).alias("method"),
        rendered_url(part("url"), whole).alias("url"),
        F.coalesce(part("description"), F.lit("")).alias("description"),
        "folder_path",
        keys_of(part("header")).alias("header_keys"),
        body_keys(part("body")).alias("body_keys"),
        keys_of(F.get_json_object(whole, "$.query")).alias("query_keys"),
        path_variables(whole).alias("path_vars"),
        "position",
    )
    keys = T.labelled_lines([("Headers", F.col("header_keys")), ("Query", F.col("query_keys")), ("Path vars", F.col("path_vars")), ("Body fields", F.col("body_keys"))])
    lines = F.array(
        F.when(F.size("folder_path") > 0, F.array_join("folder_path", " > ")),
        F.col("name"),
        F.concat_ws(" ", "method", "url"),
        F.nullif(F.col("description"), F.lit("")),
        F.nullif(keys, F.lit("")),
    )
    searched = F.array_join(F.array_compact(lines), "\n")
    return rows.withColumn("bm25_text", searched).withColumn("tokens", T.tokens(F.col("bm25_text")))
