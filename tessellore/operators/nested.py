"""Deeply nested API documents as related flat tables (structural-variant shredding).

A tree automaton reads each document. Its contexts (`GRAMMAR`) say what a node means from where it
stands, its shapes (`shape_of`) say what the node is made of; context and shape together are the
node's *variant*. All variants share the supertype columns (page, node, parent, position) in one
node table; `variant_tables` routes them to typed subtype tables that keep the same keys. Schemas of
parameters and all components have nodes too, but only what is under `paths` gives named items.

Defined results: null, blank, cut-off and non-object documents give no nodes. Documents encoded
twice are read. Repeated input rows give repeated nodes in the node table (`found_items` is
distinct). Extra columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellore.runtime import is_blank, stored

VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")

#: context -> {key class: child context}; `*` is any key, `verb` an HTTP verb in any case, `[]` a list's member.
GRAMMAR = {
    "document": {"paths": "paths", "components": "components"},
    "components": {"schemas": "shared_schemas", "parameters": "shared_parameters", "responses": "shared_responses", "requestBodies": "shared_bodies"},
    "shared_schemas": {"*": "schema"},
    "shared_parameters": {"*": "parameter"},
    "shared_responses": {"*": "response"},
    "shared_bodies": {"*": "body"},
    "paths": {"*": "path"},
    "path": {"verb": "operation", "parameters": "parameters"},
    "operation": {"parameters": "parameters", "requestBody": "body", "responses": "responses"},
    "parameters": {"[]": "parameter"},
    "parameter": {"schema": "schema", "content": "content"},
    "responses": {"*": "response"},
    "response": {"content": "content"},
    "body": {"content": "content"},
    "content": {"*": "media"},
    "media": {"schema": "schema"},
    "schema": {"properties": "properties", "items": "schema", "allOf": "members"},
    "properties": {"*": "schema"},
    "members": {"[]": "schema"},
}
#: Where components are kept -> the section's key.
SECTIONS = {inner: key for key, inner in GRAMMAR["components"].items()}
#: Contexts that only group their children and give no node of their own.
TRANSPARENT = {"paths", "parameters", "responses", "content", "properties", "members", "components", *SECTIONS}
#: Contexts whose `$ref` is followed. At a schema a missing or open target is a leaf; elsewhere it gives nothing.
FOLLOWED = {"path", "parameter", "response", "body", "schema"}

NODE_SCHEMA = (
    "page_id bigint, node_id int, parent_id int, variant string, oas_path string, verb string, "
    "item_kind string, item_name string, depth int, node_type string, node_format string, "
    "is_required boolean, ref_target string, summary string, media_type string, source_id string"
)


SPACE = re.compile(r"[ \t\n\r]*")
ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def parse_deep(text: str) -> object:
    """JSON of any depth, read with an explicit stack; ValueError where it does not parse."""
    skip = lambda i: SPACE.match(text, i).end()
    top: list = []
    stack: list[tuple[list | dict, str | None]] = [(top, None)]  # containers that are open, and the key to be filled
    at, value_next = skip(0), True
    while True:
        home, key = stack[-1]
        mark = text[at : at + 1]
        if value_next:
            if mark in ("{", "["):
                made: list | dict = {} if mark == "{" else []
                at = skip(at + 1)
                closed = text[at : at + 1] == ("}" if mark == "{" else "]")
                if not closed:
                    stack.append((made, None))
            elif mark == '"':
                made, at = json.decoder.scanstring(text, at + 1)
                closed = None
            elif m := ATOM.match(text, at):
                made, at, closed = json.loads(m[0]), m.end(), None
            else:
                raise ValueError(f"no value at {at}")
            if isinstance(home, dict):
                home[key] = made
            else:
                home.append(made)
            if closed is False:
                value_next = isinstance(made, list)
                if not value_next:
                    at = _key(text, at, stack, skip)
                    value_next = True
                continue
            at, value_next = skip(at + (closed is True)), False
        elif len(stack) == 1:
            if at < len(text):
                raise ValueError(f"more text at {at}")
            return top[0]
        elif mark == ",":
            at, value_next = skip(at + 1), True
            if isinstance(home, dict):
                at = _key(text, at, stack, skip)
        elif mark == ("}" if isinstance(home, dict) else "]"):
            stack.pop()
            at = skip(at + 1)
        else:
            raise ValueError(f"no end of a value at {at}")


def _key(text: str, at: int, stack: list, skip) -> int:
    """Read a key and its colon at ``at``; the key is put on top of the stack."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = json.decoder.scanstring(text, at + 1)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    stack[-1] = (stack[-1][0], key)
    return skip(at + 1)


def parsed(text: str) -> object:
    """JSON as Python values, at any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return parse_deep(text)


def decode(text: str | None) -> dict | None:
    """The document as an object, also where it was encoded twice; None where it does not parse."""
    if text is None or not text.strip():
        return None
    try:
        found = parsed(text)
        if isinstance(found, str):
            found = parsed(found)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


ESCAPE = re.compile("~[01]")


class Pointers(dict):
    """The objects that a document's local JSON pointers lead to (None where to nothing); each is looked up once."""

    def __init__(self, document: dict):
        super().__init__()
        self.document = document

    def __missing__(self, pointer: object) -> dict | None:
        root, *steps = pointer.split("/") if isinstance(pointer, str) else ("",)
        found: object = self.document if root == "#" and steps else None
        for step in steps:
            found = found.get(ESCAPE.sub(lambda m: "~/"[int(m[0][1])], step)) if isinstance(found, dict) else None
        self[pointer] = found if isinstance(found, dict) else None
        return self[pointer]


def pointer(section: str, key: str) -> str:
    """The local JSON pointer to a component."""
    return f"#/components/{section}/" + key.replace("~", "~0").replace("/", "~1")


def shape_of(node: object) -> str:
    """The shape half of a variant, from the node's type and keys alone."""
    if isinstance(node, dict):
        if "allOf" in node:
            return "all_of"
        if "properties" in node:
            return "object"
        if "items" in node:
            return "array"
        if "$ref" in node:
            return "ref"
        return "plain"
    return "list" if isinstance(node, list) else "scalar"


def child_context(context: str, key: str) -> str | None:
    """Where the automaton goes from ``context`` on ``key``; None rejects the child."""
    rules = GRAMMAR.get(context, {})
    if key in rules:
        return rules[key]
    if "verb" in rules and key.lower() in VERBS:
        return rules["verb"]
    return rules.get("*")


def step_name(names: tuple[str, ...], context: str, key: str) -> tuple[str, ...]:
    """The property path below a schema: a property adds a name, an array level adds `[]`."""
    if context == "properties":
        return (*names, key)
    if context == "schema" and key == "items":
        return (*names[:-1], names[-1] + "[]") if names else ("[]",)
    return names


def text_of(value: object) -> str | None:
    return value if isinstance(value, str) else None


def nodes_of(document: dict) -> Iterator[dict]:
    """All nodes the automaton accepts, parents before children, in document order."""
    count, pointers = 0, Pointers(document)
    # node, context, parent id, depth, path, verb, names, root of names (status, body, parameter or component),
    # references open here, media type, whether what is below gives items
    stack: list[tuple] = [(document, "document", None, 0, "", "", (), "", frozenset(), None, True)]
    while stack:
        node, context, parent, depth, path, verb, names, root, opened, media, listed = stack.pop()
        ref = None
        while context in FOLLOWED and isinstance(node, dict) and "$ref" in node and not (context == "schema" and {"properties", "items", "allOf"} & node.keys()):
            ref = node["$ref"]
            target = None if not isinstance(ref, str) or ref in opened else pointers[ref]
            if target is None:
                node = {"$ref": ref} if context in ("schema", "response") else None
                break
            opened, node = opened | {ref}, target
        if node is None and context in FOLLOWED and ref is not None:
            continue
        mine = parent
        if context not in TRANSPARENT:
            if context not in ("schema", "response") and not isinstance(node, dict):
                continue
            shape = shape_of(node)
            leaf = context == "schema" and shape not in ("all_of", "object", "array")
            kind = name = None
            if context == "operation":
                kind, name = "operation", ""
            elif context == "response":
                kind, name = "response", root
            elif context == "parameter" and isinstance(node.get("in"), str) and isinstance(node.get("name"), str):
                kind, name = "parameter", f"{node['in']}:{node['name']}"
            elif leaf and names:
                kind, name = "field", f"{root} {'/'.join(names)}"
            elif leaf and not listed:
                name = root
            kind = kind if listed else None
            if context == "parameter":
                root, listed = name or "", False  # its schema gives no items
            mine, count = count, count + 1
            own = node if isinstance(node, dict) else {}
            required = own.get("required")
            yield {
                "node_id": mine, "parent_id": parent, "variant": f"{context}:{'leaf' if leaf else shape}",
                "oas_path": path, "verb": verb, "item_kind": kind, "item_name": name, "depth": depth,
                "node_type": text_of(own.get("type")) or text_of(own.get("in")), "node_format": text_of(own.get("format")),
                "is_required": required if isinstance(required, bool) else None, "ref_target": text_of(ref),
                "summary": text_of(own.get("summary")) or text_of(own.get("description")),
                "media_type": media, "source_id": None,
            }
        below = []
        if isinstance(node, dict):
            for key, child in node.items():
                if (inner := child_context(context, key)) is None:
                    continue
                if inner == "schema" and context == "schema" and isinstance(child, list):  # tuple-typed arrays
                    below += [(x, inner, mine, depth + 1, path, verb, step_name(names, context, key), root, opened, media, listed) for x in child]
                    continue
                below.append((
                    child, inner, mine, depth + (inner not in TRANSPARENT),
                    key if context == "paths" else path,
                    key.lower() if inner == "operation" else verb,
                    step_name(names, context, key),
                    f"{SECTIONS[context]}/{key}" if context in SECTIONS else key if inner == "response" else "body" if inner == "body" else root,
                    opened | {pointer(SECTIONS[context], key)} if context in SECTIONS else opened,
                    key if inner == "media" else media,
                    listed and context not in SECTIONS,
                ))
        elif isinstance(node, list) and "[]" in GRAMMAR.get(context, {}):
            below = [(x, GRAMMAR[context]["[]"], mine, depth + 1, path, verb, names, root, opened, media, listed) for x in node]
        stack.extend(reversed(below))


SLICE = 50_000  # nodes that are passed on together


def _shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [x.split()[0] for x in NODE_SCHEMA.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        for column in ("parent_id", "is_required"):
            out[column] = out[column].astype("Int32" if column == "parent_id" else "boolean")
        return out

    for batch in batches:
        rows: list[dict] = []
        for page_id, text in zip(batch["page_id"], batch["document"]):
            if (document := decode(text)) is None:
                continue
            for node in nodes_of(document):  # a document may unfold into far more nodes than it has characters
                rows.append({"page_id": page_id, **node})
                if len(rows) >= SLICE:
                    yield frame(rows)
                    rows = []
        yield frame(rows)


def shred(df: DataFrame, id_col: str = "page_id", document_col: str = "oas") -> DataFrame:
    """The node table of the documents in ``document_col``: one row for each node the automaton accepts."""
    documents = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(document_col).alias("document"))
    return documents.filter(F.col("page_id").isNotNull() & ~is_blank(F.col("document"))).mapInPandas(_shred, NODE_SCHEMA)


def category_nodes(df: DataFrame, id_col: str = "page_id", category_col: str = "category") -> DataFrame:
    """One node per page whose category struct is there; its item is the slug, if that is not blank."""
    slug = F.col(f"{category_col}.slug")
    return df.filter(F.col(category_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.lit(-1).alias("node_id"),
        F.lit(None).cast("int").alias("parent_id"),
        F.lit("category:object").alias("variant"),
        F.lit("").alias("oas_path"),
        F.lit("").alias("verb"),
        F.when(~is_blank(slug), F.lit("category")).alias("item_kind"),
        F.when(~is_blank(slug), slug).alias("item_name"),
        F.lit(0).alias("depth"),
        F.col(f"{category_col}.type").alias("node_type"),
        F.lit(None).cast("string").alias("node_format"),
        F.lit(None).cast("boolean").alias("is_required"),
        F.lit(None).cast("string").alias("ref_target"),
        F.col(f"{category_col}.title").alias("summary"),
        F.lit(None).cast("string").alias("media_type"),
        F.col(f"{category_col}.id").alias("source_id"),
    )


#: Subtype tables: name -> (the variants' context, their shapes or None for all others, typed columns beside the supertype's).
SUBTYPES = {
    "category": ("category", None, {"title": "summary", "slug": "item_name", "category_type": "node_type", "category_id": "source_id"}),
    "document": ("document", None, {}),
    "path": ("path", None, {}),
    "operation": ("operation", None, {"summary": "summary"}),
    "parameter": ("parameter", None, {"name": "item_name", "location": "node_type", "is_required": "is_required"}),
    "body": ("body", None, {"is_required": "is_required"}),
    "response": ("response", None, {"status": "item_name", "description": "summary"}),
    "media": ("media", None, {"media_type": "media_type"}),
    "object_schema": ("schema", ("object",), {"description": "summary", "ref_target": "ref_target", "media_type": "media_type"}),
    "array_schema": ("schema", ("array",), {"description": "summary", "ref_target": "ref_target", "media_type": "media_type"}),
    "composed_schema": ("schema", ("all_of",), {"description": "summary", "ref_target": "ref_target", "media_type": "media_type"}),
    "leaf_schema": ("schema", ("leaf",), {"field": "item_name", "field_type": "node_type", "field_format": "node_format", "ref_target": "ref_target", "media_type": "media_type"}),
}
#: The supertype's columns, which every table has.
KEYS = ["page_id", "node_id", "parent_id", "variant", "oas_path", "verb", "item_kind", "depth"]


def variant_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The typed subtype tables of a node table; each keeps the supertype's columns and the parent link.

    Every context that gives nodes, and every shape of a schema, has a table, so each parent is in one.
    ``nodes`` is best stored by `routed` before.
    """
    return {name: nodes.filter(F.col("subtype") == name).select(*KEYS, *(F.col(a).alias(b) for b, a in columns.items())) for name, (_, _, columns) in SUBTYPES.items()}


def routed(nodes: DataFrame) -> DataFrame:
    """The node table stored in a folder per subtype, so that reading a subtype's table touches its rows only."""
    return stored(nodes, "nodes", "subtype")


#: The tables with named items, and the column of their name; operations have none.
NAMED = {"category": "slug", "operation": None, "parameter": "name", "response": "status", "leaf_schema": "field"}


def found_items(tables: dict[str, DataFrame]) -> DataFrame:
    """The distinct named items of the subtype tables."""
    out = None
    for name, column in NAMED.items():
        title = F.lit("") if column is None else F.col(column)
        some = tables[name].filter(F.col("item_kind").isNotNull()).select("page_id", "item_kind", "oas_path", "verb", title.alias("item_name"))
        out = some if out is None else out.unionByName(some)
    return out.distinct()


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """The nodes of the subtype tables whose parent is in none of them: there are none."""
    every = None
    for name, t in tables.items():
        some = t.select("page_id", "node_id", "parent_id", F.lit(name).alias("subtype"))
        every = some if every is None else every.unionByName(some)
    parents = every.select("page_id", F.col("node_id").alias("parent_id")).distinct()
    return every.filter(F.col("parent_id").isNotNull()).join(parents, ["page_id", "parent_id"], "left_anti")


def page_nodes(pages: DataFrame) -> DataFrame:
    """The node table of page records: their API documents and their categories, each node with its subtype."""
    nodes = shred(pages).unionByName(category_nodes(pages))
    context, shape = F.substring_index("variant", ":", 1), F.substring_index("variant", ":", -1)
    subtype = F.lit(None).cast("string")
    for name, (where, shapes, _) in reversed(SUBTYPES.items()):
        mine = context == where if shapes is None else (context == where) & shape.isin(*shapes)
        subtype = F.when(mine, name).otherwise(subtype)
    return nodes.withColumn("subtype", subtype)
