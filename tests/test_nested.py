import json

import pytest

from tessellore.operators import nested

DOCUMENT = {
    "paths": {
        "/a/{x}": {
            "parameters": [{"name": "x", "in": "path"}, {"$ref": "#/components/parameters/Gone"}],
            "GET": {
                "parameters": [{"$ref": "#/components/parameters/P~1q"}],
                "responses": {
                    "200": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/S"}}}}},
                    "404": {"$ref": "#/components/responses/R"},
                },
            },
            "post": {
                "requestBody": {"content": {"a/b": {"schema": {"allOf": [{"properties": {"k": {"type": "array", "items": {"type": "string"}}}}, {"$ref": "#/components/schemas/S"}]}}}},
                "responses": {"204": {"description": "x"}, "201": {"content": {"a/b": {"schema": {"type": "string"}}}}},
            },
            "x-owner": {"get": {"responses": {"200": {}}}},
        }
    },
    "components": {
        "parameters": {"P/q": {"name": "q", "in": "query"}},
        "responses": {"R": {"content": {"a/b": {"schema": {"properties": {"why": {"$ref": "#/components/schemas/None"}}}}}}},
        "schemas": {"S": {"properties": {"me": {"$ref": "#/components/schemas/S"}, "n": {"type": "number"}}}},
    },
}
EXPECTED = {
    ("parameter", "/a/{x}", "", "path:x"),
    ("operation", "/a/{x}", "get", ""),
    ("parameter", "/a/{x}", "get", "query:q"),
    ("response", "/a/{x}", "get", "200"),
    ("field", "/a/{x}", "get", "200 []/me"),
    ("field", "/a/{x}", "get", "200 []/n"),
    ("response", "/a/{x}", "get", "404"),
    ("field", "/a/{x}", "get", "404 why"),
    ("operation", "/a/{x}", "post", ""),
    ("field", "/a/{x}", "post", "body k[]"),
    ("field", "/a/{x}", "post", "body me"),
    ("field", "/a/{x}", "post", "body n"),
    ("response", "/a/{x}", "post", "204"),
    ("response", "/a/{x}", "post", "201"),
}


def items(document):
    return {(x["item_kind"], x["oas_path"], x["verb"], x["item_name"]) for x in nested.nodes_of(document) if x["item_kind"]}


def test_items_of_a_document():
    assert items(DOCUMENT) == EXPECTED


def test_parents_come_before_children_and_link():
    nodes = list(nested.nodes_of(DOCUMENT))
    assert [x["node_id"] for x in nodes] == list(range(len(nodes)))
    assert all(x["parent_id"] is None or x["parent_id"] < x["node_id"] for x in nodes)


def test_decoding():
    assert nested.decode(json.dumps(json.dumps({"a": 1}))) == {"a": 1}
    assert [nested.decode(x) for x in (None, "", " ", "{", "null", "[1]", "3", '"x"', "[" * 100_000)] == [None] * 9


def test_documents_of_any_depth():
    deep = "{\"a\": " * 30_000 + "[1, {\"b\": \"\\u00e9,]\"}, [], {}, -2.5e3, true, null]" + "}" * 30_000
    found, levels = nested.decode(deep), 0
    while isinstance(found, dict):
        found, levels = found["a"], levels + 1
    assert levels == 30_000 and found == [1, {"b": "é,]"}, [], {}, -2500.0, True, None]
    for text in ('{"a": [1, {"b": {}}, [[]], "x"], "c": {"d": [true, false]}}', "[]", " 3 ", '"a\\nb"', '{"a":{},"b":[{}]}'):
        assert nested.parse_deep(text) == json.loads(text)
    for text in ("", "{", "[1,]", '{"a"}', '{"a":}', "{1:2}", "[1 2]", "nul", '["a]', "{} x", '{"a":1,}', "]"):
        with pytest.raises(ValueError):
            nested.parse_deep(text)
    schema = "".join('{"properties": {"p": ' for _ in range(5_000)) + '{"type": "string"}' + "}}" * 5_000
    one = nested.decode('{"paths": {"/a": {"get": {"responses": {"200": {"content": {"a/b": {"schema": ' + schema + "}}}}}}}}")
    assert [x["item_name"] for x in nested.nodes_of(one) if x["item_kind"] == "field"] == ["200 " + "/".join("p" * 5_000)]


def test_shred_handles_dirty_rows(spark):
    schema = "page_id bigint, oas string, category struct<title:string,slug:string,type:string,id:string>, node_id string, variant int"
    rows = [
        (1, json.dumps(DOCUMENT), ("t", "s", "guide", "i"), "clash", 1),
        (1, json.dumps(DOCUMENT), ("t", "s", "guide", "i"), "clash", 1),
        (2, None, None, None, None),
        (3, "{", ("t", "  ", None, None), None, None),
        (4, json.dumps(json.dumps(DOCUMENT)), ("t", None, None, None), "x", 2),
        (None, json.dumps(DOCUMENT), ("t", "s", "guide", "i"), "x", 3),
    ]
    nodes = nested.page_nodes(spark.createDataFrame(rows, schema))
    found = {tuple(r) for r in nested.found_items(nested.variant_tables(nodes)).collect()}
    expected = {(p, k, path, v, n) for p in (1, 4) for k, path, v, n in EXPECTED} | {(1, "category", "", "", "s")}
    assert found == expected
    tables = nested.variant_tables(nodes)
    assert tables["operation"].filter("page_id = 4").count() == 2
    assert tables["category"].count() == 4


def test_nothing_named_is_lost_and_every_parent_resolves(spark):
    """Parameter schemas, components nothing refers to, media types and category ids."""
    document = {
        "paths": {"/p": {"get": {
            "parameters": [{"name": "n", "in": "query", "schema": {"type": "integer", "format": "int32"}}, {"name": "f", "in": "query", "content": {"a/json": {"schema": {"properties": {"k": {"type": "number"}}}}}}],
            "responses": {"200": {"content": {"text/csv": {"schema": {"properties": {"c": {"type": "string"}}}}}}},
        }}},
        "components": {
            "schemas": {"Alone/x": {"properties": {"me": {"$ref": "#/components/schemas/Alone~1x"}, "v": {"type": "boolean"}}}, "Flat": {"type": "string"}},
            "parameters": {"H": {"name": "h", "in": "header", "schema": {"type": "array", "items": {"type": "string"}}}},
            "responses": {"R": {"content": {"a/b": {"schema": {"properties": {"why": {"type": "null"}}}}}}},
            "requestBodies": {"B": {"content": {"a/b": {"schema": {"type": "object"}}}}},
        },
    }
    schema = "page_id bigint, oas string, category struct<title:string,slug:string,type:string,id:string>"
    nodes = nested.page_nodes(spark.createDataFrame([(1, json.dumps(document), ("t", "s", "guide", "c7"))], schema))
    tables = {name: table.collect() for name, table in nested.variant_tables(nodes).items()}
    fields = {(r["field"], r["field_type"], r["media_type"]) for r in tables["leaf_schema"] if r["field"]}
    assert fields == {
        ("query:n", "integer", None), ("query:f k", "number", "a/json"), ("200 c", "string", "text/csv"),
        ("schemas/Alone/x me", None, None), ("schemas/Alone/x v", "boolean", None), ("schemas/Flat", "string", None),
        ("header:h []", "string", None), ("responses/R why", "null", "a/b"), ("requestBodies/B", "object", "a/b"),
    }
    assert sorted(r["media_type"] for r in tables["media"]) == ["a/b", "a/b", "a/json", "text/csv"]
    assert [r["category_id"] for r in tables["category"]] == ["c7"]
    assert nested.orphans(nested.variant_tables(nested.routed(nodes))).count() == 0
    known = {r["node_id"] for table in tables.values() for r in table}
    assert len(known) == nodes.count()
    assert all(r["parent_id"] is None or r["parent_id"] in known for table in tables.values() for r in table)
    assert {tuple(r)[1:] for r in nested.found_items(nested.variant_tables(nodes)).collect()} == {
        ("operation", "/p", "get", ""), ("parameter", "/p", "get", "query:n"), ("parameter", "/p", "get", "query:f"),
        ("response", "/p", "get", "200"), ("field", "/p", "get", "200 c"), ("category", "", "", "s"),
    }


def test_nodes_are_passed_on_in_slices(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(nested, "SLICE", 10)
    batch = pd.DataFrame({"page_id": [1, 2], "document": [json.dumps(DOCUMENT)] * 2})
    parts = list(nested._shred(iter([batch])))
    assert max(map(len, parts)) == 10 and sum(map(len, parts)) == 2 * len(list(nested.nodes_of(DOCUMENT)))


def test_empty_table(spark):
    schema = "page_id bigint, oas string, category struct<title:string,slug:string,type:string,id:string>"
    assert nested.found_items(nested.variant_tables(nested.page_nodes(spark.createDataFrame([], schema)))).count() == 0
