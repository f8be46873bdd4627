import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellore.operators import answering, embedding, endpoints, extract, links, trees
from tessellore.operators.nested import Pointers

OAS = {
    "paths": {
        "/a/{x}": {
            "parameters": [{"name": "x", "in": "path"}],
            "get": {
                "summary": "Get it",
                "description": " Long ",
                "deprecated": True,
                "parameters": [{"name": "q", "in": "query", "required": True, "schema": {"type": "array", "items": {"type": "integer", "format": "int32"}}, "description": "a|b\nc"}, {"$ref": "#/components/parameters/P"}],
                "responses": {
                    "200": {"description": "ok", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/S"}, "examples": {"one": {"summary": "first", "value": {"b": 1, "a": 2}}, "two": {"value": 1}}}}},
                    "404": {"content": {"application/json": {"schema": {"type": "string"}}}},
                },
            },
            "post": {"requestBody": {"required": True, "content": {"text/csv": {"schema": {"$ref": "#/components/schemas/Gone"}, "example": "a,b"}}}},
            "x-extra": {"get": {}},
        }
    },
    "components": {"parameters": {"P": {"name": "p", "in": "header"}}, "schemas": {"S": {"type": "object", "properties": {"me": {"$ref": "#/components/schemas/S"}}}}},
}
RENDERED = '''## GET /a/{x}

**Get it**

Long

> ⚠ This operation is marked deprecated.

### Parameters

| Name | In | Required | Type | Description |
| --- | --- | --- | --- | --- |
| `q` | query | yes | array<integer (int32)> | a\\|b c |
| `p` | header | no |  |  |

### Responses

#### 200 — ok

Content-Type: `application/json`

##### Schema
```json
{
  "type": "object",
  "properties": {
    "me": {
      "type": "object",
      "properties": {
        "me": {
          "$ref": "#/components/schemas/S",
          "_cycle": true
        }
      }
    }
  }
}
```

##### Examples
###### one — first
```json
{
  "b": 1,
  "a": 2
}
```
_(1 additional example(s) omitted)_

#### 404


## POST /a/{x}

### Request body

_Required._

Content-Type: `text/csv`

#### Schema
```json
{
  "$ref": "#/components/schemas/Gone"
}
```

#### Example
```json
"a,b"
```
'''


def test_rendered_document():
    assert endpoints.endpoint_markdown(json.dumps(OAS), None) == RENDERED
    assert endpoints.endpoint_markdown(None, None) == endpoints.endpoint_markdown("{", "[1]") == endpoints.endpoint_markdown('{"paths": {}}', "{}") == ""


def test_four_hops():
    chain = {"components": {"schemas": {f"S{i}": {"$ref": f"#/components/schemas/S{i + 1}"} for i in range(6)}}}
    assert endpoints.expanded({"$ref": "#/components/schemas/S0"}, Pointers(chain)) == {"$ref": "#/components/schemas/S4"}


def test_large_schemas_and_examples():
    fields = {f"field{i:03d}": {"type": "string", "description": "d" * 40} for i in range(120)}
    lines = endpoints.schema_lines({"type": "array", "items": {"properties": fields, "required": ["field001"]}})
    assert lines[0] == "_Array of:_" and lines[1] == endpoints.FIELD_HEAD[0] and "| yes |" in lines[4]
    assert sum(len(x) + 1 for x in lines[1:-1]) <= 3500 and lines[-1] == f"_({120 - (len(lines) - 4)} more field(s) omitted; see full schema in OAS)_"
    assert endpoints.shortened("x" * 5000).endswith("\n... (truncated, 1,002 more chars)")
    assert endpoints.schema_lines({"type": "object", "description": "x" * 4000}) == [f"_object_ — {'x' * 4000}"]


def test_code_samples():
    api = {"examples": {"codes": [{"language": "CURL", "code": "curl x y"}, {"code": "{}"}, {"language": "js", "code": "f(1);", "name": "JS"}]}, "results": {"codes": [{"status": 200, "language": "json", "code": '{"a": 1}'}, {"code": "null "}]}}
    assert endpoints.written(endpoints.sample_parts(api)) == ["#### curl", "```curl", "curl x y", "```", "", "#### JS", "```js", "f(1);", "```", "", "#### Response 200 — json", "```json", '{"a": 1}', "```", ""]


def test_deep_documents_are_rendered():
    value = "x"
    for _ in range(20_000):
        value = [value]
    text = "[" * 20_000 + '"x"' + "]" * 20_000
    assert endpoints.pretty(value) == text and endpoints.shortened(value).startswith("[[[[")


def test_record_text(spark):
    rows = [("synth", "b", "S"), ("body+synth", "b", "S"), ("body+synth", " ", "S"), ("body+synth", "b", ""), ("body", None, "S")]
    df = spark.createDataFrame(rows, "route string, body string, synth string")
    assert [r[0] for r in df.select(endpoints.record_text(F.col("route"), F.col("body"), F.col("synth"))).collect()] == ["S", "b\n\nS", "S", "b", ""]


PROPS = {
    "sidebars": {
        "docs": [{"title": "C", "slug": "c", "pages": [{"slug": "a", "title": "A", "pages": [{"slug": "b"}, {"slug": "h", "hidden": True, "pages": [{"slug": "lost"}]}]}, {"title": "no slug", "pages": [{"slug": "lost2"}]}, {"slug": "z", "title": "", "deprecated": True}]}],
        "refs": [{"pages": [{"slug": "r", "title": "R"}]}],
    },
    "changelogs": [{"slug": "v1", "title": "One", "body": "(changelog:v0) and (CHANGELOG:v2)"}, {"slug": "v2", "title": "listed too late"}, {"slug": "hid", "hidden": True, "body": "(changelog:v9)"}, {}],
}


def test_frontier(spark):
    pages = spark.createDataFrame([(json.dumps(PROPS), "https://h/", "s"), ("{", "https://h/", "s"), (None, "h", "s")], "props string, base_url string, section string")
    rows = trees.frontier(pages).orderBy("position").collect()
    assert [(r["slug"], r["url"], r["kind"], r["title"], r["parent_slug"], r["breadcrumb"]) for r in rows] == [
        ("a", "https://h/s/docs/a", "guide", "A", None, ["C", "A"]),
        ("b", "https://h/s/docs/b", "guide", "b", "a", ["C", "A", "b"]),
        ("z", "https://h/s/docs/z", "guide", "z", None, ["C", "z"]),
        ("r", "https://h/s/reference/r", "reference", "R", None, ["", "R"]),
        ("v1", "https://h/s/changelog/v1", "changelog", "One", None, ["Release Notes", "One"]),
        ("v0", "https://h/s/changelog/v0", "changelog", "v0", None, ["Release Notes", "v0"]),
        ("v2", "https://h/s/changelog/v2", "changelog", "v2", None, ["Release Notes", "v2"]),
    ]
    assert trees.frontier(pages, skip_hidden=False).filter("slug IN ('h', 'lost', 'hid', 'v9')").count() == 4


def test_collections(spark):
    request = {
        "method": "post", "description": "Makes it", "header": [{"key": "X-A"}, {"key": ""}, 3],
        "url": {"host": ["h", "com"], "path": ["v1", ":id", "x"], "query": [{"key": "q"}, {"key": None}], "variable": [{"key": "id"}]},
        "body": {"mode": "raw", "raw": '[{"b": 1, "a": 2}]'},
    }
    tree = {"item": [{"name": "F", "item": [{"name": "G", "item": [{"name": "deep", "request": request}]}, {"name": "text", "request": "GET x"}, "junk"]}, {"name": "top", "request": {"url": "/plain", "body": {"mode": "formdata", "formdata": [{"key": "f"}, {}]}}}]}
    rows = trees.api_entries(spark.createDataFrame([(json.dumps(tree),), ("{}",)], "collection string")).orderBy("position").collect()
    assert [r["bm25_text"] for r in rows] == ["F > G\ndeep\nPOST h.com/v1/:id/x\nMakes it\nHeaders: X-A\nQuery: q\nPath vars: id, id\nBody fields: b, a", "top\nGET /plain\nBody fields: f, "]
    assert rows[0]["folder_path"] == ["F", "G"] and rows[1]["tokens"] == ["top", "get", "plain", "body", "fields", "f"]
    bodies = [json.dumps({"mode": "raw", "raw": "{bad"}), json.dumps({"mode": "raw", "raw": "text"}), None]
    bare = spark.createDataFrame([(b,) for b in bodies], "body string").select(trees.body_keys(F.col("body")))
    assert [r[0] for r in bare.collect()] == [[], [], []]
    urls = [{"raw": "r", "host": ["h"]}, None, "{{base}}/x", {"host": "h.org", "path": "a/b"}, 7]
    tree = {"item": [{"request": {"url": u}} for u in urls]}
    rows = trees.api_entries(spark.createDataFrame([(json.dumps(tree),), ("{",)], "collection string")).orderBy("position").collect()
    assert [r["url"] for r in rows] == ["r", "", "{{base}}/x", "h.org/a/b", "7"]
    assert trees.unreadable(spark.createDataFrame([("{",), ("{}",), (None,)], "x string"), "x").first()[0] == 1


def test_internal_links(spark):
    body = "[a](doc:one) ![i](doc:img) [b](doc:one#x) [c](/s/reference/two?x#y) [d](https://h/s/docs/three/) [e](https://h/s/docs/a/b) [f](https://other/s/docs/no) [g](four) [h](changelog:v-1) [i](doc:one)"
    html = '<a href="/s/changelog/five">x</a> <a href=\'mailto:x\'>y</a>'
    rows = [("https://h/s/docs/here", body, html, "https://h/", "s"), ("https://h/s/docs/there", None, None, "https://h", "s")]
    found = links.internal_links(spark.createDataFrame(rows, "source_url string, body string, html string, base_url string, section string"))
    assert [(r["url"], r["kind"], r["slug"]) for r in found.orderBy("position").collect()] == [
        ("https://h/s/docs/one", "guide", "one"), ("https://h/s/reference/two", "reference", "two"), ("https://h/s/docs/three/", "guide", "three"),
        ("https://h/s/docs/four", "guide", "four"), ("https://h/s/changelog/v-1", "changelog", "v-1"), ("https://h/s/changelog/five", "changelog", "five"),
    ]


def test_crawl(spark):
    url = "https://h/s/docs/{}".format
    graph = {"a": "bc", "b": "d", "c": "da", "d": "e", "e": "", "x": "y"}
    web = spark.createDataFrame([(url(k), " ".join(f"[l](doc:{t})" for t in v), None, "https://h", "s", k != "d") for k, v in graph.items()], "source_url string, body string, html string, base_url string, section string, is_page boolean")
    fetch = lambda urls: web.join(urls.withColumnRenamed("url", "source_url"), "source_url", "left_semi")
    seeds = spark.createDataFrame([(url("a"),), (url("a"),)], "url string")
    assert sorted((r["url"][-1], r["round"]) for r in links.crawl(seeds, fetch).collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert links.crawl(seeds, fetch, most_pages=2).count() == 2


def test_extraction(spark):
    doc = {"slug": "", "title": "T", "body": "see (doc:x)\n\n\n\nend", "hidden": False, "type": "basic", "category": {"title": "C", "_id": "1"}, "updatedAt": "u"}
    page = lambda props: f'<script id="ssr-props" type="application/json">{json.dumps(props)}</script>'
    rows = [
        ("d", "guide", page({"doc": doc, "oasDefinition": {"paths": {"/a": {}}}})),
        ("r", "reference", page({"doc": doc, "oasDefinition": {"openapi": "3", "paths": {"/a": {}}, "x": 1}})),
        ("l", "changelog", page({"changelogs": [{"slug": "k", "body": "no"}, {"slug": "l", "title": "L", "body": "yes"}]})),
        ("c", "guide", page({"custompage": {"title": "CP", "html": "<b>", "fullscreen": True}})),
        ("n", "guide", page({"other": 1})),
        ("e", "guide", "<html>"),
    ]
    schema = "slug string, kind string, html string"
    fixed = {"source": "src", "section": "s", "base_url": "https://h", "url": "u", "title": "fallback"}
    df = spark.createDataFrame(rows, schema).withColumns({k: F.lit(v) for k, v in fixed.items()})
    df = df.withColumn("parent_slug", F.lit(None).cast("string")).withColumn("breadcrumb", F.array(F.lit("B"))).withColumn("hidden", F.lit(True)).withColumn("deprecated", F.lit(True))
    got = {r["slug"]: r for r in extract.extract_records(df).collect()}
    assert sorted(got) == ["c", "d", "l", "r"]
    assert got["d"]["body_md"] == "see (https://h/s/docs/x)\n\nend" and got["d"]["title"] == "T" and got["d"]["oas"] is None
    assert (got["d"]["hidden"], got["d"]["deprecated"], got["d"]["category"]["id"], got["d"]["raw_body_chars"]) == (False, True, "1", 18)
    assert json.loads(got["r"]["oas"]) == {"openapi": "3", "info": None, "servers": None, "paths": {"/a": {}}, "components": {}}
    assert (got["l"]["body_md"], got["l"]["title"], got["l"]["category"]["slug"]) == ("yes", "L", "changelog")
    assert (got["c"]["kind"], got["c"]["type"], got["c"]["html_chars"], got["c"]["fullscreen"]) == ("custompage", "custompage", 3, True)


def test_extraction_keeps_what_pages_hold_beside_the_body(spark):
    page = lambda props: f'<script id="ssr-props" type="application/json">{json.dumps(props)}</script>'
    rows = [
        ("a", page({"doc": {"body": "x", "reusableContent": [{"tag": "T", "body": "again"}], "tutorials": [{"slug": "how"}]}})),
        ("b", page({"doc": {"body": "x", "reusableContent": {}, "tutorials": []}})),
        ("c", page({"doc": {"body": "x"}})),
    ]
    fixed = {"kind": "guide", "source": "src", "section": "s", "base_url": "https://h", "url": "u", "title": "t", "parent_slug": ""}
    df = spark.createDataFrame(rows, "slug string, html string").withColumns({k: F.lit(v) for k, v in fixed.items()})
    df = df.withColumn("breadcrumb", F.array(F.lit("B"))).withColumn("hidden", F.lit(False)).withColumn("deprecated", F.lit(False))
    got = {r["slug"]: (r["reusable_content"], r["doc_tutorials"]) for r in extract.extract_records(df).collect()}
    assert [json.loads(x) for x in got["a"]] == [[{"tag": "T", "body": "again"}], [{"slug": "how"}]]
    assert got["b"] == got["c"] == (None, None)


def test_embedding_is_incremental(spark):
    texts = spark.createDataFrame([("a b",), ("c",), ("a b",), (None,), ("",)], "page_content string")
    first = embedding.embed(texts, embedding.hashing_encoder(16), "m").cache()
    rows = {r["text_hash"]: r["embedding"] for r in first.collect()}
    assert len(rows) == 3 and sorted(round(float(np.linalg.norm(v)), 3) for v in rows.values()) == [0.0, 1.0, 1.0]
    more = texts.union(spark.createDataFrame([("new",)], "page_content string"))
    assert embedding.embed(more, embedding.hashing_encoder(16), "m", stored=first).count() == 1
    assert embedding.embed(more, embedding.hashing_encoder(16), "other", stored=first).count() == 4


def test_service_encoder_batches_and_retries(monkeypatch):
    import urllib.error

    calls, waits = [], []
    monkeypatch.setattr(embedding.time, "sleep", waits.append)

    def post(body):
        sent = json.loads(body)["input"]
        calls.append(len(sent))
        if len(calls) == 1:
            raise urllib.error.HTTPError("u", 429, "slow", {"Retry-After": "7"}, None)
        return json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in enumerate(sent)][::-1]}).encode()

    out = embedding.http_encoder("u", "k", "m", 2, post=post)()(["x" * i for i in range(40)])
    assert calls == [32, 32, 8] and waits == [7.0] and out[:, 0].tolist() == [float(i) for i in range(40)]
    with pytest.raises(ValueError):
        embedding.http_encoder("u", "", "m", 2)


HITS = "rank int, title string, breadcrumb array<string>, url string, page_content string, kind string, score double"


def test_prompt_and_answer(spark):
    hits = spark.createDataFrame([(2, "", None, None, " second ", "guide", 0.1), (1, "T", ["A", "B"], "u", "first", "guide", 0.2)], HITS)
    ends = spark.createDataFrame([(1, "GET", "/x", "N", ["F", "G"], " line one\nline two "), (2, "PUT", "/y", "M", [], "")], "place int, method string, url string, name string, folder_path array<string>, description string")
    text = answering.prompt(" why? ", hits, ends).first()["prompt"]
    assert text == (
        f"{answering.SYSTEM}\n\n## Documentation\n[Source 1] Title: T  •  Section: A > B\nURL: u\n\nfirst\n---\n[Source 2] Title: (untitled)  •  Section: Documentation\nURL: \n\nsecond"
        "\n\n## Relevant API endpoint(s)\n- GET /x — N\n  Folder: F > G\n  line one\n- PUT /y — M\n\n## Question\nwhy?\n\n## Answer"
    )
    assert answering.NOTHING_FOUND in answering.prompt("q", hits.limit(0), ends.limit(0)).first()["prompt"]
    got = answering.answer("q", hits, ends, answering.quoting_model)
    assert got.answer.endswith("first") and [s["url"] for s in got.sources] == ["u", None] and got.relevant_endpoints[0] == {"name": "N", "method": "GET", "path": "/x", "description": "line one\nline two", "folder_path": ["F", "G"]}
    with pytest.raises(ValueError):
        answering.answer("", hits, ends, answering.quoting_model)
