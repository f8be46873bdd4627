"""Queries over literal inputs whose results are known: what the test tables hold no input for.

Fetched pages with embedded JSON, deep sidebars, release notes, API collections and API documents are
given here as literals; the SQL gives the results that their definitions demand, as literals too.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellore.functions import text as T
from tessellore.operators import answering, chunking, embedding, endpoints, extract, links, records, service, trees
from tessellore.operators.nested import decode
from tessellore.sources import tables


def values_sql(columns: str, rows: list[tuple]) -> str:
    """Literal rows as SQL."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, list):
            return "[" + ", ".join(map(literal, x)) + "]::VARCHAR[]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def page(props: dict) -> str:
    return f'<html><script id="ssr-props" type="application/json">{json.dumps(props)}</script></html>'


DOC = {"slug": "", "title": "T", "body": "see (doc:x)\n\n\n\nend", "hidden": False, "type": "basic", "category": {"title": "C", "_id": "1"}, "updatedAt": "u", "reusableContent": [{"tag": "A"}]}
PAGES = [
    ("d", "guide", page({"doc": DOC, "oasDefinition": {"paths": {"/a": {}}}})),
    ("r", "reference", page({"doc": DOC, "oasDefinition": {"openapi": "3", "paths": {"/a": {}}, "x": 1}})),
    ("l", "changelog", page({"changelogs": [{"slug": "k", "body": "no"}, {"slug": "l", "title": "L", "body": "yes"}]})),
    ("c", "guide", page({"custompage": {"title": "CP", "html": "<b>", "fullscreen": True}})),
    ("n", "guide", page({"other": 1})),
    ("e", "guide", "<html>"),
    ("o", "guide", "<title>Login</title>"),
]


def _fetched(spark: SparkSession) -> DataFrame:
    fixed = {"source": "src", "section": "s", "base_url": "https://h", "url": "u", "title": "fallback"}
    df = spark.createDataFrame(PAGES, "slug string, kind string, html string").withColumns({k: F.lit(v) for k, v in fixed.items()})
    return df.withColumn("parent_slug", F.lit(None).cast("string")).withColumn("breadcrumb", F.array(F.lit("B"))).withColumn("hidden", F.lit(True)).withColumn("deprecated", F.lit(True))


def extract_pages(spark, sf_dir):
    """Records of guide, reference, changelog and custom pages; pages without data give none."""
    got = extract.extract_records(_fetched(spark))
    return got.select("slug", "kind", "title", "body_md", "type", "hidden", "deprecated", F.col("category.title").alias("category"), F.col("category.id").alias("category_id"), "raw_body_chars", F.col("oas").isNotNull().alias("has_oas"), "reusable_content", "html_chars", "fullscreen")


def embedded_json(spark, sf_dir):
    """Why a page gave no record, and whether it holds JSON."""
    return _fetched(spark).select("slug", records.page_class(F.col("html")).alias("reason"), records.embedded_props(F.col("html")).isNotNull().alias("has_props"))


SIDEBARS = {
    "sidebars": {
        "docs": [{"title": "C", "slug": "c", "pages": [{"slug": "a", "title": "A", "pages": [{"slug": "b", "pages": [{"slug": "deep", "title": "D"}]}, {"slug": "h", "hidden": True, "pages": [{"slug": "lost"}]}]}, {"title": "no slug", "pages": [{"slug": "lost2"}]}, {"slug": "z", "title": "", "deprecated": True}]}],
        "refs": [{"pages": [{"slug": "r", "title": "R"}]}],
    },
    "changelogs": [{"slug": "v1", "title": "One", "body": "(changelog:v0) and (CHANGELOG:v2)"}, {"slug": "v2", "title": "listed too late", "body": "(changelog:v3)"}, {"slug": "hid", "hidden": True, "body": "(changelog:v9)"}, {}],
}


def frontier_deep(spark, sf_dir):
    """A sidebar of three levels with hidden and nameless subtrees, and release notes."""
    rows = spark.createDataFrame([(json.dumps(SIDEBARS), "https://h/", "s"), ("{", "https://h/", "s"), (None, "h", "s")], "props string, base_url string, section string")
    return trees.frontier(rows).select("slug", "url", "kind", "title", "category_title", "parent_slug", "breadcrumb", "deprecated")


REQUEST = {
    "method": "post", "description": "Makes it", "header": [{"key": "X-A"}, {"key": ""}, 3],
    "url": {"host": ["h", "com"], "path": ["v1", ":id", "x"], "query": [{"key": "q"}, {"key": None}], "variable": [{"key": "id"}]},
    "body": {"mode": "raw", "raw": '[{"b": 1, "a": 2}]'},
}
COLLECTION = {"item": [
    {"name": "F", "item": [{"name": "G", "item": [{"name": "deep", "request": REQUEST}]}, {"name": "text", "request": "GET x"}, "junk"]},
    {"name": "top", "request": {"url": "{{base}}/plain", "body": {"mode": "formdata", "formdata": [{"key": "f"}, {}]}}},
    {"name": "form", "request": {"method": "put", "url": {"raw": "r", "host": "h"}, "body": {"mode": "urlencoded", "urlencoded": [{"key": "u"}]}}},
    {"name": "bad", "request": {"url": {"host": "h.org", "path": "a/b"}, "body": {"mode": "raw", "raw": "{bad"}}},
]}


def collection_keys(spark, sf_dir):
    """Requests of a collection with their header, query, path and body keys."""
    found = trees.api_entries(spark.createDataFrame([(json.dumps(COLLECTION),), ("{",), ("{}",)], "collection string"))
    return found.select("name", "method", "url", "description", "folder_path", "header_keys", "query_keys", "path_vars", "body_keys", "bm25_text")


def href_links(spark, sf_dir):
    """Internal links of a page's Markdown and of its href attributes."""
    body = "[a](doc:one) ![i](doc:img) [b](doc:one#x) [c](/s/reference/two?x#y) [d](https://h/s/docs/three/) [e](https://h/s/docs/a/b) [f](https://other/s/docs/no) [g](four) [h](changelog:v-1) [i](doc:one)"
    html = "<a href=\"/s/changelog/five\">x</a> <a href='mailto:x'>y</a>"
    rows = spark.createDataFrame([("https://h/s/docs/here", body, html, "https://h/", "s")], "source_url string, body string, html string, base_url string, section string")
    return links.internal_links(rows).select("url", "kind", "slug")


def link_bodies(spark, sf_dir):
    """The bodies in which links are looked for."""
    props = [{"doc": {"body": "a"}, "changelog": {"body": "b"}, "changelogs": [{"body": "c"}, {"body": ""}, {}], "custompage": {"body": "d"}}, {"doc": {}}]
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(props)], "i int, props string")
    return rows.select("i", links.link_body(F.col("props")).alias("body"))


def crawl_limited(spark, sf_dir):
    """Two seeds of three, and no links followed."""
    seeds = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "url string")
    return links.crawl(seeds, lambda urls: urls, limit=2)


OAS = {
    "paths": {
        "/a/{x}": {
            "get": {
                "summary": "Get it", "description": " Long ", "deprecated": True,
                "parameters": [{"name": "q", "in": "query", "required": True, "schema": {"type": "array", "items": {"type": "integer", "format": "int32"}}, "description": "a|b\nc"}, {"$ref": "#/components/parameters/P"}],
                "responses": {"200": {"description": "ok", "content": {"text/csv": {"schema": {"$ref": "#/components/schemas/S"}, "examples": {"one": {"summary": "first", "value": {"b": 1}}, "two": {"value": 1}}}}}, "404": {"content": {"a/b": {"schema": {}}}}},
            },
            "POST": {"requestBody": {"required": True, "content": {"text/csv": {"schema": {"$ref": "#/components/schemas/Gone"}, "example": "a,b"}}}},
            "x-extra": {"get": {}},
        }
    },
    "components": {"parameters": {"P": {"name": "p", "in": "header"}}, "schemas": {"S": {"anyOf": [{"$ref": "#/components/schemas/S"}]}}},
}
SAMPLES = {"examples": {"codes": [{"language": "CURL", "code": "curl x y"}, {"code": "{}"}]}, "results": {"codes": [{"status": 200, "language": "json", "code": '{"a": 1}'}, {"code": "null "}]}}
# a response is expanded as a whole and its schemas again, so a cycle shows one level more
RENDERED = """## GET /a/{x}

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

Content-Type: `text/csv`

##### Schema
```json
{
  "anyOf": [
    {
      "anyOf": [
        {
          "$ref": "#/components/schemas/S",
          "_cycle": true
        }
      ]
    }
  ]
}
```

##### Examples
###### one — first
```json
{
  "b": 1
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


### Code samples (rendered by ReadMe)

#### curl
```curl
curl x y
```

#### Response 200 — json
```json
{"a": 1}
```
"""


def render_document(spark, sf_dir):
    """An API document and its samples as Markdown."""
    rows = spark.createDataFrame([(1, json.dumps(OAS), json.dumps(SAMPLES)), (2, "{", "[]"), (3, None, None)], "i int, oas string, doc_api string")
    return rows.select("i", endpoints.synthesized(F.col("oas"), F.col("doc_api")).alias("markdown"))


TYPES = [({"type": "string", "format": "date"}, "string (date)"), ({"type": ["a", "null"]}, "a|null"), ({"anyOf": []}, "oneOf"), ({"allOf": []}, "allOf"), ({"type": "array", "items": {"type": "array"}}, "array<array<object>>"), ({}, "")]


def schema_labels(spark, sf_dir):
    """Labels of types, tables of large schemas, and long examples."""
    wide = {"properties": {f"f{i:03d}": {"type": "string", "description": "d" * 40} for i in range(100)}, "required": ["f001"]}
    lines = endpoints.schema_lines({"type": "array", "items": wide})
    rows = [(f"label {i}", endpoints.label_of(schema)) for i, (schema, _) in enumerate(TYPES)]
    rows += [("array", lines[0]), ("second row", lines[4]), ("rest", lines[-1]), ("example", endpoints.shortened("x" * 5000)[-32:])]
    return spark.createDataFrame(rows, "what string, text string")


def text_routes(spark, sf_dir):
    """A record's text from body and rendered document."""
    rows = [("synth", "b", "S"), ("body+synth", "b", "S"), ("body+synth", " ", "S"), ("body+synth", "b", ""), ("body", None, "S")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, route string, body string, synth string")
    return df.select("i", endpoints.record_text(F.col("route"), F.col("body"), F.col("synth")).alias("text"))


def splitter(spark, sf_dir):
    """Texts split at the strongest separator that fits, with overlap, and merged while small."""
    cases = [("a" * 10, 4, 0), ("ab cd ef gh", 6, 0), ("one two three four", 9, 4), ("p1\n\np2\n\np3", 6, 0)]
    rows = [(i, n, piece) for i, (text, size, overlap) in enumerate(cases) for n, piece in enumerate(chunking.split_text(text, size, overlap))]
    return spark.createDataFrame(rows, "i int, n int, piece string")


def settings_from_env(spark, sf_dir):
    """Settings by default and from the environment."""
    given = [tables.Settings.from_env({}), tables.Settings.from_env({"VECTOR_STORE_PATH": "/x", "RETRIEVAL_K": "7", "RRF_K": "10", "RRF_INPUT_DEPTH": "30"})]
    return spark.createDataFrame([(i, s.store, s.retrieval_k, s.rrf_k, s.depth) for i, s in enumerate(given)], "i int, store string, k int, rrf_k int, depth int")


def refused(spark, sf_dir):
    """What is refused at once: an empty question, an unknown backend, a service without key."""
    hits = spark.createDataFrame([], "rank int")
    calls = {"question": lambda: answering.answer("", hits, None, answering.quoting_model), "backend": lambda: embedding.encoder_for("other"), "key": lambda: embedding.encoder_for("http", url="u", key="", model="m", dimension=2)}

    def outcome(call) -> str:
        try:
            call()
        except ValueError:
            return "refused"
        return "taken"

    return spark.createDataFrame([(k, outcome(call)) for k, call in calls.items()], "what string, outcome string")


def question_vector(spark, sf_dir):
    """A question is embedded like a passage of the same words, and scaled to length one."""
    make = embedding.hashing_encoder(32)
    asked = embedding.embed_question(make, "How are rates locked?")
    passage = [float(x) for x in make()(["how are rates locked?"])[0]]
    return spark.createDataFrame([(len(asked), asked == passage, round(sum(x * x for x in asked), 5))], "numbers int, same boolean, squares double")


def answer_parts(spark, sf_dir):
    """The prompt with an endpoint block, and the projections of a response."""
    hits = spark.createDataFrame([(2, "", None, None, " second ", "guide", 0.1), (1, "T", ["A", "B"], "u", "first", "guide", 0.2)], "rank int, title string, breadcrumb array<string>, url string, page_content string, kind string, score double")
    ends = spark.createDataFrame([(1, "GET", "/x", "N", ["F", "G"], " line one\nline two "), (2, "PUT", "/y", "M", [], "")], "place int, method string, url string, name string, folder_path array<string>, description string")
    got = answering.answer(" why? ", hits, ends, answering.quoting_model)
    rows = [("prompt", answering.prompt(" why? ", hits, ends).first()["prompt"]), ("answer", got.answer), *((f"source {i}", f"{s['title']}|{s['url']}|{s['preview']}") for i, s in enumerate(got.sources)), *((f"endpoint {i}", f"{e['method']} {e['path']} {e['name']} {e['description']}") for i, e in enumerate(got.relevant_endpoints))]
    return spark.createDataFrame(rows, "part string, text string")


def service_responses(spark, sf_dir):
    """Statuses of requests that are fine, not understood, or fail behind the edge."""
    edge = service.Service(None, answering.quoting_model)
    asked = [("POST", "/api/query", "{}"), ("POST", "/api/query", '{"query": ""}'), ("POST", "/api/query", "["), ("POST", "/api/query", '{"query": "x"}'), ("GET", "/api/health", ""), ("GET", "/api/config/", ""), ("GET", "/", "")]
    return spark.createDataFrame([(i, edge.handle(*a)[0]) for i, a in enumerate(asked)], "i int, status int")


def double_encoded(spark, sf_dir):
    """Documents encoded twice, cut off, or nested beyond the parser's stack are read or left out."""
    deep = '{"a": ' * 20_000 + "1" + "}" * 20_000
    texts = [json.dumps(json.dumps({"a": 1})), '{"a": 1', "[1]", deep, " "]
    return spark.createDataFrame([(i, decode(t) is not None) for i, t in enumerate(texts)], "i int, readable boolean")


QUERIES = {f.__name__: f for f in (
    extract_pages, embedded_json, frontier_deep, collection_keys, href_links, link_bodies, crawl_limited, render_document, schema_labels, text_routes,
    splitter, settings_from_env, refused, question_vector, answer_parts, service_responses, double_encoded,
)}

_GUIDE = ("see (https://h/s/docs/x)\n\nend", "basic", False, True, "C", "1", 18)
_PROMPT = (
    f"{answering.SYSTEM}\n\n## Documentation\n[Source 1] Title: T  •  Section: A > B\nURL: u\n\nfirst\n---\n[Source 2] Title: (untitled)  •  Section: Documentation\nURL: \n\nsecond"
    "\n\n## Relevant API endpoint(s)\n- GET /x — N\n  Folder: F > G\n  line one\n- PUT /y — M\n\n## Question\nwhy?\n\n## Answer"
)
ORACLE = {
    "extract_pages": values_sql("slug, kind, title, body_md, type, hidden, deprecated, category, category_id, raw_body_chars, has_oas, reusable_content, html_chars, fullscreen", [
        ("d", "guide", "T", *_GUIDE, False, '[{"tag":"A"}]', None, None),
        ("r", "reference", "T", *_GUIDE, True, '[{"tag":"A"}]', None, None),
        ("l", "changelog", "L", "yes", None, True, True, "Release Notes", None, 3, False, None, None, None),
        ("c", "custompage", "CP", "", "custompage", True, True, None, None, 0, False, None, 3, True),
    ]),
    "embedded_json": values_sql("slug, reason, has_props", [*((s, "no_doc_or_custompage", True) for s in "drlcn"), ("e", "no_ssr_props", False), ("o", "auth_required (login page returned)", False)]),
    "frontier_deep": values_sql("slug, url, kind, title, category_title, parent_slug, breadcrumb, deprecated", [
        ("a", "https://h/s/docs/a", "guide", "A", "C", None, ["C", "A"], False),
        ("b", "https://h/s/docs/b", "guide", "b", "C", "a", ["C", "A", "b"], False),
        ("deep", "https://h/s/docs/deep", "guide", "D", "C", "b", ["C", "A", "b", "D"], False),
        ("z", "https://h/s/docs/z", "guide", "z", "C", None, ["C", "z"], True),
        ("r", "https://h/s/reference/r", "reference", "R", None, None, ["", "R"], False),
        ("v1", "https://h/s/changelog/v1", "changelog", "One", "Release Notes", None, ["Release Notes", "One"], False),
        ("v0", "https://h/s/changelog/v0", "changelog", "v0", "Release Notes", None, ["Release Notes", "v0"], False),
        ("v2", "https://h/s/changelog/v2", "changelog", "v2", "Release Notes", None, ["Release Notes", "v2"], False),
    ]),
    "collection_keys": values_sql("name, method, url, description, folder_path, header_keys, query_keys, path_vars, body_keys, bm25_text", [
        ("deep", "POST", "h.com/v1/:id/x", "Makes it", ["F", "G"], ["X-A"], ["q"], ["id", "id"], ["b", "a"], "F > G\ndeep\nPOST h.com/v1/:id/x\nMakes it\nHeaders: X-A\nQuery: q\nPath vars: id, id\nBody fields: b, a"),
        ("top", "GET", "{{base}}/plain", "", [], [], [], [], ["f", ""], "top\nGET {{base}}/plain\nBody fields: f, "),
        ("form", "PUT", "r", "", [], [], [], [], ["u"], "form\nPUT r\nBody fields: u"),
        ("bad", "GET", "h.org/a/b", "", [], [], [], [], [], "bad\nGET h.org/a/b"),
    ]),
    "href_links": values_sql("url, kind, slug", [
        ("https://h/s/docs/one", "guide", "one"), ("https://h/s/reference/two", "reference", "two"), ("https://h/s/docs/three/", "guide", "three"),
        ("https://h/s/docs/four", "guide", "four"), ("https://h/s/changelog/v-1", "changelog", "v-1"), ("https://h/s/changelog/five", "changelog", "five"),
    ]),
    "link_bodies": values_sql("i, body", [(0, "a\n\nb\n\nc\n\nd"), (1, "")]),
    "crawl_limited": values_sql("url, round", [("a", 0), ("b", 0)]),
    "render_document": values_sql("i, markdown", [(1, RENDERED), (2, ""), (3, "")]),
    "schema_labels": values_sql("what, text", [
        *((f"label {i}", label) for i, (_, label) in enumerate(TYPES)), ("array", "_Array of:_"), ("second row", f"| `f001` | string | yes | {'d' * 40} |"),
        ("rest", "_(50 more field(s) omitted; see full schema in OAS)_"), ("example", "\n... (truncated, 1,002 more chars)"[-32:]),
    ]),
    "text_routes": values_sql("i, text", list(enumerate(["S", "b\n\nS", "S", "b", ""]))),
    "splitter": values_sql("i, n, piece", [
        (0, 0, "aaaa"), (0, 1, "aaaa"), (0, 2, "aa"), (1, 0, "ab cd"), (1, 1, "ef gh"), (2, 0, "one two"), (2, 1, "three"), (2, 2, "four"), (3, 0, "p1\n\np2"), (3, 1, "p3"),
    ]),
    "settings_from_env": values_sql("i, store, k, rrf_k, depth", [(0, None, 5, 60, 20), (1, "/x", 7, 10, 30)]),
    "refused": values_sql("what, outcome", [("question", "refused"), ("backend", "refused"), ("key", "refused")]),
    "question_vector": values_sql("numbers, same, squares", [(32, True, 1.0)]).replace(", 1.0)", ", 1.0::DOUBLE)"),
    "answer_parts": values_sql("part, text", [("prompt", _PROMPT), ("answer", "Title: T  •  Section: A > B\nURL: u\n\nfirst"), ("source 0", "T|u|first"), ("source 1", "|None| second "), ("endpoint 0", "GET /x N line one\nline two"), ("endpoint 1", "PUT /y M ")]),
    "service_responses": values_sql("i, status", list(enumerate([422, 422, 422, 500, 200, 200, 404]))),
    "double_encoded": values_sql("i, readable", [(0, True), (1, False), (2, False), (3, True), (4, False)]),
}
