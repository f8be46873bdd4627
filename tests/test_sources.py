import json

import pytest

from tessellore import runtime
from tessellore.sources import http, tables
from tessellore.streaming import ingest


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"url": "u", "slug": "s", "oas": null, "breadcrumb": ["a"]}\n\n{"url": "v", "hidden": true}\n')
    rows = tables.read_jsonl(spark, str(good)).orderBy("url").collect()
    assert [(r["url"], r["slug"], r["hidden"], r["breadcrumb"]) for r in rows] == [("u", "s", None, ["a"]), ("v", None, True, None)]
    tables.write_jsonl(tables.read_jsonl(spark, str(good)), str(tmp_path / "out"))
    assert tables.read_jsonl(spark, str(tmp_path / "out")).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"url": \n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        tables.read_jsonl(spark, str(bad)).collect()


def test_page_cache(spark, tmp_path):
    (tmp_path / "s" / "docs").mkdir(parents=True)
    (tmp_path / "s" / "docs" / "a.html").write_text("<b>a\nx</b>")
    (tmp_path / "s" / "docs" / "_index.html").write_text("index")
    cache = tables.read_page_cache(spark, str(tmp_path))
    urls = spark.createDataFrame([("https://h/s/docs/a?q#f",), ("https://h/s/docs/",), ("https://h/gone",)], "url string")
    got = {r["url"]: (r["html"], r["cache_hit"]) for r in tables.cached_pages(urls, cache).collect()}
    assert got == {"https://h/s/docs/a?q#f": ("<b>a\nx</b>", True), "https://h/s/docs/": ("index", True), "https://h/gone": (None, False)}


def test_fetch_retries():
    waits = []
    answers = {"ok": [(503, ""), (200, "x")], "gone": [(404, "")], "down": [(500, "")] * 9, "net": [OSError("no route"), (200, "y")], "dead": [OSError("z" * 500)] * 9}

    def get(url):
        found = answers[url].pop(0)
        if isinstance(found, Exception):
            raise found
        return found

    got = {u: http.fetch_one(u, get, waits.append) for u in list(answers)}
    assert got["ok"] == (200, "x", None) and got["gone"] == (404, "", "http 404") and got["net"][:2] == (200, "y")
    assert got["down"] == (500, "", "http 500 after 4 attempts") and len(got["dead"][2]) == 300
    assert len(waits) == 1 + 0 + 3 + 1 + 3 and all(1 <= w <= 31 for w in waits)


def test_fetch_table(spark):
    urls = spark.createDataFrame([("a", None), ("b", "cached")], "url string, html string")
    got = {r["url"]: r for r in http.fetch(urls, lambda u: (404, ""), delay=0).collect()}
    assert (got["a"]["http_status"], got["a"]["cache_hit"], got["a"]["body_hash"]) == (404, False, None)
    assert (got["b"]["html"], got["b"]["cache_hit"]) == ("cached", True)


def test_store_location(tmp_path):
    settings = tables.Settings.from_env({"VECTOR_STORE_PATH": str(tmp_path), "RETRIEVAL_K": "7"})
    assert tables.locate_store(settings) == str(tmp_path) and settings.retrieval_k == 7
    with pytest.raises(FileNotFoundError):
        tables.locate_store(tables.Settings(store=str(tmp_path / "none")))
    assert tables.locate_store(tables.Settings(), here=str(tmp_path), remote="r") == "r"
    (tmp_path / "vector_store").mkdir()
    assert tables.locate_store(tables.Settings(), here=str(tmp_path)).endswith("vector_store")


def test_settings_of_a_file(tmp_path):
    (tmp_path / ".env").write_text("# a note\n\nexport RETRIEVAL_K=9\nVECTOR_STORE_PATH='/x y'\nno value\n")
    found = tables.Settings.from_env({"RETRIEVAL_K": "3"}, str(tmp_path / ".env"))
    assert (found.store, found.retrieval_k, found.rrf_k) == ("/x y", 3, 60)
    assert tables.read_env_file(str(tmp_path / "none")) == {}


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    schema = "page_id bigint, type string, discovered_via string, url string, body_md string"
    batch = spark.createDataFrame([(1, "basic", None, "u", "x"), (2, "basic", None, "v", " ")], schema)
    for _ in range(2):
        ingest.add_batch(batch, str(tmp_path / "s"), 4)
    ingest.add_batch(batch, str(tmp_path / "s"), 5)
    assert sorted((r["batch"], r["page_id"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(4, 1), (4, 2), (5, 2)]


def test_streaming_ingest(spark, tmp_path):
    schema = "page_id bigint, type string, discovered_via string, url string, body_md string"
    first = [(1, "basic", None, "u", "x"), (2, "basic", None, "v", "x"), (3, None, None, "w", ""), (4, "custompage", None, "q", "y")]
    spark.createDataFrame(first, schema).write.parquet(str(tmp_path / "in"))
    go = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "state"), schema).awaitTermination()
    go()
    assert sorted(r["page_id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 3]
    spark.createDataFrame([(5, "basic", None, "a", "x"), (6, "basic", None, "b", "new"), (7, "basic", None, "c", "")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    go()
    assert sorted(r["page_id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 3, 6, 7]


def test_manifest_windows_on_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00' AS fetched_at, 'u' AS url, 200 AS http_status, CAST(NULL AS STRING) AS error, true AS cache_hit UNION ALL SELECT TIMESTAMP_NTZ'2024-03-01 10:00:00', 'u', 404, 'x', false")
    rows.write.parquet(str(tmp_path / "m"))
    stream = ingest.manifest_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "m")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = ingest.manifest_windows(rows)
    assert sorted(r["outcome"] for r in batch.collect()) == ["bad_status", "cached"]
    assert [r["outcome"] for r in spark.table("windows").collect()] == ["cached"]  # the later day is not closed yet


def test_reading_collections(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"item": []}, indent=2))
    assert json.loads(tables.read_collections(spark, str(tmp_path)).first()["collection"]) == {"item": []}


def test_few_keys_are_spread_over_partitions(spark):
    for count in (1, 2, 7, 30):
        keys = spark.range(count)
        n = runtime.even_partitions(keys, count)
        held = [x for x in keys.repartition(n, "id").rdd.glom().map(len).collect() if x]
        assert count <= n <= 4 * count + 50 and max(held) <= 2 and sum(held) == count
    assert max(len(x) for x in spark.range(2).repartition(runtime.even_partitions(spark.range(2), 2), "id").rdd.glom().collect()) == 1
    assert runtime.even_partitions(spark.range(0), 0) == 1 and runtime.even_partitions(spark.range(5_000), 5_000) == 5_000
