import json
import threading
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellore import __main__ as cli
from tessellore.operators import answering, embedding, service, store
from tessellore.sources import tables


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    body = ["Rates are locked by the pricing desk.", "The webhook sends a signature.", None, "Pages of the list come in order. " * 90]
    rows = [(i, "s", f"https://h/{i}", b, "basic") for i, b in enumerate(body)]
    pages = spark.createDataFrame(rows, "page_id bigint, source string, url string, body_md string, type string")
    missing = [c.split()[0] for c in tables.RECORD_SCHEMA.replace("struct<title:string,slug:string,type:string,id:string>", "string").split(", ") if c.split()[0] not in pages.columns]
    pages = pages.withColumns({c: F.lit(None).cast("array<string>" if c == "breadcrumb" else "string") for c in missing})
    tree = {"item": [{"name": "Lock a rate", "request": {"method": "post", "url": "/rates/lock"}}, *({"name": f"Get {x}", "request": {"url": f"/{x}"}} for x in ("loan", "user", "form", "log"))]}
    return cli.build(spark, pages, spark.createDataFrame([(json.dumps(tree),)], "collection string"), path), path


def test_retrieve(spark, built):
    index, path = built
    encode = embedding.hashing_encoder(cli.DIMENSION)()
    hits = store.retrieve(index, "Who locks rates?", 2, encode).orderBy("rank").collect()
    assert hits[0]["page_id"] == 0 and hits[0]["sources"] == "semantic,bm25" and len(hits) == 2
    assert store.retrieve(index, "?!", 2).count() == 0  # no words, no vector
    many = store.retrieve(index, [store.Question("signature"), store.Question("desk", [0.0] * cli.DIMENSION), store.Question("none")]).collect()
    assert {(r["question"], r["page_id"]) for r in many} == {(0, 1), (1, 0)}
    with pytest.raises(ValueError):
        store.retrieve(index, "")
    with pytest.raises(ValueError):
        store.lexical_hits(index.lexical, [store.Question("x")] * (store.MOST_QUESTIONS + 1))
    assert [r["url"] for r in store.gated(index, "lock a rate").collect()] == ["/rates/lock"]
    assert spark.read.json(f"{path}/stats").first()["records_loaded"] == 4
    assert [np.frombuffer(r["packed"]).size for r in index.vectors.collect()] == [cli.DIMENSION] * index.vectors.count()


def test_a_store_is_read_where_it_was_built(spark, built):
    again = store.read_store(spark, built[1])
    assert again.payload.count() == built[0].payload.count() and again.lexical.corpus.first() == built[0].lexical.corpus.first()
    assert not embedding.exists(spark, built[1] + "/nothing")


def test_service(built):
    edge = service.Service(built[0], answering.quoting_model, embedding.hashing_encoder(cli.DIMENSION)())
    status, found = edge.handle("post", "/api/query/", json.dumps({"query": "lock rates pricing"}))
    assert status == 200 and "pricing desk" in found["answer"] and found["relevant_endpoints"][0]["path"] == "/rates/lock"
    server = service.serve(edge, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/health", timeout=20) as got:
        assert json.loads(got.read())["status"] == "healthy"
    server.shutdown()


def test_page_cache_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("https://h/", "<i>"), ("https://h/a/b?x", "<b>"), ("https://h/a/", "<a>"), ("https://h/n", None)], "url string, html string")
    assert tables.write_page_cache(pages, str(tmp_path)) == tables.write_page_cache(pages, str(tmp_path)) == 3
    assert {(r["cache_key"], r["html"]) for r in tables.read_page_cache(spark, str(tmp_path)).collect()} == {("_index", "<i>"), ("a/b", "<b>"), ("a/_index", "<a>")}
    assert tables.read_page_cache(spark, str(tmp_path / "none")).count() == 0


def test_embedding_resumes(spark, tmp_path):
    path, texts = str(tmp_path / "v"), spark.createDataFrame([(f"text {i % 9}",) for i in range(30)], "page_content string")
    make = embedding.hashing_encoder(8)
    assert embedding.embed_into(spark, path, texts.limit(0), make, "m").count() == 0
    assert embedding.embed_into(spark, path, texts, make, "m", rounds=3).count() == 9
    assert embedding.embed_into(spark, path, texts, make, "m").count() == 9
    with pytest.raises(ValueError):
        embedding.encoder_for("unknown")
