"""Command line: build a store from records and collections, ask it, or serve it.

    python -m tessellore build --records pages.jsonl --collections collections/ --store STORE
    python -m tessellore ask --store STORE "How are rates locked?"
    python -m tessellore serve --store STORE --port 8000
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellore.operators import answering, chunking, embedding, endpoints, records, service, store, trees
from tessellore.sources import tables

DIMENSION = 64


def build(spark: SparkSession, rows: DataFrame, collections: DataFrame | None, path: str) -> store.Store:
    """A store from page records (with page_id) and API collections, embedded by the offline encoder."""
    kept = records.text_route(records.deduplicated(records.indexable(rows)))
    wanted = F.col("route") != "body"
    synth = endpoints.synthesized(F.when(wanted, F.col("oas")), F.when(wanted, F.col("doc_api")))
    texts = kept.withColumn("synth", synth).withColumn("record_text", endpoints.record_text(F.col("route"), F.col("body_md"), F.col("synth")))
    chunks = chunking.chunk_records(texts).withColumn("chunk_id", F.xxhash64("page_id", "chunk_index"))
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    made = embedding.embed_into(spark, f"{path}/embeddings", chunks, embedding.hashing_encoder(DIMENSION), f"hashing-{DIMENSION}")
    vectors = chunks.select("chunk_id", F.sha2("page_content", 256).alias("text_hash")).join(made, "text_hash")
    entries = None
    if collections is not None:
        entries = trees.api_entries(collections).select(F.xxhash64("position", "bm25_text").alias("id"), F.col("bm25_text").alias("searched"), "name", "method", "url", "folder_path", "description")
    return store.write_store(path, chunks, vectors, DIMENSION, records.build_stats(rows, chunks), entries)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessellore")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "ask", "serve"):
        commands.add_parser(name).add_argument("--store")
    commands.choices["build"].add_argument("--records", required=True)
    commands.choices["build"].add_argument("--collections")
    commands.choices["ask"].add_argument("question")
    commands.choices["serve"].add_argument("--port", type=int, default=8000)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tessellore").getOrCreate()
    settings = tables.Settings.from_env()
    if given.command == "build":
        rows = tables.read_jsonl(spark, given.records).withColumn("page_id", F.xxhash64("url", "body_md"))
        build(spark, rows, tables.read_collections(spark, given.collections) if given.collections else None, given.store)
        return
    path = given.store or tables.locate_store(settings)
    index = store.read_store(spark, path, embedding.exists(spark, f"{path}/entries"))
    edge = service.Service(index, answering.quoting_model, embedding.hashing_encoder(DIMENSION)(), settings)
    if given.command == "ask":
        print(json.dumps(asdict(edge.ask(given.question)), default=str, ensure_ascii=False))
    else:
        service.serve(edge, port=given.port).serve_forever()


if __name__ == "__main__":
    main()
