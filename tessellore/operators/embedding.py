"""Embedding with pluggable encoders, incremental by content hash and model.

An encoder is a factory made once per worker task: ``make() -> encode(list of texts) -> array [n, d]``.
`hashing_encoder` needs no model and no network; it stands in for a language model in tests and is not
one. `http_encoder` posts batches to an embedding service and retries with growing pauses.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the embedding service.
RETRY_STATUS = (429, 500, 502, 503, 504)
ATTEMPTS, MOST_PAUSE, API_BATCH = 6, 30.0, 32
PASSAGE, QUESTION = "retrieval.passage", "retrieval.query"

Encoder = Callable[[list[str]], np.ndarray]
VECTORS = "text_hash string, model_tag string, embedding array<float>"


def hashing_encoder(dimension: int = 64, task: str = PASSAGE) -> Callable[[], Encoder]:
    """Signed feature hashing of words and word pairs, scaled to length one; the task doesn't matter."""

    def make() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension), dtype=np.float32)
            for i, text in enumerate(texts):
                words = text.lower().split()
                for feature in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))):
                    h = zlib.crc32(feature.encode("utf-8", "surrogatepass"))
                    out[i, (h >> 1) % dimension] += 1.0 if h & 1 else -1.0
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, length, out=out, where=length > 0)

        return encode

    return make


def http_encoder(url: str, key: str, model: str, dimension: int, task: str = PASSAGE, post: Callable | None = None) -> Callable[[], Encoder]:
    """An encoder behind a service; a missing key is refused at once."""
    if not key:
        raise ValueError("the embedding service needs a key")

    def send(body: bytes) -> bytes:
        request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=120) as answer:
            return answer.read()

    def make() -> Encoder:
        def batch(texts: list[str]) -> list:
            body = json.dumps({"model": model, "task": task, "normalized": True, "input": texts}).encode()
            for attempt in range(ATTEMPTS):
                try:
                    rows = json.loads((post or send)(body))["data"]
                    return [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]
                except urllib.error.HTTPError as error:
                    if error.code not in RETRY_STATUS or attempt == ATTEMPTS - 1:
                        raise
                    wait = float(error.headers.get("Retry-After") or min(2.0**attempt, MOST_PAUSE) + random.random())
                except urllib.error.URLError:
                    if attempt == ATTEMPTS - 1:
                        raise
                    wait = min(2.0**attempt, MOST_PAUSE) + random.random()
                time.sleep(wait)
            raise RuntimeError("unreachable")

        def encode(texts: list[str]) -> np.ndarray:
            rows = [v for at in range(0, len(texts), API_BATCH) for v in batch(texts[at : at + API_BATCH])]
            return np.array(rows, dtype=np.float32).reshape(len(rows), dimension)

        return encode

    return make


def encoder_for(backend: str, **settings) -> Callable[[], Encoder]:
    """The encoder of a backend by its name; an unknown one is refused at once."""
    known = {"hashing": hashing_encoder, "http": http_encoder}
    if backend not in known:
        raise ValueError(f"unknown embedding backend {backend!r}; there are {', '.join(sorted(known))}")
    return known[backend](**settings)


def embed_question(make: Callable[[], Encoder], question: str) -> list[float]:
    """The vector of one question."""
    return [float(x) for x in make()([question])[0]]


def _encode(make: Callable[[], Encoder], tag: str, batch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for part in batches:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                yield pd.DataFrame({"text_hash": rows["text_hash"], "model_tag": tag, "embedding": [v.tolist() for v in encode(rows["text"].tolist())]})

    return run


def embed(texts: DataFrame, make: Callable[[], Encoder], tag: str, text_col: str = "page_content", stored: DataFrame | None = None, batch: int = 256) -> DataFrame:
    """text_hash, model_tag, embedding of every distinct text that ``stored`` doesn't have for this model.

    Written beside ``stored``, the result makes the next run cheaper; an interrupted run loses only what
    it hadn't written.
    """
    rows = texts.filter(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col), 256).alias("text_hash"), F.col(text_col).alias("text")).dropDuplicates(["text_hash"])
    if stored is not None:
        rows = rows.join(stored.filter(F.col("model_tag") == tag).select("text_hash"), "text_hash", "left_anti")
    return rows.mapInPandas(_encode(make, tag, batch), VECTORS)


def embed_into(spark: SparkSession, path: str, texts: DataFrame, make: Callable[[], Encoder], tag: str, text_col: str = "page_content", rounds: int = 1) -> DataFrame:
    """Add the vectors that the table at ``path`` lacks, in rounds that are committed one by one, and read it.

    An interrupted call loses the round it was in; the next call goes on from there. A round is the texts
    whose hash falls into its share.
    """
    for number in range(rounds):
        there = read_vectors(spark, path)
        part = texts.filter(F.pmod(F.xxhash64(text_col), F.lit(rounds)) == number)
        embed(part, make, tag, text_col, there).write.mode("append").parquet(path)
    return read_vectors(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vectors stored at ``path``; none where nothing is stored yet."""
    return spark.read.schema(VECTORS).parquet(path) if exists(spark, path) else spark.createDataFrame([], VECTORS)
