"""The stored index: built once as Parquet, then asked many questions.

A store is a folder with the lexical index (postings clustered by term, term statistics, one row of
corpus statistics), unit vectors in packed form, the payload of the chunks, the endpoints' own lexical
index and tokens, and a row of build counters as JSON. Postings are written first; all statistics come
from them, so texts are tokenized once. A question reads the postings of its terms (the term list
reaches the scan as a filter), the vectors once, and the payload of its hits.

Questions come in batches of at most `MOST_QUESTIONS`: their terms and vectors are what is broadcast, so
that bound is the broadcast's. All of a batch are scored in one pass.

Defined results: null texts count as documents without tokens; vectors that are null, of another length,
all zero or not finite are left out; a question without tokens has no lexical hits, one without a vector
no dense hits; scores are rounded to six digits before ranking, ties go to the smaller id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellore.functions import text as T
from tessellore.operators import scoring

MOST_QUESTIONS = 10_000
PACKED_FILES = 64


@dataclass(frozen=True)
class Question:
    """A question with its vector in the space of the stored vectors, if it has one."""

    text: str
    vector: Sequence[float] | None = None


@dataclass(frozen=True)
class Store:
    lexical: scoring.LexicalIndex
    vectors: DataFrame  # id, packed
    payload: DataFrame  # the chunks
    endpoints: scoring.LexicalIndex | None
    entries: DataFrame | None  # id, tokens and the endpoints' payload


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            rows = np.array(batch["v"].tolist(), dtype=np.float64)
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.DataFrame({"id": batch["id"], "packed": [r.tobytes() for r in rows]})


def packed_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    """id and the vector scaled to length one, as packed doubles."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & scoring.usable_vector(v, dimension))
    return rows.filter(F.forall(v, lambda x: F.abs(x) < F.lit(float("inf")))).mapInPandas(_pack, "id bigint, packed binary")


def write_lexical(docs: DataFrame, path: str, id_col: str, text_col: str) -> scoring.LexicalIndex:
    """Store the lexical index of a corpus; the statistics are taken from the stored postings."""
    spark = docs.sparkSession
    scoring.postings_of(docs, id_col, text_col).repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    scoring.term_statistics(postings).write.mode("overwrite").parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    sizes = terms.agg(F.lit(docs.count()).cast("bigint").alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("tokens"))
    scoring.corpus_statistics(terms, sizes).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    return scoring.LexicalIndex.read(spark, path)


def write_store(path: str, chunks: DataFrame, vectors: DataFrame, dimension: int, stats: DataFrame | None = None, entries: DataFrame | None = None) -> Store:
    """Build a store from chunks (chunk_id, page_content and payload), their vectors (chunk_id, embedding), a row of counters, and endpoints (id, searched and payload)."""
    write_lexical(chunks, f"{path}/lexical", "chunk_id", "page_content")
    packed_vectors(vectors, "chunk_id", "embedding", dimension).write.mode("overwrite").parquet(f"{path}/vectors")
    chunks.withColumnRenamed("chunk_id", "id").write.mode("overwrite").parquet(f"{path}/payload")
    if entries is not None:
        write_lexical(entries, f"{path}/endpoints", "id", "searched")
        entries.withColumn("tokens", T.tokens(F.col("searched"))).write.mode("overwrite").parquet(f"{path}/entries")
    if stats is not None:
        stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return read_store(chunks.sparkSession, path, entries is not None)


def read_store(spark: SparkSession, path: str, with_endpoints: bool = True) -> Store:
    read = spark.read.parquet
    endpoints = scoring.LexicalIndex.read(spark, f"{path}/endpoints") if with_endpoints else None
    return Store(scoring.LexicalIndex.read(spark, f"{path}/lexical"), read(f"{path}/vectors"), read(f"{path}/payload"), endpoints, read(f"{path}/entries") if with_endpoints else None)


def _checked(questions: Sequence[Question]) -> Sequence[Question]:
    if len(questions) > MOST_QUESTIONS:
        raise ValueError(f"more than {MOST_QUESTIONS} questions at once")
    return questions


def best_of(scores: DataFrame, n: int) -> DataFrame:
    """question, id, score and rank of the n best rows of each question; each task keeps n before the shuffle."""
    order = W.partitionBy("question").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def lexical_hits(index: scoring.LexicalIndex, questions: Sequence[Question], n: int = scoring.RRF_DEPTH) -> DataFrame:
    """question (its number), id, score, rank of the n best rows with a score above zero."""
    spark = index.postings.sparkSession
    wanted = [(i, t, c) for i, q in enumerate(_checked(questions)) for t, c in sorted(Counter(T.question_tokens(q.text)).items())]
    names = sorted({t for _, t, _ in wanted})
    asked = spark.createDataFrame(wanted, "question int, term string, qtf int")
    weights = asked.join(scoring.term_weights(index, names), "term")
    hits = index.postings.filter(F.col("term").isin(names)).join(F.broadcast(weights), "term")  # the questions' terms: bounded by MOST_QUESTIONS
    scores = hits.groupBy("question", "row", "id").agg(F.round(F.sum(F.col("qtf") * scoring.term_part()), scoring.DIGITS).alias("score"))
    return best_of(scores.filter("score > 0").select("question", "id", "score"), n)


def _dense(numbers: np.ndarray, queries: np.ndarray, n: int):
    """The n best of each batch for each question."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            ids = batch["id"].to_numpy()
            scores = np.round(np.frombuffer(b"".join(batch["packed"]), dtype=np.float64).reshape(len(batch), -1) @ queries.T, scoring.DIGITS)
            for number, column in zip(numbers, scores.T):
                best = np.lexsort((ids, -column))[:n]
                yield pd.DataFrame({"question": number, "id": ids[best], "score": column[best]})

    return search


def dense_hits(vectors: DataFrame, questions: Sequence[Question], n: int = scoring.RRF_DEPTH) -> DataFrame:
    """question, id, score, rank of the n rows of largest inner product with each question's vector."""
    with_vector = [(i, np.asarray(q.vector, dtype=np.float64)) for i, q in enumerate(_checked(questions)) if q.vector is not None and np.any(q.vector)]
    if not with_vector:
        return vectors.sparkSession.createDataFrame([], "question int, id bigint, score double, rank int")
    queries = np.array([v / np.linalg.norm(v) for _, v in with_vector])
    return best_of(vectors.mapInPandas(_dense(np.array([i for i, _ in with_vector], dtype=np.int32), queries, n), "question int, id bigint, score double"), n)


def fused_hits(store: Store, questions: Sequence[Question], k: int = scoring.RETRIEVAL_K) -> DataFrame:
    """question, id, score, sources, rank: the two rankings of each question fused by reciprocal ranks."""
    return scoring.fuse_all(dense_hits(store.vectors, questions), lexical_hits(store.lexical, questions), k)


def retrieve(store: Store, question: str | Sequence[Question], k: int = scoring.RETRIEVAL_K, encode: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """The k best chunks for a question, or for each of several, with payload, score, sources and rank.

    ``encode`` gives the vector of a plain question; without it only its words count.
    """
    if isinstance(question, str):
        if not question:
            raise ValueError("an empty question")
        question = [Question(question, None if encode is None else encode([question])[0].tolist())]
    hits = fused_hits(store, question, k)
    return store.payload.join(F.broadcast(hits), "id")  # k rows for each question


def gated(store: Store, question: str) -> DataFrame:
    """The endpoints worth showing for a question, with their payload."""
    found = scoring.gate(store.endpoints, store.entries.select("id", "tokens"), question)
    return store.entries.drop("tokens").join(F.broadcast(found), "id")  # three rows at most
