"""Lexical and dense scoring, rank fusion, and the gate for endpoints.

The lexical index is three tables (postings, term statistics, one row of corpus statistics), so a
query joins its few terms to their postings and reads nothing else. Scores are rounded to six digits
before ranking and ties go to the smaller id, which makes ranks independent of summation order.

Defined results: null texts count as documents without tokens; a question without tokens matches
nothing; unknown terms add nothing; repeated question tokens count repeatedly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellore.functions import text as T

# Parameters of the lexical score, of the fusion and of the gate.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, RRF_DEPTH, RETRIEVAL_K = 60, 20, 5
GATE_TOP, GATE_OVERLAP, GATE_RATIO, GATE_MOST = 5, 0.3, 2.0, 3
DIGITS = 6


@dataclass(frozen=True)
class LexicalIndex:
    """postings (term, id, tf, dl), terms (term, df, total), corpus (docs, tokens, avgdl, avg_idf)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def write(self, path: str, partitions: int | None = None) -> None:
        """Store the index; postings are clustered by term, so a term's rows lie in one file."""
        postings = self.postings.repartition(partitions, "term") if partitions else self.postings.repartition("term")
        postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")

    @classmethod
    def read(cls, spark, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "corpus")))


def document_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tokens, dl: the one pass over the texts."""
    return docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("tokens")).withColumn("dl", F.size("tokens"))


def raw_idf(docs: Column, df: Column) -> Column:
    return F.ln(docs - df + F.lit(0.5)) - F.ln(df + F.lit(0.5))


def postings_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, row, id, tf, dl; ids may repeat, each row is a document."""
    rows = document_tokens(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", "id", "dl", F.explode("tokens").alias("term")).groupBy("term", "row", "id", "dl").agg(F.count("*").alias("tf")).select("term", "row", "id", "tf", "dl")


def term_statistics(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def corpus_statistics(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: docs, tokens, avg_idf, terms, avgdl; ``sizes`` is one row of docs and tokens."""
    mean = terms.crossJoin(F.broadcast(sizes)).agg(F.avg(raw_idf(F.col("docs"), F.col("df"))).alias("avg_idf"), F.count("*").alias("terms"))  # one row of sizes
    return sizes.crossJoin(mean).withColumn("avgdl", F.try_divide(F.col("tokens").cast("double"), F.col("docs")))  # one row each


def lexical_index(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "page_content") -> LexicalIndex:
    """The index of a corpus that is not stored; `store.write_lexical` tokenizes only once."""
    postings = postings_of(docs, id_col, text_col)
    terms = term_statistics(postings)
    sizes = document_tokens(docs, id_col, text_col).agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("tokens"))
    return LexicalIndex(postings, terms, corpus_statistics(terms, sizes))


def term_weights(index: LexicalIndex, names: list[str]) -> DataFrame:
    """term, idf, avgdl of the named terms; frequent terms weigh a share of the mean."""
    terms = index.terms.filter(F.col("term").isin(names)).crossJoin(F.broadcast(index.corpus))  # one row of statistics
    raw = raw_idf(F.col("docs"), F.col("df"))
    return terms.select("term", "avgdl", F.when(raw < 0, F.lit(EPSILON) * F.col("avg_idf")).otherwise(raw).alias("idf"))


def term_part() -> Column:
    """What one term adds to the score of a row."""
    return F.col("idf") * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")))


def lexical_scores(index: LexicalIndex, question: str) -> DataFrame:
    """id, score of every row that has a term of the question."""
    wanted = Counter(T.question_tokens(question))
    query = index.postings.sparkSession.createDataFrame(sorted(wanted.items()), "term string, qtf int")
    names = sorted(wanted)  # a literal list reaches the scan as a filter
    weights = term_weights(index, names).join(F.broadcast(query), "term")
    hits = index.postings.filter(F.col("term").isin(names)).join(F.broadcast(weights), "term")  # at most the question's terms
    return hits.groupBy("row", "id").agg(F.round(F.sum(F.col("qtf") * term_part()), DIGITS).alias("score")).select("row", "id", "score")


def top(scores: DataFrame, n: int) -> DataFrame:
    """The n best rows with their rank; the window runs over n rows only."""
    best = scores.orderBy(F.desc("score"), "id").limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def lexical_top(index: LexicalIndex, question: str, n: int = RRF_DEPTH) -> DataFrame:
    """id, score, rank of the n best; rows that don't score above zero are dropped before ranking."""
    return top(top(lexical_scores(index, question), n).filter(F.col("score") > 0).select("id", "score"), n).select("id", "score", "rank")


def usable_vector(v: Column, dimension: int) -> Column:
    return v.isNotNull() & (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    """id, vec of the usable rows, scaled to length one."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(usable_vector(F.col("v"), dimension))
    length = F.sqrt(dot(F.col("v"), F.col("v")))
    return rows.select("id", length.alias("n"), "v").select("id", F.transform("v", lambda x: x.cast("double") / F.col("n")).alias("vec"))


def dense_top(vectors: DataFrame, query: Sequence[float], n: int = RRF_DEPTH) -> DataFrame:
    """id, score, rank of the n rows of largest inner product with the query vector."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select("id", F.round(dot(F.col("vec"), q), DIGITS).alias("score"))
    return top(scored, n).select("id", "score", "rank")


def fuse_all(dense: DataFrame, lexical: DataFrame, k: int = RETRIEVAL_K, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion for each question: id, score, sources, final rank. An id that occurs twice in a ranker adds twice."""
    both = dense.select("question", "id", "rank", F.lit("semantic").alias("source")).unionByName(lexical.select("question", "id", "rank", F.lit("bm25").alias("source")))
    first = lambda name: F.min(F.when(F.col("source") == name, F.col("rank")))
    fused = both.groupBy("question", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank"))), 9).alias("score"),
        first("semantic").alias("semantic_rank"),
        first("bm25").alias("bm25_rank"),
    )
    order = W.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("bm25_rank"), F.asc("id"))
    sources = F.array_join(F.array_compact(F.array(F.when(F.col("semantic_rank").isNotNull(), "semantic"), F.when(F.col("bm25_rank").isNotNull(), "bm25"))), ",")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("sources", sources)


def fuse(dense: DataFrame, lexical: DataFrame, k: int = RETRIEVAL_K, rrf_k: int = RRF_K) -> DataFrame:
    """`fuse_all` for the rankings of a single question."""
    one = F.lit(0).alias("question")
    return fuse_all(dense.select(one, "id", "rank"), lexical.select(one, "id", "rank"), k, rrf_k).drop("question")


def gate(index: LexicalIndex, entries: DataFrame, question: str, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """The endpoints worth showing: of the five best those that overlap enough; one if it dominates, else up to three."""
    wanted = sorted(set(T.question_tokens(question)))
    best = top(lexical_scores(index, question).select("id", "score"), GATE_TOP).select("id", "score")
    wants = F.array(*(F.lit(t) for t in wanted)) if wanted else F.array().cast("array<string>")
    known = best.join(entries.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("entry_tokens")), "id")
    overlap = F.try_divide(F.size(F.array_intersect(wants, "entry_tokens")).cast("double"), F.lit(float(len(wanted))))
    kept = known.withColumn("overlap", F.round(overlap, DIGITS)).filter((F.size("entry_tokens") > 0) & (overlap >= GATE_OVERLAP) & (F.col("score") > 0))
    order = W.orderBy(F.desc("score"), "id")  # over five rows at most
    placed = kept.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("score").over(order))
    placed = placed.withColumn("dominates", F.max(F.when((F.col("place") == 1) & (F.col("second").isNull() | (F.col("score") / F.col("second") >= GATE_RATIO)), F.lit(1)).otherwise(F.lit(0))).over(W.partitionBy()))
    return placed.filter((F.col("place") == 1) | ((F.col("dominates") == 0) & (F.col("place") <= GATE_MOST))).select("id", "score", "overlap", "place")
