import math
from collections import Counter

import pytest

from tessellore.functions import text as T
from tessellore.operators import scoring

DOCS = [(1, "the cat sat on the mat"), (2, "the dog"), (3, "a cat and a dog and a cat"), (4, ""), (5, None), (6, "the the the"), (2, "the dog")]


def plain_bm25(docs, question):
    """The formula as written down: epsilon floor, repeated question tokens, no +1 in the logarithm."""
    tokens = [T.question_tokens(t or "") for _, t in docs]
    n, avgdl = len(docs), sum(map(len, tokens)) / len(docs)
    df = Counter(t for ts in tokens for t in set(ts))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for (i, _), ts in zip(docs, tokens):
        tf = Counter(ts)
        s = sum(idf[q] * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(ts) / avgdl)) for q in T.question_tokens(question) if q in idf)
        out.append((i, round(s, 6)))
    return out


@pytest.mark.parametrize("question", ["cat dog", "the cat the", "unknown cat", "and a", "?!"])
def test_lexical_scores(spark, question):
    index = scoring.lexical_index(spark.createDataFrame(DOCS, "chunk_id bigint, page_content string"))
    got = sorted((r["id"], r["score"]) for r in scoring.lexical_scores(index, question).collect())
    wanted = set(T.question_tokens(question))
    assert got == sorted(x for x, (_, t) in zip(plain_bm25(DOCS, question), DOCS) if wanted & set(T.question_tokens(t or "")))


def test_top_drops_what_does_not_score(spark):
    index = scoring.lexical_index(spark.createDataFrame([(1, "x"), (2, "x y")], "chunk_id bigint, page_content string"))
    assert scoring.lexical_top(index, "x").count() == 0  # a term of all documents has a negative floor here
    assert [tuple(r) for r in scoring.top(spark.createDataFrame([(3, 1.0), (2, 1.0), (1, 2.0)], "id bigint, score double"), 2).collect()] == [(1, 2.0, 1), (2, 1.0, 2)]


def test_index_round_trip(spark, tmp_path):
    index = scoring.lexical_index(spark.createDataFrame(DOCS, "chunk_id bigint, page_content string"))
    index.write(str(tmp_path / "index"))
    again = scoring.LexicalIndex.read(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, scoring.lexical_top(again, "cat dog").collect())) == sorted(map(tuple, scoring.lexical_top(index, "cat dog").collect()))


def ranked(spark, ids):
    return spark.createDataFrame([(i, float(len(ids) - r), r + 1) for r, i in enumerate(ids)], "id bigint, score double, rank int")


def test_fusion(spark):
    got = [(r["id"], r["score"], r["sources"]) for r in scoring.fuse(ranked(spark, [1, 2, 3]), ranked(spark, [3, 4]), k=4).orderBy("rank").collect()]
    assert got == [(3, round(1 / 63 + 1 / 61, 9), "semantic,bm25"), (1, round(1 / 61, 9), "semantic"), (2, round(1 / 62, 9), "semantic"), (4, round(1 / 62, 9), "bm25")]
    twice = scoring.fuse(ranked(spark, [1, 2, 1]), ranked(spark, []).limit(0)).orderBy("rank").first()
    assert (twice["id"], twice["score"]) == (1, round(1 / 61 + 1 / 63, 9))


def gated(spark, texts, question):
    entries = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    index = scoring.lexical_index(entries, "id", "text")
    found = scoring.gate(index, entries.select("id", T.tokens(entries["text"]).alias("tokens")), question)
    return [r["id"] for r in found.orderBy("place").collect()]


FILL = [f"other words number {i}" for i in range(12)]


def test_gate(spark):
    assert gated(spark, FILL, "?!") == []
    assert gated(spark, FILL, "loans") == []
    assert gated(spark, ["loans", *FILL], "loans") == [0]
    assert gated(spark, ["loans and more", "loans and less", "loans and all", "loans or none", *FILL], "loans") == [0, 1, 2]
    assert gated(spark, ["list all loans of one folder", "loans are not for people", *FILL], "list all loans of one folder") == [0]
    assert gated(spark, ["loans", *FILL], "loans a b c") == []  # a quarter of the question is too little


def test_dense(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [6.0, 8.0]), (6, [float("nan"), 1.0]), (7, [-1.0, 0.0])]
    vectors = scoring.unit_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "vec_id", "embedding", 2)
    assert [tuple(r) for r in scoring.dense_top(vectors, [1.0, 0.0], 2).collect()] == [(1, 0.6, 1), (5, 0.6, 2)]
