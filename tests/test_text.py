import pytest
from pyspark.sql import functions as F

from tessellore.functions import text as T

TOKENS = {
    "2abc _x9 foo_bar": ["2", "abc", "x9", "foo_bar"],
    "Éa naïve": ["a", "na", "ve"],
    "٣ and 12": ["٣", "and", "12"],
    "A a A": ["a", "a", "a"],
    "": [],
    None: [],
}


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TOKENS)], "i int, t string")
    assert [r[0] for r in df.select(T.tokens(F.col("t")).alias("x"), "i").orderBy("i").select("x").collect()] == list(TOKENS.values())
    assert [T.question_tokens(t) for t in TOKENS if t is not None] == [v for k, v in TOKENS.items() if k is not None]


def test_header(spark):
    rows = [(" T ", "s", ["A", "", None, "B"]), ("  ", "s", []), (None, None, None)]
    df = spark.createDataFrame(rows, "title string, slug string, breadcrumb array<string>")
    got = [r[0] for r in df.select(T.chunk_header(F.col("title"), F.col("slug"), F.col("breadcrumb"))).collect()]
    assert got == ["Title: T\nSection: A > B\n\n", "Title: s\nSection: Documentation\n\n", "Title: \nSection: Documentation\n\n"]


REWRITTEN = {
    "see [x](doc:a-b#c) and [y]( ref:z )": "see [x](https://h/s/docs/a-b#c) and [y](https://h/s/reference/z)",
    "a\n[block:html]\n{}\n[/block]\n\n\n\nb": "a\n\nb",
    "x <TokenBox /> y <br/>": "x  y <br/>",
    "\n a \n": "a",
    "costs $1 (doc:a)": "costs $1 (https://h/s/docs/a)",
    None: "",
}


def test_rewrite(spark):
    df = spark.createDataFrame([(t,) for t in REWRITTEN], "t string")
    got = [r[0] for r in df.select(T.rewrite_body(F.col("t"), F.lit("https://h/"), F.lit("s"))).collect()]
    assert got == list(REWRITTEN.values())


@pytest.mark.parametrize("url,key", [("https://h/a/b?x=1#y", "a/b"), ("https://h/a/", "a/_index"), ("https://h", "_index"), ("/a/b", "a/b")])
def test_cache_key(spark, url, key):
    assert spark.range(1).select(T.url_cache_key(F.lit(url))).first()[0] == key


def test_first_line(spark):
    assert spark.range(1).select(T.first_line(F.lit(" ab\ncd ")), T.first_line(F.lit("x" * 300)), T.flat_description(F.lit(" a|b\nc "))).first()[:] == ("ab", "x" * 200, "a\\|b c")
