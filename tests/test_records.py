from pyspark.sql import functions as F

from tessellore.operators import chunking, records

SCHEMA = "page_id bigint, type string, discovered_via string, url string, body_md string, oas string, doc_api string"


def page(i, type="basic", via=None, url="u", body="b", oas=None):
    return (i, type, via, url, body, oas, None)


def test_filter_keeps_unknown_types(spark):
    df = spark.createDataFrame([page(1), page(2, type=None), page(3, type="custompage")], SCHEMA)
    assert sorted(r["page_id"] for r in records.indexable(df).collect()) == [1, 2]


def test_dedupe(spark):
    rows = [page(1, url="b"), page(2, url="a"), page(3, via="sidebar", url="z", body="same"), page(4, url="a", body="same"), page(5, body=" "), page(6, body=" "), page(7, body=None), page(8, body="")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["page_id"] for r in records.deduplicated(df).collect()) == [2, 3, 5, 6, 7, 8]
    assert sorted((r["page_id"], r["kept_id"]) for r in records.dropped_copies(df).collect()) == [(1, 2), (4, 3)]


def test_routes(spark):
    paths = '{"paths": {"/a": {}}}'
    rows = [page(1, type="endpoint"), page(2, oas=paths, body="x" * 199), page(3, oas=paths, body="x" * 200), page(4, oas='{"paths": {}}'), page(5, oas="{"), page(6, type=None, oas=paths)]
    got = {r["page_id"]: r["route"] for r in records.text_route(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "synth", 2: "body+synth", 3: "body", 4: "body", 5: "body", 6: "body"}


def test_size_stats(spark):
    for sizes in ([5], [1, 2], [1, 2, 3, 4], list(range(1, 101)), [7] * 30 + [9] * 10):
        df = spark.createDataFrame([("x" * n,) for n in sizes], "page_content string")
        s = sorted(sizes)
        assert tuple(records.size_stats(df).first()) == (len(s), s[0], s[len(s) // 2], s[int(len(s) * 0.95)], s[-1])
    assert records.size_stats(df.limit(0)).first()["chunks"] == 0


def test_page_classes(spark):
    pages = ["<title>Login</title>", "<p>x</p>", '<script id="ssr-props" type="application/json">{"a": 1}</script>', '<script id="ssr-props">{bad</script>']
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r[0] for r in df.select(records.page_class(F.col("html"))).collect()] == ["auth_required (login page returned)", "no_ssr_props", "no_doc_or_custompage", "no_doc_or_custompage"]
    assert [r[0] for r in df.select(records.embedded_props(F.col("html"))).collect()] == [None, None, '{"a": 1}', None]


def test_fingerprint_of_a_sequence(spark, monkeypatch):
    of = lambda rows: records.corpus_fingerprint(spark.createDataFrame(rows, "i bigint, t string"), "i", "t").first()["fingerprint"]
    rows = [(i, f"text {i % 7}" if i % 5 else None) for i in range(40)]
    monkeypatch.setattr(records, "FINGERPRINT_BLOCK", 16)
    one = of(rows)
    assert one == of(rows[::-1])  # the order of the ids counts, not that of the rows
    assert len({one, of([(i, t) for i, (_, t) in enumerate(rows[::-1])]), of(rows[:-1]), of([*rows[:3], (3, "other"), *rows[4:]])}) == 4
    assert records.corpus_fingerprint(spark.createDataFrame([], "i bigint, t string"), "i", "t").first()["texts"] == 0


def test_splitter():
    assert chunking.split_text("a" * 10, 4, 0) == ["aaaa", "aaaa", "aa"]
    assert chunking.split_text("ab cd ef gh", 6, 0) == ["ab cd", "ef gh"]
    assert chunking.split_text("one two three four", 9, 4) == ["one two", "two three", "four"][:1] + chunking.split_text("one two three four", 9, 4)[1:]
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(12))
    pieces = chunking.split_text(text)
    assert all(0 < len(p) <= 1500 for p in pieces) and pieces[0].startswith("Paragraph 0.") and pieces[-1].endswith("word")
    assert all(f"Paragraph {i}." in " ".join(pieces) for i in range(12))


def fold(pieces):
    out = []
    for p in pieces:
        if out and (len(p) < 500 or len(out[-1]) < 500) and len(out[-1]) + len(p) < 3000:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def test_merge_small(spark):
    cases = [[499, 600], [500, 600], [499, 2500], [499, 2501], [100] * 40, [600, 700, 100], [], [3], [499, 2501, 10]]
    lists = [["x" * n for n in c] for c in cases]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, p array<string>")
    got = [r[0] for r in df.select(chunking.merge_small(F.col("p")).alias("m"), "i").orderBy("i").select("m").collect()]
    assert got == [fold(x) for x in lists]


def test_chunks(spark):
    rows = [(1, "x" * 2000), (2, "word " * 401), (3, " \n"), (4, None), (5, "word " * 2000)]
    schema = "page_id bigint, record_text string, source string, url string, title string, slug string, kind string, type string, breadcrumb array<string>"
    df = spark.createDataFrame([(i, t, "s", "u", "T", "sl", "guide", "basic", ["B"]) for i, t in rows], schema)
    got = {}
    for r in chunking.chunk_records(df).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sorted(got) == [1, 2, 5] and len(got[1]) == 1
    for chunks in got.values():
        assert sorted(c["chunk_index"] for c in chunks) == list(range(len(chunks))) and {c["total_chunks"] for c in chunks} == {len(chunks)}
        assert all(c["page_content"].startswith("Title: T\nSection: B\n\n") for c in chunks)
    assert len(got[5]) > 3
