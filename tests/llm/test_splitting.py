import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessellore.llm import splitting as sp

ALPHABET = "ab é語。.!? \n\n\t,"


def check(text, pieces, limit, overlap):
    """Round trip, limit, order, and the overlap wherever it need not be shortened."""
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, _ in pieces:
        assert 0 < b - a <= limit
    for (_, b0, how), (a1, b1, _) in zip(pieces, pieces[1:]):
        assert b0 - overlap <= a1 <= b0 < b1
        if how == "hard":
            assert not any(c.isspace() for c in text[b0 - limit + overlap : b0])
    assert "".join(text[a if i == 0 else pieces[i - 1][1] : b] for i, (a, b, _) in enumerate(pieces)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=ALPHABET, min_size=1, max_size=400), st.integers(0, 60))
def test_pieces_round_trip(text, run):
    text = text + "x" * run + " " + text
    pieces = sp.cut(text, 0, len(text), 40, 10)
    check(text, pieces, 40, 10)
    if sp.longest_run(text) <= 40:
        assert all(how != "hard" for _, _, how in pieces)
        for _, b, how in pieces[:-1]:
            assert text[b - 1].isspace() or text[b].isspace() or text[b - 1] in "。!?." or how == "sentence"


def test_prefers_strong_boundaries():
    text = "word " * 20 + "end.\n\n" + "word " * 40
    first = sp.cut(text, 0, len(text), 150, 20)[0]
    assert first == (0, 106, "paragraph")


def test_overlap_is_exact_where_runs_are_short():
    text = "Some words here. " * 400
    pieces = sp.cut(text, 0, len(text))
    assert all(b0 - a1 == 200 for (_, b0, _), (a1, _, _) in zip(pieces, pieces[1:]))


def test_run_that_just_fits_is_kept_whole():
    text = "a " * 700 + "x" * 1500 + " b" * 300
    assert any(text[a:b].strip() == "x" * 1500 for a, b, _ in sp.cut(text, 0, len(text)))


ROWS = "tbl string, row_id bigint, body string, piece string"


def test_ranges_of_a_giant_text_agree_with_its_length(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(["word ", "Sentence. ", "文章。", "\n\n", "x" * 40, "line\n"]) for _ in range(30_000))
    hard = "y" * 70_000 + " z " * 3000
    rows = [("t", 1, text, "c"), ("t", 2, hard, "c"), ("t", 3, None, "c"), ("t", 4, "", "c"), ("t", 5, "x" * 2000, "c"), ("t", None, "w " * 1500, "c")]
    df = spark.createDataFrame(rows, ROWS)
    out = sp.split_texts(df, range_chars=20_000).collect()
    for row, body, kind in ((1, text, "soft"), (2, hard, "hard"), (None, "w " * 1500, "soft")):
        mine = sorted((r["piece"], r["start"], r["end"], r["text"], r["cut_kind"]) for r in out if r["row_id"] == row)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert {m[4] for m in mine} == {kind}
        at = 0
        for _, a, b, piece, _ in mine:
            assert a <= at < b and b - a <= 1500 and body[a:b] == piece
            at = b
        assert at == len(body)
    assert {r["row_id"] for r in out} == {1, 2, None}
    assert sorted((r["row_id"] or 0, r["cut_kind"]) for r in sp.cut_kinds(sp.split_texts(df)).collect()) == [(0, "soft"), (1, "soft"), (2, "hard")]


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(rng.choice(["word ", "Satz. ", "文章。", "日本語", "\n\n", "é" * 30, "😀 "]) for _ in range(6_000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "b.txt").write_text("short", encoding="utf-8")
    (tmp_path / "c.txt").write_text("", encoding="utf-8")
    out = sp.split_files(spark, str(tmp_path), limit=200, overlap=30, range_bytes=5_001).collect()
    mine = sorted((r["piece"], r["start"], r["end"], r["text"]) for r in out if r["path"].endswith("a.txt"))
    assert [m[0] for m in mine] == list(range(len(mine)))
    at = 0
    for _, a, b, piece in mine:
        assert a <= at < b and b - a <= 200 and text[a:b] == piece
        at = b
    assert at == len(text)
    assert [r["text"] for r in out if r["path"].endswith("b.txt")] == ["short"]


def test_pieces_overlap_across_range_borders(spark, tmp_path):
    """As within a range: exactly the overlap, also for pieces on both sides of a border."""
    rng = random.Random(5)
    text = "".join(rng.choice(["word ", "Satz. ", "文章。", "\n\n", "é" * 9, "😀 "]) for _ in range(9_000))
    whole = sp.cut(text, 0, len(text), 200, 30)
    assert {b0 - a1 for (_, b0, _), (a1, _, _) in zip(whole, whole[1:])} == {30}
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    ranged = sp.split_texts(spark.createDataFrame([("t", 1, text, "c")], ROWS), limit=200, overlap=30, range_chars=2_000)
    for out in (ranged, sp.split_files(spark, str(tmp_path), limit=200, overlap=30, range_bytes=5_001)):
        pieces = sorted((r["piece"], r["start"], r["end"], r["text"]) for r in out.collect())
        assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
        assert all(text[a:b] == piece and b - a <= 200 for _, a, b, piece in pieces)
        assert {b0 - a1 for (_, _, b0, _), (_, a1, _, _) in zip(pieces, pieces[1:])} == {30}


def test_runs_are_measured_across_ranges(spark):
    """A range may begin inside a run, behind a full stop without white space."""
    run = "語" * 1_300 + "。" + "語" * 1_300
    text = "w " * 500 + run + " end" * 400
    df = spark.createDataFrame([("t", 1, text, "c"), ("t", 2, "w " * 500 + "語" * 1_400 + " end" * 400, "c")], ROWS)
    for size in (400, 1_000, 1_200, 2_000, 2_300, 1 << 20):
        assert {(r["row_id"], r["cut_kind"]) for r in sp.split_texts(df, range_chars=size).collect()} == {(1, "hard"), (2, "soft")}
    for size in range(1, 60):
        line = "ab cdefghijkl  m 。nopqrstuvwxyz " * 2
        inside = [sp.longest_run(line, a, min(len(line), a + size)) for a in range(0, len(line), size)]
        assert max(inside) == sp.longest_run(line) == 14


def test_overlap_is_exact_at_every_joint_for_any_range(spark):
    text = "Some words here. " * 900
    df = spark.createDataFrame([("t", 1, text, "c"), ("t", 1, text, "c")], ROWS)
    for size in (1_700, 4_096, sp.RANGE, 1 << 20):
        pieces = sorted((r["piece"], r["start"], r["end"], r["text"]) for r in sp.split_texts(df, range_chars=size).collect())
        assert pieces[::2] == pieces[1::2]  # the repeated row
        mine = pieces[::2]
        assert [m[0] for m in mine] == list(range(len(mine))) and mine[0][1] == 0 and mine[-1][2] == len(text)
        assert all(text[a:b] == piece and b - a <= sp.LIMIT for _, a, b, piece in mine)
        assert {b0 - a1 for (_, _, b0, _), (_, a1, _, _) in zip(mine, mine[1:])} == {sp.OVERLAP}


def test_empty_table(spark):
    assert sp.split_texts(spark.createDataFrame([], ROWS)).count() == 0
