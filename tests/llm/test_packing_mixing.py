import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellore.llm import mixing, packing


def plain_sum_of_squares(sizes, capacity):
    """The same choice, by trying every place and counting anew."""
    bins, fills = [], []

    def score(gaps):
        counts = {}
        for g in gaps:
            if 0 < g < capacity:
                counts[g] = counts.get(g, 0) + 1
        return sum(v * v for v in counts.values())

    for size in sizes:
        gaps = [capacity - f for f in fills]
        options = []
        for g in sorted({g for g in gaps if size <= g < capacity and g > 0}):
            i = max(i for i, x in enumerate(gaps) if x == g)
            options.append((score(gaps[:i] + [g - size] + gaps[i + 1 :]), 0, g))
        options.append((score([*gaps, capacity - size]), 1, capacity))
        _, new, g = min(options)
        if new:
            fills.append(size)
        else:
            fills[next(i for i, x in enumerate(gaps) if x == g)] += size
        bins.append(g)
    return bins, sorted(fills)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 19), max_size=40))
def test_sum_of_squares_against_trying_every_place(sizes):
    bins = packing.sum_of_squares(np.array(sizes, dtype=np.int64), 20)
    fills = sorted(np.bincount(bins, weights=sizes).astype(int).tolist()) if sizes else []
    assert fills == plain_sum_of_squares(sizes, 20)[1]


def test_pack_keeps_everything_within_capacity(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 400).tolist()
    rows = [(i, "x" * n, "clash") for i, n in enumerate(sizes)] + [(900, None, "a"), (901, "", "b"), (902, "é" * 130, "c"), (None, "abc", "d"), (3, "dup", "e"), (3, "dup", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container string")
    out = packing.pack(df, capacity=100, shard_items=90).collect()
    assert len(out) == len(rows) + 2  # one text of 260 bytes gives three pieces
    by = {}
    for r in out:
        if r["container"] is None:
            assert r["n_tokens"] == 0 and r["doc_id"] in (900, 901)
        else:
            by.setdefault(r["container"], []).append(r["n_tokens"])
    assert max(map(sum, by.values())) <= 100
    total = sum(sizes) + 260 + 9
    assert sum(map(sum, by.values())) == total
    assert len(by) <= 1.1 * total / 100
    assert sorted(r["start_token"] for r in out if r["doc_id"] == 902) == [0, 100, 200]
    assert sorted(r["doc_id"] for r in packing.split_documents(packing.pack(df, capacity=100)).collect()) == [902]


def test_one_size_for_all_rows(spark):
    df = spark.range(500).selectExpr("7 AS doc_id", "'same text' AS text")
    out = packing.fill_report(packing.pack(df, capacity=90, shard_items=64), 90).first()
    assert (out["containers"], out["tokens"]) == (50, 4500)


def test_pack_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(df).count() == 0
    assert packing.fill_report(packing.pack(df)).first()["containers"] == 0


TARGETS = [("a_b", 0.5, 1), ("c", 0.3, 3), ("gone", 0.2, 2)]


def test_mixture_shares_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(1, 80)), " A-b" if i % 4 else "C", 1) for i in range(2000)] + [(9000, None, "c", 1), (9001, "t", None, 1), (9002, "t", "other", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot int")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixture, sources = mixing.mix(df, targets, block_tokens=500)
    out = mixture.collect()
    uses = {}
    for r in out:
        uses[r["doc_id"], r["repetition"]] = uses.get((r["doc_id"], r["repetition"]), 0) + 1
    assert set(uses.values()) == {1}
    tokens = {s: sum(len(t or "") for _, t, x, _ in rows if x == raw) for s, raw in (("a_b", " A-b"), ("c", "C"))}
    total = sum(tokens.values())
    got = {r["source"]: r for r in mixing.report(mixture, sources).collect()}
    assert abs(got["a_b"]["actual_tokens"] - 0.5 * total) < 80
    assert abs(got["c"]["actual_tokens"] - min(0.3 * total, 3 * tokens["c"])) < 80
    assert [s for s in got if got[s]["is_short"]] == ["gone"] and got["gone"]["actual_tokens"] == 0
    # every stretch of slots holds the sources in nearly their shares
    slots = sorted({(r["slot"], r["source"]) for r in out})
    share = sources[0].allotted / sum(s.allotted for s in sources)
    for lo in range(0, len(slots) - 20, 20):
        part = [s for _, s in slots[lo : lo + 20]]
        assert abs(part.count("a_b") / len(part) - share) < 0.16


def test_prefix_sums_in_buckets_agree_with_plain_ones(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS doc_id", "repeat('x', CAST(id % 7 + 1 AS INT)) AS text", "'c' AS source")
    targets = spark.createDataFrame([("c", 1.0, 2)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "BUCKET_TOKENS", 50)
    sources = mixing.allot(df, targets, 1800)
    assert sources[0].buckets > 8
    rows = sorted(mixing.blocks(df, sources, 100).collect(), key=lambda r: r["start_token"])
    at = 0
    for r in rows:
        assert r["start_token"] == at and r["block"] == at // 100
        at += r["n_tokens"]
    assert at >= 1800 > at - 7


def test_a_tiny_source_does_not_stretch_the_schedule(spark):
    sources = [mixing.Source("a", 0.5, 1, 10**8, 10**8, 1), mixing.Source("b", 0.5, 1, 10**8, 10**8, 1), mixing.Source("c", 0.0, 1, 100, 100, 1)]
    need = sum(-(-s.allotted // 1_000) for s in sources)
    assert mixing.schedule(sources, spark, 1_000).count() <= 1.01 * need
    rows = [(i, "x" * 100, "a" if i % 2 else "b") for i in range(2_000)] + [(5_000, "tiny", "c"), (5_001, "t", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.49998, 1), ("c", 0.00002, 1)], "source string, target_share double, max_repeats int")
    mixture, sources = mixing.mix(df, targets, block_tokens=500)
    out = mixture.collect()
    assert all(r["slot"] is not None for r in out)
    assert any(r["source"] == "c" for r in out)
    assert sum(r["n_tokens"] for r in out if r["source"] != "c") >= sum(s.allotted for s in sources if s.name != "c")


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixture, sources = mixing.mix(df, targets)
    assert mixture.count() == 0
    assert [r["actual_tokens"] for r in mixing.report(mixture, sources).collect()] == [0, 0, 0]
