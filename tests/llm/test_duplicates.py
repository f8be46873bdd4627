import math
import random
import re

import numpy as np

from tessellore.llm import duplicates as dup

SCHEMA = "page_id bigint, body_md string, doc string, label int"


def shingles(text, n):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(rows, n, least, least_chars):
    docs = [(i, shingles(t, n)) for i, t, *_ in rows if t is not None and len(t.strip()) >= least_chars]
    docs = [d for d in docs if d[1]]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(docs):
        for j, b in docs[x + 1 :]:
            if len(a & b) / len(a | b) >= least:
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return {i: find(i) for i, _ in docs}


def corpus(seed, count=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(count):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += rng.choices(vocabulary, k=8)
        else:
            words = rng.choices(vocabulary, k=90)
        rows.append((i, " ".join(words), "clash", 1))
    return rows


def test_groups_against_all_pairs(spark):
    rows = corpus(1)
    rows += [(500 + i, rows[0][1], "copy", 1) for i in range(30)]  # a hot text
    rows += [(600, None, "x", 1), (601, "", "x", 1), (602, "?!", "x", 1), (603, "two words", "x", 1), (604, "TWO, words!", "x", 1), (605, "x" * 200_000, "x", 1)]
    got = {r["page_id"]: r["group_id"] for r in dup.duplicate_groups(spark.createDataFrame(rows, SCHEMA), words=3, least=0.6, least_chars=1).collect()}
    assert got == {**brute_groups(rows, 3, 0.6, 1), 602: 602}
    assert got[603] == got[604] == 603


def test_members_of_a_bucket_that_only_match_each_other(spark):
    """Two pairs in one bucket whose smallest id is like neither: the second stage has to find them."""
    base = [f"a{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: 40 + 3 * i], *(f"z{i}x{j}" for j in range(60 - 3 * i))]), "x", 1) for i in range(16)]
    got = {r["page_id"]: r["group_id"] for r in dup.duplicate_groups(spark.createDataFrame(rows, SCHEMA), words=1, least=0.75, components_count=400).collect()}
    assert got == brute_groups(rows, 1, 0.75, 0)


def test_links_of_a_family_are_all_counted(spark):
    """Each of twelve edited versions is like all others, not only like the smallest id; copies don't count."""
    rows = [(i, " ".join(f"v{i}" if j == i else f"w{j}" for j in range(100)), "x", 1) for i in range(12)]
    rows += [(50, rows[3][1], "x", 1), (51, "quite another text", "x", 1)]
    got = {r["page_id"]: (r["group_id"], r["links"]) for r in dup.duplicate_groups(spark.createDataFrame(rows, SCHEMA), words=1, least=0.75).collect()}
    assert got == {**{i: (0, 11) for i in (*range(12), 50)}, 51: (51, 0)}


def test_groups_are_the_same_without_links(spark):
    base = [f"a{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: 40 + 3 * i], *(f"z{i}x{j}" for j in range(60 - 3 * i))]), "x", 1) for i in range(16)]
    rows += [(100 + i, *r) for i, *r in corpus(2, 60)]
    found = dup.duplicate_groups(spark.createDataFrame(rows, SCHEMA), words=1, least=0.75, components_count=400, count_links=False)
    assert found.columns == ["page_id", "group_id"]
    assert {r["page_id"]: r["group_id"] for r in found.collect()} == brute_groups(rows, 1, 0.75, 0)


def test_pairs_of_groups(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (5, 1), (7, 7)], "page_id bigint, group_id bigint")
    assert sorted(tuple(r) for r in dup.grouped_pairs(groups).collect()) == [(1, 2), (1, 5), (2, 5)]


def test_empty_table(spark):
    assert dup.duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in dup.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_signatures_estimate_the_probability_likeness():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(1, 2**62, 120).astype(np.uint64))
    b = np.unique(np.concatenate([a[:80], rng.integers(1, 2**62, 50).astype(np.uint64)]))
    wa, wb = rng.integers(1, 6, len(a)), rng.integers(1, 6, len(b))
    m = 20_000
    plain = dup.prob_min_hash([a, b], None, m)
    assert abs((plain[0] == plain[1]).mean() - dup.likeness(a, b)) < 0.015
    weighted = dup.prob_min_hash([a, b], [wa, wb], m)
    full = {int(x): [0, 0] for x in np.union1d(a, b)}
    for k, (s, w) in enumerate(((a, wa), (b, wb))):
        for x, y in zip(s, w):
            full[int(x)][k] = int(y)
    exact = sum(1 / sum(max(y0 / x0, y1 / x1) for y0, y1 in full.values()) for x0, x1 in full.values() if x0 and x1)
    assert abs(dup.probability_likeness(a, wa, b, wb) - exact) < 1e-9
    assert abs((weighted[0] == weighted[1]).mean() - exact) < 0.015
    ones = dup.probability_likeness(a, np.ones(len(a)), b, np.ones(len(b)))
    assert abs(ones - dup.likeness(a, b)) < 1e-9


def test_banding_meets_its_miss_rate():
    for least in (0.5, 0.6, 0.8, 0.9):
        bands, rows = dup.banding(least)
        assert (1 - least**rows) ** bands <= dup.MISS and bands * rows <= dup.COMPONENTS


def test_sketches_keep_every_pair_at_the_threshold():
    rng = np.random.default_rng(5)
    for least in (0.6, 0.8):
        n, sets = 240, []
        both = math.ceil(n * 2 * least / (1 + least))  # two sets of n with this likeness
        for _ in range(150):
            x = rng.integers(1, 2**62, 2 * n - both).astype(np.uint64)
            sets += [np.unique(x[:n]), np.unique(x[n - both :])]
        sketch = dup.prob_min_hash(sets, None, dup.COMPONENTS).astype(np.uint8)
        agree = (sketch[::2] == sketch[1::2]).sum(axis=1)
        assert agree.min() >= dup.least_agreement(least, dup.COMPONENTS) > 0.3 * dup.COMPONENTS * least


def test_an_outsider_meets_all_members_of_a_large_bucket(spark, monkeypatch):
    """Its pairs grow with the bucket, not with the bucket's square."""
    monkeypatch.setattr(dup, "BLOCK_DOCS", 16)
    shared = spark.createDataFrame([(7, i) for i in range(200)] + [(8, 0), (8, 1)], "bucket bigint, doc bigint")
    labels = spark.createDataFrame([(i, 0) for i in range(198)], "node bigint, label bigint")
    got = {tuple(r) for r in dup._pairs_apart(shared, labels).collect()}
    assert got == {(i, j) for j in (198, 199) for i in range(j)}
    assert {tuple(r) for r in dup._bucket_pairs(shared).collect()} == {(i, j) for j in range(200) for i in range(j)}
