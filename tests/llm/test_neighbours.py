import numpy as np

from tessellore.llm import neighbours as nb

SCHEMA = "vec_id bigint, embedding array<float>, node string, shard int"


def exact(vectors, k):
    sims = vectors @ vectors.T
    np.fill_diagonal(sims, -np.inf)
    return np.sort(sims, axis=1)[:, ::-1][:, :k]


def test_recall_of_one_graph():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = nb.Graph.build(vectors, np.arange(3000))
    assert len(graph.members) > 1 and len(graph.members[0]) == 3000
    found, sims = graph.search(vectors, 6)
    best = exact(vectors, 5)
    hit = [(sims[i][found[i] != i][:5] >= best[i, 4] - 1e-6).mean() for i in range(3000)]
    assert np.mean(hit) >= 0.95


def test_stored_graph_is_the_same():
    import pandas as pd

    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(500, 8)).astype(np.float32)
    rows = pd.DataFrame({"shard": 0, "node": np.arange(500), "packed": [v.tobytes() for v in vectors]})
    stored = nb._build(8, 6, 20)(rows).iloc[0].to_dict()
    nodes, graph = nb.load_graph(stored, 8)
    assert sorted(nodes.tolist()) == list(range(500))
    found, _ = graph.search(nb.unit(rows["packed"], 8), 1, 20)
    assert (nodes[found[:, 0]] == np.arange(500)).mean() > 0.99


def brute(rows, k, dimension):
    usable = [(i, np.array(v, dtype=np.float64)) for i, v, *_ in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (i, v) in enumerate(usable):
        sims = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 5), j) for m, (j, w) in enumerate(usable) if m != n)
        out[i] = sims[:k]
    return out


def test_dirty_rows_ties_and_copies(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), "x", 1) for i in range(60)]
    rows += [(100 + i, rows[3][1], "x", 1) for i in range(8)]  # nine equal vectors
    rows += [(200, rows[4][1], "x", 1), (201, [2 * x for x in rows[5][1]], "x", 1)]
    rows += [(300, None, "x", 1), (301, [0.0] * 8, "x", 1), (302, [1.0] * 4, "x", 1), (303, [float("nan")] + [1.0] * 7, "x", 1), (304, [None] + [1.0] * 7, "x", 1), (305, [float("inf")] + [1.0] * 7, "x", 1), (306, [], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for r in nb.neighbours(df, dimension=8, cell_rows=1000).collect():
        found.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour_id"], r["cosine"]))
    expected = brute(rows, 5, 8)
    assert set(found) == set(expected)
    for i, want in expected.items():
        got = sorted(found[i])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert np.allclose([g[2] for g in got], [-s for s, _ in want], atol=2e-5)
    assert [g[1] for g in sorted(found[104])] == [3, 100, 101, 102, 103]
    assert [g[1] for g in sorted(found[3])] == [100, 101, 102, 103, 104]


def test_many_shards_merge(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(30, 16))
    rows = [(i, (centre[i % 30] + 0.1 * rng.normal(size=16)).astype(np.float32).tolist(), "x", 1) for i in range(600)]
    found = nb.neighbours(spark.createDataFrame(rows, SCHEMA), dimension=16, cell_rows=100)
    best = {i: -w[-1][0] for i, w in brute(rows, 5, 16).items()}
    got = found.collect()
    assert len(got) == 3000
    assert np.mean([r["cosine"] >= best[r["vec_id"]] - 1e-4 for r in got]) >= 0.95


def test_distant_neighbours_are_found_in_many_cells(spark):
    """Vectors without any close neighbour, in ten times the cells that used to be searched."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(2000, 16)).astype(np.float32)
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    best = exact(vectors, 5)[:, 4]
    got = nb.neighbours(spark.createDataFrame(rows, SCHEMA), dimension=16, cell_rows=50).collect()
    assert len(got) == 10_000
    assert sum(r["cosine"] >= best[r["vec_id"]] - 1e-5 for r in got) / len(got) >= 0.95


def test_probes_follow_the_data(spark):
    """Clusters need few of many cells, vectors without close neighbours nearly all; recall holds for both."""
    rng = np.random.default_rng(10)
    centre = 4 * rng.normal(size=(40, 16))
    tight = np.array([centre[i % 40] + 0.1 * rng.normal(size=16) for i in range(2_000)], dtype=np.float32)
    loose = rng.normal(size=(2_000, 16)).astype(np.float32)
    asked = []
    for vectors in (tight, loose):
        df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)], SCHEMA)
        groups = nb.distinct_vectors(nb.pack_vectors(df, "vec_id", "embedding", 16)).mapInPandas(nb._pack(16), "key bigint, key2 bigint, node bigint, copies bigint, packed binary")
        centres = nb.centroids_of(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), 40)
        asked.append(nb.probes_needed(groups, centres, 5, 16))
        found = nb.neighbours(df, dimension=16, cell_rows=50)
        report = nb.recall_against_brute_force(df, found, dimension=16).first()
        assert report["queries"] == 100 and report["recall"] >= 0.9
    assert asked[0] <= 8 < asked[1] <= 40


def test_few_and_none(spark):
    assert nb.neighbours(spark.createDataFrame([], SCHEMA), dimension=2).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], "x", 1)], SCHEMA)
    assert nb.neighbours(one, dimension=2).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0], "x", 1), (2, [0.0, 2.0], "x", 1)], SCHEMA)
    assert sorted(tuple(r) for r in nb.neighbours(two, dimension=2).collect()) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]


def test_every_true_neighbour_is_found(spark):
    """Vectors without close neighbours, in several cells and blocks: no neighbour is passed over."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(6_000, 64)).astype(np.float32)
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    best = exact(vectors, 5)
    got = nb.neighbours(spark.createDataFrame(rows, SCHEMA), cell_rows=1_000).collect()
    assert len(got) == 30_000 and len({(r["vec_id"], r["neighbour_id"]) for r in got}) == 30_000
    assert all(abs(r["cosine"] - best[r["vec_id"], r["rank"] - 1]) <= 2e-6 for r in got)


def test_equal_similarities_go_to_the_smaller_ids(spark):
    """Multiples of one vector are different vectors, all of cosine 1 to each other."""
    rng = np.random.default_rng(12)
    one = rng.normal(size=8)
    rows = [(i, (one * (1 + (i * 37 % 101) / 7)).astype(np.float32).tolist(), "x", 1) for i in range(100)]
    rows += [(100 + i, rng.normal(size=8).astype(np.float32).tolist(), "x", 1) for i in range(100)]
    found = {}
    for r in nb.neighbours(spark.createDataFrame(rows, SCHEMA), dimension=8).collect():
        found.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour_id"], r["cosine"]))
    for i in range(100):
        assert sorted(found[i]) == [(n + 1, j, 1.0) for n, j in enumerate([j for j in range(6) if j != i][:5])]


def test_only_blocks_that_can_better_are_compared():
    """In clusters far from each other a vector is compared with its own cluster only, and nothing is lost."""
    rng = np.random.default_rng(13)
    clusters = [np.array([c + 0.05 * rng.normal(size=16) for _ in range(200)]) for c in rng.normal(size=(20, 16))]
    clusters = [(c / np.linalg.norm(c, axis=1, keepdims=True)).astype(np.float32) for c in clusters]
    best = exact(np.concatenate(clusters), 5)
    compared = 0
    for n, queries in enumerate(clusters):
        own = np.arange(200) + 200 * n
        sims, nodes = np.full((200, 5), -np.inf), np.full((200, 5), np.iinfo(np.int64).max)
        for m in [n, *(m for m in range(20) if m != n)]:
            compared += nb.better(sims, nodes, own, queries, np.arange(200) + 200 * m, clusters[m])
        assert np.allclose(sims, best[own], atol=2e-6) and not (nodes == own[:, None]).any()
    assert compared < 20 * 200 * 3


def test_graphs_are_asked_where_probes_are_given(spark):
    rng = np.random.default_rng(14)
    vectors = rng.normal(size=(600, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)], SCHEMA)
    for probes in (0, 6):
        report = nb.recall_against_brute_force(df, nb.neighbours(df, dimension=16, cell_rows=100, probes=probes), dimension=16).first()
        assert report["queries"] == 30 and report["recall"] >= 0.9
