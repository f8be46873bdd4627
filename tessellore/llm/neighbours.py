"""The k most similar vectors of every vector, exactly: blocks of vectors against all blocks, results merged.

Equal vectors are collapsed first and shared out again at the end, so a vector held by a third of
all rows is one node. Vectors lie in the cells of a coarse quantiser: k-means centroids fitted on a
bounded sample (`SAMPLE` distinct vectors, those of smallest hash).

Each cell is cut into blocks of at most `BLOCK_ROWS` vectors that lie near each other, one row per block.
A task holds the blocks of one partition and streams over all blocks (over one of up to `STREAMS` parts of
them while partitions are few); they are read from the checkpoint, nothing is copied in a shuffle. A pair
of blocks is one matrix product in tiles, of which only what betters a vector's k best so far is looked at.
A vector passes over a block only if the triangle inequality rules out that the block betters them, so
nothing is lost: where vectors form clusters most blocks are passed over, where they do not all pairs are
compared and the work grows with the square of the distinct vectors.

Given ``probes``, small-world graphs are asked instead, one per shard: every distinct vector is indexed
in its nearest cell, of about `CELL_ROWS` vectors, and a cell with more than `SHARD_ROWS` vectors is
divided over several graphs, all of which are asked. ``probes`` is the number of nearest cells a vector
asks; 0 has it measured: for `PROBED` vectors (those of smallest hash) the true neighbours are found by
brute force over all vectors, and the number of cells is the least for which these hold at least the share
`COVER` of them. Graphs pass over true neighbours, and at the sizes measured they cost more than the
matrix products.

A shard's graph is hierarchical: a node reaches level L with probability m^-L (from a hash of its
key), each level links its nodes to diverse near neighbours, a search descends greedily through the
upper levels and then keeps the ``ef`` best of the lowest. Graphs are kept as flat arrays
(vectors, and per level the node numbers and a neighbour table padded with -1), one row per shard.
Building and searching run over blocks of vectors at once.

Defined results: a vector is usable if it has the given dimension, only finite numbers and is not
all zero; all others take no part. Similarities equal in six digits are ordered by id; copies of a vector
count as other vectors. Repeated ids are separate rows, but a row is never its own neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellore.runtime import checkpoint, even_partitions

DIMENSION = 64
K = 5
LINKS = 16
EF_BUILD = 64
EF_SEARCH = 64
SLICES = 4
SLICE_ROWS = 131_072
QUERY_BLOCK = 4_096
PARTS = 16
CELL_ROWS = 32_768
SHARD_ROWS = 65_536
SAMPLE = 20_000
PROBED = 500
COVER = 0.98
BLOCK = 512
ROUTED = 4_096
BLOCK_ROWS = 4_096
STREAMS = 4
TILE = 256
TASKS = 64  # of comparing, at least, as far as `STREAMS` allows
SLACK = 1.2e-6  # what rounding to six digits and single precision can move a similarity


# --- one graph -------------------------------------------------------------------------------------


def levels_of(keys: np.ndarray, links: int = LINKS) -> np.ndarray:
    """The level each node reaches, from its key alone."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    u = ((x >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    return np.minimum(12, (-np.log(u) / math.log(links)).astype(np.int64))


def best_first(vectors: np.ndarray, table: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search over one level for all queries at once: node numbers and similarities, best first.

    ``table`` has the neighbours of each node of ``vectors``; unused places are -1.
    """
    rows, width = len(queries), table.shape[1]
    seen = np.zeros((rows, len(vectors)), dtype=bool)
    nodes = np.full((rows, ef), -1, dtype=np.int64)
    sims = np.full((rows, ef), -np.inf, dtype=np.float32)
    open_ = np.zeros((rows, ef), dtype=bool)
    start = min(ef, entries.shape[1])
    nodes[:, :start] = entries[:, :start]
    valid = nodes >= 0
    r, c = np.nonzero(valid)
    sims[r, c] = np.einsum("ij,ij->i", queries[r], vectors[nodes[r, c]])
    open_[r, c] = True
    seen[r, nodes[r, c]] = True
    active = np.arange(rows)
    step = 4
    while active.size:
        score = np.where(open_[active], sims[active], -np.inf)
        pick = np.argpartition(-score, min(step, ef) - 1, axis=1)[:, :step]
        ok = np.take_along_axis(score, pick, 1) > -np.inf
        alive = ok.any(axis=1)
        active, pick, ok = active[alive], pick[alive], ok[alive]
        if not active.size:
            break
        at, place = np.nonzero(ok)
        open_[active[at], pick[at, place]] = False
        near = table[nodes[active[at], pick[at, place]]]
        owner = np.repeat(at, width)
        near = near.ravel()
        keep = near >= 0
        owner, near = owner[keep], near[keep]
        new = ~seen[active[owner], near]
        pair = np.unique(owner[new] * len(vectors) + near[new])
        owner, near = pair // len(vectors), pair % len(vectors)
        seen[active[owner], near] = True
        if not owner.size:
            continue
        sim = np.einsum("ij,ij->i", queries[active[owner]], vectors[near])
        better = sim > sims[active[owner], -1]
        owner, near, sim = owner[better], near[better], sim[better]
        if not owner.size:
            continue
        count = np.bincount(owner, minlength=len(active))
        most = int(count.max())
        column = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        more_nodes = np.full((len(active), most), -1, dtype=np.int64)
        more_sims = np.full((len(active), most), -np.inf, dtype=np.float32)
        more_nodes[owner, column], more_sims[owner, column] = near, sim
        all_nodes = np.concatenate([nodes[active], more_nodes], 1)
        all_sims = np.concatenate([sims[active], more_sims], 1)
        all_open = np.concatenate([open_[active], more_nodes >= 0], 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
        nodes[active] = np.take_along_axis(all_nodes, order, 1)
        sims[active] = np.take_along_axis(all_sims, order, 1)
        open_[active] = np.take_along_axis(all_open, order, 1)
    return nodes, sims


def diverse(vectors: np.ndarray, nodes: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Up to ``links`` of each row's candidates (best first): those nearer to the row's own vector than
    to any candidate taken before; free places go to the best of the rest."""
    rows, width = nodes.shape
    own = vectors[np.maximum(nodes, 0)]
    between = np.einsum("ijk,ilk->ijl", own, own)
    valid = nodes >= 0
    taken = np.zeros((rows, width), dtype=bool)
    covered = np.full((rows, width), -np.inf, dtype=np.float32)
    for j in range(width):
        take = valid[:, j] & (sims[:, j] > covered[:, j]) & (taken.sum(1) < links)
        taken[:, j] = take
        np.maximum(covered, np.where(take[:, None], between[:, j, :], -np.inf), out=covered)
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :links]
    return np.take_along_axis(np.where(valid, nodes, -1), order, 1)


def _link_back(vectors: np.ndarray, table: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
    """Add sources to their targets' neighbours; a full list is chosen anew."""
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    who, count = np.unique(targets, return_counts=True)
    width = table.shape[1]
    column = np.arange(len(targets)) - np.repeat(np.cumsum(count) - count, count)
    more = np.full((len(who), int(count.max())), -1, dtype=np.int64)
    more[np.repeat(np.arange(len(who)), count), column] = sources
    everyone = np.concatenate([table[who], more], 1)
    sims = np.where(everyone >= 0, np.einsum("ik,ijk->ij", vectors[who], vectors[np.maximum(everyone, 0)]), -np.inf).astype(np.float32)
    best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
    everyone, sims = np.take_along_axis(everyone, best, 1), np.take_along_axis(sims, best, 1)
    few = (everyone >= 0).sum(1) <= width
    table[who[few]] = everyone[few][:, :width] if everyone.shape[1] >= width else np.pad(everyone[few], ((0, 0), (0, width - everyone.shape[1])), constant_values=-1)
    if (~few).any():
        table[who[~few]] = diverse(vectors, everyone[~few], sims[~few], width)


class Graph:
    """A hierarchical small-world graph over unit vectors, held in flat arrays."""

    def __init__(self, vectors: np.ndarray, tables: list[np.ndarray], members: list[np.ndarray]):
        self.vectors, self.tables, self.members = vectors, tables, members  # members: nodes of each level

    @classmethod
    def build(cls, vectors: np.ndarray, keys: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> Graph:
        """Levels are built from the top, so that each insertion descends through finished ones."""
        levels = levels_of(keys, links)
        graph = cls(vectors, [], [])
        for level in range(int(levels.max(initial=0)), -1, -1):
            members = np.nonzero(levels >= level)[0]
            graph.members.insert(0, members)
            graph.tables.insert(0, np.full((len(members), 2 * links if level == 0 else links), -1, dtype=np.int32))
            graph._fill(links, ef)
        return graph

    def _fill(self, links: int, ef: int) -> None:
        """Insert the nodes of the lowest level so far, in blocks that at most double the level."""
        members, table = self.members[0], self.tables[0]
        vectors = self.vectors[members]
        done = 0
        while done < len(members):
            block = np.arange(done, min(len(members), done + max(32, min(BLOCK, done))))
            own = vectors[block]
            within = own @ own.T
            np.fill_diagonal(within, -np.inf)
            near = np.argsort(-within, axis=1)[:, : min(ef, len(block) - 1)]
            nodes, sims = block[near], np.take_along_axis(within, near, 1)
            if done:
                entries = self._descend(own, 1, done)
                found, found_sims = best_first(vectors[:done], table[:done], own, entries, ef)
                nodes, sims = np.concatenate([nodes, found], 1), np.concatenate([sims, found_sims], 1)
            if not nodes.shape[1]:
                done += len(block)
                continue
            order = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
            nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
            chosen = diverse(vectors, nodes, sims, links)
            table[block, : chosen.shape[1]] = chosen
            r, c = np.nonzero(chosen >= 0)
            _link_back(vectors, table, block[r], chosen[r, c])
            done += len(block)

    def _descend(self, queries: np.ndarray, to: int, most: int | None = None) -> np.ndarray:
        """Entry nodes (numbers within level to-1) for each query; only below ``most`` if given."""
        entries = np.zeros((len(queries), 1), dtype=np.int64)
        for level in range(len(self.members) - 1, to - 1, -1):
            members = self.members[level]
            found, _ = best_first(self.vectors[members], self.tables[level], queries, entries, 4)
            entries = np.where(found >= 0, np.searchsorted(self.members[level - 1], members[np.maximum(found, 0)]), -1)
        if most is not None:
            entries = np.where(entries < most, entries, -1)
            entries[(entries < 0).all(1), 0] = 0
        return entries

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest nodes of each query, best first; -1 where there are fewer."""
        ef = max(ef, k)
        nodes, sims = [], []
        for at in range(0, len(queries), BLOCK):
            block = queries[at : at + BLOCK]
            n, s = best_first(self.vectors, self.tables[0], block, self._descend(block, 1), ef)
            nodes.append(n[:, :k])
            sims.append(s[:, :k])
        return np.concatenate(nodes), np.concatenate(sims)


# --- shards ----------------------------------------------------------------------------------------


def unit(blob: pd.Series, dimension: int) -> np.ndarray:
    """Rows of packed floats as unit vectors."""
    flat = np.frombuffer(b"".join(blob), dtype=np.float32).reshape(-1, dimension).astype(np.float64)
    flat /= np.abs(flat).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def centroids_of(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """k-means on the sphere, started from the sample's first rows."""
    centres = sample[:cells].copy()
    for _ in range(rounds if cells > 1 else 0):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def pack_vectors(df: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    """The usable rows as (vec_id, key of equal vectors, packed floats)."""
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("vec_id").isNotNull())
    v = F.col("v")
    rows = rows.filter(v.isNotNull() & (F.size(v) == dimension)).filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(3.4028234663852886e38)))).filter(F.exists(v, lambda x: x != 0))
    same = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("float"))  # -0 equals 0
    return rows.select("vec_id", same.alias("v")).select("vec_id", F.xxhash64("v").alias("key"), F.xxhash64("v", F.lit(1)).alias("key2"), "v")


def _route(centres: np.ndarray, shards: np.ndarray, dimension: int, probes: int = 0):
    """Points to a shard of their nearest cell; or, with ``probes``, to all shards of that many nearest cells."""
    first = np.concatenate([[0], np.cumsum(shards)])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROUTED):
                part = batch.iloc[at : at + ROUTED]
                near = unit(part["packed"], dimension) @ centres.T
                if not probes:
                    cell = near.argmax(1)
                    salt = (part["node"].to_numpy().astype(np.uint64) >> np.uint64(7)) % shards[cell].astype(np.uint64)
                    yield pd.DataFrame({"shard": first[cell] + salt.astype(np.int64), "node": part["node"], "packed": part["packed"]})
                    continue
                cells = np.argpartition(-near, probes - 1, axis=1)[:, :probes].ravel() if probes < len(centres) else np.tile(np.arange(len(centres)), len(part))
                many = shards[cells]
                owner = np.repeat(np.repeat(np.arange(len(part)), probes), many)
                shard = np.repeat(first[cells], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield pd.DataFrame({"shard": shard, "node": part["node"].to_numpy()[owner], "packed": part["packed"].to_numpy()[owner]})

    return route


def _nearest_of(queries: np.ndarray, nodes: np.ndarray, k: int, dimension: int):
    """The k nearest vectors of each query in each batch, by brute force; a vector is not its own neighbour."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROUTED):
                part = batch.iloc[at : at + ROUTED]
                found = queries @ unit(part["packed"], dimension).T
                own = part["node"].to_numpy()
                found[nodes[:, None] == own[None, :]] = -np.inf
                best = np.argpartition(-found, min(k, found.shape[1]) - 1, axis=1)[:, :k]
                sims = np.take_along_axis(found, best, 1).ravel()
                query = np.repeat(np.arange(len(queries), dtype=np.int32), best.shape[1])
                ok = sims > -np.inf
                yield pd.DataFrame({"query": query[ok], "sim": sims[ok], "other": own[best.ravel()[ok]], "packed": part["packed"].to_numpy()[best.ravel()[ok]]})

    return nearest


def exact_neighbours(groups: DataFrame, queries: pd.DataFrame, k: int, dimension: int = DIMENSION) -> DataFrame:
    """query (its row), other, sim, packed: the true k nearest of ``groups`` (node, packed) for the rows of ``queries``, a bounded set on the driver."""
    near = groups.select("node", "packed").mapInPandas(_nearest_of(unit(queries["packed"], dimension), queries["node"].to_numpy(), k, dimension), "query int, sim float, other bigint, packed binary")
    return near.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "other"))).filter(F.col("place") <= k).drop("place")


def probes_needed(groups: DataFrame, centres: np.ndarray, k: int, dimension: int = DIMENSION, cover: float = COVER) -> int:
    """The least number of nearest cells that hold at least the share ``cover`` of the true neighbours of `PROBED` vectors."""
    if len(centres) == 1:
        return 1
    queries = groups.select("node", "packed", F.xxhash64("node", F.lit(11)).alias("h")).orderBy("h").limit(PROBED).select("node", "packed").toPandas()
    found = exact_neighbours(groups, queries, k, dimension).select("query", "packed").toPandas()  # k for each of PROBED
    if not len(found):
        return 1
    near = unit(queries["packed"], dimension) @ centres.T
    home = (unit(found["packed"], dimension) @ centres.T).argmax(1)
    asked = found["query"].to_numpy()
    ranks = (near[asked] > near[asked, home][:, None]).sum(axis=1) + 1
    return int(np.sort(ranks)[math.ceil(cover * len(ranks)) - 1])


INDEX_SCHEMA = "shard bigint, nodes binary, vectors binary, level_sizes array<int>, members binary, tables binary, links int"


def _build(dimension: int, links: int, ef: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        nodes, vectors = rows["node"].to_numpy(), unit(rows["packed"], dimension)
        mixed = np.argsort(nodes * 2654435761 % 2**31, kind="stable")  # inserted in no order of likeness
        nodes, vectors = nodes[mixed], vectors[mixed]
        graph = Graph.build(vectors, nodes, links, ef)
        return pd.DataFrame([{
            "shard": rows["shard"].iloc[0], "nodes": nodes.astype(np.int64).tobytes(), "vectors": vectors.tobytes(),
            "level_sizes": [len(m) for m in graph.members], "members": b"".join(m.astype(np.int32).tobytes() for m in graph.members),
            "tables": b"".join(t.astype(np.int32).tobytes() for t in graph.tables), "links": links,
        }])

    return build


def load_graph(row: dict, dimension: int) -> tuple[np.ndarray, Graph]:
    """The node keys and the graph of one index row."""
    members = np.frombuffer(row["members"], dtype=np.int32).astype(np.int64)
    tables = np.frombuffer(row["tables"], dtype=np.int32)
    links, at, place, ms, ts = int(row["links"]), 0, 0, [], []
    for level, size in enumerate(row["level_sizes"]):
        width = 2 * links if level == 0 else links
        ms.append(members[at : at + size])
        ts.append(tables[place : place + size * width].reshape(size, width))
        at, place = at + size, place + size * width
    return np.frombuffer(row["nodes"], dtype=np.int64), Graph(np.frombuffer(row["vectors"], dtype=np.float32).reshape(-1, dimension), ts, ms)


def _search(dimension: int, k: int, ef: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"node": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float32")})
        if not len(index) or not len(queries):
            return empty
        nodes, graph = load_graph(index.iloc[0].to_dict(), dimension)
        found, sims = graph.search(unit(queries["packed"], dimension), k + 1, ef)
        own = np.repeat(queries["node"].to_numpy(), found.shape[1])
        other, sims = nodes[np.maximum(found.ravel(), 0)], sims.ravel()
        ok = (found.ravel() >= 0) & (other != own)
        return pd.DataFrame({"node": own[ok], "other": other[ok], "sim": sims[ok]})

    return search


def _in_shards(groups: DataFrame, centres: np.ndarray, shards: np.ndarray, dimension: int) -> DataFrame:
    """``groups`` (node, packed) by shard."""
    points = groups.select("node", "packed").mapInPandas(_route(centres, shards, dimension), "shard bigint, node bigint, packed binary")
    count = int(shards.sum())
    return points.repartition(even_partitions(groups.sparkSession.range(count), count), "shard")  # not merged: few rows but much work


def build_index(groups: DataFrame, centres: np.ndarray, shards: np.ndarray, dimension: int = DIMENSION, links: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """One row of flat arrays per shard over ``groups`` (node, packed)."""
    return _in_shards(groups, centres, shards, dimension).groupBy("shard").applyInPandas(_build(dimension, links, ef), INDEX_SCHEMA)


def _cells(groups: DataFrame, count: int, cell_rows: int, shard_rows: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The centres of cells of about ``cell_rows`` of ``groups``, and over how many shards of at most about ``shard_rows`` each is divided."""
    cells = max(1, math.ceil(count / cell_rows))
    sample = groups.select("packed", F.xxhash64("node", F.lit(7)).alias("h")).orderBy("h").limit(max(SAMPLE, 4 * cells)).select("packed").toPandas()
    centres = centroids_of(unit(sample["packed"], dimension), cells)
    in_cell = groups.select("node", "packed").mapInPandas(_route(centres, np.ones(cells, dtype=np.int64), dimension), "shard bigint, node bigint, packed binary").groupBy("shard").count().collect()  # a row per cell
    shards = np.ones(cells, dtype=np.int64)
    for r in in_cell:
        shards[r["shard"]] = math.ceil(r["count"] / shard_rows)
    return centres, shards


def _near_in_graphs(groups: DataFrame, count: int, k: int, dimension: int, cell_rows: int, links: int, ef_build: int, ef_search: int, probes: int) -> DataFrame:
    """node, other, sim: up to k near neighbours of each of ``groups``, from the graphs of its ``probes`` nearest cells (0: as many as are measured to be needed)."""
    spark = groups.sparkSession
    centres, shards = _cells(groups, count, cell_rows, SHARD_ROWS, dimension)
    cells = len(centres)
    probes = min(cells, probes or probes_needed(groups, centres, k, dimension))
    index = checkpoint(build_index(groups, centres, shards, dimension, links, ef_build))
    # a graph is asked in slices, each with a copy of it
    slices = max(SLICES, math.ceil(count * probes / cells / SLICE_ROWS))
    graphs = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    queries = groups.select("node", "packed").mapInPandas(_route(centres, shards, dimension, probes), "shard bigint, node bigint, packed binary")
    queries = queries.withColumn("slice", F.pmod(F.xxhash64("node"), F.lit(slices)).cast("int"))
    pairs = spark.range(int(shards.sum()) * slices).select(F.floor(F.col("id") / slices).alias("shard"), (F.col("id") % slices).cast("int").alias("slice"))
    parts = even_partitions(pairs, int(shards.sum()) * slices)
    graphs, queries = (x.repartition(parts, "shard", "slice") for x in (graphs, queries))
    near = graphs.groupBy("shard", "slice").cogroup(queries.groupBy("shard", "slice")).applyInPandas(_search(dimension, k, ef_search), "node bigint, other bigint, sim float")
    best = near.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy(F.desc("sim"), "other"))).filter(F.col("place") <= k)
    return best.select("node", "other", F.round(F.col("sim").cast("double"), 6).alias("sim"))


# --- blocks against blocks -------------------------------------------------------------------------


def better(sims: np.ndarray, nodes: np.ndarray, own: np.ndarray, queries: np.ndarray, others: np.ndarray, vectors: np.ndarray) -> int:
    """Bring the best of each query (similarities in six digits and nodes, best first; -inf where none) up to date with a block of other vectors, in place.

    A query's own node is left out, equal similarities go to the smaller node. Queries that the block cannot
    better are passed over: none of its vectors is nearer to the query than the query's angle to the block's
    middle less the widest angle in the block. Returns the number of queries compared.
    """
    k = sims.shape[1]
    middle = vectors.sum(axis=0, dtype=np.float64)
    middle /= max(np.linalg.norm(middle), 1e-12)
    widest = np.arccos(np.clip((vectors @ middle).min(), -1, 1))
    angle = np.arccos(np.clip(queries @ middle, -1, 1)) - widest - 1e-3  # single precision moves small angles by less
    asking = np.flatnonzero(np.cos(np.clip(angle, 0, np.pi)) >= sims[:, -1] - SLACK)
    space = np.empty((min(TILE, len(asking)), len(vectors)), dtype=np.float32)  # small enough to stay in a cache
    for at in range(0, len(asking), TILE):
        rows = asking[at : at + TILE]
        found = np.matmul(queries[rows], vectors.T, out=space[: len(rows)])
        least = (sims[rows, -1] - SLACK).astype(np.float32)
        few = np.flatnonzero(np.isneginf(least))
        if few.size and found.shape[1] > k + 1:  # the k best and the query itself
            least[few] = np.partition(found[few], -k - 1, axis=1)[:, -k - 1] - SLACK
        hot = np.flatnonzero(found.max(axis=1) >= least)
        found = found[hot]
        hits = np.flatnonzero(found >= least[hot][:, None])
        query, sim, node = rows[hot[hits // len(vectors)]], np.round(found.ravel()[hits].astype(np.float64), 6), others[hits % len(vectors)]
        keep = (node != own[query]) & ((sim > sims[query, -1]) | ((sim == sims[query, -1]) & (node < nodes[query, -1])))
        who = np.unique(query[keep])
        query = np.concatenate([np.repeat(who, k), query[keep]])
        sim, node = np.concatenate([sims[who].ravel(), sim[keep]]), np.concatenate([nodes[who].ravel(), node[keep]])
        order = np.lexsort((node, -sim, query))
        place = order[np.searchsorted(query[order], who)[:, None] + np.arange(k)]
        sims[who], nodes[who] = sim[place], node[place]
    return len(asking)


def _cut(dimension: int):
    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        nodes, vectors = rows["node"].to_numpy(), unit(rows["packed"], dimension)
        count = math.ceil(len(rows) / BLOCK_ROWS)
        order = np.argsort((vectors @ centroids_of(vectors, count).T).argmax(1), kind="stable")
        blocks = np.array_split(order, count)
        return pd.DataFrame({"block": [f"{rows['shard'].iloc[0]}/{i}" for i in range(count)], "nodes": [nodes[b].astype(np.int64).tobytes() for b in blocks], "vectors": [vectors[b].tobytes() for b in blocks]})

    return cut


def _compare(dimension: int, k: int):
    """Pairs of a block (nodes, vectors) and a block that asks (block, own, queries) to the k best of each asking block's vectors."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asking = {}  # the blocks of one partition
        for batch in batches:
            for block, own, queries, others, vectors in batch[["block", "own", "queries", "nodes", "vectors"]].itertuples(index=False):
                if block not in asking:
                    own = np.frombuffer(own, dtype=np.int64).copy()
                    queries = np.frombuffer(queries, dtype=np.float32).reshape(-1, dimension).copy()
                    asking[block] = np.full((len(own), k), -np.inf), np.full((len(own), k), np.iinfo(np.int64).max), own, queries
                better(*asking[block], np.frombuffer(others, dtype=np.int64), np.frombuffer(vectors, dtype=np.float32).reshape(-1, dimension))
        for block, (sims, nodes, own, _) in asking.items():
            yield pd.DataFrame([{"block": block, "own": own.tobytes(), "others": nodes.tobytes(), "sims": sims.tobytes()}])

    return compare


def _merge(k: int):
    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        sims = np.concatenate([np.frombuffer(x, dtype=np.float64).reshape(-1, k) for x in parts["sims"]], axis=1)
        others = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, k) for x in parts["others"]], axis=1)
        best = np.lexsort((others, -sims), axis=1)[:, :k]
        sims, others = np.take_along_axis(sims, best, 1).ravel(), np.take_along_axis(others, best, 1).ravel()
        ok = sims > -np.inf
        return pd.DataFrame({"node": np.repeat(np.frombuffer(parts["own"].iloc[0], dtype=np.int64), k)[ok], "other": others[ok], "sim": sims[ok]})

    return merge


def _near_in_blocks(groups: DataFrame, count: int, k: int, dimension: int, cell_rows: int) -> DataFrame:
    """node, other, sim: the k nearest neighbours of each of ``groups`` (node, packed) among all of them."""
    centres, shards = _cells(groups, count, min(cell_rows, 2 * BLOCK_ROWS), 4 * BLOCK_ROWS, dimension)
    blocks = checkpoint(_in_shards(groups, centres, shards, dimension).groupBy("shard").applyInPandas(_cut(dimension), "block string, nodes binary, vectors binary"))
    asking = blocks.select("block", F.col("nodes").alias("own"), F.col("vectors").alias("queries"))
    streams = min(STREAMS, math.ceil(TASKS / int(shards.sum())))
    streamed = blocks.select("nodes", "vectors").coalesce(streams)
    # each partition of the one with each of the other, read where they are stored
    pairs = streamed.hint("shuffle_replicate_nl").crossJoin(asking)
    near = pairs.mapInPandas(_compare(dimension, k), "block string, own binary, others binary, sims binary")
    return near.groupBy("block").applyInPandas(_merge(k), "node bigint, other bigint, sim double")


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """The distinct vectors: node (the smallest id), number of copies, the k+1 smallest ids, packed floats."""
    return vectors.groupBy("key", "key2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("v").alias("v"))


def neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dimension: int = DIMENSION, cell_rows: int = CELL_ROWS, links: int = LINKS, ef_build: int = EF_BUILD, ef_search: int = EF_SEARCH, probes: int | None = None) -> DataFrame:
    """For every usable row its k most similar other rows: vec_id, rank from 1, neighbour_id, cosine.

    ``links``, ``ef_build`` and ``ef_search`` are those of the graphs, which are asked only if ``probes`` is given.
    """
    spark = df.sparkSession
    rows = pack_vectors(df, id_col, vector_col, dimension)
    groups = checkpoint(distinct_vectors(rows).mapInPandas(_pack(dimension), "key bigint, key2 bigint, node bigint, copies bigint, packed binary"))
    count = groups.count()
    result = "vec_id bigint, rank int, neighbour_id bigint, cosine double"
    if count == 0:
        return spark.createDataFrame([], result)
    near = _near_in_blocks(groups, count, k, dimension, cell_rows) if probes is None else _near_in_graphs(groups, count, k, dimension, cell_rows, links, ef_build, ef_search, probes)
    best = checkpoint(near)
    # the smallest ids of each distinct vector that has copies: at most k+1, cut down before the shuffle
    many = groups.filter("copies > 1").select("key", "key2", "node")
    copies = rows.select("vec_id", "key", "key2")
    first = copies.withColumn("n", F.row_number().over(W.partitionBy("key", "key2").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    first = first.join(many, ["key", "key2"]).groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k+1 at most
    others = best.join(first.withColumnRenamed("node", "other"), "other", "left").select("node", "sim", F.explode(F.coalesce("ids", F.array("other"))).alias("id"))
    own = first.select("node", F.lit(1.0).alias("sim"), F.explode("ids").alias("id"))
    listed = others.unionByName(own).groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("minus"), "id"))).alias("list"))  # k*(k+1)+k+1 at most
    members = copies.join(groups.select("key", "key2", "node"), ["key", "key2"]).select("vec_id", "node")
    each = members.join(listed, "node").select("vec_id", F.slice(F.filter("list", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("list"))
    return each.select("vec_id", F.posexplode("list").alias("at", "x")).select("vec_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.round(-F.col("x.minus"), 6).alias("cosine"))


def _pack(dimension: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blobs = [np.asarray(v, dtype=np.float32).tobytes() for v in batch["v"]]
            yield batch.drop(columns="v").assign(packed=blobs)

    return pack


def similar_pairs(found: DataFrame, least: float) -> DataFrame:
    """The pairs a < b of cosine ``least`` or more where one is a neighbour of the other."""
    close = found.filter(F.col("cosine") >= least)
    return close.select(F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")).distinct()


def recall_against_brute_force(df: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dimension: int = DIMENSION, every: int = 20) -> DataFrame:
    """One row: queries (the usable rows whose id is divisible by ``every``), and the share of their k neighbours that are as near as the true ones.

    The query set is compared with all rows in blocks: each task holds a block of queries, which are shared out
    by hash, and streams over a share of the rows.
    """
    rows = pack_vectors(df, id_col, vector_col, dimension).select(F.col("vec_id").alias("node"), "v")
    packed = rows.withColumn("key", F.lit(0)).mapInPandas(_pack(dimension), "node bigint, key int, packed binary").select("node", "packed")
    packed = checkpoint(packed)
    asked = packed.filter(F.pmod("node", F.lit(every)) == 0)
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    spread = packed.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(PARTS)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [x.assign(query=left["node"].to_numpy()[x["query"]]) for x in _nearest_of(unit(left["packed"], dimension), left["node"].to_numpy(), k, dimension)(iter([right]))] if len(left) and len(right) else []
        return pd.concat(out)[["query", "sim"]] if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float32")})

    true = asked.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInPandas(compare, "query bigint, sim float")
    true = true.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim")))).filter(F.col("place") <= k)
    least = true.groupBy("query").agg(F.min("sim").alias("least"), F.count("*").alias("wanted"))
    hits = found.join(least, found["vec_id"] == least["query"]).groupBy("query").agg(F.max("wanted").alias("wanted"), F.count_if(F.col("cosine") >= F.col("least") - 1e-5).alias("hit"))
    return hits.agg(F.count("*").alias("queries"), F.round(F.try_divide(F.sum(F.least("hit", "wanted")), F.sum("wanted")), 4).alias("recall"))
