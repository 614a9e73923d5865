"""Approximate nearest neighbours: one navigable small-world graph per shard.

Vectors are dealt by hash into shards of bounded size.  Each shard's
hierarchical graph is built in one task by insertion: nodes come in blocks that
grow with the graph; a block's nodes search the graph as it stands for
candidates, see the earlier nodes of their own block, link to the diverse ones
among the nearest on each of their layers, and those link back.  The graph is
kept as flat neighbour arrays, one table row a shard.  Queries pass by every
shard's graph in batches, all of a batch at once: greedy descent through the
upper layers, then a beam on the lowest.  A graph travels once; queries are a
stated set and go to each shard.  What the beam holds is scored in double
precision on the original vectors, and the shards' results are merged.

Vectors of one direction are one node with the smallest few identifiers, which
is all a result can need of them, so a vector that very many rows share, or
share up to a factor, costs one node.  Directions are equal when their
components agree to twelve decimals: cosines that differ by less are ties.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without identifier, take no part; rows that repeat an
identifier count once, with the smallest vector; vectors are compared with
those of their own dimension only; ties go to the smaller identifier; with
fewer candidates than asked for, all come back; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.textkit import map_batches
from tessera.storage import materialise

SHARD = 8192
#: Links a node makes, links it keeps on the lowest layer, candidates for links, width of the search.
LINKS, LOWEST_LINKS, CANDIDATES, BEAM = 16, 32, 40, 128
#: The first nodes see all before them; then a block has at most so many nodes, and no more than there are already.
FIRST, BLOCK = 256, 512
#: Nodes of the beam whose neighbours are looked at in one step.
STEP = 4
#: Decimals to which directions are compared, and the difference of cosines that this allows.
DECIMALS, SAME = 12, 1e-10

#: Shards whose numbers are sent to all tasks; more are joined by dimension.
BROADCAST = 100_000
INDEX = "shard long, dim int, vectors binary, ids binary, sizes binary, entry int, layers array<struct<nodes:binary,links:binary>>"


def _diverse(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """From candidates by falling similarity (-1: none), those nearer to the node than to one chosen before; the nearest others fill up."""
    rows, width = near.shape
    points = vectors[np.maximum(near, 0)]
    among = points @ points.transpose(0, 2, 1)
    chosen = np.zeros((rows, width), bool)
    nearest_chosen = np.full((rows, width), -np.inf, np.float32)
    for t in range(width):
        take = (near[:, t] >= 0) & (chosen.sum(axis=1) < most) & (sims[:, t] > nearest_chosen[:, t])
        chosen[take, t] = True
        nearest_chosen[take] = np.maximum(nearest_chosen[take], among[take, t])
    # chosen first, then the nearest that were passed over
    order = np.argsort(np.where(chosen, 0, np.where(near >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(near, order, axis=1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


class Graph:
    """Unit vectors with, from the lowest layer up, (nodes, neighbour array by position in nodes; -1: none)."""

    def __init__(self, vectors: np.ndarray, entry: int, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.entry, self.layers = vectors, entry, layers

    def descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        """The node at which each query's greedy walk through the layers above ``level`` ends."""
        at = np.full(len(queries), self.entry)
        for nodes, links in reversed(self.layers[level + 1 :]):
            place = np.searchsorted(nodes, at)
            best = np.einsum("ij,ij->i", self.vectors[nodes[place]], queries)
            moving = np.arange(len(queries))
            while len(moving):
                around = links[place[moving]]
                sims = np.einsum("ijk,ik->ij", self.vectors[nodes[np.maximum(around, 0)]], queries[moving])
                sims[around < 0] = -np.inf
                step = sims.argmax(axis=1)
                value = sims[np.arange(len(moving)), step]
                better = value > best[moving]
                moving, value, around, step = moving[better], value[better], around[better], step[better]
                best[moving], place[moving] = value, around[np.arange(len(moving)), step]
            at = nodes[place]
        return at

    def beam(self, queries: np.ndarray, level: int, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``width`` nodes of a layer for each query (-1: none) and their similarities, falling."""
        nodes, links = self.layers[level]
        vectors = self.vectors if len(nodes) == len(self.vectors) else self.vectors[nodes]
        count = len(queries)
        found = np.full((count, width), -1, np.int64)
        sims = np.full((count, width), -np.inf, np.float32)
        done = np.zeros((count, width), bool)
        seen = np.zeros((count, len(nodes) + 1), bool)
        seen[:, -1] = True  # where "none" points
        found[:, 0] = np.searchsorted(nodes, start)
        sims[:, 0] = np.einsum("ij,ij->i", vectors[found[:, 0]], queries)
        seen[np.arange(count), found[:, 0]] = True
        active = np.arange(count)
        step = min(STEP, width)
        while True:
            waiting = np.where(done[active], -np.inf, sims[active])
            pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
            ready = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            going = ready.any(axis=1)
            active, pick, ready = active[going], pick[going], ready[going]
            if not len(active):
                break
            rows = np.arange(len(active))[:, None]
            done[active[:, None], pick] |= ready
            around = np.where(ready[:, :, None], links[found[active[:, None], pick]], -1)
            new = np.empty(around.shape, bool)
            for k in range(step):  # one node may be named by two of the expanded
                new[:, k] = ~seen[active[:, None], around[:, k]]
                seen[active[:, None], around[:, k]] = True
            around, new = around.reshape(len(active), -1), new.reshape(len(active), -1)
            i, j = np.nonzero(new)
            if len(i):
                nearby = around[i, j]
                value = np.einsum("ij,ij->i", vectors[nearby], queries[active[i]])
                place = np.arange(len(i)) - np.searchsorted(i, i)
                wide = int(place.max()) + 1
                more, gain = np.full((len(active), wide), -1, np.int64), np.full((len(active), wide), -np.inf, np.float32)
                more[i, place], gain[i, place] = nearby, value
                every = np.concatenate([sims[active], gain], axis=1)
                order = np.argpartition(-every, width - 1, axis=1)[:, :width]
                sims[active] = every[rows, order]
                found[active] = np.concatenate([found[active], more], axis=1)[rows, order]
                done[active] = np.concatenate([done[active], np.zeros(more.shape, bool)], axis=1)[rows, order]
        order = np.argsort(-sims, axis=1, kind="stable")
        found = np.take_along_axis(found, order, axis=1)
        return np.where(found >= 0, nodes[np.maximum(found, 0)], -1), np.take_along_axis(sims, order, axis=1)

    def search(self, queries: np.ndarray, width: int = BEAM) -> np.ndarray:
        """Up to ``width`` nodes for each query (-1: none), by falling similarity."""
        return self.beam(queries, 0, self.descend(queries, 0), width)[0]


def _link(graph: Graph, level: int, fresh: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
    """Adds the nodes ``fresh`` (higher than all of the layer) with links to the diverse ones of their candidates, and back."""
    most = LOWEST_LINKS if level == 0 else LINKS
    nodes, links = graph.layers[level]
    chosen = _diverse(near, sims, graph.vectors, LINKS)
    nodes = np.concatenate([nodes, fresh])
    links = np.concatenate([links, np.full((len(fresh), most), -1, np.int32)])
    real = chosen >= 0
    ends = np.searchsorted(nodes, chosen[real])
    starts = np.repeat(np.arange(len(nodes) - len(fresh), len(nodes)), real.sum(axis=1))
    # both directions, by node: what it had, then what comes
    into = np.concatenate([ends, starts])
    other = np.concatenate([starts, ends])
    touched = np.unique(into)
    order = np.argsort(into, kind="stable")
    into, other = np.searchsorted(touched, into[order]), other[order]
    place = np.arange(len(into)) - np.searchsorted(into, into)
    come = np.full((len(touched), int(place.max(initial=0)) + 1), -1, np.int64)
    come[into, place] = other
    every = np.concatenate([links[touched], come], axis=1)
    vectors = graph.vectors[nodes] if len(nodes) < len(graph.vectors) else graph.vectors
    for low in range(0, len(touched), BLOCK):
        part = every[low : low + BLOCK]
        value = np.einsum("ijk,ik->ij", vectors[np.maximum(part, 0)], vectors[touched[low : low + BLOCK]])
        value[part < 0] = -np.inf
        nearest = np.argsort(-value, axis=1, kind="stable")[:, : 2 * most]
        part, value = np.take_along_axis(part, nearest, axis=1), np.take_along_axis(value, nearest, axis=1)
        links[touched[low : low + BLOCK]] = _diverse(part, value, vectors, most)
    graph.layers[level] = (nodes, links)


def build(vectors: np.ndarray, seed: int) -> Graph:
    """The graph of unit vectors, inserted in their order."""
    rng = np.random.default_rng(seed)
    top = np.floor(-np.log(1 - rng.random(len(vectors))) / math.log(LINKS)).astype(int)
    graph = Graph(vectors, 0, [])
    low = 0
    while low < len(vectors):
        high = min(len(vectors), low + (FIRST if low == 0 else min(BLOCK, low)))
        block = np.arange(low, high)
        own = vectors[block] @ vectors[block].T
        own[np.triu_indices(len(block))] = -np.inf  # earlier nodes only
        for level in range(int(top[block].max()) + 1):
            if level == len(graph.layers):
                graph.layers.append((np.empty(0, np.int32), np.empty((0, LOWEST_LINKS if level == 0 else LINKS), np.int32)))
            here = np.flatnonzero(top[block] >= level)
            near = np.where(np.isfinite(own[np.ix_(here, here)]), block[here][None, :], -1)
            sims = own[np.ix_(here, here)]
            if len(graph.layers[level][0]):
                asked = vectors[block[here]]
                # the walk starts at the entry, which is on every layer
                found, value = graph.beam(asked, level, graph.descend(asked, level), min(CANDIDATES, len(graph.layers[level][0])))
                near, sims = np.concatenate([found, near], axis=1), np.concatenate([value, sims], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :CANDIDATES]
            _link(graph, level, block[here].astype(np.int32), np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1))
        if top[block].max() > top[graph.entry] or low == 0:
            graph.entry = int(block[np.argmax(top[block])])
        low = high
    return graph


def _usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, one for each identifier."""
    vector = F.col(embedding).cast("array<double>")
    good = F.size(embedding) > 0
    rows = rows.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & good).select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _nodes(usable: DataFrame, most: int) -> DataFrame:
    """(members): for each direction its ``most`` smallest identifiers with their vectors, the smallest first."""
    largest = F.array_max(F.transform("vector", F.abs))
    scaled = usable.withColumn("scaled", F.transform("vector", lambda x: x / largest))  # squares that neither overflow nor vanish
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x))
    direction = F.transform("scaled", lambda x: F.round(x / norm, DECIMALS) + F.lit(0.0))
    named = scaled.withColumn("direction", direction).select("vec_id", "vector", F.xxhash64("direction").alias("a"), F.xxhash64(F.lit(1), "direction").alias("b"))
    order = Window.partitionBy("a", "b").orderBy("vec_id")
    first = named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)  # limited in the tasks before the shuffle too
    return first.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("vec_id", "vector"))).alias("members")).select("members")


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    query = query / np.abs(query).max()
    return (scaled * query).sum(axis=1) / (np.sqrt((scaled * scaled).sum(axis=1)) * np.sqrt((query * query).sum()))


def index(nodes: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """The graphs of all shards, one row each, over ``nodes`` (members)."""
    shards = max(1, math.ceil(nodes.count() / shard_size))
    first = F.col("members")[0]
    dealt = nodes.withColumn("dim", F.size(first["vector"])).withColumn("shard", F.pmod(F.xxhash64(first["vec_id"]), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        lists = table["members"].combine_chunks()
        members = lists.flatten()
        ids = members.field("vec_id").to_numpy()
        flat = members.field("vector").flatten().to_numpy().reshape(-1, dim)
        limits = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        order = np.argsort(ids[limits[:-1]], kind="stable")
        order = order[np.random.default_rng(7).permutation(len(order))]  # order of insertion
        graph = build(_unit(flat[limits[:-1][order]]), 11)
        sizes = np.diff(limits)[order]
        at = np.arange(sizes.sum()) + np.repeat(limits[:-1][order] - (np.cumsum(sizes) - sizes), sizes)
        layers = [{"nodes": n.tobytes(), "links": k.tobytes()} for n, k in graph.layers]
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int64()),
                "dim": pa.array([dim], pa.int32()),
                "vectors": pa.array([flat[at].tobytes()], pa.binary()),
                "ids": pa.array([ids[at].tobytes()], pa.binary()),
                "sizes": pa.array([sizes.astype(np.int32).tobytes()], pa.binary()),
                "entry": pa.array([graph.entry], pa.int32()),
                "layers": pa.array([layers], pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())]))),
            }
        )

    return materialise(dealt.repartition(shards, "shard").groupBy("shard", "dim").applyInArrow(run, INDEX), "graphs")


class _Shard:
    """A graph with its nodes' members, from a row of INDEX."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.vectors = np.frombuffer(row["vectors"]).reshape(-1, self.dim)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        layers = [(n := np.frombuffer(x["nodes"], np.int32), np.frombuffer(x["links"], np.int32).reshape(len(n), -1)) for x in row["layers"]]
        self.graph = Graph(_unit(self.vectors[self.starts]), row["entry"], layers)

    def nearest(self, ids: list[int], vectors: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        found = self.graph.search(_unit(vectors), min(beam, max(len(self.sizes), k + 1)))
        for query, vector, near in zip(ids, vectors, found, strict=True):
            near = near[near >= 0]
            scores = _cosines(self.vectors[self.starts[near]], vector)
            # nodes that may hold one of the k, the query itself apart; each has at most k + 1 members
            worst = np.sort(scores)[::-1][min(k, len(scores) - 1)] - SAME
            near = near[scores >= worst]
            at = np.concatenate([np.arange(self.starts[n], self.starts[n] + self.sizes[n]) for n in near])
            at = at[self.ids[at] != query]
            scores = _cosines(self.vectors[at], vector)
            for i in np.lexsort((self.ids[at], -scores))[:k].tolist():
                yield query, int(self.ids[at[i]]), float(scores[i])


def nearest(graphs: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each of ``queries`` (vec_id, vector), itself excepted."""
    places = graphs.select("shard", "dim")
    shards = max(1, places.count())
    # each query goes to every shard of its dimension, behind the shard's graph
    asked = queries.select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dim"))
    asked = asked.join(F.broadcast(places) if shards <= BROADCAST else places, "dim")
    wanted = graphs.withColumn("turn", F.lit(0)).unionByName(asked.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    order = ("shard", "dim", "turn")
    wanted = wanted.repartition(shards, "shard", "dim").sortWithinPartitions(*order).select("turn", "query_id", "vector", *graphs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            turns = batch.column("turn").to_numpy()
            cuts = [*np.flatnonzero(turns == 0).tolist(), batch.num_rows]
            out: list[tuple[int, int, float]] = []
            for low, high in zip([0, *cuts], cuts, strict=False):
                if low < high and turns[low] == 0:
                    shard = _Shard({c: batch.column(c)[low].as_py() for c in ("dim", "vectors", "ids", "sizes", "entry", "layers")})
                    low += 1
                if low < high:
                    part = batch.slice(low, high - low)
                    vectors = part.column("vector").flatten().to_numpy().reshape(-1, shard.dim)
                    out += shard.nearest(part.column("query_id").to_pylist(), vectors, k, beam)
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = map_batches(wanted, run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose identifier 50 divides."""
    usable = _usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    graphs = index(materialise(_nodes(usable, 6), "nodes"))
    return nearest(graphs, usable.where(F.col("vec_id") % 50 == 0))
