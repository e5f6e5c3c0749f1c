"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are indexed once, with the ids that share them. Distinct vectors
are dealt by hash into a number of shards that follows from the table alone: up to
SHARDS, more where a shard would outgrow a task. A shard's graph is grown in one task by
insertion: batches of points search the graph that stands so far for their
neighbours and are linked into it. It is stored as flat neighbour arrays. All
blocks of queries then stream past each shard, which is loaded once, and the
shards' results are merged by exact double-precision distance. So the work is
queries times a number of shards that does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import keep

#: Rows of a shard: at least, so that small tables make few shards, and at most, for memory.
LEAST_ROWS, MOST_ROWS = 4_096, 500_000
#: Shards of a table that is large enough for them and small enough for MOST_ROWS.
SHARDS = 64
QUERY_BLOCK = 512
#: Links of a node, and how far a search goes in a shard of LEAST_ROWS rows; in larger
#: ones by the cube root of their number farther, which keeps recall.
LINKS, EFFORT = 16, 160
#: Points that are inserted together, at most, and how far each one searches.
INSERT_BLOCK, INSERT_EFFORT = 1024, 64


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, for building only."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _select(candidates: np.ndarray, dist: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """Neighbours that are nearer to the point than to any neighbour taken before; the rest fill up, nearest first."""
    open_, taken = np.ones(len(candidates), bool), []
    while len(taken) < most and open_.any():
        c = int(open_.argmax())
        taken.append(c)
        open_ &= between[c] > dist
        open_[c] = False
    if len(taken) < most:
        rest = np.ones(len(candidates), bool)
        rest[taken] = False
        taken += np.flatnonzero(rest)[: most - len(taken)].tolist()
    return candidates[taken]


def build_graph(x: np.ndarray, seed: int, links: int = LINKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers (nodes, neighbours) from the bottom up. ``neighbours`` is a flat
    array of 2 * links numbers of rows for each node, -1 where there is none.

    Each node reaches layer l with probability links ** -l. Points are inserted in
    random order, in batches that grow with the graph: each point's candidates are
    what a search of the graph finds in a layer and its nearest in the batch. Links
    are thinned for diversity and made mutual; a node whose links overflow keeps
    those that the same thinning takes.
    """
    n, width = len(x), 2 * links
    rng = np.random.default_rng(seed)
    top = np.floor(-np.log(rng.random(n)) / np.log(links)).astype(int)
    order = rng.permutation(n)
    # the first point stands in every layer, and alone in the topmost one
    top[order[0]] = top.max() + 1
    layers = [(np.flatnonzero(top >= level).astype(np.int32),) for level in range(int(top.max()) + 1)]
    layers = [(nodes, np.full((len(nodes), width), -1, np.int32)) for (nodes,) in layers]
    places = []
    for nodes, _ in layers:
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        places.append(place)
    done = 1
    while done < n:
        batch = order[done : done + min(INSERT_BLOCK, max(64, done // 2))]
        found = _search_layers(x, layers, x[batch], INSERT_EFFORT, int(order[0]))
        within = _distances(x[batch], x[batch])
        np.fill_diagonal(within, np.inf)
        for level, (_, flat) in enumerate(layers):
            here = np.flatnonzero(top[batch] >= level)
            if not len(here):
                break
            place = places[level]
            ids, dist = found[level]
            some = min(len(here) - 1, links)
            added: dict[int, list[int]] = {}
            for k in here.tolist():
                ok = np.isfinite(dist[k])
                near, d = ids[k][ok], dist[k][ok]
                if some > 0:
                    others = here[np.argpartition(within[k, here], some - 1)[:some]]
                    others = others[others != k]
                    near, d = np.concatenate([near, batch[others]]), np.concatenate([d, within[k, others]])
                if not len(near):
                    continue
                best = np.argsort(d, kind="stable")[:INSERT_EFFORT]
                near, d = near[best], d[best]
                taken = _select(near, d, _distances(x[near], x[near]), links)
                for a, b in [(int(batch[k]), int(c)) for c in taken] + [(int(c), int(batch[k])) for c in taken]:
                    added.setdefault(a, []).append(b)
            for a, new in added.items():
                old = flat[place[a]]
                both = np.array(list(dict.fromkeys([*old[old >= 0].tolist(), *new])))
                if len(both) > width:
                    d = ((x[both] - x[a]) ** 2).sum(1)
                    nearest_first = np.argsort(d, kind="stable")
                    both = both[nearest_first]
                    # room for a quarter more before the next thinning
                    both = _select(both, d[nearest_first], _distances(x[both], x[both]), width * 3 // 4)
                flat[place[a]] = -1
                flat[place[a], : len(both)] = both
        done += len(batch)
    return layers


def _joined(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Results of several blocks of queries as one, filled up to the widest."""
    width = max(ids.shape[1] for ids, _ in parts)
    return tuple(np.vstack([np.pad(p[k], ((0, 0), (0, width - p[k].shape[1])), constant_values=fill) for p in parts]) for k, fill in ((0, n), (1, np.inf)))


def _search_layers(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, effort: int, entry_row: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, squared distances), nearest first, found in each layer from the bottom up;
    inf beyond what was found. All queries walk at once, or so many that what they
    have seen takes some 100 MB."""
    n, count = len(x), len(q)
    most = max(16, 100_000_000 // (n + 1))
    if count > most:
        parts = [_search_layers(x, layers, q[at : at + most], effort, entry_row) for at in range(0, count, most)]
        return [_joined([p[level] for p in parts], n) for level in range(len(layers))]
    entry = np.full((count, 1), entry_row)
    out = []
    for depth in reversed(range(len(layers))):
        nodes, flat = layers[depth]
        place = np.full(n + 1, len(nodes))
        place[nodes] = np.arange(len(nodes))
        flat = np.vstack([flat, np.full((1, flat.shape[1]), -1, np.int32)])
        beam = effort if depth == 0 else max(4, effort // 4)
        seen = np.zeros((count, n + 1), bool)
        seen[:, n] = True
        rows = np.arange(count)[:, None]
        ids = entry
        dist = ((x[ids] - q[:, None, :]) ** 2).sum(2)
        seen[rows, ids] = True
        opened = np.zeros(ids.shape, bool)
        while True:
            waiting = np.where(opened | ~np.isfinite(dist), np.inf, dist)
            best = waiting.argmin(1)
            act = np.flatnonzero(np.isfinite(waiting[np.arange(count), best]))
            if not len(act):
                break
            opened[act, best[act]] = True
            new = flat[place[ids[act, best[act]]]]
            new = np.where(new < 0, n, new)
            fresh = ~seen[act[:, None], new]
            seen[act[:, None], new] = True
            d = np.full(new.shape, np.inf)
            gap = x[new[fresh]] - q[act[np.nonzero(fresh)[0]]]
            d[fresh] = np.einsum("ij,ij->i", gap, gap)
            more_i, more_d, more_o = (np.full((count, new.shape[1]), fill) for fill in (n, np.inf, True))
            more_i[act], more_d[act], more_o[act] = new, d, ~fresh
            ids, dist, opened = np.hstack([ids, more_i]), np.hstack([dist, more_d]), np.hstack([opened, more_o.astype(bool)])
            if ids.shape[1] > beam:
                part = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, opened = ids[rows, part], dist[rows, part], opened[rows, part]
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = ids[rows, order], dist[rows, order]
        entry = np.where(np.isfinite(dist[:, :1]), ids[:, :1], entry[:, :1])
        out.append((ids, dist))
    return out[::-1]


def search_graph(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, k: int, effort: int | None = None, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact distances) of the k nearest found for every query, -1 and inf
    beyond. Of equally near rows those with the smaller ``least`` come first."""
    effort = effort or int(EFFORT * max(1.0, (len(x) / LEAST_ROWS) ** (1 / 3)))
    ids, dist = _search_layers(x, layers, q, effort, int(layers[-1][0][0]))[0]
    dist = np.sqrt(dist)
    if least is not None:
        ties = np.append(least, np.iinfo(np.int64).max)[np.minimum(ids, len(x))]
        order = np.lexsort((ties, dist), axis=1)
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    ids, dist = ids[:, :k], dist[:, :k]
    return np.where(np.isfinite(dist), ids, -1), dist


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, v array<double>) without null ids, and without vectors that
    are null, empty, zero or hold null or non-finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine).distinct()


def shard_count(n: int) -> int:
    """Shards of an index of n vectors: LEAST_ROWS each until there are SHARDS of them,
    which then grow, so that a query's work does not; past MOST_ROWS their number grows again."""
    return max(1, min(SHARDS, -(-n // LEAST_ROWS)), -(-n // MOST_ROWS))


_SHARD = "dim int, shard int, ids binary, least binary, vectors binary, nodes array<binary>, neighbours array<binary>"


def build_index(classes: DataFrame, shards: int) -> DataFrame:
    """One row for each length of vectors and shard of (class_id, least, v): ids,
    vectors and the graph's layers as packed arrays."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("class_id").to_numpy()
        order = np.argsort(ids)
        dim, shard = (group.column(c)[0].as_py() for c in ("dim", "shard"))
        x = np.concatenate([np.asarray(c.flatten(), float).reshape(-1, dim) for c in group.column("v").chunks])[order]
        layers = build_graph(x, shard)
        flat = [[a[k].astype("<i4").tobytes() for a in layers] for k in (0, 1)]
        packed = [[y[order].astype("<i8").tobytes()] for y in (ids, group.column("least").to_numpy())]
        return pa.table([pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), *packed, [x.astype("<f8").tobytes()], pa.array([flat[0]], pa.list_(pa.binary())), pa.array([flat[1]], pa.list_(pa.binary()))], [c.split()[0] for c in _SHARD.split(", ")])

    dealt = classes.select("class_id", "least", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("class_id"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("dim", "shard").applyInArrow(run, _SHARD)


def search_index(index: DataFrame, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(query_key, class_id, score): the k nearest classes that each shard of the index
    finds for each of the queries (query_key, v).

    A task gets a shard's graph and after it all blocks of queries, one at a time.
    """
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    asked = queries.select("query_key", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("query_key", F.lit(1)), F.lit(blocks)).cast("int").alias("block")).groupBy("dim", "block").agg(F.collect_list(F.struct("query_key", "v")).alias("queries"))
    to_shards = index.select("dim", "shard").join(asked, "dim").select("dim", "shard", (F.col("block") + 1).alias("seq"), "queries")
    graphs = index.withColumn("seq", F.lit(0))
    stream = graphs.unionByName(to_shards, allowMissingColumns=True).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = ids = least = layers = None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                dim = row["dim"].as_py()
                if row["seq"].as_py() == 0:
                    x = np.frombuffer(row["vectors"].as_py(), "<f8").reshape(-1, dim)
                    ids, least = (np.frombuffer(row[c].as_py(), "<i8") for c in ("ids", "least"))
                    layers = [(np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4").reshape(-1, 2 * LINKS)) for a, b in zip(row["nodes"].as_py(), row["neighbours"].as_py(), strict=True)]
                    continue
                asked = row["queries"].values
                q = np.asarray(asked.field("v").flatten(), float).reshape(-1, dim)
                keys = np.asarray(asked.field("query_key"))
                found, dist = search_graph(x, layers, q, k, least=least)
                ok = found >= 0
                yield pa.record_batch([pa.array(keys[np.nonzero(ok)[0]]), pa.array(ids[found[ok]]), pa.array(dist[ok])], ["query_key", "class_id", "score"])

    columns = ["dim", "shard", "seq", "ids", "least", "vectors", "nodes", "neighbours", "queries"]
    return stream.select(*columns).mapInArrow(run, "query_key long, class_id long, score double")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all
    rows but the query's own; vectors of another length are no candidates. Ties
    go to the smaller vec_id. Rows that are equal in id and vector count once; an
    id with several vectors makes as many queries, whose rows all carry it, and each
    of its vectors is a candidate for the others. ``shards`` defaults to a number that
    follows from the number of distinct vectors alone, so any cluster finds the same.
    """
    rows = keep(usable(vectors), "vectors")
    # equal vectors form a class; the k + 1 least ids are all that a query can return of it
    order = Window.partitionBy("v").orderBy("vec_id")
    classes = keep(rows.groupBy("v").agg(F.min("vec_id").alias("least")).select(F.xxhash64("v", "least").alias("class_id"), "least", "v"), "classes")
    members = keep(rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r").join(classes.select("class_id", "v"), "v").select("class_id", "vec_id"), "members")
    n = max(1, classes.count())
    index = keep(build_index(classes, shards or shard_count(n)), "hnsw")
    queries = rows.where(F.col("vec_id") % every == 0).join(classes.select("class_id", "v"), "v").select(F.xxhash64("vec_id", "class_id").alias("query_key"), F.col("vec_id").alias("query_id"), F.col("class_id").alias("own"), "v")
    queries = keep(queries, "queries")
    found = search_index(index, queries.select("query_key", "v"), queries.count(), k + 1)
    best = Window.partitionBy("query_key").orderBy("score", "least")
    top = found.join(classes.select("class_id", "least"), "class_id").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query_key", "class_id", "score")
    candidates = top.join(members, "class_id").join(queries.select("query_key", "query_id", "own"), "query_key").where((F.col("vec_id") != F.col("query_id")) | (F.col("class_id") != F.col("own")))
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_key").orderBy("score", "vec_id", "class_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
