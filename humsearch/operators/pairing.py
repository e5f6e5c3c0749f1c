"""All pairs of queries and tracks, dealt to tasks by the work that they make.

The work of a pair is the product of its two lengths, so neither bytes nor rows tell
how long a task takes. All pairs are laid on one line, block by block of queries and
track by track, each as long as its work. The line is cut into equal parts, a task
each: a task's work exceeds a part by less than one pair. A track goes to the few parts
that its pairs with a block lie in, a block's queries to the parts that the block
lies in; where a track's pairs begin follows from two sums of lengths, over cells
of tracks and within a cell, so no task sees all tracks.

With ``alike`` rows of the very same array go as one, with the ids of all, so whatever
follows from two arrays alone is computed once for each two different ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import written

#: Queries of a block: a task holds one block's queries and lets tracks pass by.
QUERY_BLOCK = 256
#: Groups of tracks whose lengths are summed, and which are all that the driver sees.
CELLS = 1024
#: Cells of alignments that a task does at most, but for one pair, and at least.
MOST_WORK, LEAST_WORK = 2_000_000_000, 500_000
#: Pairs of rows that a task has at most, but for those of one pair of arrays, and at least.
MOST_PAIRS, LEAST_PAIRS = 50_000_000, 500_000
#: Rows of the same array that go as one at most.
ALIKE = 512
#: Parts for each core that the cluster has.
PARTS_A_CORE = 3
#: Tracks that are handed over together, and the numbers that they hold at most, but for one track.
TILE, TILE_FRAMES = 2048, 4_000_000


@dataclass
class Tile:
    """Some tracks that meet some queries: pair (q, t) is due here where ``due[q, t]``. With
    ``alike`` it is due for all ``query_rows[q]`` and ``track_rows[t]``, in order, the first of which are the ids."""

    query_ids: list[int]
    xs: list[np.ndarray]
    track_ids: list[int]
    ys: list[np.ndarray]
    due: np.ndarray
    query_rows: list[np.ndarray] | None = None
    track_rows: list[np.ndarray] | None = None


def _before(of: str, *order: str) -> Column:
    window = Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(of).over(window), F.lit(0).cast("long"))


def _alike(rows: DataFrame) -> DataFrame:
    """Rows (id, v, size) of the same v as one, with ``ids`` in order; some at a time, so that none grows with a table."""
    number = F.row_number().over(Window.partitionBy("v").orderBy("id")) - 1
    some = rows.withColumn("some", F.call_function("div", number, F.lit(ALIKE)))
    one = some.groupBy("v", "some").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return one.select(F.get("ids", F.lit(0)).alias("id"), "v", F.size("v").cast("long").alias("size"), "ids")


def _sides(queries: DataFrame, tracks: DataFrame, alike: bool) -> tuple[DataFrame, DataFrame]:
    narrow = lambda df, key, value: df.select(F.col(key).cast("long").alias("id"), F.col(value).alias("v"), F.size(value).cast("long").alias("size")).where(F.col("id").isNotNull() & (F.col("size") > 0))
    made = (narrow(queries, "query_id", "x"), narrow(tracks, "track_id", "y"))
    return tuple(written(_alike(side) if alike else side.withColumn("ids", F.lit(None).cast("array<long>")), tag) for side, tag in zip(made, ("queries", "tracks"), strict=True))


def dealt(queries: DataFrame, tracks: DataFrame, parts: int | None = None, block: int = QUERY_BLOCK, alike: bool = False) -> tuple[DataFrame, int]:
    """(rows, unit): the rows (part, block, kind, id, start, size, whole, v, ids) of all tasks,
    partition by partition, and the work of a part.

    Of kind 0 are queries, ``start`` being the lengths before theirs in the block; of kind
    1 are tracks, ``start`` being where their pairs with the block begin and ``whole``
    the block's length. Sides without a length take no part.
    """
    spark = tracks.sparkSession
    q, t = _sides(queries, tracks, alike)
    cell = F.pmod(F.xxhash64("id"), F.lit(CELLS)).cast("int").alias("cell")
    n_rows = F.sum(F.greatest(F.size("ids"), F.lit(1))).cast("long")
    found = t.groupBy(cell).agg(F.sum("size"), n_rows).collect()
    sums = {c: frames for c, frames, _ in found}
    n_queries, frames, asked_rows = q.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(n_rows, F.lit(0))).first()
    columns, total, met_rows = sum(sums.values()), sum(sums.values()) * frames, asked_rows * sum(r for *_, r in found)
    if parts is None:
        parts = max(1, -(-total // MOST_WORK), -(-met_rows // MOST_PAIRS), min(PARTS_A_CORE * spark.sparkContext.defaultParallelism, max(total // LEAST_WORK, met_rows // LEAST_PAIRS)))
    unit = max(1, -(-total // parts))
    before = np.concatenate([[0], np.cumsum([sums.get(c, 0) for c in range(CELLS)])]).tolist()
    cells = spark.createDataFrame(list(zip(range(CELLS), before)), "cell int, base long")  # CELLS rows, whichever the tables
    n_blocks = max(1, -(-n_queries // block))
    of_block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("cell")
    lengths = q.groupBy(of_block).agg(F.sum("size").alias("whole"))
    # one row for each block of queries
    lengths = lengths.withColumn("base", F.coalesce(F.sum("whole").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")) * columns)
    lengths = written(lengths, "blocks")
    parts_of = lambda start, work: F.explode(F.sequence(F.call_function("div", start, F.lit(unit)), F.call_function("div", start + work - 1, F.lit(unit)))).alias("part")
    asked = q.select("*", of_block).withColumn("start", _before("size", "id", "size")).join(lengths, "cell")
    asked = asked.select(parts_of(F.col("base"), F.col("whole") * columns), F.col("cell").alias("block"), F.lit(0).alias("kind"), "id", "start", "size", "whole", "v", "ids")
    placed = t.select("*", cell).withColumn("start", _before("size", "id", "size")).join(F.broadcast(cells), "cell").select("id", "v", "size", "ids", (F.col("start") + F.col("base")).alias("start"))
    met = placed.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(lengths, "cell")
    met = met.withColumn("start", F.col("base") + F.col("start") * F.col("whole"))
    met = met.select(parts_of(F.col("start"), F.col("size") * F.col("whole")), F.col("cell").alias("block"), F.lit(1).alias("kind"), "id", "start", "size", "whole", "v", "ids")
    rows = asked.union(met).repartitionById(parts, F.col("part").cast("int"))
    return rows.sortWithinPartitions("part", "block", "kind", "id"), unit


def _tiles(batches: Iterator[pa.RecordBatch], unit: int) -> Iterator[Tile]:
    block, ids, xs, starts, alike = None, [], [], [], []
    tracks: list[tuple[int, np.ndarray, int, int, np.ndarray]] = []

    def tile(part: int) -> Tile:
        begin, size = (np.array([t[k] for t in tracks], np.int64) for k in (2, 3))
        place = begin[None, :] + np.array(starts, np.int64)[:, None] * size[None, :]
        due = (place >= part * unit) & (place < (part + 1) * unit)
        made = Tile(list(ids), list(xs), [k for k, *_ in tracks], [y for _, y, *_ in tracks], due, list(alike), [rows for *_, rows in tracks])
        tracks.clear()
        return made

    part, held = -1, 0
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        values, rows = batch.column(7), batch.column(8)
        for k, (p, b, kind, i, start, size) in enumerate(zip(*columns, strict=True)):
            if tracks and (b != block or p != part or len(tracks) == TILE or held > TILE_FRAMES):
                yield tile(part)
                held = 0
            if b != block or p != part:
                block, part = b, p
                ids, xs, starts, alike = [], [], [], []
            v = values[k].values.to_numpy(zero_copy_only=False)
            all_ids = rows[k].values.to_numpy() if rows[k].is_valid else np.array([i], np.int64)
            if kind == 0:
                ids.append(i)
                xs.append(v)
                starts.append(start)
                alike.append(all_ids)
            else:
                tracks.append((i, v, start, size, all_ids))
                held += size
    if tracks:
        yield tile(part)


def paired(queries: DataFrame, tracks: DataFrame, work: Callable[[Iterator[Tile]], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None, block: int = QUERY_BLOCK, alike: bool = False) -> DataFrame:
    """What ``work`` makes of all pairs of ``queries`` (query_id, x) and ``tracks``
    (track_id, y), arrays of numbers without nulls; rows without any number or id are
    left out. Every pair is due in one tile of one task, or with ``alike`` every pair of arrays."""
    rows, unit = dealt(queries, tracks, parts, block, alike)
    return rows.mapInArrow(lambda batches: work(_tiles(batches, unit)), schema)


#: Rows of a batch that ``for_all`` makes.
BATCH = 200_000


def for_all(query_rows: np.ndarray, track_rows: list[np.ndarray], columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(query_id, track_id, *columns) of all rows that have a query's array and those that have a track's;
    ``columns`` are what follows from the arrays, a place for each of ``track_rows``."""
    counts = np.array([len(r) for r in track_rows], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // BATCH)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(track_rows)], strict=True):
        if a == b:
            continue
        ids, at = np.concatenate(track_rows[a:b]), np.repeat(np.arange(a, b), counts[a:b])
        some = max(1, BATCH // len(ids))
        for k in range(0, len(query_rows), some):
            asked = query_rows[k : k + some]
            of = pa.array(np.tile(at, len(asked)))
            yield pa.record_batch([pa.array(np.repeat(asked, len(ids))), pa.array(np.tile(ids, len(asked))), *(c.take(of) for c in columns)], names)


def id_lists(rows: list[np.ndarray]) -> pa.Array:
    """Lists of ids, from flat values."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def each_row(rows: DataFrame) -> DataFrame:
    """``rows`` with lists of ids as query_id and track_id, as a row for each two of them."""
    for name in ("query_id", "track_id"):
        rows = rows.select(*[F.explode(c).alias(c) if c == name else c for c in rows.columns])
    return rows


def pairs(queries: DataFrame, tracks: DataFrame, parts: int | None = None, alike: bool = False) -> DataFrame:
    """(query_id, track_id, x, y) of all pairs, as rows of the tasks that their work is dealt to. With
    ``alike`` a row has the ids of all queries and tracks of the same arrays, to be told apart by ``each_row``."""
    kind = pa.list_(pa.int64()) if alike else pa.int64()

    def work(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        for t in tiles:
            for q, (query_id, x) in enumerate(zip(t.query_ids, t.xs, strict=True)):
                some = np.flatnonzero(t.due[q]).tolist()
                ys = [t.ys[k] for k in some]
                if not some:
                    continue
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in side])]), pa.int32()), pa.array(np.concatenate(side).astype(float))) for side in ([x] * len(some), ys)]
                ids = [id_lists([t.query_rows[q]] * len(some)), id_lists([t.track_rows[k] for k in some])] if alike else [pa.array([query_id] * len(some), kind), pa.array([t.track_ids[k] for k in some], kind)]
                yield pa.record_batch([*ids, *lists], ["query_id", "track_id", "x", "y"])

    id_ = "array<long>" if alike else "long"
    return paired(queries, tracks, work, f"query_id {id_}, track_id {id_}, x array<double>, y array<double>", parts, alike=alike)
