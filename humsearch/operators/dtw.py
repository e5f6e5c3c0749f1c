"""Dynamic time warping: alignments of pairs in a DataFrame, and their kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .distance import pairwise

DEFAULT_STEPS = ((1, 1), (0, 1), (1, 0))


@dataclass(frozen=True)
class Warping:
    """How to align: steps with weights, whole or subsequence, and an optional band.

    Own steps come after the default ones, whose weights are then infinite, so
    step numbers of own steps begin at 3.
    """

    metric: str = "euclidean"
    steps: tuple[tuple[int, int], ...] | None = None
    weights_add: tuple[float, ...] | None = None
    weights_mul: tuple[float, ...] | None = None
    subsequence: bool = False
    band_radius: float | None = None

    def __post_init__(self) -> None:
        own = self.steps or ()
        if any(a < 0 or b < 0 for a, b in own):
            raise ValueError("steps must not be negative")
        for w in (self.weights_add, self.weights_mul):
            if w is not None and len(w) != len(own or DEFAULT_STEPS):
                raise ValueError("a weight for each step is needed")

    def moves(self) -> list[tuple[int, int, float, float]]:
        """(rows, columns, added, factor) of every step."""
        own = self.steps or DEFAULT_STEPS
        add = self.weights_add or (0.0,) * len(own)
        mul = self.weights_mul or (1.0,) * len(own)
        given = [(*s, a, m) for s, a, m in zip(own, add, mul, strict=True)]
        return given if self.steps is None else [(*s, np.inf, np.inf) for s in DEFAULT_STEPS] + given


@dataclass(frozen=True)
class Alignment:
    """Accumulated cost, the step into each cell (0 where a path starts) and the path from its end."""

    cost: np.ndarray
    steps: np.ndarray
    path: np.ndarray | None


def band(cost: np.ndarray, radius: float) -> np.ndarray:
    """The cost with infinity outside a Sakoe-Chiba band around the diagonal."""
    n, m = cost.shape
    reach, spare = round(radius * min(n, m)), abs(n - m)
    ahead = np.arange(m)[None, :] - np.arange(n)[:, None]
    low, high = (-reach, reach + spare) if n < m else (-reach - spare, reach)
    return np.where((ahead > low) & (ahead < high), cost, np.inf)


def accumulate(cost: np.ndarray, w: Warping) -> tuple[np.ndarray, np.ndarray]:
    """(accumulated cost, number of the step that led there, -1 at a start).

    Every step comes from an earlier antidiagonal, so the cells of one are done
    together, in the order of operations of a plain loop over cells. Equal costs
    keep the earlier step, and a start before any step.
    """
    n, m = cost.shape
    moves = w.moves()
    above, left = (max(move[k] for move in moves) for k in (0, 1))
    width = m + left
    total = np.full((n + above) * width, np.inf)
    taken = np.full(total.shape, -1, np.int32)
    begin = above * width + left
    total[begin : begin + (m if w.subsequence else 1)] = cost[0] if w.subsequence else cost[0, 0]
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        at, c = (i + above) * width + (d - i) + left, cost[i, d - i]
        best, step = total[at], taken[at]
        for code, (di, dj, add, mul) in enumerate(moves):
            if not np.isfinite(mul):
                continue
            came = (total[at - (di * width + dj)] if di or dj else best) + (mul * c + add)
            better = came < best
            best, step = np.where(better, came, best), np.where(better, code, step)
        total[at], taken[at] = best, step
    whole, codes = (x.reshape(n + above, width)[above:, left:] for x in (total, taken))
    return whole, codes


def trace(steps: np.ndarray, w: Warping, start: int | None = None) -> np.ndarray:
    """Path from the end to the start, as (row, column) pairs."""
    i, j = steps.shape[0] - 1, steps.shape[1] - 1 if start is None else start
    moves, path = w.moves(), [(i, j)]
    while (i > 0) if w.subsequence else (i, j) != (0, 0):
        if steps[i, j] < 0:
            break
        di, dj, *_ = moves[steps[i, j]]
        i, j = i - di, j - dj
        if i < 0 or j < 0:
            break
        path.append((i, j))
    return np.array(path, int)


def align(x: np.ndarray | None = None, y: np.ndarray | None = None, *, cost: np.ndarray | None = None, warping: Warping = Warping(), backtrack: bool = True) -> Alignment:
    """Align two sequences of feature columns (features x frames), or a given cost matrix."""
    if (cost is None) == (x is None or y is None):
        raise ValueError("give either two sequences or a cost matrix")
    given, turned = cost is not None, False
    if not given:
        x, y = np.atleast_2d(np.asarray(x, float)), np.atleast_2d(np.asarray(y, float))
        cost = pairwise(x.T, y.T, warping.metric)
        if warping.subsequence and cost.shape[0] > cost.shape[1]:
            cost, turned = cost.T, True
    cost = np.asarray(cost, float)
    if np.isnan(cost).any():
        raise ValueError("the cost matrix holds NaN")
    if warping.band_radius is not None:
        cost = band(cost, warping.band_radius)
    total, steps = accumulate(cost, warping)
    if not backtrack:
        return Alignment(total, np.maximum(steps, 0), None)
    if warping.subsequence:
        if np.isinf(total[-1]).all():
            raise ValueError("no path reaches the last row")
        path = trace(steps, warping, int(total[-1].argmin()))
    else:
        if np.isinf(total[-1, -1]):
            raise ValueError("no path reaches the end")
        path = trace(steps, warping)
        if tuple(path[-1]) != (0, 0):
            raise ValueError("the path doesn't reach the start")
    if warping.subsequence and (turned or (given and cost.shape[0] > cost.shape[1])):
        path = path[:, ::-1]
    return Alignment(total, np.maximum(steps, 0), path)


def _path_array(paths: list[np.ndarray]) -> pa.Array:
    """Paths as lists of (i, j), from flat columns."""
    flat = np.concatenate([np.zeros((0, 2), int), *paths]).astype(np.int32)
    return _lists([len(p) for p in paths], pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["i", "j"]))


def _lists(lengths: Sequence[int] | np.ndarray, flat: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), flat)


def _matrix_array(matrices: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Matrices as lists of rows, from flat values."""
    flat = np.concatenate([np.zeros(0), *(m.ravel() for m in matrices)])
    rows = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, int), *(np.full(m.shape[0], m.shape[1]) for m in matrices)]))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(rows), pa.array(flat, kind))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([m.shape[0] for m in matrices])]).astype(np.int32)), lists)


def _finite(costs: np.ndarray) -> pa.Array:
    return pa.array(costs, pa.float64(), mask=~np.isfinite(costs))


def _matrix(value: pa.ListScalar) -> np.ndarray:
    rows = value.values
    return np.asarray(rows.flatten(), float).reshape(len(rows), -1)


def align_pairs(pairs: DataFrame, warping: Warping = Warping(), x: str = "x", y: str = "y", cost: str | None = None, paths: bool = True, matrices: bool = False) -> DataFrame:
    """``pairs`` with ``cost`` (end of the alignment) and, where asked for, ``path``
    array<struct<i,j>> from the end, and the matrices ``total`` and ``steps`` by rows.

    ``x`` and ``y`` hold arrays of feature rows, or ``cost`` a cost matrix; all are
    array<array<double>>. Without a path from start to end ``paths`` is an error,
    otherwise the cost is null. Rows are worked on where they are, in memory that is
    linear in the lengths unless ``matrices`` are wanted; ``align_all`` deals pairs by work.
    """
    from .diagonals import solve

    made = {"cost": "double"} | ({"path": "array<struct<i:int,j:int>>"} if paths else {}) | ({"total": "array<array<double>>", "steps": "array<array<int>>"} if matrices else {})
    sides = [cost] if cost else [x, y]
    others = [c for c in pairs.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                given = [[_matrix(v) for v in piece.column(c)] for c in sides]
                if matrices:
                    got = [align(**({"cost": g[0]} if cost else dict(zip("xy", g, strict=True))), warping=warping, backtrack=paths) for g in zip(*given, strict=True)]
                    costs = np.array([g.cost[-1].min() if warping.subsequence else g.cost[-1, -1] for g in got], float)
                    ways = [g.path for g in got]
                else:
                    # frames x features
                    costs, ways = solve(costs=given[0], warping=warping, paths=paths) if cost else solve([(a.T, b.T) for a, b in zip(*given, strict=True)], warping=warping, paths=paths)
                out = [_finite(costs)] + ([_path_array(ways)] if paths else [])
                if matrices:
                    out += [_matrix_array([g.cost for g in got], pa.float64()), _matrix_array([g.steps for g in got], pa.int32())]
                yield pa.record_batch([piece.column(c) for c in others] + out, [*others, *made])

    # a column that is named like a result gives way to it
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in others] + [f"{k} {v}" for k, v in made.items()])
    return pairs.mapInArrow(run, schema)


def align_all(queries: DataFrame, tracks: DataFrame, warping: Warping = Warping(), paths: bool = False, features: int = 1, parts: int | None = None, cost: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, framewise: bool = False) -> DataFrame:
    """(query_id, track_id, cost[, path]) of every query (query_id, x) with every track
    (track_id, y); x and y are flat arrays of ``features`` numbers a frame.

    Pairs are dealt to tasks by their work. A cost is null where no path leads from
    start to end, which is an error if ``paths`` are wanted. ``cost`` gives the matrix of
    a pair's frames, made in the task and gone with its pairs, instead of a metric; if
    ``framewise``, a cell follows from its two frames alone, so a query meets the frames of many
    tracks in one call. Equal arrays are aligned once; their paths leave the task once and are
    repeated in the plan.
    """
    if not paths:
        return _aligned(queries, tracks, warping, False, features, parts, cost, framewise)
    way = F.transform("path", lambda p: F.struct(*(c.cast("int").alias(name) for name, c in zip("ij", _cell(p), strict=True))))
    return _aligned(queries, tracks, warping, True, features, parts, cost, framewise).withColumn("path", way)


def path_rows(queries: DataFrame, tracks: DataFrame, warping: Warping = Warping(), features: int = 1, parts: int | None = None, cost: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, framewise: bool = False) -> DataFrame:
    """(query_id, track_id, k, i, j): the paths of ``align_all`` as rows, k from 0 at the end. A cell is one
    number until it is a row, as plain numbers are repeated much faster than structs."""
    rows = _aligned(queries, tracks, warping, True, features, parts, cost, framewise).select("query_id", "track_id", F.posexplode("path").alias("k", "p"))
    return rows.select("query_id", "track_id", "k", *(c.cast("int").alias(name) for name, c in zip("ij", _cell(F.col("p")), strict=True)))


def _cell(p: Column) -> tuple[Column, Column]:
    return F.shiftright(p, 32), p.bitwiseAND(F.lit(2**31 - 1))


def _aligned(queries: DataFrame, tracks: DataFrame, warping: Warping, paths: bool, features: int, parts: int | None, cost: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, framewise: bool) -> DataFrame:
    """(query_id, track_id, cost[, path]), a path as whole numbers i * 2^32 + j."""
    from .diagonals import Framewise, solved_flat
    from .pairing import Tile, each_row, for_all, id_lists, paired

    def work(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        for t in tiles:
            xs, ys = ([v.astype(float).reshape(-1, features) for v in side] for side in (t.xs, t.ys))
            sizes = np.array([len(y) for y in ys], np.int64)
            for asked, x, due in zip(t.query_rows, xs, t.due, strict=True):
                # some pairs at a time, so that their paths have a bound too
                k = np.flatnonzero(due)
                ends = np.cumsum(len(x) * sizes[k] if cost else len(x) + sizes[k])
                for some in np.split(k, np.flatnonzero(np.diff(ends // 4_000_000)) + 1) if len(k) else []:
                    yield from of_query(asked, x, [t.track_rows[b] for b in some.tolist()], [ys[b] for b in some.tolist()])

    def of_query(asked: np.ndarray, x: np.ndarray, found: list[np.ndarray], ys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if cost is None:
            costs, way, lengths = solved_flat([(x, y) for y in ys], warping=warping, paths=paths)
        else:
            costs, way, lengths = solved_flat(costs=Framewise(cost, x, ys) if framewise else [cost(x, y) for y in ys], warping=warping, paths=paths)
        if paths:
            yield pa.record_batch([id_lists([asked] * len(found)), id_lists(found), _finite(costs), _lists(lengths, pa.array(way))], names)
        else:
            yield from for_all(asked, found, [_finite(costs)], names)

    names = ["query_id", "track_id", "cost", "path"][: 3 + paths]
    if not paths:
        return paired(queries, tracks, work, "query_id long, track_id long, cost double", parts, alike=True)
    return each_row(paired(queries, tracks, work, "query_id array<long>, track_id array<long>, cost double, path array<long>", parts, alike=True))


def step_counts(queries: DataFrame, tracks: DataFrame, warping: Warping = Warping(), features: int = 1, parts: int | None = None) -> DataFrame:
    """(query_id, track_id, step, n, places) of the pairs that ``align_all`` aligns, a row for each
    step that leads to a cell: how many, and the sum of (row + 1) * (column + 1). Sides are not turned."""
    from .diagonals import tallied
    from .pairing import Tile, for_all, paired

    def work(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        for t in tiles:
            xs, ys = ([v.astype(float).reshape(-1, features) for v in side] for side in (t.xs, t.ys))
            for asked, x, due in zip(t.query_rows, xs, t.due, strict=True):
                k = np.flatnonzero(due)
                if len(k):
                    n, places = tallied([(x, ys[b]) for b in k.tolist()], warping)
                    pair, step = np.nonzero(n)
                    yield from for_all(asked, [t.track_rows[b] for b in k[pair].tolist()], [pa.array(step, pa.int32()), pa.array(n[pair, step]), pa.array(places[pair, step])], ["query_id", "track_id", "step", "n", "places"])

    return paired(queries, tracks, work, "query_id long, track_id long, step int, n long, places long", parts, alike=True)


def subsequence_cost(query: np.ndarray, reference: np.ndarray, table: np.ndarray, shifts: np.ndarray) -> float:
    """Least normalised cost of a query of bins within a reference over all shifts.

    Bins run from 0 to n - 1, n is unvoiced; ``table`` has their distances. All
    shifts go at once. With S the running sum of a row's costs, its accumulated
    cost is S + running minimum of (arrival from above - S).
    """
    n = len(table) - 1
    # a shift turns the query against a fixed reference
    turned = np.where(query[None, :] < n, (query[None, :] + shifts[:, None]) % n, n)
    if len(query) <= len(reference):
        rows = [table[turned[:, i]][:, reference] for i in range(len(query))]
    else:
        rows = [table[turned, r] for r in reference]
    total = rows[0]
    for c in rows[1:]:
        above = total.copy()
        above[:, 1:] = np.minimum(total[:, 1:], total[:, :-1])
        s = np.cumsum(c, axis=1)
        total = s + np.minimum.accumulate(above + c - s, axis=1)
    return float(total[:, -total.shape[1] :].min() / min(len(query), len(reference)))


#: References that go together, and columns that they have at most.
MOST_REFERENCES, _MOST_COLUMNS = 128, 400_000


def _last_total(cost: Callable[[int, int, int, np.ndarray], np.ndarray], n: int, m: int, shape: tuple[int, ...], kind: type, down: bool) -> np.ndarray:
    """The total of the last of n x m cells, for all problems of ``shape`` together, antidiagonal
    by antidiagonal. Paths start anywhere in the first column if ``down``, else in the first row."""
    far = np.inf if kind == np.float64 else np.iinfo(kind).max
    # one row more, above the first
    held = [np.full((n + 1, *shape), far, kind) for _ in range(3)]
    room = np.empty((min(n, m), *shape), kind)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        now, one, two = (held[(d - k) % 3] for k in range(3))
        to = now[lo + 1 : hi + 2]
        np.minimum(one[lo : hi + 1], one[lo + 1 : hi + 2], out=to)
        np.minimum(to, two[lo : hi + 1], out=to)
        if down and d < n:
            to[-1] = 0
        elif not down and lo == 0:
            to[0] = 0
        to += cost(d, lo, hi, room[: hi - lo + 1])
        now[lo] = far
        if hi + 2 <= n:
            now[hi + 2] = far
    return to[-1]


class References:
    """References of bins, those of like length padded and put together, to be met by many queries.

    Costs rounded down to whole numbers tell which shifts can be the cheapest: a sum of them
    falls short by less than one a cell. Only those are summed in double precision, by the
    operations of ``subsequence_cost``. What is padded costs nothing where the reference gives
    the rows, and the most there is where it gives the columns, which a row without
    cost then ends; so the last cell has the least end of each.
    """

    def __init__(self, references: Sequence[np.ndarray], table: np.ndarray):
        self.count, self.n, self.top = len(references), len(table) - 1, float(max(table.max(), 1e-9))
        self.tables = {}
        for down, pad in ((False, self.top), (True, 0.0)):
            self.tables[down] = np.zeros((self.n + 2, self.n + 2))
            self.tables[down][:-1, :-1], self.tables[down][:-1, -1] = table, pad
        order, self.groups, at = sorted(range(self.count), key=lambda k: len(references[k])), [], 0
        while at < len(order):
            some = order[at : at + MOST_REFERENCES]
            while len(some) > 1 and len(some) * len(references[some[-1]]) > _MOST_COLUMNS:
                some = some[: len(some) // 2]
            at += len(some)
            sizes = np.array([len(references[k]) for k in some])
            bins = np.full((sizes[-1] + 1, len(some)), self.n + 1)
            for column, k in enumerate(some):
                bins[: sizes[column], column] = references[k]
            self.groups.append((np.array(some), sizes, bins, {}))

    def costs(self, query: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """``subsequence_cost`` of a query with every reference."""
        turned = np.where(query[:, None] < self.n, (query[:, None] + shifts) % self.n, self.n)
        out = np.empty(self.count)
        for some, sizes, bins, made in self.groups:
            # the shorter side is run through whole
            cut = int(np.searchsorted(sizes, len(query)))
            for down, a, b in ((True, 0, cut), (False, cut, len(some))):
                if a < b:
                    out[some[a:b]] = self._least(turned, down, sizes[a:b], bins[: sizes[b - 1] + down, a:b], made, (down, a, b)) / np.minimum(sizes[a:b], len(query))
        return out

    def _least(self, turned: np.ndarray, down: bool, sizes: np.ndarray, bins: np.ndarray, made: dict, key: tuple[bool, int, int]) -> np.ndarray:
        """The least total of each column of ``bins`` over all shifts."""
        (n, n_shifts), (m, size), table = turned.shape, bins.shape, self.tables[down]
        most = (min(n, m) + 1) * self.top
        # no total exceeds most: straight along the longer side's frame it is met
        kind, scale = (np.uint16, 60_000 / most) if n + m <= 60_000 / most / 5 else (np.uint32, 4e9 / most)
        if made.get(key, (None,))[0] != scale:
            made[key] = (scale, np.floor(np.maximum(table, 0) * scale).astype(kind)[:, bins].reshape(-1, size))
        cells = made[key][1]
        if not down:
            turned = np.concatenate([turned, np.full((1, n_shifts), self.n + 1)])
        n = len(turned)
        at = turned * m - np.arange(n)[:, None]
        least = _last_total(lambda d, lo, hi, room: cells.take(at[lo : hi + 1] + d, axis=0, out=room, mode="clip"), n, m, (n_shifts, size), kind, down).astype(np.int64)
        s, p = np.nonzero(least <= least.min(0) + sizes + n)
        rows, columns, flat = np.ascontiguousarray(turned[:, s]) * (self.n + 2), np.ascontiguousarray(bins[::-1, p]), table.ravel()
        places = np.empty((min(n, m), len(s)), np.int64)

        def exact(d: int, lo: int, hi: int, room: np.ndarray) -> np.ndarray:
            place = np.add(rows[lo : hi + 1], columns[m - 1 - d + lo : m - d + hi], out=places[: hi - lo + 1])
            return flat.take(place, out=room, mode="clip")

        best = np.full(size, np.inf)
        np.minimum.at(best, p, _last_total(exact, n, m, (len(s),), np.float64, down))
        return best


def subsequence_costs(query: np.ndarray, references: list[np.ndarray], table: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """``subsequence_cost`` of a query with many references, those of like length together."""
    return References(references, table).costs(query, shifts)
