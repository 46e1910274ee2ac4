"""Exact top-k search by inner product as a Voronoi join: cells around pivots, bounds from summaries, local solutions.

Every vector goes to the cell of its nearest pivot. For a pivot p and a vector s at distance d from it, Cauchy and Schwarz put
the score q.s between q.p - |q| d and q.p + |q| d. Queries are grouped by cell (small cells together, large ones cut by
hash). From the summary of a cell, the distances of its k + 1 nearest members, a group knows k scores that each of its
queries reaches at least; the least of them, and the group's greatest q.p for every pivot, say from which distance on a
cell's members can matter. Only those are copied to the group, in slices of bounded size, and each (group, slice) is
solved by itself. The best k of the slices' best are the result.

Vectors are scaled to whole numbers, and scores are whole numbers too: doubles where no sum can pass 2**53, Python's integers
elsewhere. Bounds are widened by more than the rounding of doubles, so they never cost a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

_EXACT = 2.0**53
_SCORES = "query_row long, query_id long, row long, vec_id long, score long"


def scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part (not null, all components finite), and their components times `scale`, rounded down, end to end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * float(scale)  # a null becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(sizes)
    usable = pc.is_valid(column).to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
    return usable, np.floor(values[np.repeat(usable, sizes)])


def matrix(packed: list[bytes], width: int | None = None) -> np.ndarray:
    """Vectors of doubles as rows; shorter ones end in zeros."""
    sizes = np.array([len(b) // 8 for b in packed], np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), width)
    out = np.zeros((len(packed), width))
    for row, b in zip(out, packed, strict=True):
        row[: len(b) // 8] = np.frombuffer(b, "<f8")[:width]
    return out


def _packed(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        usable, values = scaled(batch.column("embedding"), scale)
        sizes = pc.fill_null(pc.list_value_length(batch.column("embedding")), 0).to_numpy(zero_copy_only=False)[usable]
        offsets = np.concatenate([[0], np.cumsum(sizes)]) * 8
        vectors = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
        ids = batch.column("vec_id").filter(pa.array(usable))
        yield pa.record_batch([ids, vectors.cast(pa.binary())], ["vec_id", "vector"])


def _celled(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nearest pivot of each vector, and its distance, from differences: products would cancel."""
    for batch in batches:
        packed = batch.column("vector").to_pylist()
        cell, distance = np.zeros(len(packed), np.int32), np.zeros(len(packed))
        for a in range(0, len(packed), 1024):
            part = packed[a : a + 1024]
            width = max(pivots.shape[1], max(len(b) for b in part) // 8)
            rows, wide = matrix(part, width), np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
            near = ((wide**2).sum(1) - 2 * (rows @ wide.T)).argmin(1)
            cell[a : a + len(part)], distance[a : a + len(part)] = near, np.linalg.norm(rows - wide[near], axis=1)
        yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(distance)], [*batch.schema.names, "cell", "distance"])


def group_cells(counts: dict[int, int], pivots: np.ndarray, rows: int) -> tuple[list[int], list[int]]:
    """For each cell the number of its first query group and the number of groups it is cut to; about `rows` queries to a group.

    Cells are strung together, each followed by the nearest one left, so that groups join neighbours.
    """
    first, parts = [0] * len(pivots), [1] * len(pivots)
    left, group, held, at = set(counts), 0, 0, None
    while left:
        here = min(left) if at is None else min(left, key=lambda c: (float(((pivots[c] - pivots[at]) ** 2).sum()), c))
        left.discard(here)
        if held and held + counts[here] > rows:
            group, held = group + 1, 0
        first[here], parts[here] = group, max(1, -(-counts[here] // rows))
        held += counts[here]
        if parts[here] > 1:
            group, held = group + parts[here], 0
        at = here
    return first, parts


def _needed(table: pa.Table, pivots: np.ndarray, nearest: list[np.ndarray], k: int) -> pa.Table:
    """A group's queries in one row, and for each cell the distance from which its members matter."""
    queries = matrix(table.column("vector").to_pylist())
    width = max(queries.shape[1], pivots.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        q = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        at = q @ np.pad(pivots, ((0, 0), (0, width - pivots.shape[1]))).T
        norm = np.linalg.norm(q, axis=1).max(initial=0.0)
        slack = 1.0 + 1e-9 * (norm * (np.linalg.norm(pivots, axis=1) + np.array([d.max(initial=0.0) for d in nearest])).max(initial=0.0))
        sure = np.concatenate([at[:, c].min() - norm * d for c, d in enumerate(nearest)])
        floor = np.sort(sure)[-k - 1] if len(sure) > k else -np.inf  # one of the k + 1 may be the query's own row
        cuts = (floor - at.max(0) - slack) / max(norm, 1e-300)
    cuts = np.where(np.isfinite(cuts), cuts - 1e-9 * np.abs(cuts), -1.0)
    lists = lambda values, kind: pa.array([values], pa.list_(kind))
    rows, ids, vectors = (table.column(c).to_pylist() for c in ("row", "vec_id", "vector"))
    return pa.table([table.column("group").slice(0, 1), lists(rows, pa.int64()), lists(ids, pa.int64()), lists(vectors, pa.binary()), lists(cuts.tolist(), pa.float64())], ["group", "rows", "ids", "vectors", "cuts"])


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: doubles where sums stay under 2**53, else Python's integers."""
    top = np.abs(queries).max(initial=0.0) * np.abs(rows).max(initial=0.0) * queries.shape[1]
    if top < _EXACT:
        return queries @ rows.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return whole(queries) @ whole(rows).T


def _solved(queries: pa.Table, data: pa.Table, k: int) -> pa.Table:
    """The k best rows of a slice for each query of a group; ties to smaller ids, without an id last. The query's own row is left out."""
    rows, ids, vectors = (data.column(c).to_pylist() for c in ("row", "vec_id", "vector"))
    of, named, asked = (queries.column(c)[0].as_py() if queries.num_rows else [] for c in ("rows", "ids", "vectors"))
    out: tuple[list, ...] = ([], [], [], [], [])
    if rows and of:
        width = max(len(b) for b in vectors + asked) // 8
        order = sorted(range(len(rows)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))  # a stable choice then breaks ties by id
        rows, ids, found = [rows[i] for i in order], [ids[i] for i in order], matrix([vectors[i] for i in order], width)
        place, wanted = {r: i for i, r in enumerate(rows)}, matrix(asked, width)
        step = max(1, (1 << 21) // len(rows))
        for a in range(0, len(of), step):
            for j, scores in enumerate(products(wanted[a : a + step], found), a):
                own = place.get(of[j])
                if own is not None:
                    scores = np.delete(scores, own)
                best = _best(scores, k)
                if own is not None:
                    best = np.where(best >= own, best + 1, best)
                    scores = np.insert(scores, own, 0)
                for column, values in zip(out, ([of[j]] * len(best), [named[j]] * len(best), [rows[i] for i in best], [ids[i] for i in best], [int(scores[i]) for i in best]), strict=True):
                    column += values
    return pa.table([pa.array(c, pa.int64()) for c in out], ["query_row", "query_id", "row", "vec_id", "score"])


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores; of equal ones the first."""
    if len(scores) > k and scores.dtype != object:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > limit)
        some = np.concatenate([over, np.flatnonzero(scores == limit)[: k - len(over)]])
    else:
        some = np.arange(len(scores))
    return np.array(sorted(some.tolist(), key=lambda i: (-scores[i], i))[:k], np.int64)


def nearest_vectors(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, most_pivots: int = 256, group_rows: int = 2048, slice_rows: int = 8192,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k other rows of the highest inner products.

    Components are floor(scale * x). Null vectors and those with a null or non-finite component take no part. Where lengths differ, what is
    missing counts as zero. Ties go to smaller ids, rows without an id come last; such rows are never queries. Repeated rows are
    rows: each that is a query has its own results, and the others are its candidates. Fewer than k candidates are all
    returned; an empty table gives no rows. A score beyond a long raises an error. Other columns are not read.

    The driver holds `most_pivots` vectors, and k + 1 distances and a count for each. A task holds `group_rows` queries and `slice_rows` candidates, about.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    packed = source.mapInArrow(lambda it: _packed(it, scale), "vec_id long, vector binary")
    data = stored(packed.withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers are fixed by being written
    total = data.count()
    wanted = min(most_pivots, max(4, round(total**0.5 / 4)))
    pivots = [r["vector"] for r in data.select("vector", F.xxhash64("row", F.lit(29)).alias("mix")).orderBy("mix", "vector").limit(wanted).collect()]
    pivots = matrix(pivots or [b""])
    cells = stored(data.mapInArrow(lambda it: _celled(it, pivots), "vec_id long, vector binary, row long, cell int, distance double"), "cells")
    dropped(data)
    nearest = [np.zeros(0)] * len(pivots)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("distance"))
    least = cells.select("cell", "distance", rank.alias("rank")).where(F.col("rank") <= k + 1).groupBy("cell").agg(F.collect_list("distance").alias("d"))
    for r in least.collect():
        nearest[r["cell"]] = np.array(r["d"])
    queries = cells.where(F.col("vec_id") % every == 0)
    counts = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}
    first, parts = group_cells(counts, pivots, group_rows)
    of_cell = lambda values: F.element_at(F.lit(values), F.col("cell") + 1)
    group = of_cell(first) + F.pmod(F.xxhash64("row"), of_cell(parts))
    grouped = queries.select(group.cast("long").alias("group"), "row", "vec_id", "vector")
    groups = stored(grouped.groupBy("group").applyInArrow(lambda t: _needed(t, pivots, nearest, k), "group long, rows array<bigint>, ids array<bigint>, vectors array<binary>, cuts array<double>"), "groups")
    slices = max(1, -(-total // slice_rows))
    numbered = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    cuts = groups.select("group", F.posexplode("cuts").alias("cell", "cut")).select("group", "cell", "cut", numbered)
    dealt = cells.withColumn("slice", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(slices)).cast("int"))
    copied = dealt.join(cuts, ["cell", "slice"]).where("distance >= cut").select(F.col("group").alias("to"), F.col("slice").alias("part"), "row", "vec_id", "vector")
    asked = groups.select("group", "rows", "ids", "vectors", numbered)
    solve: Callable = lambda left, right: _solved(left, right, k)
    scores = asked.groupBy("group", "slice").cogroup(copied.groupBy("to", "part")).applyInArrow(solve, _SCORES)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
