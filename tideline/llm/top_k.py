"""Exact top-k by inner product: a Voronoi kNN join of queries with all vectors.

With M the greatest norm of a vector, the vectors get one more component sqrt(M^2 - |x|^2)
and the queries 0; then |q - x|^2 = |q|^2 + M^2 - 2 qx, so the nearest vectors are those of the
highest inner product. Queries and vectors go to the cell of their nearest pivot. Summaries
of the cells (a row each: the greatest distance of a query to its pivot, and the least
distances of vectors to theirs) bound how far the k-th neighbour of any query of a cell can
be; by the triangle inequality a vector has to go to a group of query cells only if its
distance to its own pivot lies between two bounds. Vectors are sent to those groups only, and
every (group, block of vectors) is solved on its own with exact integer products. Bounds are
widened by more than the rounding of their distances, so no neighbour is lost.

Groups are dealt in parts and vectors in blocks of bounded bytes, so that neither one cell
with a third of all vectors nor one with a third of all queries comes to one task. Where the
bounds exclude nothing, as for directions spread evenly in many dimensions, every query meets
every vector, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.session import materialise

#: Vectors a pivot, and pivots at most: the summaries are at most two rows a pivot.
CELL_VECTORS = 2048
MOST_PIVOTS = 512
#: Vectors from which the pivots are made, by hash: this many a pivot, within these bytes.
SAMPLE = 8
SAMPLE_BYTES = 16 << 20
#: Bytes of the queries of a part of a group, and of the vectors of a block, as doubles.
PART_BYTES = 8 << 20
BLOCK_BYTES = 2 << 20
#: Products computed at once.
PRODUCTS = 1 << 20
#: Relative width of the bounds against rounding.
SLACK = 1e-6
#: From this norm on squares pass a double: then every query meets every vector.
NO_BOUNDS = 1e150

_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _whole(scale: int):
    """Rows with finite components only, as floor(scale * x), with their norm and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("vec").is_valid())
            vec = batch.column("vec")
            sizes = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten()
            x = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
            row = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(row, ~np.isfinite(x), len(sizes)) == 0
            x, sizes = x[good[row]], sizes[good]
            with np.errstate(over="ignore"):
                norm = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), x * x, len(sizes)))
            batch = batch.filter(pa.array(good))
            rows = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("asks"), rows, pa.array(norm), pa.array(sizes.astype(np.int32))],
                names=["row", "id", "asks", "vec", "norm", "width"],
            )

    return run


def _pivots(sample: np.ndarray, n: int, rounds: int = 3) -> np.ndarray:
    """``n`` centres of a sample of vectors, by some rounds of k-means from its first rows."""
    centres = sample[:n].copy()
    for _ in range(rounds):
        near = _nearest(sample, centres)[0]
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest pivot of each row, and the distance to it."""
    with np.errstate(over="ignore", invalid="ignore"):
        cell = ((pivots * pivots).sum(1) - 2 * (x @ pivots.T)).argmin(1)
        return cell, np.nan_to_num(np.sqrt(((x - pivots[cell]) ** 2).sum(1)))


def _lifted(x: np.ndarray, norm: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most * most - norm * norm, 0))[:, None]], 1)


def _place(pivots: np.ndarray, most: float, width: int):
    """Cell and distance of each vector; of a query also those as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = _matrix(batch.column("vec"), width)
                cell, away = _nearest(_lifted(x, batch.column("norm").to_numpy(), most), pivots)
                asks = batch.column("asks").to_numpy(zero_copy_only=False)
                asked, far = np.zeros(len(x), np.int64), np.zeros(len(x))
                if asks.any():
                    asked[asks], far[asks] = _nearest(_lifted(x[asks], np.full(asks.sum(), most), most), pivots)
                columns = [batch.column(c) for c in ("row", "id", "asks", "vec")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(cell.astype(np.int32)), pa.array(away), pa.array(asked.astype(np.int32)), pa.array(far)],
                    names=["row", "id", "asks", "vec", "cell", "away", "asked", "far"],
                )

    return run


def _chains(pivots: np.ndarray, cells: np.ndarray, sizes: np.ndarray, most: int) -> list[list[int]]:
    """Query cells in groups of neighbours with at most ``most`` queries; a larger cell is a group."""
    left, groups, held = dict(zip(cells.tolist(), sizes.tolist(), strict=True)), [], most
    at = int(cells[0])
    while left:
        at = min(left, key=lambda c: float(((pivots[c] - pivots[at]) ** 2).sum()))
        size = left.pop(at)
        if held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(at)
        held += size
    return groups


def reach(pivots: np.ndarray, asked: dict[int, float], near: dict[int, list[float]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query cell and vector cell: least and greatest distance of needed vectors to their pivot.

    ``asked`` has the greatest distance of a query of a cell to its pivot, ``near`` the k least
    distances of the vectors of a cell to theirs.
    """
    apart = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(2))
    low, high = np.full_like(apart, np.inf), np.full_like(apart, -np.inf)
    ends = [(j, d) for j, ds in near.items() for d in ds]
    cell, away = np.array([j for j, _ in ends]), np.array([d for _, d in ends])
    for i, far in asked.items():
        bound = np.sort(apart[i, cell] + away + far)
        bound = bound[k - 1] if len(bound) >= k else np.inf
        room = (far + bound) * (1 + SLACK)
        low[i] = apart[i] * (1 - SLACK) - room
        high[i] = apart[i] * (1 + SLACK) + room
    return low, high


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest of each row, ties to the first columns; -inf is none."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, 1)[:, n - k]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = np.nonzero(scores > -np.inf)
    value = scores[row, column]
    row, column, value = row[value > -np.inf], column[value > -np.inf], value[value > -np.inf]
    order = np.lexsort((column, -value, row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    good = np.arange(len(row)) - first < k
    return row[good], column[good]


_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _solve(k: int, width: int):
    """The best ``k`` of one block of vectors for each query of one part."""

    def run(table: pa.Table) -> pa.Table:
        asks = table["query"].to_numpy(zero_copy_only=False)
        queries, vectors = (table.filter(pa.array(m)) for m in (asks, ~asks))
        # by id, a missing one last: the first of equal scores is the one to take
        vectors = vectors.take(pc.sort_indices(vectors, [("id", "ascending"), ("row", "ascending")]))
        out: list[tuple] = []
        if len(queries) and len(vectors):
            q, x = (_matrix(t["vec"].combine_chunks(), width) for t in (queries, vectors))
            exact = max(1.0, float(np.abs(q).max(initial=0))) * max(1.0, float(np.abs(x).max(initial=0))) * max(1, width) < _EXACT
            row_q, row_x = queries["row"].to_numpy(), vectors["row"].to_numpy()
            step = max(1, PRODUCTS // len(x))
            for start in range(0, len(q), step):
                part = slice(start, start + step)
                if exact:
                    scores = q[part] @ x.T
                    scores[row_q[part, None] == row_x] = -np.inf
                    row, column = _best(scores, k)
                    value = scores[row, column].astype(np.int64)
                else:
                    row, column, value = _best_exact(q[part], x, row_q[part], row_x, k)
                out.append((row + start, column, value))
        if not out:
            return _FOUND.empty_table()
        row, column, value = (np.concatenate(c) for c in zip(*out, strict=True))
        asked, got = queries.take(pa.array(row)), vectors.take(pa.array(column))
        return pa.Table.from_arrays([asked["row"], asked["id"], got["id"], pa.array(value, pa.int64())], schema=_FOUND)

    return run


def _best_exact(q: np.ndarray, x: np.ndarray, row_q: np.ndarray, row_x: np.ndarray, k: int) -> tuple:
    """As ``_best`` in integers of any size; a score beyond a long counts as the nearest long."""
    rows, columns, values = [], [], []
    whole = [[int(v) for v in r] for r in x]
    for i, r in enumerate(q):
        r = [int(v) for v in r]
        scores = [(sum(a * b for a, b in zip(r, w, strict=True)), j) for j, w in enumerate(whole) if row_x[j] != row_q[i]]
        for score, j in sorted(((max(-_LONG - 1, min(_LONG, s)), j) for s, j in scores), key=lambda s: (-s[0], s[1]))[:k]:
            rows.append(i)
            columns.append(j)
            values.append(score)
    return np.array(rows, np.int64), np.array(columns, np.int64), np.array(values, np.int64)


def _bounded(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: for each row where ``asks`` holds, its ``k`` highest inner products.

    Components become floor(scale * x). Candidates are all rows but the query's own; ties go
    to the smaller id, a missing id last. Vectors that are null or hold a null, NaN or infinity
    take no part. A vector shorter than others counts as 0 beyond its end, an empty one as all
    zeros. Rows that share an id are rows of their own, as queries too. Scores are exact;
    beyond a long they count as the nearest long. Other columns are not read.
    """
    spark = vectors.sparkSession
    given = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.col(vector_column).cast("array<double>").alias("vec"),
    )
    # rows are numbered once, in a table
    whole = materialise(given.mapInArrow(_whole(scale), "row long, id long, asks boolean, vec array<double>, norm double, width int"))
    n, most, width = whole.agg(F.count("*"), F.max("norm"), F.max("width")).first()
    bounded, most, width = (most or 0.0) < NO_BOUNDS, min(most or 0.0, NO_BOUNDS), width or 0
    sample = min(SAMPLE * MOST_PIVOTS, max(1, SAMPLE_BYTES // (8 * (width + 1))))
    few = whole.orderBy(F.xxhash64("row"), "row").limit(sample).select("vec", "norm").toArrow()
    result = "query_id long, rank int, id long, score long"
    if not n or not len(few):
        return spark.createDataFrame([], result)
    pivots = _lifted(_matrix(few["vec"].combine_chunks(), width), few["norm"].to_numpy(), most)
    pivots = _pivots(pivots, max(1, min(MOST_PIVOTS, len(few) // SAMPLE, -(-n // CELL_VECTORS))))
    schema = "row long, id long, asks boolean, vec array<double>, cell int, away double, asked int, far double"
    placed = materialise(whole.mapInArrow(_place(pivots, most, width), schema))

    nearest = Window.partitionBy("cell").orderBy("away")
    close = placed.select("cell", "away").withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    near: dict[int, list[float]] = {}
    for r in close.collect():  # k + 1 rows a pivot
        near.setdefault(r.cell, []).append(r.away)
    counts = dict(placed.groupBy("cell").count().collect())
    asked = {r.asked: (r.far, r.n) for r in placed.where("asks").groupBy("asked").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    if not asked:
        return spark.createDataFrame([], result)
    # a query may itself be one of the vectors, so k + 1 are looked for
    low, high = reach(pivots, {c: far for c, (far, _) in asked.items()}, near, k + 1)
    if not bounded:
        low, high = np.full_like(low, -np.inf), np.full_like(high, np.inf)

    row_bytes = 8 * max(1, width)
    part_rows, block_rows = max(1, PART_BYTES // row_bytes), max(1, BLOCK_BYTES // row_bytes)
    cells = np.array(sorted(asked))
    sizes = np.array([asked[c][1] for c in cells.tolist()])
    cell_group, needs = [], []
    for g, members in enumerate(_chains(pivots, cells, sizes, part_rows)):
        least, greatest = low[members].min(0), high[members].max(0)
        parts = -(-sum(asked[c][1] for c in members) // part_rows)
        cover = sum(counts.get(j, 0) for j in range(len(pivots)) if least[j] <= greatest[j])
        blocks = max(1, -(-cover // block_rows))
        cell_group += [(c, g, parts, blocks) for c in members]
        needs += [(j, g, parts, blocks, float(least[j]), float(greatest[j])) for j in counts if least[j] <= greatest[j]]
    # at most a row for each two pivots
    to_group = _bounded(spark, cell_group, "asked int, grp int, parts int, blocks int")
    to_groups = _bounded(spark, needs, "cell int, grp int, parts int, blocks int, low double, high double")
    pick: Callable[[str], Column] = lambda by: F.pmod(F.xxhash64("row"), by).cast("int")
    every: Callable[[str], Column] = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    columns = ["grp", "part", "block", "query", "row", "id", "vec"]
    queries = placed.where("asks").join(to_group, "asked").withColumn("part", pick("parts")).withColumn("block", every("blocks"))
    needed = placed.join(to_groups, "cell").where("away >= low AND away <= high").withColumn("block", pick("blocks")).withColumn("part", every("parts"))
    dealt = queries.withColumn("query", F.lit(True)).select(columns).union(needed.withColumn("query", F.lit(False)).select(columns))
    found = dealt.groupBy("grp", "part", "block").applyInArrow(_solve(k, width), "query long, query_id long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
