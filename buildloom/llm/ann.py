"""Approximate nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed under its nearest centroid (its cell) with
one byte of code for each subspace of its residual. Cells are packed into units of bounded size, and a larger cell is split
over several, so one that holds a third of all vectors is shared out among tasks; queries come to a unit in blocks of
bounded size as well. A query visits the units of the cells whose centroids have the largest products with it. In each unit
it scores the vectors through its table of products with the codebooks (asymmetric distance), and the best are scored anew
on the original vectors in double precision. So are all others that may be nearer than the last of these: each vector has
the length of what its code leaves out, which bounds how far its score is off. Thus a unit gives its true nearest, also
where vectors lie so near to each other that they share their codes. How many cells to visit is calibrated: the fewest with
which a bounded sample of queries finds TARGET of its true neighbours, which a brute-force pass over all vectors gives.
Cells, codes and bounds are of vectors by a common scale and queries of length 1, so neither large nor small values matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, small

#: Documented bounds: vectors that centroids and codebooks are fitted on (each cell's centroid on CELL_SAMPLE at least, so
#: there are 2 sqrt(N) cells as long as the sample allows), vectors and queries of a block, queries that the number of visited
#: cells is calibrated on.
SAMPLE = 32_768
CELL_SAMPLE = 16
BLOCK = 4096
QUERY_BLOCK = 1024
CALIBRATE = 256
#: Vectors of a unit that are scored exactly for each query in any case.
RERANK = 128
#: The share of true neighbours whose cells are visited.
TARGET = 0.95
#: Vectors and queries that are scored at once, so that what is summed stays in a processor's cache.
TILE, TILE_QUERIES = 256, 128
SUBSPACES = 16
CODES = 256


@dataclass
class Index:
    centroids: np.ndarray  # cells x dim
    books: np.ndarray  # subspaces x codes x width
    dim: int

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        res = pad(x - self.centroids[cell], self.padded)
        m, _, w = self.books.shape
        return np.stack([nearest(res[:, i * w : (i + 1) * w], self.books[i]) for i in range(m)], 1).astype(np.uint8)

    def left_out(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far a vector's product with a query of length 1 is from what its cell and codes give, at most."""
        told = np.concatenate([self.books[m][codes[:, m]] for m in range(codes.shape[1])], 1)
        return length(pad(x - self.centroids[cell], self.padded) - told) * (1 + 1e-9) + 1e-9 * (length(x) + length(self.centroids)[cell])

    def tables(self, q: np.ndarray) -> np.ndarray:
        """subspaces x codes x queries: products with the codebooks."""
        m, _, w = self.books.shape
        return np.matmul(self.books, pad(q, self.padded).reshape(len(q), m, w).transpose(1, 2, 0))

    def asymmetric(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """queries x vectors: the products of queries with cells' centroids and what the tables add for the codes."""
        table, centre = self.tables(q), self.centroids @ q.T
        near = np.empty((len(q), len(cell)))
        for i in range(0, len(cell), TILE):
            sums = centre[cell[i : i + TILE]]
            for m in range(codes.shape[1]):
                sums += table[m][codes[i : i + TILE, m]]
            near[:, i : i + TILE] = sums.T
        return near


def length(x: np.ndarray) -> np.ndarray:
    """Of each row, whatever its values' size."""
    most = np.abs(x).max(1, initial=0.0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1))


def unit_length(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / length(x)[:, None]


def pad(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]))], 1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def fit(x: np.ndarray, cells: int, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)  # copies don't draw centroids
    centroids = k_means(x, cells, 8, rng)
    m = min(SUBSPACES, x.shape[1])
    w = -(-x.shape[1] // m)
    x = x[rng.permutation(len(x))[: 32 * CODES]]
    res = pad(x - centroids[nearest(x, centroids)], m * w)
    books = []
    for i in range(m):
        book = k_means(res[:, i * w : (i + 1) * w], CODES, 6, rng)
        books.append(np.concatenate([book, np.repeat(book[:1], CODES - len(book), 0)]))
    return Index(centroids, np.stack(books), x.shape[1])


def vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector that takes part (dim finite components, not all zero), and these as a matrix."""
    column = column.cast(pa.large_list(pa.float64()))
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy() == dim)
    taken = column.filter(pa.array(ok))
    x = taken.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(taken) else np.zeros((0, dim))
    fine = np.isfinite(x).all(1) & (x != 0).any(1)  # a null component is a NaN here
    ok[np.flatnonzero(ok)] = fine
    return ok, x[fine]


def best(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest in each row; of equal ones the first columns."""
    if scores.shape[1] <= n:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    least = np.partition(scores, scores.shape[1] - n, 1)[:, -n][:, None]
    pick = scores >= least
    tied = np.flatnonzero(np.count_nonzero(pick, 1) > n)
    if len(tied):
        over, level = scores[tied] > least[tied], scores[tied] == least[tied]
        pick[tied] = over | (level & (np.cumsum(level, 1) <= n - over.sum(1)[:, None]))
    return np.nonzero(pick)[1].reshape(len(scores), n)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def nearest_exact(entries: DataFrame, asked: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, cell, score of the k nearest, by brute force: a bounded number of queries against all entries."""
    dim = x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cell, v = b.column("vec_id").to_numpy(), b.column("cell").to_numpy(), matrix(b.column("raw"), dim)
            s = x @ v.T
            s[asked[:, None] == ids[None, :]] = -np.inf
            top = best(s, k)
            s = np.take_along_axis(s, top, 1).ravel()
            cols = [np.repeat(asked, top.shape[1]), ids[top].ravel(), cell[top].ravel(), s]
            yield pa.RecordBatch.from_arrays([pa.array(c[np.isfinite(s)]) for c in cols], names=["query_id", "vec_id", "cell", "score"])

    found = entries.select("vec_id", "cell", "raw").mapInArrow(run, "query_id long, vec_id long, cell int, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def sample(valid: DataFrame, total: int) -> DataFrame:
    """SAMPLE of the rows (or all), those of the least hashes of vec_id: no part of the table is left out."""
    keep = min(1.0, 2.0 * SAMPLE / max(total, 1))  # expected to hold twice as many, so that what is ordered is small
    drawn = valid.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(np.ceil(keep * (1 << 20))))
    return drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)


def search(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, target: float = TARGET) -> DataFrame:
    """For each row whose id is divisible by `every`: query_id, rank (from 1), vec_id, score of its k nearest among all others.

    Ids null, and vectors null, zero, of another length than most valid ones, or with null or non-finite components take no part.
    Rows that repeat an id count once (the larger product, if their vectors differ) and never answer a query of that id.
    Equal products go to the smaller id. With no valid vector or query the result is empty. Other columns are ignored.
    """
    spark = table.sparkSession
    ship(spark)
    rows = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))  # NaN is above all numbers
    valid = rows.where(F.col("vec").isNotNull()).where(finite & F.exists("vec", lambda v: v != 0))
    shape = valid.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], schema)
    dim, total = shape["dim"], shape["count"]
    drawn = sample(valid.where(F.size("vec") == dim), total).toArrow()
    _, x = vectors(drawn.column("vec").combine_chunks(), dim)
    if not len(x):
        return spark.createDataFrame([], schema)
    scale = float(np.median(np.abs(x).max(1)))
    index = fit(x / scale, int(max(1, min(2 * np.sqrt(total), len(x) / CELL_SAMPLE))))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = vectors(b.column("vec"), dim)
            y = x / scale
            cell = index.cells(y)
            codes = index.codes(y, cell)
            cols = [b.column("vec_id").filter(pa.array(ok)), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(index.left_out(y, cell, codes)), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cell", "code", "off", "raw"])

    entries = cut(rows.mapInArrow(enter, "vec_id long, cell int, code binary, off double, raw binary"), "ivf")
    counts = np.zeros(len(index.centroids), np.int64)
    for r in entries.groupBy("cell").count().collect():  # one row for each cell, of which there are SAMPLE / CELL_SAMPLE at most
        counts[r["cell"]] = r["count"]
    asked = entries.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", F.col("raw").alias("q_raw")).dropDuplicates(["vec_id"])
    trial = asked.orderBy(F.xxhash64("vec_id")).limit(CALIBRATE).toArrow()
    if not trial.num_rows:
        return spark.createDataFrame([], schema)
    who, y = trial.column("vec_id").to_numpy(), unit_length(matrix(trial.column("q_raw"), dim))
    true = nearest_exact(entries, who, y, k).toArrow()  # k rows for each of CALIBRATE queries
    order = np.argsort(-(y @ index.centroids.T), 1, kind="stable")
    at = np.argsort(order, 1)
    back = {q: i for i, q in enumerate(who.tolist())}
    seen = np.sort([at[back[q], c] for q, c in zip(true.column("query_id").to_pylist(), true.column("cell").to_pylist())])
    probes = int(seen[int(np.ceil(target * len(seen))) - 1]) + 1 if len(seen) else len(counts)
    enough = min(int(counts.sum()), 10 * k)

    # Units: small cells packed together in their order, a large cell over several.
    first, n_units, filled = np.zeros(len(counts), np.int64), 0, BLOCK + 1
    spread = np.maximum(1, -(-counts // BLOCK))
    for c, n in enumerate(counts.tolist()):
        if spread[c] > 1 or filled + n > BLOCK:
            first[c], filled = n_units, n if spread[c] == 1 else BLOCK + 1
            n_units += int(spread[c])
        else:
            first[c], filled = n_units - 1, filled + n

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = unit_length(matrix(b.column("q_raw"), dim))
            for i in range(0, len(q), 256):
                near = q[i : i + 256] @ index.centroids.T
                order = np.argsort(-near, 1, kind="stable")
                n = np.maximum(np.argmax(np.cumsum(counts[order], 1) >= enough, 1) + 1, min(probes, order.shape[1]))
                least = np.take_along_axis(near, np.take_along_axis(order, n[:, None] - 1, 1), 1)
                row, cell = np.nonzero((near >= least) & (counts > 0))
                times = spread[cell]
                row, unit = np.repeat(row, times), np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                pairs = np.unique(row * n_units + unit)
                row, unit = pairs // n_units, pairs % n_units
                part = b.slice(i, 256).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("q_raw"), pa.array(unit, pa.int32())], names=["query_id", "q_raw", "unit"])

    def place_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, ids = b.column("cell").to_numpy(), b.column("vec_id").to_numpy()
            with np.errstate(over="ignore"):
                dealt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            unit = first[cell] + dealt % spread[cell]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unit, pa.int32())], names=["vec_id", "cell", "code", "off", "raw", "unit"])

    visits = cut(asked.mapInArrow(visit, "query_id long, q_raw binary, unit int"), "visits")
    # How many blocks a unit's queries make: a row for each unit of BLOCK vectors, joined to both sides.
    loads = visits.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    loads = small(loads, n_units)
    left = visits.join(loads, "unit").withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    placed = entries.mapInArrow(place_in, "vec_id long, cell int, code binary, off double, raw binary, unit int").join(loads, "unit")
    right = placed.withColumn("v_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumnRenamed("unit", "v_unit").drop("blocks")

    def score(q: pa.Table, v: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and v.num_rows:
            ids = v.column("vec_id").to_numpy()
            ids, once = np.unique(ids, return_index=True)  # ascending, so of equal scores the smaller id comes first
            v = v.take(pa.array(once))
            cell = v.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(v.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            off, raw = v.column("off").to_numpy(), matrix(v.column("raw"), dim)
            scaled = raw / scale
            far = length(scaled)
            asked, x = q.column("query_id").to_numpy(), matrix(q.column("q_raw"), dim)
            for i in range(0, len(asked), TILE_QUERIES):
                who, y = asked[i : i + TILE_QUERIES], unit_length(x[i : i + TILE_QUERIES])
                near, own = index.asymmetric(y, cell, codes), ids[None, :] == who[:, None]
                near[own] = -np.inf
                pick = best(near, RERANK)
                sure = np.einsum("qrd,qd->qr", scaled[pick], y)
                sure[np.isneginf(np.take_along_axis(near, pick, 1))] = -np.inf
                few = sure.shape[1] <= k  # then all are answers
                level = np.full(len(who), -np.inf) if few else np.partition(sure, -k, 1)[:, -k]
                near += off
                near = near >= level[:, None] - 1e-9 * np.abs(level)[:, None]
                may = np.flatnonzero(near.any(0))
                s = np.where(near[:, may] & ~own[:, may], y @ scaled[may].T, -np.inf)
                level = np.full(len(who), -np.inf) if s.shape[1] <= k else np.partition(s, -k, 1)[:, -k]
                tied = s + 1e-12 * far[may] >= (level - 1e-9 * np.abs(level))[:, None]
                for j in range(len(who)):
                    at = may[np.flatnonzero(tied[j] & ~own[j, may])]
                    exact = np.einsum("rd,d->r", raw[at], x[i + j])
                    top = np.lexsort((ids[at], -exact))[:k]
                    out.append((np.repeat(who[j], len(top)), ids[at[top]], exact[top]))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pa.table({"query_id": pa.array(a), "vec_id": pa.array(b), "score": pa.array(c)})

    found = left.groupBy("unit", "q_block").cogroup(right.groupBy("v_unit", "v_block")).applyInArrow(score, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
