"""Clusters around centroids, in exact integers.

Vectors are integers; every assignment is the nearest centroid by exact squared distance, the smaller number on a tie.
Nearly all of them are settled in float32: one matrix product gives every distance with a bound of its rounding error, so
each is an interval that surely holds it. A row whose least interval lies below all others is done; for the rest, the
centroids whose intervals overlap the least one are compared in 64-bit integers. Results don't depend on the BLAS, on
the order of rows or on the number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm._scratch import arrow_map, stored

#: Integer components beyond this could make a squared distance of 64 components that is no 64-bit number.
WIDEST = 1 << 27
#: Numbers in a temporary matrix of one step.
CELLS = 1 << 21


class Centroids:
    """k integer centroids (k x d), ready to compare rows with."""

    def __init__(self, table: np.ndarray):
        self.exact = np.ascontiguousarray(table, np.int64)
        self.single = self.exact.T.astype(np.float32)
        self.squares = (self.exact * self.exact).sum(axis=1)
        self.norms = np.sqrt(self.squares.astype(np.float64)) * (1 + 1e-12)
        n = (self.exact.shape[1] + 2) * 2.0**-24
        #: In any order of summation, a float32 product of d terms is off by at most this share of the product of the
        #: vectors' lengths: d - 1 additions, d multiplications and the two conversions.
        self.share = n / (1 - n)

    def intervals(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of |c|^2 - 2 x c, the distance less what all centroids share, for each row and centroid."""
        dots = (rows.astype(np.float32) @ self.single).astype(np.float64)
        length = np.sqrt(np.square(rows.astype(np.float64)).sum(axis=1)) * (1 + 1e-12)
        middle = self.squares.astype(np.float64) - 2 * dots
        off = 2 * self.share * np.outer(length, self.norms)
        off += 2.0**-49 * (self.squares + 2 * np.abs(dots) + off)  # of the double arithmetic here
        return middle - off, middle + off

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest centroid of each row, and how many rows were compared exactly."""
        out, again = np.empty(len(rows), np.int32), 0
        step = max(1, CELLS // max(self.exact.shape))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            low, high = self.intervals(part)
            listed = low <= high.min(axis=1, keepdims=True)
            out[at : at + step] = listed.argmax(axis=1)
            close = np.flatnonzero(listed.sum(axis=1) > 1)
            again += len(close)
            each = max(1, step // len(self.exact))
            for b in range(0, len(close), each):
                own = close[b : b + each]
                row, column = np.nonzero(listed[own])  # by row, then by number
                d = np.square(part[own][row].astype(np.int64) - self.exact[column]).sum(axis=1)
                first = np.searchsorted(row, np.arange(len(own)))
                best = np.flatnonzero(d == np.minimum.reduceat(d, first)[row])
                out[at + own] = column[best[np.searchsorted(row[best], np.arange(len(own)))]]
        return out, again

    def distances(self, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        step = max(1, CELLS // self.exact.shape[1])
        for at in range(0, len(rows), step):
            out[at : at + step] = np.square(rows[at : at + step].astype(np.int64) - self.exact[numbers[at : at + step]]).sum(axis=1)
        return out


def integers(vectors: DataFrame, size: int = 64, scale: int = 1024, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, v): the vectors of exactly `size` components, none null or non-finite, as integers floor(scale x), x a double.

    v: `size` little-endian 32-bit integers. Other rows have none; an integer beyond 2^27 raises. Repeated rows stay.
    """
    kind = vectors.schema[key].dataType.simpleString()
    whole = (F.size(column) == size) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            x = np.floor(scale * x.astype(np.float64))
            if x.size and np.abs(x).max() > WIDEST:
                raise ValueError(f"components beyond {WIDEST} of the scaled vectors")
            data = np.ascontiguousarray(x.astype("<i4"))
            bounds = np.arange(len(x) + 1, dtype=np.int32) * (4 * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(bounds), pa.py_buffer(data)])], names=["key", "v"])

    return arrow_map(vectors.filter(whole).select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("x")), run, f"key {kind}, v binary").withColumnRenamed("key", key)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of v."""
    if not len(column):
        return np.zeros((0, size), np.int32)
    column = column.cast(pa.large_binary())
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], "<i4", len(column) * size, first).reshape(-1, size)


def first_centroids(rows: DataFrame, k: int, size: int, seed: int, key: str = "vec_id") -> np.ndarray:
    """The k vectors with the least SHA-256 of `seed:key`, by hash, then by components; a null key counts as empty."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    least = rows.select(named.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([np.frombuffer(r["v"], "<i4") for r in least], np.int64).reshape(-1, size)


def moved(rows: DataFrame, table: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; those without vectors stay.

    A task sums its own vectors, so k rows of it are shuffled; k rows reach the driver.
    """
    k, size = table.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, counts = Centroids(table), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), size)
            numbers, _ = own.nearest(x)
            order = np.argsort(numbers, kind="stable")
            found, first = np.unique(numbers[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
                counts += np.bincount(numbers, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array([sums[i].tobytes() for i in some], pa.binary())], names=["cluster", "n", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = {}, {}
        for batch in batches:
            for c, m, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n[c] = n.get(c, 0) + m
                sums[c] = sums.get(c, 0) + np.frombuffer(s, np.int64).astype(object)  # of any size
        means = [np.array(sums[c] // n[c], np.int64).tobytes() for c in n]
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(means, pa.binary())], names=["cluster", "mean"])

    parts = arrow_map(rows.select("v"), partial, "cluster int, n long, sums binary").repartition("cluster")
    out = table.copy()
    for c, mean in arrow_map(parts, total, "cluster int, mean binary").collect():
        out[c] = np.frombuffer(mean, np.int64)
    return out


def fit(rows: DataFrame, k: int, rounds: int, size: int = 64, seed: int = 3, key: str = "vec_id") -> np.ndarray:
    """The centroids (k x size; fewer if there are fewer vectors) after so many rounds over the rows of integers()."""
    table = first_centroids(rows, k, size, seed, key)
    for _ in range(rounds if len(table) else 0):
        new = moved(rows, table)
        if np.array_equal(new, table):  # and so in all rounds to come
            break
        table = new
    return table


def assigned(rows: DataFrame, table: np.ndarray, key: str = "vec_id") -> DataFrame:
    """key, cluster and distance of each row of integers()."""
    kind, size = rows.schema[key].dataType.simpleString(), table.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centroids(table)
        for batch in batches:
            x = matrix(batch.column(1), size)
            numbers, _ = own.nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers), pa.array(own.distances(x, numbers))], names=["key", "cluster", "distance"])

    return arrow_map(rows.select(F.col(f"`{key}`").alias("key"), "v"), run, f"key {kind}, cluster int, distance long").withColumnRenamed("key", key)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that integers() keeps.

    Lloyd's rounds from the k vectors with the least hashes; then one more assignment. Rows with a null id or equal to
    another are vectors like others. Without vectors there are no rows. Other columns of the table aren't read.
    """
    rows = stored(integers(vectors, size, scale, key, column), "vectors")
    table = fit(rows, k, rounds, size, seed, key)
    if not len(table):
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    out = stored(assigned(rows, table, key), "assigned")
    sums = {c: int(s) for c, s in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    facts = [(c, s, sum(sums.values()), digest(table[c])) for c, s in sorted(sums.items())]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(F.col(f"`{key}`"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    far = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT rid, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (SELECT v.rid, c.c, {far} AS d FROM v, c{i} c) GROUP BY rid)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT c, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{i} JOIN v USING (rid), range(1, {size + 1}) r(i) GROUP BY c, i)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM m{i} GROUP BY c) m ON m.c = c.c)")
    return "WITH " + ", ".join(parts) + f" SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} f USING (c)"


OP12_SQL = _sql()
