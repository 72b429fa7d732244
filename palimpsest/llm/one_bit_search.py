"""Nearest neighbours by randomly rotated one-bit codes.

A vector less the mean is turned by a seeded random rotation and kept as the signs of its components, packed, with two
numbers: its length and the inner product of its direction with its code. From these the inner product with any query
is estimated without bias, with an error that lies within SPREAD standard bounds of 0 nearly always. A vector is
reranked by its exact distance only if the lower bound of its distance is not above the K-th best so far.

Every row is in the index; nothing is fitted but the mean, which is taken over all rows. Queries are worked on in
blocks of at most QUERY_BLOCK, which is what each task and the driver hold: a block's result is written and its broadcast
destroyed before the next begins. A task keeps K neighbours for each query of a block, so no pairs are written or joined.
The best of all tasks are merged in a window by query. Each block reads the index once.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do null vec_ids.
Vectors of different lengths are never compared. Equal distances go to the smaller vec_id. Rows with the query's own
vec_id are no candidates of it; of several rows with a query's vec_id one, the smallest vector, is the query. With
fewer than K candidates all are returned. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import dropped, scratch, table, written

K, EVERY, SEED, SPREAD, QUERY_BLOCK, CELLS = 10, 100, 7, 4.0, 4096, 1 << 20
INDEX = "vec_id long, code binary, norm double, fit double, vector array<double>"


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part."""
    v = F.col("vector")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)))


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def mean_of(vectors: DataFrame, size: int) -> np.ndarray:
    """The mean of all vectors of one length, from one sum for each task."""

    def summed(batches):
        total, n = np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                total += matrix(batch.column(0)).sum(0)
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n]), pa.array([list(total)], pa.list_(pa.float64()))], ["one", "n", "total"])

    parts = vectors.select("vector").mapInArrow(summed, "one long, n long, total array<double>")
    row = parts.select("n", F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    return np.array([r.x / max(r.n, 1) for r in row])


def indexed(vectors: DataFrame, size: int, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """The code, length and fit of each vector of the given length."""

    def coded(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1)) - centre
            norm = np.sqrt((x**2).sum(1))
            y = (x / np.where(norm > 0, norm, 1.0)[:, None]) @ turn
            bits = y > 0
            fit = np.abs(y).sum(1) / np.sqrt(size)
            codes = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(fit), batch.column(1)], ["vec_id", "code", "norm", "fit", "vector"])

    return vectors.mapInArrow(coded, INDEX)


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.square, self.ids = k, np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, square: np.ndarray) -> None:
        if not len(query):
            return
        of = np.unique(query)
        q = np.concatenate([query, np.repeat(of, self.k)])
        i, s = np.concatenate([ids, self.ids[of].ravel()]), np.concatenate([square, self.square[of].ravel()])
        order = np.lexsort((i, s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.square[q[keep], rank[keep]], self.ids[q[keep], rank[keep]] = s[keep], i[keep]


def search(index: DataFrame, sent, centre: np.ndarray, turn: np.ndarray, k: int = K) -> DataFrame:
    """query_id, vec_id, score: each task's k nearest rows of the index for each query. sent: a broadcast of the queries'
    ids and vectors."""
    size = len(centre)

    def near(batches):
        names, q = sent.value
        z = q - centre
        q_norm = np.sqrt((z**2).sum(1))
        turned = ((z / np.where(q_norm > 0, q_norm, 1.0)[:, None]) @ turn).astype(np.float32).T
        best, step = Best(len(q), k), max(1, CELLS // max(1, len(q)))
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(4))
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
            norm, fit = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for a in range(0, len(ids), step):
                at = slice(a, a + step)
                sign = np.unpackbits(codes[at], axis=1, count=size).astype(np.float32) * 2 - 1
                f = np.maximum(fit[at], 1e-9)[:, None]
                cosine = (sign @ turned) / np.sqrt(size) / f
                error = SPREAD * np.sqrt(np.maximum(1 - f**2, 0)) / f / np.sqrt(max(size - 1, 1)) + 1e-5
                both = 2 * norm[at][:, None] * q_norm
                square = norm[at][:, None] ** 2 + q_norm**2 - both * cosine
                other = ids[at][:, None] != names
                upper = np.where(other, square + both * error, np.inf)
                limit = best.square[:, -1]
                if len(upper) >= k:
                    limit = np.minimum(limit, np.partition(upper, k - 1, axis=0)[k - 1])
                low = square - both * error
                row, col = np.nonzero(other & (low <= limit + 1e-9 * np.abs(np.where(np.isfinite(limit), limit, 0))))
                for c in range(0, len(row), CELLS // 8):
                    r, g = row[c : c + CELLS // 8], col[c : c + CELLS // 8]
                    best.add(g, ids[at][r], ((x[at][r] - q[g]) ** 2).sum(1))
        of, rank = np.nonzero(np.isfinite(best.square))
        yield pa.RecordBatch.from_arrays([pa.array(names[of]), pa.array(best.ids[of, rank]), pa.array(np.sqrt(best.square[of, rank]))], ["query_id", "vec_id", "score"])

    return index.mapInArrow(near, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of (vec_id, embedding) whose vec_id is divisible by every."""
    spark = rows.sparkSession
    vectors = usable(rows)
    lengths = sorted(r[0] for r in vectors.select(F.size("vector")).distinct().collect())
    rank, found = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")), "query_id long, rank int, vec_id long, score double"
    path = scratch(spark, "nearest")
    spark.createDataFrame([], found).write.parquet(path)
    for size in lengths:
        own = vectors.filter(F.size("vector") == size)
        centre, turn = mean_of(own, size), rotation(size)
        index = written(indexed(own, size, centre, turn), "codes")
        asked = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        after = None
        while True:
            block = (asked if after is None else asked.filter(F.col("vec_id") > after)).orderBy("vec_id").limit(QUERY_BLOCK).collect()
            if not block:
                break
            after = block[-1].vec_id
            sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in block], np.int64), np.array([r.vector for r in block], float)))
            best = search(index, sent, centre, turn, k).withColumn("rank", rank).filter(F.col("rank") <= k)
            best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            sent.destroy()
            if len(block) < QUERY_BLOCK:
                break
        dropped(index)
    return spark.read.schema(found).parquet(path)


def op7_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
