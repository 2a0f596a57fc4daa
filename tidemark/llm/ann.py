"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Rows of one bucket that a task compares at once; larger buckets are split.
CHUNK = 4096


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def signed_axes(x: np.ndarray, table: int, probes: int, seed: int) -> np.ndarray:
    """For each row the `probes` nearest signed axes, nearest first, under the table's pseudo-rotation H D3 H D2 H D1."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng([seed, table]).choice((-1.0, 1.0), (3, width))
    for s in signs:
        x = hadamard(x * s)
    both = np.concatenate((x, -x), axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, : min(probes, 2 * width)]


def _hashed(vectors: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """vec_id, embedding and the keys (one of table and signed axis for each table and probe)."""

    def run(batches):
        for b in batches:
            out, x = [], _matrix(b.column("embedding"))
            unit = x / np.linalg.norm(x, axis=1)[:, None] if len(x) else x
            for t in range(tables if len(x) else 0):
                out.append(signed_axes(unit, t, probes, seed) + t * (1 << 20))
            keys = np.concatenate(out, axis=1).astype(np.int32) if out else np.zeros((0, 1), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, max(1, keys.shape[1])), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), lists], ["vec_id", "embedding", "keys"])

    return vectors.mapInArrow(run, "vec_id long, embedding array<float>, keys array<int>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "vec_id long, embedding array<double>, keys array<int>")


def nearest_of(index: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """Each query's k nearest ids in index by cosine, ties to the smaller vec_id; a row never finds its own id.

    An id with several rows counts once, by its nearest row.
    """
    ids, queries = index["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
    x, q = _matrix(index["embedding"]), _matrix(asked["embedding"])
    x_norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    unit = x / x_norm[:, None]
    by = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(ids[by]) != 0][: len(ids)])
    repeated = len(starts) < len(ids)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 512):
        cos = (q[at : at + 512] / q_norm[at : at + 512, None]) @ unit.T
        cos[queries[at : at + 512, None] == ids[None, :]] = -np.inf
        top = np.maximum.reduceat(cos[:, by], starts, axis=1) if repeated else cos
        border = np.partition(top, max(0, len(starts) - k), axis=1)[:, max(0, len(starts) - k)]
        for i in range(len(cos)):
            near = np.flatnonzero((cos[i] >= border[i] - 1e-9) & np.isfinite(cos[i]))
            exact = (x[near] * q[at + i]).sum(axis=1) / (x_norm[near] * q_norm[at + i])
            best = np.lexsort((ids[near], -exact))
            if repeated:
                best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
            best = best[:k]
            found.append((np.full(len(best), queries[at + i]), ids[near][best], exact[best]))
    parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})


def _search(index: DataFrame, queries: DataFrame, by: list[str], k: int) -> DataFrame:
    """Exact top k inside each group of `by`."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest_of(left, right, k)

    return index.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 24, probes: int = 4, seed: int = 11) -> DataFrame:
    """The k nearest candidates by cosine of each query, found by cross-polytope hashing.

    vectors, queries: vec_id long, embedding array; other columns are ignored. Returns query_id, rank, vec_id, score.
    Every vector is stored under its nearest signed axis in each table; a query probes its `probes` nearest axes of
    each. Buckets are the groups of a cogroup; one of more than CHUNK rows or queries is dealt into chunks of
    about that many of either, each chunk of queries meeting each of rows. Each group returns
    at most k ids a query, so what is shuffled afterwards is linear in the queries.

    Null, zero or non-finite vectors take no part, as queries or candidates; nor do rows without a vec_id. Vectors
    must have one length. A query that finds fewer than k in its buckets (tables of a few rows) is searched again
    against all rows in blocks. Ties: the smaller vec_id. Repeated rows of one id count once, by the nearest; a
    query id with several vectors asks with the smallest of them. Empty table: no rows.
    """
    fit = lambda df: df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), "embedding")
    index, asked = fit(vectors).distinct(), fit(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    stored = _hashed(index, tables, 1, seed).withColumn("key", F.explode("keys")).drop("keys")
    probed = _hashed(asked, tables, probes, seed).withColumn("key", F.explode("keys")).drop("keys")
    # At most tables x 2 x width rows each, whatever the input.
    rows = F.broadcast(stored.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    asks = F.broadcast(probed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("asks")))
    found = materialise(_search(*_dealt(stored.join(rows, "key").join(asks, "key"), probed.join(rows, "key").join(asks, "key")), ["key", "chunk", "ask"], k), "ann-found")
    counts = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
    short = materialise(asked.join(counts, asked["vec_id"] == counts["query_id"], "left").filter(F.coalesce("n", F.lit(0)) < k).select("vec_id", "embedding"), "ann-short")
    few = short.count()
    if few:
        sizes = {"chunks": F.lit(index.count() // CHUNK + 1), "asks": F.lit(few // CHUNK + 1)}
        found = found.union(_search(*_dealt(index.withColumns(sizes), short.withColumns(sizes)), ["chunk", "ask"], k))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _dealt(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with chunk (of `chunks`, of rows) and ask (of `asks`, of queries): each has its own by hash, and all of the other's."""
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    rows = rows.withColumn("chunk", own("chunks", "vec_id", "embedding")).withColumn("ask", every("asks"))
    queries = queries.withColumn("ask", own("asks", "vec_id")).withColumn("chunk", every("chunks"))
    return rows.drop("chunks", "asks"), queries.drop("chunks", "asks")
