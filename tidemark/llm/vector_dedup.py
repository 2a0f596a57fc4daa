"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ann import _matrix, usable
from tidemark.llm.common import materialise, spread_join
from tidemark.llm.components import components

#: Rows of one bucket that a task compares at once; larger buckets are compared chunk against chunk.
CHUNK = 2048
#: Oversized buckets that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def buckets(unit: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """int32 keys, a row for each vector and a column for each table: `hashes` quantised Gaussian projections each."""
    out = np.empty((len(unit), tables), np.int32)
    for t in range(tables):
        rng = np.random.default_rng([seed, t])
        cells = np.floor((unit @ rng.standard_normal((unit.shape[1], hashes)) + rng.uniform(0, width, hashes)) / width).astype(np.int64)
        mixed = np.full(len(unit), 0x9E3779B97F4A7C15 + t, np.uint64)
        for j in range(hashes):
            mixed = (mixed ^ cells[:, j].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(29)
        out[:, t] = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _hashed(vectors: DataFrame, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    kind = dict(vectors.dtypes)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("embedding"))
            keys = buckets(x / np.linalg.norm(x, axis=1)[:, None], tables, hashes, width, seed) if len(x) else np.zeros((0, tables), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "n", "label", "embedding")), lists], ["vec_id", "n", "label", "embedding", "keys"])

    return vectors.select("vec_id", "n", "label", "embedding").mapInArrow(run, f"vec_id long, n long, label {kind['label']}, embedding {kind['embedding']}, keys array<int>")


def links_of(group: pa.Table, least: float) -> pa.Table:
    """(vec_id, links, root) of the rows that link, bucket by bucket; a bucket here is one pair of chunks.

    links counts the vectors that rows stand for (n), in pairs whose first common table this is, so that a pair counts once
    over all tables; root is the smallest vec_id that the chunk pair connects a row to.
    """
    columns = [*(group[n].to_numpy() for n in ("table", "key", "left", "right")), group["label"].combine_chunks().dictionary_encode().indices.to_numpy()]
    order = np.lexsort(columns)
    starts = np.flatnonzero(np.r_[np.ones(min(1, len(order)), bool), np.any([np.diff(c[order]) != 0 for c in columns], axis=0)])
    sizes = np.diff(np.r_[starts, len(order)])
    ids, chunk, x, keys = group["vec_id"].to_numpy(), group["chunk"].to_numpy(), _matrix(group["embedding"]), group["keys"].combine_chunks().flatten().to_numpy().reshape(len(group), -1) if len(group) else None
    if len(ids):
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
    table, left, right, weight = (group[n].to_numpy() for n in ("table", "left", "right", "n"))
    found = [_links(ids[at], weight[at], chunk[at], x[at], keys[at], table[at[0]], left[at[0]], right[at[0]], least) for s, n in zip(starts, sizes, strict=True) if n > 1 for at in [order[s : s + n]]]
    parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("vec_id", "links", "root"), parts, strict=True)})


def _links(ids: np.ndarray, weight: np.ndarray, chunk: np.ndarray, x: np.ndarray, keys: np.ndarray, table: int, left: int, right: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = (np.flatnonzero(chunk == c) for c in (left, right))
    linked = x[a] @ x[b].T >= least
    linked &= ids[a][:, None] != ids[b][None, :]
    if not linked.any():
        return (np.zeros(0, np.int64),) * 3
    if left == right:
        linked |= linked.T  # the product may differ in the last place across the diagonal
    first = linked.copy()
    for t in range(table):
        first &= keys[a, t][:, None] != keys[b, t][None, :]
    links = np.zeros(len(ids), np.int64)
    links[a] += first @ weight[b]
    if left != right:
        links[b] += weight[a] @ first
    root, (rows, cols) = ids.copy(), np.nonzero(linked)
    while True:
        low = np.minimum(root[a[rows]], root[b[cols]])
        new = root.copy()
        np.minimum.at(new, a[rows], low)
        np.minimum.at(new, b[cols], low)
        if (new == root).all():
            break
        root = new
    on = np.zeros(len(ids), bool)
    on[a[rows]] = on[b[cols]] = True
    return ids[on], links[on], root[on]


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = 20, hashes: int = 6, width: float = 1.2, seed: int = 5) -> DataFrame:
    """Link vectors of equal label whose cosine is at least `least`.

    vectors: vec_id long, embedding array, label; other columns are ignored. Returns one row per input row: vec_id,
    n_links, component_id, kept. Equal vectors of one label are one row with a count, so that copies are never compared.
    Two unit vectors at cosine c lie sqrt(2 - 2c) apart; at 0.98 a pair shares a table
    with probability 0.42, so that 20 tables miss fewer than 2 in 100,000. Buckets (table, label and
    key) are dealt to groups of a few thousand rows. A bucket of more than CHUNK rows is split, and chunks meet pairwise, each pair of chunks in a group of its
    own. A group returns a row for each linked vector (count and smallest id reached), never its pairs.

    Null, zero or non-finite vectors, null labels and null ids link with nothing (n_links 0, component_id = vec_id).
    Repeated rows of one vec_id never link with each other; equal (id, label, vector) rows count once for others and
    each returns the same values. Vectors must have one length. Empty table: empty result.
    """
    fit = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    fit = materialise(fit.select(F.col("vec_id").cast("long"), "label", "embedding").distinct(), "vectors-fit")
    # An id with several vectors stands alone with each, so that it is known not to link with itself.
    several = fit.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id", F.col("vec_id").cast("string").alias("own"))
    fit = fit.join(several, "vec_id", "left").withColumn("own", F.coalesce("own", F.lit("")))
    alike = ["label", "embedding", "own"]
    classes = materialise(fit.groupBy(*alike).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")), "vectors-classes")
    hashed = materialise(_hashed(classes.withColumnRenamed("node", "vec_id"), tables, hashes, width, seed), "vectors-hashed")
    keyed = hashed.select("vec_id", "n", "label", "embedding", "keys", F.posexplode("keys").alias("table", "key"))
    bucket = ["table", "label", "key"]
    large = materialise(keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK).select(*bucket, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "vectors-large")
    if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    rows = keyed.join(large, bucket, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(F.col("chunk"), o).alias("left"), F.greatest(F.col("chunk"), o).alias("right"))))
    rows = rows.withColumn("pair", other).select("*", "pair.left", "pair.right").drop("pair")
    # Small buckets share a group; each pair of chunks of a large one has its own.
    groups = hashed.count() * tables // (4 * CHUNK) + 1
    small = F.pmod(F.xxhash64(*bucket), F.lit(groups))
    rows = rows.withColumn("group", F.when(F.col("chunks") == 1, small).otherwise(F.xxhash64(*bucket, "left", "right"))).drop("chunks")

    def run(group: pa.Table) -> pa.Table:
        return links_of(group, least)

    found = materialise(rows.groupBy("group").applyInArrow(run, "vec_id long, links long, root long"), "vectors-links")
    linked = found.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    told = classes.join(linked, "node", "left").join(joined, "node", "left")
    told = materialise(told.select(*alike, "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "vectors-told")
    each = spread_join(fit, told, alike, "n", fit.count()).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select(F.col("vec_id").cast("long")).join(each, "vec_id", "left")
    part = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), part.alias("component_id"), (F.col("vec_id") == part).alias("kept"))
