"""Vectors as short codes: codebooks of parts, trained and assigned over a lexicographic trie of the distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, spread_join

#: Vectors whose parts a task puts into one trie, and leaves of a subtree that are taken at once.
CHUNK, SUBTREE = 32_768, 4096
#: Largest integer component: sums of squared distances stay exact in 64 bits.
LARGEST = 1 << 26
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """floor(256 x) of every component, a row for each vector; all must have `dims` components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    dims = dims or (int(sizes[0]) if len(sizes) else 1)
    if (sizes != dims).any():
        raise ValueError(f"vectors must all have {dims} components")
    whole = np.floor(256 * flat)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"components above {LARGEST / 256} have no exact code")
    return whole.astype(np.int64).reshape(-1, dims)


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, how often each occurs, and the number of each given row's."""
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.r_[np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(axis=1)]
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return rows[new], np.diff(np.r_[np.flatnonzero(new), len(rows)]), number


def leaves(parts: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs [low, high) of the sorted distinct parts with their squared distances to all entries, depth first.

    A node of the trie is a prefix of components; it holds the distances summed over them, once for all parts below. A subtree of at most
    SUBTREE leaves is expanded level by level, so that at most so many vectors of distances are held, besides one for each ancestor.
    """
    depths = parts.shape[1]
    stack = [(0, 0, len(parts), np.zeros(len(entries), np.int64))] if len(parts) else []
    while stack:
        depth, low, high, summed = stack.pop()
        here = parts[low:high]
        if high - low <= SUBTREE:
            new, level = np.zeros(high - low, bool), summed[None, :]
            parent = np.zeros(high - low, np.int64)
            new[0] = True
            for j in range(depth, depths):
                new[1:] |= here[1:, j] != here[:-1, j]
                at = np.flatnonzero(new)
                level = level[parent[at]] + np.square(here[at, j][:, None] - entries[None, :, j])
                parent = np.cumsum(new) - 1
            yield low, high, level[parent]
            continue
        ends = np.r_[np.flatnonzero(here[1:, depth] != here[:-1, depth]) + 1, high - low]
        below, start = [], 0
        while start < high - low:  # children that fit together stay one run below this node; a larger one is a node of its own
            k = int(np.searchsorted(ends, start + SUBTREE, "right")) - 1
            if k >= 0 and ends[k] > start:
                end = int(ends[k])
                below.append((depth, low + start, low + end, summed))
            else:
                end = int(ends[k + 1])
                below.append((depth + 1, low + start, low + end, summed + np.square(here[start, depth] - entries[:, depth])))
            start = end
        stack.extend(reversed(below))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted distinct parts its nearest entry, ties to the lower index, and the squared distance."""
    entry, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for low, high, summed in leaves(parts, entries):
        entry[low:high] = summed.argmin(axis=1)
        distance[low:high] = np.take_along_axis(summed, entry[low:high, None], axis=1)[:, 0]
    return entry, distance


def _chunks(batches, dims: int):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _assigned(table: pa.Table, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: its number, distinct parts, their counts, the number of each row's part, nearest entries and distances."""
    positions, _, width = books.shape
    x = integers(table["embedding"].combine_chunks(), positions * width)
    for p in range(positions):
        parts, counts, number = distinct(x[:, p * width : (p + 1) * width])
        yield p, parts, counts, number, *nearest(parts, books[p])


def retrained(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the floor of its parts' mean; unused entries stay.

    A task sums over its distinct parts, weighted by their counts, and returns a row for each entry; Spark adds them up, and
    positions x entries rows reach the driver.
    """
    positions, entries, width = books.shape
    names = [f"s{j}" for j in range(width)]

    def run(batches):
        n, sums = np.zeros((positions, entries), np.int64), np.zeros((positions, entries, width), np.int64)
        for table in _chunks(batches, positions * width):
            for p, parts, counts, _, entry, _ in _assigned(table, books):
                np.add.at(n[p], entry, counts)
                np.add.at(sums[p], entry, parts * counts[:, None])
        p, e = np.nonzero(n)
        columns = [p, e, n[p, e], *(sums[p, e, j] for j in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["p", "e", "n", *names])

    told = vectors.select("embedding").mapInArrow(run, "p long, e long, n long, " + ", ".join(f"{c} long" for c in names))
    new = books.copy()
    for r in told.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():  # positions x entries rows
        new[r.p, r.e] = [r[c] // r.n for c in names]
    return new


def trained(vectors: DataFrame, positions: int, entries: int, rounds: int) -> np.ndarray | None:
    """The codebooks (position, entry, component) of finite vectors; None where there are none."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()  # `entries` rows
    if not first:
        return None
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    start = integers(pa.array([r.embedding for r in first], pa.list_(pa.float32() if kind == "float" else pa.float64())))
    if start.shape[1] % positions:
        raise ValueError(f"{start.shape[1]} components do not fall into {positions} equal parts")
    books = start.reshape(len(start), positions, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = retrained(vectors, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by position, entry and component, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, positions: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Code each vector by the nearest codebook entry of each of its parts.

    vectors: vec_id, embedding, label; other columns are ignored. Returns vec_id, code (two hex digits a part), error (squared distances
    summed over parts), label_error (error summed over the rows of that label) and codebooks_sha256, a row for each row kept.

    Components become floor(256 x). Each task cuts some thousand vectors into parts and walks one trie of the distinct parts for each
    position, so that equal prefixes share their distances and equal parts are assigned once. Training shuffles one row for
    each entry and task; no vector is shuffled. At most 256 entries.

    Vectors that are null, empty or hold null or non-finite components go. The others must have one length, a multiple of
    `positions`, and components of at most 262,144 in size: else an error. Fewer rows than entries: as many entries as rows. Null
    labels are one label. Null vec_ids come last; repeated ids and rows are rows like others, the smaller vector first. Empty table: empty result.
    """
    kept = vectors.select("vec_id", "embedding", "label").filter(finite(F.col("embedding")))
    books = trained(kept, positions, entries, rounds)
    kind = dict(vectors.dtypes)
    dims = 0 if books is None else positions * books.shape[2]

    def run(batches):
        for table in _chunks(batches, dims):
            code, error = np.empty((len(table), positions), np.uint8), np.zeros(len(table), np.int64)
            for p, _, _, number, entry, distance in _assigned(table, books):
                code[:, p] = entry[number]
                error += distance[number]
            text = np.ascontiguousarray(_HEX[code]).reshape(-1)
            offsets = np.arange(0, len(text) + 1, 2 * positions, dtype=np.int32)
            codes = pa.Array.from_buffers(pa.string(), len(table), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
            out = pa.table([table["vec_id"], table["label"], codes, pa.array(error)], ["vec_id", "label", "code", "error"])
            yield from out.combine_chunks().to_batches()

    coded = materialise(kept.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "vector-codes")
    known = {"label_null": F.col("label").isNull(), "label": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    rows = coded.withColumns(known)
    sums = rows.groupBy("label", "label_null").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error"))
    joined = spread_join(rows, materialise(sums, "vector-codes-labels"), ["label", "label_null"], "n", coded.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit("" if books is None else digest(books)).alias("codebooks_sha256"))


def _round(i: int) -> str:
    """CTEs that assign every part to the entries e{i} and make e{i + 1}."""
    return f"""
a{i} AS MATERIALIZED (SELECT k, p, c, dist FROM (SELECT k, p, c, dist, row_number() OVER (PARTITION BY k, p ORDER BY dist, c) AS r FROM (
  SELECT k, x.p, c, sum((x.v - e.v) * (x.v - e.v))::bigint AS dist FROM x JOIN e{i} e ON x.p = e.p AND x.j = e.j GROUP BY k, x.p, c)) WHERE r = 1),
e{i + 1} AS MATERIALIZED (SELECT e.p, e.c, e.j, coalesce(m.v, e.v) AS v FROM e{i} e LEFT JOIN (
  SELECT x.p, c, j, CASE WHEN sum(x.v) % count(*) < 0 THEN sum(x.v) // count(*) - 1 ELSE sum(x.v) // count(*) END::bigint AS v FROM x JOIN a{i} USING (k, p) GROUP BY x.p, c, j) m ON e.p = m.p AND e.c = m.c AND e.j = m.j),"""


SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS k FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT k, (i - 1) // width AS p, (i - 1) % width AS j, floor(256 * embedding[i])::bigint AS v FROM (SELECT k, embedding, len(embedding) // 16 AS width, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
e0 AS MATERIALIZED (SELECT p, k AS c, j, v FROM x WHERE k < 64),{_round(0)}{_round(1)}{_round(2).rstrip(",")},
coded AS (SELECT k, string_agg(printf('%02x', c::int), '' ORDER BY p) AS code, sum(dist)::bigint AS error FROM a2 GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
  (SELECT sha256(string_agg(v::varchar, ',' ORDER BY p, c, j)) FROM e2) AS codebooks_sha256
FROM kept JOIN coded USING (k)
"""
