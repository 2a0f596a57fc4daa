"""SimHash near-duplicates: 64-bit fingerprints linked through pivot distance tables."""

from __future__ import annotations

import hashlib
import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, released, spread_join, tidy
from tidemark.llm.components import components

#: Fingerprints of one bucket that a task compares at once; larger buckets are compared chunk against chunk.
CHUNK = 4096
#: Oversized buckets that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Bits by which each reference of a walk differs from the one before; and references beside the walk.
STEP, BESIDE = 2, 31


def shingles(text: str | None, width: int) -> np.ndarray:
    """The XXH64 (seed 42) of a text's word shingles, repeats included; fewer words than `width`: one of them all."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends[:-1]]
    return np.array([xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, ends[min(width, len(found)) - 1 :], strict=False)], np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """The bits that more than half of a text's shingle hashes have; no words: 0."""
    hashed = shingles(text, width)
    n = len(hashed)
    bits = np.unpackbits(hashed.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a long), and the columns of `also`."""
    kinds = dict(docs.dtypes)

    def run(batches):
        for b in batches:
            prints = [fingerprint(t, width) for t in b.column("text").to_pylist()]
            kept = [b.column(c) for c in ("doc_id", *also)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", *also, "fingerprint"])

    shape = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *also))
    return docs.select("doc_id", *also, "text").mapInArrow(tidy(run), f"{shape}, fingerprint long")


def walk(seed: int = 17) -> np.ndarray:
    """Reference fingerprints of 64 bits, each the one before with STEP other bits turned, until all are turned."""
    rng = np.random.default_rng(seed)
    steps = (np.uint64(1) << rng.permutation(64).astype(np.uint64)).reshape(-1, STEP).sum(axis=1, dtype=np.uint64)
    turned = np.cumsum(np.concatenate((np.zeros(1, np.uint64), steps)), dtype=np.uint64)
    return (rng.integers(0, 2**64, 1, np.uint64) ^ turned).reshape(-1, 1)


def pivots(words: int = 1, seed: int = 17) -> np.ndarray:
    """Reference fingerprints of `words` times 64 bits: of one word the walk, and BESIDE random ones."""
    beside = np.random.default_rng(seed).integers(0, 2**64, (BESIDE, words), np.uint64)
    return np.concatenate((beside, walk(seed))) if words == 1 else beside


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each fingerprint, its Hamming distance to every reference."""
    return np.stack([np.bitwise_count(prints ^ r).sum(axis=1, dtype=np.int16) for r in references], axis=1)


def stretches(distance: int, expected: int) -> list[tuple[int, ...]]:
    """Which steps of the walk make up each key: fingerprints within `distance` bits agree on one key at least.

    The difference of two neighbouring columns of the pivot table tells how many of a step's bits agree with the
    reference, and one differing bit changes one such difference only. So of b stretches of the walk, b - distance
    have equal differences throughout. b grows with the number of fingerprints, so that a key tells four times as many apart:
    bits of texts in one language lean one way, and buckets get much larger than those of even bits.
    """
    steps, b = 64 // STEP, distance + 1
    told = sum(-math.comb(STEP, k) / 2**STEP * math.log2(math.comb(STEP, k) / 2**STEP) for k in range(STEP + 1))
    while b < 2 * distance + 1 and 4 * expected > 2 ** (told * steps * (b - distance) / b):
        b += 1
    edges = [steps * i // b for i in range(b + 1)]
    return [tuple(i for p in chosen for i in range(edges[p], edges[p + 1])) for chosen in combinations(range(b), b - distance)]


def pivot_keys(prints: np.ndarray, chosen: list[tuple[int, ...]]) -> np.ndarray:
    """The keys of each fingerprint, a column for each of `chosen`: the differences along those steps as one number."""
    moves = (np.diff(distances(prints.reshape(-1, 1), walk()), axis=1).astype(np.int64) + STEP) // 2
    return np.stack([moves[:, list(c)] @ (STEP + 1) ** np.arange(len(c), dtype=np.int64) for c in chosen], axis=1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets without repeats; of two empty ones: 0."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def roots_of(group: pa.Table, distance: int, references: np.ndarray, least: float | None = None) -> pa.Table:
    """(u, v): each part that links inside its bucket, with the smallest part that its bucket connects it to.

    Rows of one part count as connected from the start. Rows are sorted by bucket and by distance to the first pivot; a row meets those after it until that distance
    differs by more than `distance`. Pairs that any other pivot tells apart go; the rest are verified bit by bit. With
    `least`, a pair also needs that Jaccard similarity of its rows' shingles, counted exactly.
    """
    wide, node = references.shape[1], group["part"].to_numpy()
    prints = group["fingerprint"].to_numpy().view(np.uint64).reshape(-1, 1) if wide == 1 else np.frombuffer(b"".join(group["fingerprint"].to_pylist()), np.uint64).reshape(-1, wide)
    columns = [group[c].to_numpy() for c in ("mask", "key", "left", "right")]
    table = distances(prints, references)
    order = np.lexsort([table[:, 0], *columns])
    prints, node, table, chunk = prints[order], node[order], table[order], group["chunk"].to_numpy()[order]
    if least is not None:
        raw = group["shingles"].combine_chunks()
        sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in order.tolist()]
        size = np.array([len(x) for x in sets], np.int64)
    same = np.any([np.diff(c[order]) != 0 for c in columns], axis=0) if len(order) else np.zeros(0, bool)
    bucket, across = np.cumsum(np.r_[0, same])[: len(order)], (columns[2] != columns[3])[order]
    root, pairs, waiting = np.arange(len(order)), [], 0
    alike = np.lexsort((node, bucket))  # rows of one part in a bucket start with one root
    again = np.flatnonzero((np.diff(bucket[alike]) == 0) & (np.diff(node[alike]) == 0)) + 1
    if len(again):
        starts = np.setdiff1d(np.arange(len(order)), again, assume_unique=True)
        root[alike] = np.repeat(np.minimum.reduceat(alike, starts), np.diff(np.r_[starts, len(order)]))

    def join() -> None:
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            low, old = np.minimum(root[a], root[b]), root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            np.minimum.at(root, old[a], low)
            np.minimum.at(root, old[b], low)
            root[:] = root[root]
            if (root == old).all():
                return

    active, step = np.arange(max(0, len(order) - 1)), 0
    if len(again):  # a bucket of one part has nothing to link
        begins = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
        several = np.maximum.reduceat(root, begins) != np.minimum.reduceat(root, begins)
        active = active[several[bucket[active]]]
    while len(active):
        step += 1
        active = active[active + step < len(order)]
        near = active + step
        active = active[(bucket[active] == bucket[near]) & (table[near, 0] - table[active, 0] <= distance)]
        i, j = active, active + step
        fresh = (root[i] != root[j]) & ~(across[i] & (chunk[i] == chunk[j]))
        i, j = i[fresh], j[fresh]
        for p in range(1, table.shape[1]):
            if not len(i):
                break
            close = np.abs(table[i, p] - table[j, p]) <= distance
            i, j = i[close], j[close]
        linked = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int16) <= distance
        if least is not None:
            linked &= np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-6
            for at in np.flatnonzero(linked):
                linked[at] = jaccard(sets[i[at]], sets[j[at]]) >= least
        if linked.any():
            pairs.append((i[linked], j[linked]))
            waiting += int(linked.sum())
            if waiting > len(order):
                join()
                pairs, waiting = [], 0
    if pairs:
        join()
    low = node.copy()
    np.minimum.at(low, root, node)
    low = low[root]
    on = low != node
    u, v = np.unique(np.stack((node[on], low[on])), axis=1)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(u, v) edges between nodes whose fingerprints link; prints: node, fingerprint, one row per fingerprint.

    The edges connect what the links connect; a bucket returns at most one edge for each of its rows.
    """
    chosen = stretches(distance, n := prints.count())

    def run(batches):
        for b in batches:
            keys = pivot_keys(b.column("fingerprint").to_numpy().view(np.uint64), chosen) if len(b) else np.zeros((0, len(chosen)), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(chosen)), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("fingerprint"), lists], ["part", "fingerprint", "keys"])

    keyed = prints.select("node", "fingerprint").mapInArrow(tidy(run), "part long, fingerprint long, keys array<long>")
    return _bucket_links(keyed.select("part", "fingerprint", F.posexplode("keys").alias("mask", "key")), n * len(chosen), distance, pivots())


def _bucket_links(keyed: DataFrame, n: int, distance: int, references: np.ndarray, least: float | None = None, size: int | None = None) -> DataFrame:
    """The edges of all buckets (mask, key) of keyed: part, fingerprint, mask, key; about n rows.

    Rows of one part are connected already and need not meet. A bucket of more than CHUNK (or `size`) rows is cut into
    chunks, equal parts together, which meet pairwise; its largest part, where that is more than a chunk, has chunks of its
    own, which meet the others but not each other. With `least`, keyed has `shingles` too (see roots_of).
    """
    size, bucket = size or CHUNK, ["mask", "key"]
    large = materialise(keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size), "simhash-large")
    few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    told = F.broadcast(large) if few else large
    tops = keyed.join(told.select(*bucket), bucket, "left_semi").groupBy(*bucket, "part").agg(F.count(F.lit(1)).alias("own")).groupBy(*bucket).agg(F.max(F.struct("own", "part")).alias("top"))
    tops = tops.select(*bucket, F.when(F.col("top.own") > size, F.col("top.part")).alias("top"), F.when(F.col("top.own") > size, F.col("top.own")).otherwise(F.lit(0)).alias("own"))
    cut = large.join(tops, bucket).select(*bucket, "top", F.ceil(F.col("own") / size).cast("int").alias("tops"), F.ceil((F.col("n") - F.col("own")) / size).cast("int").alias("chunks"))
    cut = materialise(cut, "simhash-chunks")
    rows = keyed.join(F.broadcast(cut) if few else cut, bucket, "left").withColumns({"tops": F.coalesce("tops", F.lit(0)), "chunks": F.coalesce("chunks", F.lit(1))})
    rows = rows.filter("chunks > 0")  # of one part alone: nothing to link
    is_top = F.coalesce(F.col("part") == F.col("top"), F.lit(False))
    chunk = F.when(is_top, F.col("chunks") + F.pmod(F.xxhash64("fingerprint"), F.greatest("tops", F.lit(1)))).otherwise(F.pmod(F.xxhash64("part"), F.col("chunks"))).cast("int")
    other = F.when(is_top, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.sequence(F.lit(0), F.col("chunks") + F.col("tops") - 1))
    pair = F.transform(other, lambda o: F.struct(F.least(F.col("chunk"), o).alias("left"), F.greatest(F.col("chunk"), o).alias("right")))
    rows = rows.withColumn("chunk", chunk).withColumn("pair", F.explode(pair)).select("*", "pair.left", "pair.right").drop("pair")
    groups = n // (2 * size) + 1
    small = (F.col("chunks") == 1) & (F.col("tops") == 0)
    rows = rows.withColumn("group", F.when(small, F.pmod(F.xxhash64("mask", "key"), F.lit(groups))).otherwise(F.xxhash64("mask", "key", "left", "right"))).drop("chunks", "tops", "top")

    def run(group: pa.Table) -> pa.Table:
        return released(roots_of(group, distance, references, least))

    return rows.groupBy("group").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """Group documents whose SimHash fingerprints are linked at `distance` or fewer differing bits.

    docs: doc_id long, text; other columns are ignored. Returns doc_id, fingerprint (16 hex digits), component_id, one
    row per input row. Equal fingerprints become one node, so copies are never compared. Candidates come from the table of
    distances to a walk of references: distinct fingerprints meet in the buckets of `stretches`, which lose no link. Inside a
    bucket the distances to all references discard pairs by their largest difference, and the
    survivors are verified. A bucket of more than CHUNK fingerprints is split, chunks meeting pairwise.

    Null or empty text, or one without words: fingerprint zero, linked like any other. Fewer than `width` words: one
    shingle of them all. Null doc_id: its fingerprint, linked with nothing, component_id null. Repeated rows: each
    returned. Empty table: empty result.
    """
    prints = materialise(fingerprints(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), width), "simhash-prints")
    nodes = materialise(prints.filter("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    joined = nodes.join(components(links(nodes, distance)).withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    joined = materialise(joined.select("fingerprint", F.coalesce("component", "node").alias("component_id"), "n"), "simhash-joined")
    out = spread_join(prints, joined, ["fingerprint"], "n", prints.count(), "left")
    part = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), part.alias("component_id"))


#: 64-bit words of a wide fingerprint; the share of near-duplicates of least similarity that the tables may miss.
WIDE, MISSED = 8, 0.005
#: Standard deviations above the mean of differing bits within which a pair is proposed.
LOOSE = 4
#: Tables whose buckets' first rows are compared with the others before all else.
FIRST = 4
#: Shingle sets of one group of proposals that a task compares at once, and their bytes; larger groups are split.
SETS, SET_BYTES = 512, 16 << 20
#: Sets up to this size are small: ties in their majorities make more bits differ than `differing` says.
SMALL = 40


def differing(similarity: float) -> float:
    """The share of bits in which fingerprints of two large sets of this Jaccard similarity differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@cache
def most_differing(similarity: float) -> float:
    """The largest share of bits in which fingerprints of two sets of at least this similarity differ, on average, small sets included."""
    half = [np.array([math.comb(n, k) / 2**n for k in range(n + 1)]) for n in range(SMALL + 1)]
    worst = differing(similarity)
    for a in range(1, SMALL + 1):
        for b in range(1, a + 1):
            both = max(0, math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9))
            if both <= b:
                k = np.arange(both + 1)
                one, two = (np.array([half[n - both][np.arange(n - both + 1) + x > n / 2].sum() for x in k]) for n in (a, b))
                worst = max(worst, float((half[both] * (one + two - 2 * one * two)).sum()))
    return worst


def distinct_shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(shingles(text, width))


def wide_fingerprint(hashed: np.ndarray) -> bytes:
    """WIDE * 64 majority bits of a set of shingle hashes: those of WIDE remixes of them."""
    out = []
    for k in range(WIDE):
        mixed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), 8), axis=1)
        out.append(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(mixed)).tobytes())
    return b"".join(out)


def _sets(docs: DataFrame, width: int, prints: bool) -> DataFrame:
    """doc_id, digest of the set of shingles, and its wide fingerprint or the set itself, as `shingles`."""
    name = "fingerprint" if prints else "shingles"

    def run(batches):
        for b in batches:
            every = [distinct_shingles(t, width) for t in b.column("text").to_pylist()]
            digests = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in every], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), digests, pa.array([wide_fingerprint(x) if prints else x.tobytes() for x in every], pa.binary())], ["doc_id", "digest", name])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id long, digest binary, {name} binary")


def _near_first(keyed: DataFrame, n: int, limit: int) -> DataFrame:
    """(node, leader): of the buckets of the first FIRST tables, the nearest first row within `limit` bits; at most one for each node."""
    near = keyed.filter(F.col("mask") < FIRST)
    firsts = near.groupBy("mask", "key").agg(F.min(F.struct("node", "fingerprint")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = spread_join(near, firsts, ["mask", "key"], "n", FIRST * n).filter("node <> first.node").select("node", "fingerprint", F.col("first.node").alias("leader"), F.col("first.fingerprint").alias("other"))

    def run(batches):
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint64).reshape(-1, WIDE) for x in ("fingerprint", "other"))
            bits = np.bitwise_count(a ^ c).sum(axis=1, dtype=np.int32)
            near = pa.array(bits <= limit)
            yield pa.RecordBatch.from_arrays([b.column("node").filter(near), b.column("leader").filter(near), pa.array(bits).filter(near)], ["node", "leader", "bits"])

    near = met.mapInArrow(tidy(run), "node long, leader long, bits int")
    return near.groupBy("node").agg(F.min(F.struct("bits", "leader"))["leader"].alias("leader"))


def _verified(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v): the edges (node, leader; one for each node) whose sets have a Jaccard similarity of `least` or more.

    sets: node, shingles. A leader's set goes to as many groups as its members' bytes ask for.
    """
    members = materialise(edges.join(sets, "node").withColumn("bytes", F.octet_length("shingles").cast("long")), "simhash-members")
    degrees = materialise(members.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("bytes") / SET_BYTES + 0.5).cast("int").alias("subs")), "simhash-degrees")
    n, size = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    rows = spread_join(members, degrees, ["leader"], "n", n).select("leader", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int").alias("sub"), "node", "shingles")
    leaders = degrees.join(sets.withColumnRenamed("node", "leader"), "leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(None).cast("long").alias("node"), "shingles")
    every = rows.unionByName(leaders).withColumn("group", F.pmod(F.xxhash64("leader", "sub"), F.lit(size // SET_BYTES + 1)))

    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        ids = list(zip(group["leader"].to_pylist(), group["sub"].to_pylist(), strict=True))
        nodes = group["node"].to_pylist()
        first = {i: s for i, n, s in zip(ids, nodes, sets, strict=True) if n is None}
        on = [(n, i[0]) for i, n, s in zip(ids, nodes, sets, strict=True) if n is not None and jaccard(s, first[i]) >= least]
        return released(pa.table({"u": pa.array([u for u, _ in on], pa.int64()), "v": pa.array([v for _, v in on], pa.int64())}))

    return every.groupBy("group").applyInArrow(run, "u long, v long")


def similar_documents(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, component_id: groups of documents whose sets of shingles have a Jaccard similarity of `least` or more.

    Fingerprints of WIDE * 64 bits only propose: two meet if they agree on all bits of one of several random bit sets,
    as many as it takes to miss at most MISSED of pairs at `least`, and closer pairs hardly ever; those within LOOSE
    standard deviations of the bits that such pairs differ in go on. A bit set's size follows the number of fingerprints, so
    that buckets stay small. Links are of exact similarity `least` or more, counted from the shingles themselves.

    First the buckets of a few tables compare their rows with one of them, the first, which joins large groups of near
    copies into parts at a cost linear in their rows. Then all buckets propose links between different parts, by pivot
    tables of wide reference fingerprints; and the parts that proposals connect are compared by their shingles, row against row of
    other parts. Equal sets are one node. The cases are those of near_duplicates.
    """
    share = most_differing(least)
    limit = int(WIDE * 64 * share + LOOSE * math.sqrt(WIDE * 64 * share * (1 - share)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = materialise(_sets(rows, width, True), "simhash-wide")
    nodes = found.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("fingerprint").alias("fingerprint"), F.count(F.lit(1)).alias("n"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    n = nodes.count()
    bits = max(13, (n - 1).bit_length() - 6 if n else 0)
    tables = math.ceil(math.log(MISSED) / math.log(1 - (1 - share) ** bits))
    rng = np.random.default_rng(29)
    chosen = np.stack([rng.permutation(WIDE * 64)[:bits] for _ in range(tables)])

    def keyed(nodes: DataFrame, only: int) -> DataFrame:
        def run(batches):
            for b in batches:
                own = b.column("fingerprint").to_pylist()
                bit = np.unpackbits(np.frombuffer(b"".join(own), np.uint8).reshape(len(own), WIDE * 8), axis=1)
                key = np.stack([bit[:, c].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)) for c in chosen[:only]], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, only), pa.int32()), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("fingerprint"), lists], ["node", "fingerprint", "keys"])

        return nodes.select("node", "fingerprint").mapInArrow(tidy(run), "node long, fingerprint binary, keys array<long>").select("node", "fingerprint", F.posexplode("keys").alias("mask", "key"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        own = nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "digest")
        made = _sets(rows.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), width, False)
        return materialise(made.join(own, ["doc_id", "digest"]).dropDuplicates(["node"]).select("node", "shingles"), "simhash-sets")

    # Few documents first: those near the first row of a bucket.
    edges = materialise(_near_first(keyed(nodes, min(FIRST, tables)), n, limit), "simhash-first")
    sure = _verified(edges, sets_of(edges.select("node").union(edges.select("leader")).distinct()), least)
    parts = components(sure).withColumnRenamed("component", "part")
    known = materialise(nodes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "simhash-parts")
    # Then everything, between parts.
    of = known.select("part", "fingerprint").withColumnRenamed("part", "node")
    proposed = components(_bucket_links(keyed(of, tables).withColumnRenamed("node", "part"), n * tables, limit, pivots(WIDE))).select(F.col("node").alias("part"), F.col("component").alias("key"))
    sizes = materialise(known.groupBy("part").agg(F.count(F.lit(1)).alias("own"), F.min("doc_id").alias("doc_id")), "simhash-sizes")
    asked = materialise(spread_join(known.select("node", "part", "fingerprint"), sizes.join(proposed, "part").select("part", "key", "own"), ["part"], "own", n), "simhash-proposed")
    judged = materialise(asked.join(sets_of(asked.select("node")), "node").select("part", "fingerprint", F.lit(0).alias("mask"), "key", "shingles"), "simhash-judged")
    count, size = judged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("shingles").cast("long")), F.lit(0))).first()
    at_once = max(16, min(SETS, SET_BYTES * count // max(1, size)))
    links_ = components(_bucket_links(judged, count, limit, pivots(WIDE), least, at_once)).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    ends = materialise(sizes.join(links_, "part", "left").withColumn("whole", F.coalesce("whole", "part")), "simhash-ends")
    firsts = materialise(ends.groupBy("whole").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-wholes")
    ends = materialise(spread_join(ends.select("part", "whole", "own"), firsts, ["whole"], "n", n), "simhash-ends")
    joined = materialise(spread_join(known.select("part", "digest", "n"), ends.select("part", "component_id", "own"), ["part"], "own", n).select("digest", "component_id", "n"), "simhash-joined")
    out = spread_join(found.select("doc_id", "digest"), joined, ["digest"], "n", found.count(), "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that are the first (by doc_id) of their group of similar documents, with docs' own columns.

    Rows without a doc_id stay, and so do repeated rows of a first one.
    """
    others = similar_documents(docs, width, least).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
