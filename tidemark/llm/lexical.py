"""Ranked lexical search: shards of documents with block-coded postings, searched by block-max MaxScore."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.prefix import with_running_sum
from tidemark.llm.common import materialise, tidy
from tidemark.llm.tokens import LOWER, TERM_BYTES, Texts, by_bytes

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a block; a place in one takes a byte.
BLOCK = 256
#: Bytes of text that a task takes at once, and of a shard.
PIECE, SHARD = 2 << 20, 8 << 20
#: Query terms that are sent to every task at once; more are searched in rounds.
TERMS = 200_000
#: A count from here on is kept beside its byte.
WIDE = 255

#: A row for each shard and term. blocks: of each block its number, how many documents it has, and how many pairs of `tops` (count and length); wide: places
#: in the list, and counts from WIDE on. ids, lengths: on the row of a shard's documents alone, which has no term.
INDEX = "shard long, term string, n long, terms long, blocks array<int>, tops array<int>, places binary, counts binary, wide array<int>, ids array<long>, lengths array<int>"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text: runs of ASCII letters and digits and of all other characters, A-Z in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0)))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, pa.int32()))


def _bytes(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(values.astype(np.uint8))]).cast(pa.binary())


def frontier(group: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of those (tf, n) of each group that no other of it has at least the tf and at most the n of; groups ascend.

    A posting's score grows with tf and falls with n, so a group's largest score is that of one of them, whatever the corpus' mean length.
    """
    order = np.lexsort((n, -tf, group))
    lowered = n[order].astype(np.int64) - group[order] * (int(n.max(initial=0)) + 1)  # each group lies below the one before: the running minimum starts anew
    before = np.r_[np.iinfo(np.int64).max, np.minimum.accumulate(lowered)[:-1]][: len(order)]
    return order[lowered < before]


@dataclass
class Shard:
    """Postings of the documents taken so far."""

    ids: list[pa.Array] = field(default_factory=list)
    lengths: list[np.ndarray] = field(default_factory=list)
    terms: list[pa.Array] = field(default_factory=list)
    documents: list[np.ndarray] = field(default_factory=list)
    tfs: list[np.ndarray] = field(default_factory=list)
    bytes: int = 0
    n: int = 0

    def add(self, ids: pa.Array, column: pa.Array) -> None:
        texts = Texts.of(column)
        found, of = texts.runs(TERM_BYTES, LOWER)
        coded = found.dictionary_encode()
        many = len(ids)
        pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * many + of, return_counts=True)
        self.terms.append(pa.DictionaryArray.from_arrays(pa.array(pairs // many, pa.int32()), coded.dictionary))
        self.documents.append((pairs % many + self.n).astype(np.int32))
        self.tfs.append(tf.astype(np.int32))
        self.ids.append(ids)
        self.lengths.append(np.bincount(of, minlength=many).astype(np.int32))
        self.bytes += len(texts.raw)
        self.n += many

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's rows of INDEX: one on its documents, without a term, and one for each term."""
        schema = _arrow()
        lengths = np.concatenate(self.lengths)
        ids = pa.chunked_array(self.ids).combine_chunks().cast(pa.int64())
        first = {"shard": pa.array([shard], pa.int64()), "n": pa.array([int((lengths > 0).sum())], pa.int64()), "terms": pa.array([int(lengths.sum(dtype=np.int64))], pa.int64())}
        first |= {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "lengths": _lists(lengths, np.array([len(lengths)]))}
        yield pa.RecordBatch.from_arrays([first.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)
        joined = pa.chunked_array(self.terms).unify_dictionaries()
        names = joined.chunk(0).dictionary
        term, document = np.concatenate([c.indices.to_numpy() for c in joined.chunks]), np.concatenate(self.documents)
        order = np.argsort(term.astype(np.int64) * len(lengths) + document, kind="stable")
        term, document, tf = term[order], document[order], np.concatenate(self.tfs)[order]
        self.terms, self.documents, self.tfs = [], [], []
        new = np.flatnonzero(np.r_[np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (document[1:] // BLOCK != document[:-1] // BLOCK)])
        sizes = np.diff(np.r_[new, len(term)])
        top = frontier(np.repeat(np.arange(len(new)), sizes), tf, lengths[document])
        tops = np.bincount(np.searchsorted(new, top, "right") - 1, minlength=len(new))
        per_term, per_block, wide = np.bincount(term, minlength=len(names)), np.bincount(term[new], minlength=len(names)), np.flatnonzero(tf >= WIDE)
        columns = {
            "shard": pa.array(np.full(len(names), shard), pa.int64()), "term": names.cast(pa.string()), "n": pa.array(per_term, pa.int64()),
            "blocks": _lists(np.stack((document[new] // BLOCK, sizes, tops), axis=1).ravel(), 3 * per_block),
            "tops": _lists(np.stack((tf[top], lengths[document[top]]), axis=1).ravel(), 2 * np.bincount(term[top], minlength=len(names))),
            "places": _bytes(document % BLOCK, per_term), "counts": _bytes(np.minimum(tf, WIDE), per_term),
            "wide": _lists(np.stack((wide - np.r_[0, np.cumsum(per_term)][term[wide]], tf[wide]), axis=1).ravel(), 2 * np.bincount(term[wide], minlength=len(names))),
        }
        if len(names):
            whole = pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(names), f.type)) for f in schema], schema=schema)
            for at in range(0, len(whole), 10_000):
                yield whole.slice(at, 10_000)


def _arrow() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in INDEX.split(", "))])


def build_index(docs: DataFrame, path: str) -> None:
    """Write the index of every row of docs (doc_id, text) to `path`.

    A task cuts its documents into shards of some megabytes of text, in the order in which it reads them, and writes each shard's postings: for each term the
    documents' places and counts in blocks of BLOCK documents, and for each block the undominated pairs of count and length, from which its
    largest score follows once the corpus' totals are known. Nothing is shuffled, and results do not depend on how documents fall into shards.
    """

    def run(batches):
        shard, number, part = Shard(), 0, TaskContext.get().partitionId()
        for b in by_bytes(batches, "text", PIECE):
            shard.add(b.column("doc_id"), b.column("text"))
            if shard.bytes >= SHARD or shard.n >= SHARD // 64:
                yield from shard.rows((part << 32) + number)
                shard, number = Shard(), number + 1
        if shard.n:
            yield from shard.rows((part << 32) + number)

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), INDEX).write.parquet(path)


@dataclass
class Postings:
    """One term's list in a shard; a block's scores are worked out when it is first asked for."""

    blocks: np.ndarray
    best: np.ndarray  # of each block, before the term's weight
    ends: np.ndarray
    places: np.ndarray
    counts: np.ndarray
    wide: dict[int, int]
    length: np.ndarray  # what each document's length adds to the denominator
    known: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, row: dict, norm: np.ndarray, norm_of: dict[int, int]) -> Postings:
        blocks, sizes, tops = np.array(row["blocks"], np.int64).reshape(-1, 3).T
        each = scores(np.array(row["tops"][::2], np.int64), np.array([norm_of[n] for n in row["tops"][1::2]], np.int64))
        best = np.maximum.reduceat(each, np.r_[0, np.cumsum(tops)[:-1]])
        places, counts = (np.frombuffer(row[c], np.uint8) for c in ("places", "counts"))
        return cls(blocks, best, np.cumsum(sizes), places, counts, dict(zip(row["wide"][::2], row["wide"][1::2], strict=True)), norm)

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the i-th block's documents, and their scores before the term's weight."""
        if i not in self.known:
            low, high = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
            places, tf = self.places[low:high], self.counts[low:high].astype(np.int64)
            for at in np.flatnonzero(tf == WIDE).tolist():
                tf[at] = self.wide[low + at]
            self.known[i] = places, scores(tf, self.length[int(self.blocks[i]) * BLOCK + places.astype(np.int64)])
        return self.known[i]


def scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def best_of(lists: list[tuple[int, Postings]], ids: np.ndarray, k: int, floor: int = 1) -> list[tuple[int, int]]:
    """(place, score) of the k documents of a shard with the highest scores of at least `floor`, ties to the smaller id, then place.

    lists: (weight, postings) of the query's terms. The lists with the smallest bounds whose sum is below the k-th best score so far are not
    essential: no document that stands in them alone can enter. Blocks come in the order of their bounds' sum, until that is too low. In a block, documents of the essential lists are
    summed; the others' block maxima reject those that cannot enter, and such a block is only decoded while some document is left.
    """
    found: list[tuple[int, int, int]] = []  # (-score, id, place)
    lists = [(w, p) for w, p in lists if w > 0]
    if not lists:
        return []
    lists.sort(key=lambda x: x[0] * int(x[1].best.max()))
    width = max(int(p.blocks[-1]) for _, p in lists) + 1
    bounds, index = np.zeros((len(lists), width), np.int64), np.zeros((len(lists), width), np.int64)
    for i, (w, p) in enumerate(lists):
        bounds[i, p.blocks] = w * p.best
        index[i, p.blocks] = np.arange(len(p.blocks))
    below = np.cumsum(bounds.max(axis=1)).tolist()  # of all lists up to each
    under = np.cumsum(bounds, axis=0)
    least, free = floor, 0  # lists before `free` are not essential
    for b in np.argsort(-under[-1], kind="stable").tolist():
        if under[-1, b] < least:
            break
        while free < len(lists) and below[free] < least:
            free += 1
        summed = np.zeros(BLOCK, np.int64)
        for i in np.flatnonzero(bounds[free:, b]).tolist():
            w, p = lists[free + i]
            places, score = p.block(int(index[free + i, b]))
            summed[places] += w * score
        left = summed > 0
        for i in range(free - 1, -1, -1):
            left &= summed + under[i, b] >= least
            if not left.any():
                break
            if bounds[i, b]:
                w, p = lists[i]
                places, score = p.block(int(index[i, b]))
                summed[places] += w * score
        left &= summed >= least
        at = np.flatnonzero(left)
        if len(at):
            whole = b * BLOCK + at
            found.extend(zip((-summed[at]).tolist(), ids[whole].tolist(), whole.tolist(), strict=True))
            found.sort()
            del found[k:]
            if len(found) == k:
                least = max(least, -found[-1][0])
    return [(place, -score) for score, _, place in found]


def searched(group: pa.Table, queries: list[tuple[int, dict[str, int]]], n: int, total: int, k: int) -> pa.Table:
    """(item, doc_id, score) of each query's best documents in one shard; queries: number, and weights by term."""
    rows = group.to_pylist()
    about = next(r for r in rows if r["term"] is None)
    lengths = about["lengths"]
    norm_of = {x: 10 + 90 * x * n // total for x in set(lengths)} if total else {}  # Python's integers: no overflow
    norm = np.array([norm_of[x] for x in lengths], np.int64) if total else np.zeros(len(lengths), np.int64)
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in about["ids"]], np.int64)
    held = {r["term"]: Postings.of(r, norm, norm_of) for r in rows if r["term"] is not None}
    item, place, score = [], [], []
    for number, weights in queries:
        lists = [(w, held[t]) for t, w in weights.items() if t in held]
        for at, s in best_of(lists, ids, k):
            item.append(number)
            place.append(at)
            score.append(s)
    doc = pa.array(about["ids"], pa.int64()).take(pa.array(place, pa.int64()))
    return pa.table([pa.array(item, pa.int64()), doc, pa.array(score, pa.int64())], ["item", "doc_id", "score"])


def _search(queries: list[tuple[int, dict[str, int]]], n: int, total: int, k: int):
    return lambda group: searched(group, queries, n, total, k)


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item's k best documents of the index at `path`: item_id, rank, doc_id, score. See rank."""
    index = spark.read.schema(INDEX).parquet(path)
    totals = index.filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    n, total = int(totals[0]), int(totals[1])
    asked = items.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(terms_of(F.col("text")))))).alias("terms"))
    numbered = with_running_sum(asked.withColumn("size", F.size("terms")), [F.col("item_id").isNull(), F.col("item_id")], "size", "before", materialise)
    numbered = materialise(numbered.select("item_id", "terms", F.expr(f"before div {TERMS}").alias("round"), F.monotonically_increasing_id().alias("item")), "lexical-items")
    rounds = [r["round"] for r in numbered.select("round").distinct().orderBy("round").collect()] if total else []
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1)))
    parts = []
    for r in rounds:
        own = numbered.filter(F.col("round") == r)
        names = F.broadcast(own.select(F.explode("terms").alias("term")).distinct())  # TERMS and one item's terms at most
        lists = index.join(names, "term", "left_semi")
        df = lists.groupBy("term").agg(F.sum("n").alias("df"))
        known = own.select("item", F.explode("terms").alias("term")).join(df, "term").select("item", "term", weight.alias("w")).collect()  # bounded likewise
        by: dict[int, dict[str, int]] = {}
        for x in known:
            by.setdefault(x["item"], {})[x["term"]] = x["w"]
        shards = index.filter("term IS NULL").unionByName(lists.select(*index.columns))
        parts.append(materialise(shards.groupBy("shard").applyInArrow(_search(list(by.items()), n, total, k), "item long, doc_id long, score long"), "lexical-found"))
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for p in parts:
        found = found.unionByName(p)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, path: str, k: int = 10) -> DataFrame:
    """Each item's k best documents: item_id, rank (from 1), doc_id, score, for scores above 0.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Every document is indexed at `path`, whole. A shard and what the queries ask of it
    go to one task, which returns its k best for each item; Spark merges these heaps with a limit before and after the shuffle. What is sent to all tasks
    are the terms of at most TERMS (or one item) at a time, with their weights; more items take more rounds.

    A text takes about 40 bytes of memory a byte while it is indexed. Null text, or one without terms: no document. Null doc_id: ranked like others, last among
    equal scores. Repeated ids and rows are documents of their own. Rows of one item_id, null included, are one item with the terms of all of them; one without terms,
    or whose terms no document holds, has no rows. Empty tables: empty result.
    """
    build_index(docs, path)
    return search(docs.sparkSession, path, items, k)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
totals AS (SELECT count(*) AS n, sum(len(terms))::bigint AS l FROM d WHERE len(terms) > 0),
m AS (SELECT k, doc_id, 10 + (90 * len(terms)::bigint * n) // l AS m FROM d, totals WHERE len(terms) > 0),
tf AS (SELECT k, term, count(*)::bigint AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY k, term),
w AS (SELECT term, floor(1000 * ln((2 * max(n) + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, totals GROUP BY term),
scored AS (SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (k) GROUP BY item_id, k, doc_id),
placed AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::int AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
