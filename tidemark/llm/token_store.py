"""A content-addressed store of token ids: rolling-hash chunks, unique chunks once, recipes and Merkle manifests."""

from __future__ import annotations

import hashlib
import os
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers
from tokenizers.pre_tokenizers import Split

from tidemark.functions.prefix import with_running_sum
from tidemark.llm.common import materialise, spread_join, tidy
from tidemark.llm.pieces import load, pieces_of, spelled
from tidemark.llm.tokens import by_bytes

#: Tokens of a chunk: at least, on average about, and at most.
LEAST, USUAL, MOST = 64, 256, 2048
#: Bytes of a chunk's name: the start of the SHA-256 of its ids.
NAME = 16
#: Bytes of whole texts that are encoded at once.
AT_ONCE = 4 << 20
#: Pieces whose ids a worker remembers, and that the library gets in a call.
CACHE, CALL = 1 << 20, 4096
#: What may part the pieces that the library gets in a call, private code points: the first that none of them holds.
MARKS = [chr(0xE000 + i) for i in range(0, 6400, 100)]
#: Tokens of a part of the documents, which has one root; and roots below one of the next level.
PART, FAN = 1 << 22, 4096


def _gear(size: int) -> np.ndarray:
    return np.random.default_rng(23).integers(0, 2**64, size, np.uint64)


def places(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """After which ids the rolling hash of the last 16 says that a chunk may end.

    Several documents may follow each other: only a document's first 15 places see the one before, and LEAST allows no end there.
    """
    rolled = gear[ids]
    for step in (1, 2, 4, 8):
        rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint64(step))
    return np.flatnonzero(rolled >> np.uint64(24) & np.uint64(USUAL - 1) == 0) + 1


def boundaries(found: list[int], first: int, last: int) -> list[int]:
    """Where the chunks of the document between first and last end: at the places found in it, within LEAST and MOST."""
    cuts, start = [], first
    for at in [*found, last]:
        while at - start > MOST:
            start += MOST
            cuts.append(start)
        if at - start >= LEAST or (at == last and at > start):
            cuts.append(at)
            start = at
    return cuts


class Encoder:
    """The library's ids of whole texts. Pieces, which it encodes apart from each other, are told to it once: it remembers about CACHE of them."""

    def __init__(self, path: str):
        self.tokenizer, vocab = tokenizer_of(path), load(path)
        self.own = [n for n in [self.tokenizer.normalizer] if n]
        self.part_by(MARKS[0])
        self.special, self.sizes = vocab.special, np.fromiter(map(len, vocab.as_bytes), np.int64, vocab.size)
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.lengths, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def part_by(self, mark: str) -> None:
        """Let the library cut at a mark, which it drops, and nowhere else; an empty one: nowhere. It spells the bytes of a whole call at once, before it cuts."""
        self.mark, spell = mark.encode(), normalizers.ByteLevel()
        self.tokenizer.normalizer = normalizers.Sequence([*self.own, spell])
        self.tokenizer.pre_tokenizer = Split(spell.normalize_str(mark), "removed") if mark else None

    def told(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, as one call of the library gives them, and each piece's number of them, told by the bytes that ids stand for.

        The library gets them as one string, parted by a mark that no piece holds; as a list, which takes longer, only where they hold every mark.
        """
        every = b" ".join(pieces)
        if self.mark in every:
            self.part_by(next((m for m in MARKS if m.encode() not in every), ""))
        given = self.mark.join(pieces).decode() if self.mark else [p.decode() for p in pieces]
        ids = np.array(self.tokenizer.encode_batch_fast([given], is_pretokenized=not self.mark, add_special_tokens=False)[0].ids, np.uint32)
        spelt, ends = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(spelt, ends)
        if last[-1] + 1 != len(ids) or not np.array_equal(spelt[last], ends):
            raise ValueError("the ids do not spell the pieces")
        return ids, np.diff(last, prepend=-1)

    def learn(self, distinct: list[bytes]) -> np.ndarray:
        """The places of these pieces; those that are new are remembered first."""
        at = np.fromiter(map(self.places.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = sorted(np.flatnonzero(at < 0).tolist(), key=lambda i: distinct[i] >= b"\xff")  # special tokens last
        if not missing:
            return at
        new, first = [distinct[i] for i in missing], len(self.places)
        at[missing] = np.arange(first, first + len(new))
        self.places.update(zip(new, range(first, first + len(new)), strict=True))
        special = [self.special[p[1:].decode()] for p in new if p >= b"\xff"]
        plain = new[: len(new) - len(special)]
        parts = [self.told(plain[i : i + CALL]) for i in range(0, len(plain), CALL)]
        parts.append((np.array(special, np.uint32), np.ones(len(special), np.int64)))
        self.tokens = np.concatenate([self.tokens, *(ids for ids, _ in parts)])
        self.lengths = np.concatenate([self.lengths, *(n for _, n in parts)])
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text: those of its pieces one after another, and of the strings of special tokens."""
        distinct, numbers, ends = pieces_of(texts, self.special)
        if len(self.places) > CACHE:
            self.forget()
        codes = self.learn(distinct)[numbers]
        ids = spelled(codes, np.cumsum(self.lengths) - self.lengths, self.lengths, self.tokens)
        upto = np.r_[0, np.cumsum(self.lengths[codes])][ends].tolist()
        return [ids[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]


@lru_cache(1)
def _encoder(path: str, changed: int) -> Encoder:
    return Encoder(path)


def encoder_of(path: str) -> Encoder:
    """A worker's encoder, kept from task to task with what it remembers, until the file changes."""
    return _encoder(path, os.stat(path).st_mtime_ns)


def tokenizer_of(path: str) -> Tokenizer:
    """The tokenizer in a file, its truncation and padding off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _chunks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of two kinds: chunk (key: its name; ids), each once for a batch, and recipe (key: its place in the input; doc_id, n_tokens, recipe)."""
    size = tokenizer_of(path).get_vocab_size(with_added_tokens=True)
    kind, width = dict(docs.dtypes)["doc_id"], "<u2" if size <= 1 << 16 else "<u4"

    def run(batches):
        gear, encoder, part, seen = _gear(size), encoder_of(path), TaskContext.get().partitionId(), 0
        for b in by_bytes(batches, "text", AT_ONCE):
            held: dict[bytes, bytes] = {}
            own, last = encoder.encode([t or "" for t in b.column("text").to_pylist()]), np.array([end_id], np.uint32)
            sizes, recipes, first = [len(ids) + 1 for ids in own], [], 0
            ids = np.concatenate([last[:0], *(x for ids in own for x in (ids, last))])
            raw, found, each = ids.astype(width).tobytes(), places(ids, gear), np.dtype(width).itemsize
            upto, found = np.searchsorted(found, np.cumsum(sizes), "right").tolist(), found.tolist()
            for n, before, after in zip(sizes, [0, *upto], upto, strict=False):
                start, names = first, []
                for end in boundaries(found[before:after], first, first + n):
                    one = raw[start * each : end * each]
                    name = hashlib.sha256(one).digest()[:NAME]
                    held[name] = one
                    names.append(name + (start - first).to_bytes(4, "big"))
                    start = end
                recipes.append(b"".join(names))
                first += n
            n, m, doc_ids = len(held), len(sizes), b.column("doc_id")
            keys = [part.to_bytes(8, "big") + (seen + i).to_bytes(9, "big") for i in range(m)]  # longer than a name
            seen += m
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*held, *keys], pa.binary()),
                    pa.array(["chunk"] * n + ["recipe"] * m, pa.string()),
                    pa.array([*held.values(), *([None] * m)], pa.binary()),
                    pa.concat_arrays([pa.nulls(n, doc_ids.type), doc_ids]),
                    pa.array([None] * n + sizes, pa.int64()),
                    pa.array([None] * n + recipes, pa.binary()),
                ],
                ["key", "kind", "ids", "doc_id", "n_tokens", "recipe"],
            )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"key binary, kind string, ids binary, doc_id {kind}, n_tokens long, recipe binary")


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves; an odd one at a level's end rises as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _roots(recipes: DataFrame) -> DataFrame:
    """level, part, documents, root: the tree over all recipes in document order; the last level is one root.

    Part i of level 0 is the documents that start in PART tokens; of higher ones FAN parts of the level below. Only digests are grouped.
    """
    leaf = F.sha2(F.concat(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens", F.lit("")).cast("binary"), F.col("recipe")), 256)
    level = recipes.select(F.floor(F.col("start") / PART).alias("part"), F.col("start").alias("at"), F.lit(1).cast("long").alias("documents"), leaf.alias("root"))

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["at"].to_numpy(), kind="stable")
        digests = group["root"].to_pylist()
        root = merkle([bytes.fromhex(digests[i]) for i in order]).hex()
        return pa.table({"part": group["part"][:1], "documents": pa.array([int(group["documents"].to_numpy().sum())], pa.int64()), "root": pa.array([root])})

    levels, number = [], 0
    while True:
        made = level.groupBy("part").applyInArrow(run, "part long, documents long, root string")
        levels.append(materialise(made.withColumn("level", F.lit(number)), "store-roots"))
        if levels[-1].limit(2).count() < 2:
            break
        number += 1
        level = levels[-1].select(F.floor(F.col("part") / FAN).alias("part"), F.col("part").alias("at"), "documents", "root")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("level", "part", "documents", "root")


def write_store(docs: DataFrame, path: str, to: str, end_id: int = 0) -> None:
    """Encode docs (doc_id, text) with the tokenizer file at `path` and write the store to the folder `to`.

    to/data/kind=chunk: key (its name), ids (little-endian, 16 bits where the vocabulary allows), every distinct chunk once.
    to/recipes: doc_id, start, n_tokens, recipe (names and lengths of the chunks); by ascending doc_id.
    to/manifest: level, part, documents, root: a Merkle tree over all recipes. It is written last and marks the store as whole.
    One shuffle carries the chunks, already unique by task; a chunk that all documents share is one row of each.

    Null text: as empty, so its only id is the end id. Null doc_id: before all others. Repeated rows: each has its own recipe;
    their chunks are stored once. Empty table: an empty store.
    """
    rows = _chunks(docs, path, end_id)
    rows.dropDuplicates(["key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{to}/data")
    spark = docs.sparkSession
    recipes = spark.read.schema(rows.schema).parquet(f"{to}/data").filter("kind = 'recipe'").select("doc_id", "n_tokens", "recipe")
    ordered = with_running_sum(recipes, [F.col("doc_id"), F.col("recipe")], "n_tokens", "start", materialise)
    ordered.select("doc_id", "start", "n_tokens", "recipe").write.parquet(f"{to}/recipes")
    _roots(spark.read.parquet(f"{to}/recipes")).write.parquet(f"{to}/manifest")


def _read(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """Chunks (name, ids) whose bytes have been checked against their names, and recipes whose tree of roots holds."""
    chunks = spark.read.schema("key binary, ids binary, kind string").parquet(f"{store}/data").filter("kind = 'chunk'").select(F.col("key").alias("name"), "ids")
    sound = F.unhex(F.substring(F.sha2("ids", 256), 1, 2 * NAME)) == F.col("name")
    chunks = chunks.select("name", F.when(sound, F.col("ids")).otherwise(F.raise_error(F.lit("a chunk differs from its name"))).alias("ids"))
    recipes = spark.read.parquet(f"{store}/recipes")
    told = spark.read.parquet(f"{store}/manifest").withColumnsRenamed({"documents": "n", "root": "told"})
    found = _roots(recipes).join(told, ["level", "part"], "full")
    odd = found.filter(~(F.col("root").eqNullSafe(F.col("told")) & F.col("documents").eqNullSafe(F.col("n")))).limit(1).count()
    if odd:
        raise ValueError("the recipes differ from the manifest")
    return chunks, recipes


def _uses(recipes: DataFrame) -> DataFrame:
    """start, doc_id, n_tokens, name, at, size, behind: a row for each chunk that a document uses, with the ids after it."""
    step = NAME + 4
    n = (F.length("recipe") / step).cast("int")
    offset = lambda i: F.conv(F.hex(F.substring(F.col("recipe"), i * step + NAME + 1, F.lit(4))), 16, 10).cast("long")
    end = lambda i: F.when(i == n - 1, F.col("n_tokens")).otherwise(offset(i + 1))
    name = lambda i: F.substring(F.col("recipe"), i * step + 1, F.lit(NAME))
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("at"), name(i).alias("name"), (end(i) - offset(i)).alias("size"), (F.col("n_tokens") - end(i)).alias("behind")))
    return recipes.select("start", "doc_id", "n_tokens", F.inline(each))


def _counts(recipes: DataFrame) -> DataFrame:
    """name, uses: how often documents use each chunk."""
    step = NAME + 4
    at = F.sequence(F.lit(0), (F.length("recipe") / step).cast("int") - 1)
    names = recipes.select(F.explode(F.transform(at, lambda i: F.substring(F.col("recipe"), i * step + 1, F.lit(NAME)))).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("uses"))


def _spread(recipes: DataFrame, counted: DataFrame, told: DataFrame) -> DataFrame:
    """The uses of recipes joined with told, the chunks with their counts, by name; a chunk of very many uses meets them in no single task."""
    total = counted.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    return spread_join(_uses(recipes), told, ["name"], "uses", total)


def read_store(spark: SparkSession, store: str, width: int = 2) -> DataFrame:
    """doc_id, start, ids (binary, `width` bytes an id): every document's ids rebuilt from its chunks, after checks."""
    chunks, recipes = _read(spark, store)
    counts = materialise(_counts(recipes), "store-uses")
    rows = _spread(recipes, counts, counts.join(chunks, "name")).groupBy("start", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return rows.select("doc_id", "start", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def _crc_shift(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What a CRC-32 becomes when `count` bytes follow it, before those bytes' own CRC is added."""
    column = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint64)  # one zero bit, as a matrix over GF(2)

    def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
        out = np.zeros_like(vector)
        for i in range(32):
            out ^= np.where(vector >> np.uint64(i) & np.uint64(1), matrix[i], np.uint64(0))
        return out

    for _ in range(3):
        column = times(column, column)
    crc, count = crc.astype(np.uint64), count.copy()
    while count.any():
        odd = count & 1 == 1
        crc[odd] = times(column, crc[odd])
        column, count = times(column, column), count >> 1
    return crc


def stored_digests(spark: SparkSession, store: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Each stored chunk is read and checked once and gives its CRC-32 as 32-bit ids, which is kept with its number of uses; a
    document's is combined from its chunks' by their places, so that no bytes are shuffled again.
    """
    chunks, recipes = _read(spark, store)

    def crcs(batches):
        for b in batches:
            raw = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(raw, pa.int64())], ["name", "crc"])

    def shifted(batches):
        for b in batches:
            moved = _crc_shift(b.column("crc").to_numpy(), 4 * b.column("behind").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("start", "doc_id", "n_tokens", "size")), pa.array(moved.astype(np.int64))], ["start", "doc_id", "n_tokens", "size", "crc"])

    kind = dict(recipes.dtypes)["doc_id"]
    told = materialise(_counts(recipes).join(chunks.mapInArrow(crcs, "name binary, crc long"), "name"), "store-crcs")
    joined = _spread(recipes, told, told).select("start", "doc_id", "n_tokens", "size", "behind", "crc")
    moved = joined.mapInArrow(shifted, f"start long, doc_id {kind}, n_tokens long, size long, crc long")
    out = moved.groupBy("start", "doc_id", "n_tokens").agg(F.expr("bit_xor(crc)").alias("ids_crc32"), F.sum("size").alias("size"))
    whole = F.when(F.col("size") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is not whole")).cast("long"))
    return out.select("doc_id", "start", whole.alias("n_tokens"), "ids_crc32")
