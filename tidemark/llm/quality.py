"""A quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text, scored by sharded count joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.prefix import with_rank
from tidemark.llm.common import drop, materialise, released, tidy

#: Bytes of an n-gram.
ORDER = 5
#: One in FOLDS trusted documents of a language, by the hashes of their ids, is held out to set its threshold; the model is fitted on all others.
FOLDS = 5
#: Held-out documents that a language's threshold needs.
HELD = 5
#: A language's threshold: its held-out median, plus so many times the way from there to the upper quantile.
UPPER, REACH = 0.95, 3.0
#: Bytes of text of a shard, about: an n-gram and its cost are shuffled once for each shard that has it, so larger shards move fewer. Bytes of one
#: text whose n-grams are held at once.
SHARD_BYTES, AT_ONCE = 48 << 20, 1 << 20


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def grams(text: str | bytes | None) -> np.ndarray:
    """The n-grams of a text's UTF-8 bytes as numbers, the text's start filled up with bytes 2."""
    return next(slices(text), np.zeros(0, np.int64)) if len(text or "") <= AT_ONCE // 4 else np.concatenate(list(slices(text)))


def slices(text: str | bytes | None):
    """The n-grams of a text, AT_ONCE at a time."""
    raw = text if isinstance(text, bytes) else _raw(text)
    padded = np.frombuffer(b"\x02" * (ORDER - 1) + raw, np.uint8)
    for start in range(0, len(raw), AT_ONCE):
        part = padded[start : start + AT_ONCE + ORDER - 1].astype(np.int64)
        n = len(part) - ORDER + 1
        out = np.zeros(n, np.int64)
        for k in range(ORDER):
            out = out << 8 | part[k : n + k]
        yield out


def _by_language(langs: list[str], texts: Iterable[str | bytes | None], counts: bool) -> pa.RecordBatch:
    """lang, gram, n: counted, an n-gram may have several rows to be summed; else one row for each distinct n-gram.

    Texts are read once, in their order, and n-grams of a language taken about AT_ONCE at a time, so memory follows the
    distinct n-grams and not the texts.
    """
    found: dict[str, list[tuple[np.ndarray, np.ndarray | None]]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def count(lang: str) -> None:
        every = np.concatenate([np.zeros(0, np.int64), *waiting.get(lang, [])])
        found.setdefault(lang, []).append(np.unique(every, return_counts=True) if counts else (pd.unique(every), None))
        waiting[lang], sizes[lang] = [], 0

    for lang, text in zip(langs, texts, strict=True):
        for part in slices(text):
            waiting.setdefault(lang, []).append(part)
            sizes[lang] = sizes.get(lang, 0) + len(part)
            if sizes[lang] >= AT_ONCE:
                count(lang)
    rows: list[tuple[str, np.ndarray, np.ndarray]] = []
    for lang in list(waiting):
        count(lang)
        if counts:
            rows += [(lang, gram, n) for gram, n in found[lang]]
        else:
            gram = pd.unique(np.concatenate([g for g, _ in found[lang]]))
            rows.append((lang, gram, np.ones(len(gram), np.int64)))
        found[lang] = []
    return pa.RecordBatch.from_arrays(
        [
            pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows]), pa.array([r[0] for r in rows], pa.string())).cast(pa.string()),
            pa.array(np.concatenate([np.zeros(0, np.int64), *(r[1] for r in rows)])),
            pa.array(np.concatenate([np.zeros(0, np.int64), *(r[2] for r in rows)])),
        ],
        ["lang", "gram", "n"],
    )


def _counted(docs: DataFrame, counts: bool) -> DataFrame:
    """(lang, gram, n), a row for each batch, language and n-gram."""

    def run(batches):
        for b in batches:
            yield _by_language([x or "" for x in b.column("lang").to_pylist()], b.column("text").to_pylist(), counts)

    return docs.select("lang", "text").mapInArrow(tidy(run), "lang string, gram long, n long")


def _tables(trusted: DataFrame) -> list[DataFrame]:
    """(lang, gram, n) for orders 1 to ORDER: counts at the highest, numbers of distinct left neighbours below."""
    table = materialise(_counted(trusted, True).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lm-counts")
    tables = [table]
    for order in range(ORDER - 1, 0, -1):
        lower = tables[0].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        tables.insert(0, materialise(lower, "lm-counts"))
    return tables


def _discounts(table: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: the modified Kneser-Ney discounts from the counts of counts."""
    n = [F.greatest(F.count_if(F.col("n") == i), F.lit(1)) for i in (1, 2, 3, 4)]
    d = table.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)]).withColumn("y", F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
    return d.select("lang", *[F.greatest(F.lit(0.05), F.least(F.lit(float(i)), F.lit(float(i)) - (i + 1) * F.col("y") * F.col(f"n{i + 1}") / F.col(f"n{i}"))).alias(f"d{i}") for i in (1, 2, 3)])


def _model(tables: list[DataFrame], needed: DataFrame) -> DataFrame:
    """(lang, gram, cost) for the needed n-grams of the model's languages: minus the natural log of their probability.

    Each order's counts, and its contexts' totals, are joined by language and n-gram; an unseen context passes the
    probability of the next lower order on. The lowest order is mixed with the uniform distribution over bytes.
    """
    languages = F.broadcast(tables[0].select("lang").distinct())  # a row for each language
    rows, p = needed.join(languages, "lang"), F.lit(1 / 256)
    for order, table in enumerate(tables, 1):
        mask = F.lit((1 << 8 * order) - 1)
        rated = table.join(F.broadcast(_discounts(table)), "lang")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rated = rated.select("lang", "gram", "n", cut.alias("cut"))
        context = rated.groupBy("lang", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        seen = rated.select(F.col("lang").alias("l"), F.col("gram").alias("g"), (F.col("n") - F.col("cut")).alias("mass"))
        context = context.withColumnRenamed("lang", "l")
        rows = rows.join(seen, (F.col("lang") == F.col("l")) & (F.col("gram").bitwiseAND(mask) == F.col("g")), "left").drop("l", "g")
        rows = rows.join(context, (F.col("lang") == F.col("l")) & (F.shiftright(F.col("gram").bitwiseAND(mask), 8) == F.col("context")), "left").drop("l", "context")
        mixed = F.when(F.col("total").isNull(), p).otherwise((F.coalesce("mass", F.lit(0.0)) + F.col("freed") * p) / F.col("total"))
        rows = rows.withColumn("p", mixed).drop("mass", "total", "freed") if order == 1 else rows.withColumn("q", mixed).drop("p", "mass", "total", "freed").withColumnRenamed("q", "p")
        p = F.col("p")
    return rows.select("lang", "gram", (-F.log("p")).alias("cost"))


def trusted_ids(labels: DataFrame, most: int | None = None, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out of all documents labelled as good and not toxic; in each language every FOLDS-th is held out.

    With docs (doc_id, lang), only those in docs; without, all are of one language. With `most`, which no query gives, at most so many: the
    languages take turns until they are found, so one of few documents keeps them all.
    """
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    if docs is None:
        good = good.withColumn("lang", F.lit(""))
    else:
        langs = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("lang"))
        good = good.join(langs, "doc_id")
    good = materialise(good.withColumn("h", F.xxhash64("doc_id")), "lm-good")
    ranked = with_rank(good, [F.col("lang"), F.col("h"), F.col("doc_id")], "rank", materialise)
    starts = ranked.groupBy("lang").agg(F.min("rank").alias("start"))
    ranked = ranked.join(F.broadcast(starts), "lang").withColumn("place", F.col("rank") - F.col("start") + 1)
    chosen = ranked if most is None else ranked.orderBy("place", "h", "doc_id").limit(most)
    return chosen.select("doc_id", (F.col("place") % FOLDS == 0).alias("held_out"))


def _shards(n_bytes: int | None) -> int:
    """The number of shards for so many bytes of text."""
    return (n_bytes or 0) // SHARD_BYTES + 1


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, digest (the text's MD5), n_bytes, cost (mean negative log probability of a byte; null where there is none), per input row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string"))
    fitted = rows.join(trusted.filter("NOT held_out").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")  # grows with the labels, so never broadcast
    needed = _counted(rows, False).groupBy("lang", "gram").agg(F.lit(1).alias("one")).select("lang", "gram")
    tables, needed = _tables(fitted), materialise(needed, "lm-needed")
    costs = materialise(_model(tables, needed), "lm-costs")
    drop(needed, *tables)  # the costs are all that is read from here on
    shards = _shards(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0])
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))

    names = ["shard", "ids", "langs", "sizes", "blob"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]

    def pack(batches):
        packer = zstandard.ZstdCompressor(6)
        for b in batches:
            where, langs = b.column("shard").to_numpy(), b.column("lang").to_pylist()
            raw = [_raw(t) for t in b.column("text").to_pylist()]
            out, order = [], np.argsort(where, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
                blob = packer.compress(b"".join([raw[i] for i in part]))
                out.append((int(where[part[0]]), b.column("doc_id").take(pa.array(part)).to_pylist(), [langs[i] for i in part], [len(raw[i]) for i in part], blob))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)], names)

    def texts_of(group: pa.Table) -> Iterator[bytes]:
        """The texts of a shard; only one batch's part of them is unpacked at a time."""
        for sizes, blob in zip(group["sizes"].to_pylist(), group["blob"], strict=True):
            raw, at = zstandard.ZstdDecompressor().decompress(blob.as_buffer()), 0
            for n in sizes:
                yield raw[at : at + n]
                at += n

    def heads(group: pa.Table) -> tuple[pa.Array, list[str]]:
        return pa.array([i for ids in group["ids"].to_pylist() for i in ids], pa.int64()), [x for own in group["langs"].to_pylist() for x in own]

    def wanted(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = pa.Table.from_batches([_by_language(heads(group)[1], texts_of(group), False)])
        return released(found.drop_columns(["n"]).append_column("shard", pa.array(np.full(len(found), key[0].as_py()))))

    def score(group: pa.Table, known: pa.Table) -> pa.Table:
        ids, langs = heads(group)
        cost, size, digests = np.full(len(ids), np.nan), np.zeros(len(ids), np.int64), []
        own = known["lang"].combine_chunks().dictionary_encode()
        number, gram, value = own.indices.to_numpy(), known["gram"].to_numpy(), known["cost"].to_numpy()
        told = {lang: (pd.Index(gram[at]), value[at]) for code, lang in enumerate(own.dictionary.to_pylist()) for at in [number == code]}
        for i, (lang, text) in enumerate(zip(langs, texts_of(group), strict=True)):
            size[i] = len(text)
            if size[i] and lang in told:
                index, costs = told[lang]
                cost[i] = sum(costs[index.get_indexer(part)].sum() for part in slices(text)) / size[i]
            digests.append(hashlib.md5(text, usedforsecurity=False).digest())
        return released(pa.table({"doc_id": ids, "lang": pa.array(langs, pa.string()), "digest": pa.array(digests, pa.binary()), "n_bytes": pa.array(size), "cost": pa.array(cost, from_pandas=True)}))

    placed = rows.withColumn("shard", shard).mapInArrow(tidy(pack), "shard long, ids array<long>, langs array<string>, sizes array<int>, blob binary").groupBy("shard")
    asked = placed.applyInArrow(wanted, "lang string, gram long, shard long").join(costs, ["lang", "gram"])
    return placed.cogroup(asked.groupBy("shard")).applyInArrow(score, "doc_id long, lang string, digest binary, n_bytes long, cost double")


def _limits(held: DataFrame) -> DataFrame:
    """lang, limit of the languages with HELD held-out documents or more: quantiles of all costs, read off distributed ranks."""
    ranked = with_rank(held.select("lang", "cost", "doc_id"), [F.col("lang"), F.col("cost"), F.col("doc_id")], "rank", materialise)
    own = ranked.groupBy("lang").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("n")).filter(F.col("n") >= HELD)
    ranked = ranked.join(F.broadcast(own.drop("n")), "lang")  # a row for each language

    def at(q: float) -> Column:
        place, value = (F.col("rows") - 1) * F.lit(q), lambda i: F.max(F.when(F.col("rank") - F.col("start") == i, F.col("cost")))
        low, high, part = value(F.floor(place)), value(F.ceil(place)), F.max(place - F.floor(place))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    middle, upper = at(0.5), at(UPPER)
    return ranked.groupBy("lang").agg((middle + REACH * (upper - middle)).alias("limit"))


def _judged(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, lang, digest, cost, limit, keep of every row of docs."""
    trusted = materialise(trusted_ids(labels, most, docs), "lm-trusted")
    scored = materialise(perplexities(docs, trusted), "lm-scores")
    held = scored.join(trusted.filter("held_out").select("doc_id"), "doc_id", "left_semi").filter("cost IS NOT NULL")
    out = scored.join(F.broadcast(_limits(held)), "lang", "left")  # a row for each language
    return out.withColumn("keep", F.coalesce(F.col("cost") <= F.col("limit"), F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """Which documents read like trusted text of their language.

    docs: doc_id, lang, text; labels: doc_id, quality, toxic; other columns are ignored. Returns doc_id, lang,
    perplexity (per byte), threshold, keep: one row per input row. The model is fitted on all trusted documents but those held out, and
    thresholds are set on all held-out ones; `most` bounds both for trials and no query gives it. The distinct
    n-grams of the whole corpus are joined with the sharded counts, each shard of documents gets the costs of its own
    n-grams, and texts move once, packed. A document is kept if its perplexity is at most its language's threshold,
    which stands REACH times as far above the median of held-out trusted documents as their UPPER quantile does.

    Long texts are taken AT_ONCE bytes at a time. Null lang: a language of its own. A language without trusted documents, an empty or null text: perplexity null,
    kept. A language with fewer than HELD held-out ones: threshold null, kept. Null doc_id: judged, never trusted. Repeated rows:
    each judged; ids that repeat in labels count once. Empty tables: an empty result; without labels all is kept.
    """
    return _judged(docs, labels, most).select("doc_id", "lang", F.exp("cost").alias("perplexity"), F.exp("limit").alias("threshold"), "keep")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns; each row goes by its own language and text, whatever its id."""
    rejected = _judged(docs, labels).filter("NOT keep").select(F.col("lang").alias("_lang"), F.col("digest").alias("_digest")).distinct()
    lang, digest = F.coalesce(docs["lang"].cast("string"), F.lit("")), F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")))
    return docs.join(rejected, (lang == F.col("_lang")) & (digest == F.col("_digest")), "left_anti").select(*docs.columns)
