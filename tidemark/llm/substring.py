"""Repeated passages across documents, found by recompression: rounds name pairs of symbols alike everywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words

#: Words of a window.
WINDOW = 13
#: Rounds of naming before symbols are told to others.
ROUNDS = 3
#: Bytes of text of a block (what one task call holds), and blocks whose names fill a bucket.
BLOCK_BYTES, BLOCKS_PER_BUCKET = 4 << 20, 8
#: Bytes of a symbol's name as it is told; two that share one only make more windows compared.
KEY = 6
_FAR = np.int64(1 << 40)
_NO_ID = np.iinfo(np.int64).max
_PRIME = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (2 * salt + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in a row, each text's number of them, two independent hashes of every word, and the number of its text."""
    lists = pc.ascii_split_whitespace(texts)  # may give empty strings at a text's ends
    parts = lists.flatten()
    full = pc.greater(pc.binary_length(parts), 0)
    before = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    sizes = np.diff(before[np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]])
    found = parts.filter(full)
    coded = found.dictionary_encode()
    raw = b"".join(xxhash.xxh3_128_digest(w, 7) for w in coded.dictionary.cast(pa.large_binary()).to_pylist())
    hashes = np.frombuffer(raw, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()] if len(coded) else np.zeros((0, 2), np.uint64)
    return found, sizes, hashes[:, 0].copy(), hashes[:, 1].copy(), np.repeat(np.arange(len(sizes)), sizes)


def runs_of(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each run of one word as one symbol, named by the word and the run's length: name, text, and the words [low, high) that decide it.

    The word before and the one after decide where a run ends; a text's edge decides nothing.
    """
    new = np.r_[np.ones(min(1, len(word)), bool), (word[1:] != word[:-1]) | (text[1:] != text[:-1])]
    at = np.flatnonzero(new)
    end = np.r_[at[1:], len(word)][: len(at)]
    size, text = (end - at).astype(np.uint64), text[at]
    named = np.where(size > 1, _mix(word[at] + size * _PRIME, 90), word[at])
    same = text[1:] == text[:-1]
    low, high = np.where(np.r_[False, same][: len(at)], at - 1, -_FAR), np.where(np.r_[same, False][: len(at)], end + 1, _FAR)
    return named, text, low.astype(np.int64), high.astype(np.int64)


def recompressed(word: np.ndarray, text: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after runs and `rounds` rounds of pairs are named: name, number of the text, and the words [low, high) that decide the symbol.

    A round splits the alphabet in two by a hash of the name; a left symbol before a right one becomes one symbol
    named by both, wherever it stands. A symbol that stays single depends on the neighbour it might have joined. So
    any two texts that share the words [low, high) have this symbol there. A name follows from what it stands for, so that
    it is the same in every task.
    """
    symbol, text, low, high = runs_of(word, text)
    for r in range(rounds):
        right = (_mix(symbol, r) & np.uint64(1)).astype(bool)
        same = text[1:] == text[:-1]
        pair = np.r_[~right[:-1] & right[1:] & same, False][: len(symbol)]
        second = np.r_[False, pair[:-1]][: len(symbol)]
        before, after = np.r_[False, same][: len(symbol)], np.r_[same, False][: len(symbol)]
        low_before, high_before = np.r_[-_FAR, low[:-1]][: len(symbol)], np.r_[_FAR, high[:-1]][: len(symbol)]
        low_after, high_after = np.r_[low[1:], -_FAR][: len(symbol)], np.r_[high[1:], _FAR][: len(symbol)]
        # A left symbol looks at the one after it, a right one at the one before; a text's edge decides nothing.
        seen = np.where(right, before, after)
        new_low = np.where(seen, np.minimum(low, np.where(right, low_before, low_after)), -_FAR)
        new_high = np.where(seen, np.maximum(high, np.where(right, high_before, high_after)), _FAR)
        named = np.where(pair, _mix(symbol * _PRIME + np.r_[symbol[1:], np.zeros(1, np.uint64)][: len(symbol)], r + 100), symbol)
        keep = ~second
        symbol, text, low, high = named[keep], text[keep], new_low[keep], new_high[keep]
    return symbol, text, low, high


def inside(symbol: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that some window decides: name, text, low, high; low and high ascend."""
    fit = high - low <= WINDOW
    return symbol[fit] & np.uint64((1 << 8 * KEY) - 1), text[fit], low[fit], high[fit]


def pairs_of(symbol: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring symbols that both are shared, as one, where some window decides both."""
    both = shared[1:] & shared[:-1] & (text[1:] == text[:-1])
    return inside(_mix(symbol[:-1] * _PRIME + symbol[1:], 200)[both], text[:-1][both], low[:-1][both], high[1:][both])


def _names(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and whether two texts of this block have it."""
    order = np.lexsort((text, key))
    key, text = key[order], text[order]
    new = np.r_[np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]
    other = np.r_[np.zeros(min(1, len(key)), bool), (key[1:] == key[:-1]) & (text[1:] != text[:-1])]
    return key[new], np.logical_or.reduceat(other, np.flatnonzero(new)) if len(key) else other


def _sums(values: np.ndarray, power: np.ndarray) -> np.ndarray:
    return np.r_[np.zeros(1, np.uint64), np.cumsum(values * power, dtype=np.uint64)]


class Block:
    """The documents of a block, parsed; what the steps share."""

    def __init__(self, docs: pa.Table, buckets: int) -> None:
        order = np.lexsort((np.arange(len(docs)), docs["doc_id"].fill_null(_NO_ID).to_numpy()))
        self.docs = docs.take(pa.array(order))
        self.ids = self.docs["doc_id"].fill_null(_NO_ID).to_numpy()
        texts = self.docs["text"].combine_chunks().cast(pa.large_string()).fill_null("")
        self.words, self.sizes, self.word, self.other, self.text = word_hashes(texts)
        self.bucket_of = lambda names: (names % np.uint64(buckets)).astype(np.int64)
        self.levels = [inside(*recompressed(self.word, self.text))]
        self.names, self.twice = [None, None], [None, None]
        self._name(0)

    def _name(self, step: int) -> None:
        self.names[step], self.twice[step] = _names(self.levels[step][0], self.ids[self.levels[step][1]])

    def learn(self, step: int, shared: np.ndarray) -> None:
        """Take in which of the step's names other documents have too; after the symbols come pairs of shared ones."""
        level = self.levels[step]
        level_shared = shared[np.searchsorted(self.names[step], level[0])] if len(level[0]) else np.zeros(0, bool)
        self.levels[step] = (*level[:4], level_shared)
        if step == 0:
            self.levels.append(pairs_of(*self.levels[0]))
            self._name(1)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows all of whose symbols and pairs are shared: where they start, their name and their check.

        A name is made of the symbols inside the window and of the words at its edges that no symbol covers; the check of
        all its words, by the other hash. A window without symbols is named by its words, and stays.
        """
        n = max(0, len(self.word) - WINDOW + 1)
        at = np.flatnonzero(self.text[:n] == self.text[WINDOW - 1 : n + WINDOW - 1])
        for _, _, low, high, shared in self.levels:
            lost = np.r_[0, np.cumsum(~shared)]
            a, b = np.searchsorted(low, at, "left"), np.searchsorted(high, at + WINDOW, "right")
            at = at[lost[np.maximum(a, b)] == lost[a]]
        power = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(len(self.word), _PRIME)], dtype=np.uint64)
        back = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(len(self.word), np.uint64(pow(int(_PRIME), -1, 1 << 64)))], dtype=np.uint64)[at]
        symbol, _, low, high, _ = self.levels[0]
        plain, checked = (_sums(_mix(w, salt), power[:-1]) for w, salt in ((self.word, 301), (self.other, 302)))
        named = _sums(_mix(symbol, 303), power[low] if len(low) else np.zeros(0, np.uint64))
        a, b = np.searchsorted(low, at, "left"), np.searchsorted(high, at + WINDOW, "right")
        some, end = b > a, at + WINDOW
        left, right = (np.where(some, np.r_[x, 0][np.where(some, i, -1)], at) for x, i in ((low, a), (high, b - 1)))
        right = np.where(some, right, at)
        edges = (plain[left] - plain[at]) * back + _mix((plain[end] - plain[right]) * back, 304)
        name = _mix((named[np.where(some, b, a)] - named[a]) * back + _mix(edges, 305), 306)
        return at, name, _mix((checked[end] - checked[at]) * back, 307)

    def firsts(self, at: np.ndarray, name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows: name, check, smallest id of the block that has it; and each window's place among them."""
        order = np.lexsort((self.ids[self.text[at]], check, name))
        a, b = name[order], check[order]
        new = np.r_[np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return a[new], b[new], self.ids[self.text[at]][order][new], place

    def by_bucket(self, names: np.ndarray) -> list[tuple[int, np.ndarray]]:
        bucket = self.bucket_of(names)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.r_[np.ones(min(1, len(order)), bool), np.diff(bucket[order]) != 0])
        return [(int(bucket[order[s]]), part) for s, part in zip(edges, np.split(order, edges[1:]), strict=True)] if len(order) else []

    def spread(self, masks: pa.Table, step: int, names: np.ndarray) -> np.ndarray:
        """The bits that came back for the names of this block, in the order of the names."""
        told = {b: m for b, m, s in zip(masks["bucket"].to_pylist(), masks["bits"].to_pylist(), masks["step"].to_pylist(), strict=True) if s == step}
        out = np.zeros(len(names), bool)
        for b, part in self.by_bucket(names):
            out[part] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=len(part)).astype(bool)
        return out


_SENT, _BITS = "bucket long, block long, names binary, checks binary, ids binary", "block long, step int, bucket long, bits binary"


def _rows(rows: list[tuple], shape: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in shape.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def duplicate_words(docs: DataFrame) -> DataFrame:
    """Remove each word that lies in a window of WINDOW words which also starts in a document of smaller id.

    docs: doc_id long, text; other columns are ignored. Returns doc_id, n_words, n_removed, kept (text: kept words
    joined by one space), one row per input row; windows are judged on the input.

    Round 1: every block of documents is recompressed and sends its distinct symbols, dealt by name; a symbol is shared if
    two documents have it. Round 2 does the same with pairs of neighbouring symbols that are shared. A repeated window's symbols and
    pairs are all shared, so other windows go. Round 3: the windows left, named by the symbols inside
    them and verified by a second hash of all their words, are dealt by name with the block's smallest id; each block learns
    which have a smaller id elsewhere, and removes. What returns to a block is bits. The texts are shuffled once, to their
    blocks; all rounds read that one exchange. A frequent passage is one name of a block, so no task gathers its
    occurrences. A block is about BLOCK_BYTES of text, and sends at most a row for each name.

    Null or empty text: no words. Null doc_id: larger than any id, and equal to other nulls. Repeated rows: equal ids
    are not smaller, so they remove nothing from each other. Texts shorter than a window lose nothing, and never enter a block.
    A long text is parsed as a whole, at about 150 bytes a word. Empty table: empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = words(F.col("text"))
    short = F.coalesce(F.length("text") < 2 * WINDOW - 1, F.lit(True))  # too few characters for a window
    plain = rows.filter(short).select("doc_id", F.size(found).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(found, " ").alias("kept"))
    rows = rows.filter(~short)
    blocks = (rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BLOCK_BYTES + 1
    buckets = blocks // BLOCKS_PER_BUCKET + 1
    placed = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text").groupBy("block")

    def told(block: Block, masks: pa.Table | None, steps: int) -> Block:
        for step in range(steps):
            block.learn(step, block.spread(masks, step, block.names[step]))
        return block

    def names_of(block: Block, number: int, step: int) -> pa.Table:
        out = []
        for b, part in block.by_bucket(block.names[step]):
            raw = block.names[step][part].view(np.uint8).reshape(-1, 8)[:, :KEY]
            out.append((b, number, raw.tobytes(), np.packbits(block.twice[step][part]).tobytes(), None))
        return _rows(out, _SENT)

    def send_symbols(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return names_of(Block(group, buckets), key[0].as_py(), 0)

    def send_pairs(key: tuple[pa.Scalar, ...], group: pa.Table, masks: pa.Table) -> pa.Table:
        return names_of(told(Block(group, buckets), masks, 1), key[0].as_py(), 1)

    def judge(step: int):
        def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            parts = []
            for raw in group["names"].to_pylist():
                wide = np.zeros((len(raw) // KEY, 8), np.uint8)
                wide[:, :KEY] = np.frombuffer(raw, np.uint8).reshape(-1, KEY)
                parts.append(wide.view(np.uint64).ravel())
            twice = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8), count=len(p)) for r, p in zip(group["checks"].to_pylist(), parts, strict=True)])
            _, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            shared = (count > 1) | (np.bincount(place, twice, len(count)) > 0)
            bits = np.split(shared[place], np.cumsum([len(p) for p in parts])[:-1])
            return _rows([(b, step, key[0].as_py(), np.packbits(x).tobytes()) for b, x in zip(group["block"].to_pylist(), bits, strict=True)], _BITS)

        return run

    def send_windows(key: tuple[pa.Scalar, ...], group: pa.Table, masks: pa.Table) -> pa.Table:
        block, out = told(Block(group, buckets), masks, 2), []
        name, check, ids, _ = block.firsts(*block.windows())
        for b, part in block.by_bucket(name):
            out.append((b, key[0].as_py(), name[part].tobytes(), check[part].tobytes(), _packed(ids[part])))
        return _rows(out, _SENT)

    def judge_windows(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        raw = [group[c].to_pylist() for c in ("names", "checks", "ids")]
        name, check = (np.frombuffer(b"".join(r), np.uint64) for r in raw[:2])
        ids = np.concatenate([_unpacked(r, "<i8") for r in raw[2]])
        order = np.lexsort((ids, check, name))
        new = np.r_[True, (np.diff(name[order]) != 0) | (np.diff(check[order]) != 0)]
        least = np.empty(len(ids), np.int64)
        least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        bits = np.split(least < ids, np.cumsum([len(r) // 8 for r in raw[0]])[:-1])
        return _rows([(b, 2, key[0].as_py(), np.packbits(x).tobytes()) for b, x in zip(group["block"].to_pylist(), bits, strict=True)], _BITS)

    def remove(key: tuple[pa.Scalar, ...], group: pa.Table, masks: pa.Table) -> pa.Table:
        block = told(Block(group, buckets), masks, 2)
        at, name, check = block.windows()
        names, _, least, place = block.firsts(at, name, check)
        gone = block.spread(masks, 2, names)[place] | (block.ids[block.text[at]] > least[place])
        covered = np.zeros(len(block.word) + 1, np.int64)
        np.add.at(covered, at[gone], 1)
        np.add.at(covered, at[gone] + WINDOW, -1)
        lost = np.cumsum(covered)[:-1] > 0
        removed = np.bincount(block.text[lost], minlength=len(block.sizes)).astype(np.int64)
        ends = pa.array(np.r_[0, np.cumsum(block.sizes - removed)], pa.int64())
        kept = pc.binary_join(pa.LargeListArray.from_arrays(ends, block.words.filter(pa.array(~lost))), pa.scalar(" ", pa.large_string()))
        return pa.table({"doc_id": block.docs["doc_id"], "n_words": pa.array(block.sizes, pa.int64()), "n_removed": pa.array(removed), "kept": kept.cast(pa.string())})

    # No table is written between the rounds: a second query would shuffle the texts again.
    symbols = placed.applyInArrow(send_symbols, _SENT).groupBy("bucket").applyInArrow(judge(0), _BITS)
    pairs = placed.cogroup(symbols.groupBy("block")).applyInArrow(send_pairs, _SENT).groupBy("bucket").applyInArrow(judge(1), _BITS)
    shared = symbols.union(pairs).repartition("block")  # one exchange of bits, read for the windows and again for the removal
    first = placed.cogroup(shared.groupBy("block")).applyInArrow(send_windows, _SENT).groupBy("bucket").applyInArrow(judge_windows, _BITS)
    out = placed.cogroup(shared.union(first).groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")
    return plain.union(out)


def kept_digests(docs: DataFrame) -> DataFrame:
    """duplicate_words with kept_sha256, the digest of the kept words, in place of them."""
    return duplicate_words(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS pos FROM w),
spans AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 12], ' ') AS name FROM starts),
firsts AS (SELECT name, min(doc_id) AS least FROM spans GROUP BY name HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM spans JOIN firsts USING (name) WHERE doc_id > least),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT p.doc_id, string_agg(ws[p.pos], ' ' ORDER BY p.pos) AS kept, count(*) AS n FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::bigint AS n_words, (len(ws) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
