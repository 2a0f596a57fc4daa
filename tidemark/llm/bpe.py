"""Byte-level BPE encoding with a pair occurrence index, and decoding."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import tidy
from tidemark.llm.pieces import Vocabulary, load, pieces_of, spelled

#: Characters, whole texts, whose pieces are merged together: bounds what a task holds.
AT_ONCE = 4_000_000


def _rank(keys: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocab.pairs, keys), len(vocab.pairs) - 1)
    return np.where(vocab.pairs[at] == keys, vocab.ranks[at], -1)


def _apart(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of the ascending positions of a pair of equal symbols, those that a left-to-right scan merges."""
    kept, taken = [], -1
    for p, q in zip(at.tolist(), following.tolist(), strict=True):
        if p != taken:
            kept.append(p)
            taken = q
    return np.array(kept, np.int64)


def merged(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all pieces in a row, and each piece's number of them.

    The index maps every pair that occurs to its positions over all pieces. The lowest active rank is applied at all
    of its positions at once; the neighbours' new pairs enter the index. A merge makes a token that only later
    ranks use, so one pass in ascending rank gives what merging piece by piece gives.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbol = vocab.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbol)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    last = np.cumsum(sizes)[sizes > 0] - 1
    after[last] = -1
    before[last[:-1] + 1] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray, follow: np.ndarray) -> None:
        rank = _rank(symbol[at] * vocab.size + symbol[follow], vocab)
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        edges = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]).tolist()
        for r, a, b in zip(rank[edges].tolist(), edges, [*edges[1:], len(at)], strict=True):
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(active, r)

    first = np.flatnonzero(after >= 0)
    enter(first, after[first])
    while active:
        r = heapq.heappop(active)
        a, b, new = int(vocab.left[r]), int(vocab.right[r]), int(vocab.made[r])
        found = index.pop(r)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        follow = after[at]
        good = alive[at] & (follow >= 0) & (symbol[at] == a)
        good &= symbol[follow] == b
        at, follow = at[good], follow[good]
        if a == b and len(at) > 1:
            at = _apart(at, follow)
            follow = after[at]
        if not len(at):
            continue
        beyond = after[follow]
        symbol[at] = new
        alive[follow] = False
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        left = before[at]
        outer = left >= 0
        here = np.concatenate((left[outer], at[inner]))
        enter(here, after[here])
    return symbol[alive], np.bincount(piece[alive], minlength=len(pieces))


def encoded(texts: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    """The tokens of each text, AT_ONCE characters at a time; equal pieces among those are merged once."""
    out, start, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= AT_ONCE or i + 1 == len(texts):
            out += _encoded(texts[start : i + 1], vocab)
            start, size = i + 1, 0
    return out


def _encoded(texts: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    distinct, numbers, ends = pieces_of(texts, vocab.special)
    special = {i: vocab.special[p[1:].decode()] for i, p in enumerate(distinct) if p[:1] == b"\xff"} if any(s in t for s in vocab.special for t in texts) else {}
    tokens, lengths = merged([b"" if i in special else p for i, p in enumerate(distinct)], vocab)
    for i, token in sorted(special.items()):
        tokens = np.insert(tokens, int(lengths[:i].sum()), token)
        lengths[i] = 1
    starts, tokens = np.cumsum(lengths) - lengths, tokens.astype(np.int32)
    return [spelled(numbers[a:b], starts, lengths, tokens) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def decoded(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of ids, special tokens included."""
    return b"".join(map(vocab.as_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>): the tokens of each whole text; see encoded_digests for the cases."""
    vocab = load(path)

    def run(batches):
        for b in batches:
            ids = encoded([t or "" for t in b.column("text").to_pylist()], vocab)
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give null."""
    vocab = load(path)

    def run(batches):
        for b in batches:
            texts = [None if i is None else decoded(np.asarray(i, np.int64), vocab) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode each whole text, decode its ids again, and give n_tokens, ids_sha256 and decoded_sha256 by document.

    docs: doc_id, text; other columns are ignored. Narrow: no shuffle, one pass; a task holds one batch's texts and their distinct
    pieces. Null text: as empty, no tokens. Null doc_id and repeated
    rows: each row is encoded by itself. The string of a special token in a text is that token. Empty table:
    empty result.
    """
    vocab = load(path)

    def run(batches):
        for b in batches:
            ids = encoded([t or "" for t in b.column("text").to_pylist()], vocab)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(decoded(i, vocab).encode()).hexdigest() for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), shape)
