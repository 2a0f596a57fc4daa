"""Cutting texts into the pieces of a byte-level BPE tokenizer, and naming equal pieces alike."""

from __future__ import annotations

import itertools
import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

#: Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


#: Bytes of a piece that is told apart as one number.
SHORT = 7


@dataclass
class Vocabulary:
    """What encoding and decoding need of a tokenizer file, as plain arrays: bounded by the vocabulary."""

    of_byte: np.ndarray  # token of each byte value
    pairs: np.ndarray  # sorted keys left * size + right of the merges
    ranks: np.ndarray  # their ranks
    left: np.ndarray  # by rank
    right: np.ndarray
    made: np.ndarray
    size: int
    as_bytes: list[bytes]  # by token
    special: dict[str, int]


def load(path: str) -> Vocabulary:
    """Read a tokenizer file of the byte-level BPE kind."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocab, merges = said["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    # Byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    as_bytes = [b""] * size
    for token, i in vocab.items():
        as_bytes[i] = bytes(char[c] for c in token) if token not in special else token.encode()
    for token, i in special.items():
        as_bytes[i] = token.encode()
    left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    order = np.argsort(left * size + right)
    of_byte = np.zeros(256, np.int64)
    for c, b in char.items():
        of_byte[b] = vocab[c]
    return Vocabulary(of_byte, (left * size + right)[order], order, left, right, made, size, as_bytes, special)


_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
#: Fixed value: the code points of the Unicode property White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of every code point; the one after the last marks the end of a text."""
    of = {"L": _LETTER, "N": _NUMBER}
    kinds = np.fromiter((of.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    kinds[_WHITE] = _SPACE
    return np.append(kinds, np.uint8(_END))


def cut(text: str, special: dict[str, int]) -> list[bytes]:
    """The pieces of one text by PATTERN; a special token's string is a piece of its own, marked by a byte no text has."""
    found: list[bytes] = []
    for part in regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text):
        found += [b"\xff" + part.encode()] if part in special else [p.encode("utf-8", "surrogatepass") for p in PATTERN.findall(part)]
    return found


def _starts(points: np.ndarray) -> np.ndarray:
    """Where PATTERN starts a piece, over texts that each end with the end mark: the same cuts, found for all at once."""
    kind = _kinds()[points]
    blank = points == 32
    new = np.r_[True, kind[1:] != kind[:-1]]
    after_blank = np.r_[False, blank[:-1]]
    start = new & ~(after_blank & (kind != _SPACE) & (kind != _END))  # a word takes the blank before it
    last = np.r_[(kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END), False]
    start |= last  # the last of several white-space characters before a word stands apart or goes to the word
    mark = np.flatnonzero(new & (points == 39) & ~after_blank)
    if len(mark):
        one, two = (points[np.minimum(mark + k, len(points) - 1)] for k in (1, 2))
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((mark[short], 2), (mark[long & ~short], 3)):
            start[at + 1] = False
            start[at + size] |= kind[at + size] == _LETTER
    return start


def _coded(raw: bytes, begins: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each of the strings that start at these places of raw, each reaching to the next, and the distinct strings.

    Those of SHORT bytes or fewer are told apart as whole numbers, with their length in the top byte.
    """
    bounds = np.append(begins, len(raw))
    size = np.diff(bounds)
    short = size <= SHORT
    at, n = begins[short], size[short]
    eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    keys = eight[at] & ((np.uint64(1) << (8 * n).astype(np.uint64)) - np.uint64(1)) | n.astype(np.uint64) << np.uint64(8 * SHORT)
    numbers = np.empty(len(begins), np.int64)
    numbers[short], found = pd.factorize(keys)
    distinct = [k.to_bytes(8, "little")[: k >> 8 * SHORT] for k in found.tolist()]
    rest = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw)]).filter(pa.array(~short)).dictionary_encode()
    numbers[~short] = rest.indices.to_numpy().astype(np.int64) + len(distinct)
    offsets, data = np.frombuffer(rest.dictionary.buffers()[1], np.int32)[: len(rest.dictionary) + 1].tolist(), rest.dictionary.buffers()[2]
    held = data.to_pybytes() if data else b""
    return numbers, distinct + [held[a:b] for a, b in itertools.pairwise(offsets)]


def pieces_of(texts: list[str], special: dict[str, int]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pieces of all texts; the numbers of the pieces, text by text; and where each text's numbers end."""
    odd = [i for i, t in enumerate(texts) if any(s in t for s in special)]
    plain = texts if not odd else [t if i not in set(odd) else "" for i, t in enumerate(texts)]
    counts, arrays, raws, sizes = np.zeros(len(texts), np.int64), [], [], 0
    at = 0
    while at < len(plain):  # a few million characters at a time
        upto, size = at, 0
        while upto < len(plain) and (upto == at or size + len(plain[upto]) < 4_000_000):
            size += len(plain[upto])
            upto += 1
        part = plain[at:upto]
        ends = np.cumsum([len(t) for t in part])
        points = np.insert(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32), ends, 0x110000)
        start = _starts(points)
        end = points == 0x110000
        wide = (~end).view(np.uint8) + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        wide[end] = 0
        begins = np.flatnonzero(start & ~end)
        counts[at:upto] = np.diff(np.searchsorted(begins, np.flatnonzero(end)), prepend=0)
        arrays.append(np.cumsum(wide, dtype=np.int64)[begins] - wide[begins] + sizes)
        raws.append("".join(part).encode("utf-8", "surrogatepass"))
        sizes += len(raws[-1])
        at = upto
    cuts = [cut(texts[i], special) for i in odd]
    own = [p for c in cuts for p in c]
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    numbers, distinct = _coded(b"".join([*raws, *own]), np.concatenate([np.zeros(0, np.int64), *arrays, sizes + np.cumsum(lengths) - lengths]))
    if odd:
        ends = np.cumsum(counts)
        spot = np.repeat(ends[odd], [len(c) for c in cuts])
        body = len(numbers) - len(spot)
        numbers = np.insert(numbers[:body], spot, numbers[body:])
        counts[odd] = [len(c) for c in cuts]
    return distinct, numbers, np.cumsum(counts)


def spelled(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The tokens of a sequence of pieces."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return tokens[np.repeat(starts[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
