"""Operators 11 to 13 against brute force, and their cases of nulls, empties, ties and repeats."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import BAD, ODD, WORD, frame, vectors, words
from tidemark.llm import lexical, rules, vector_codes
from tidemark.llm.common import scratch
from tidemark.llm.tokens import TERM_BYTES, Texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(ids, texts, items, k=10):
    found = [terms(t) for t in texts]
    n, total = sum(bool(f) for f in found), sum(map(len, found))
    tf = [Counter(f) for f in found]
    df = Counter(t for c in tf for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in terms(text)}
        scored = []
        for row, c in enumerate(tf):
            m = 10 + 90 * len(found[row]) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, ids[row] is None, ids[row] or 0, row))
        out += [(item, r, ids[row], -s) for r, (s, _, _, row) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def asked(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def told(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


def search_texts():
    r = random.Random(11)
    many = [" ".join(r.choices(["the", "of", "and", *(f"w{i}" for i in range(200))], weights=[400, 300, 200, *(200 / (i + 1) for i in range(200))], k=r.randrange(1, 120))) for _ in range(1500)]
    return [*ODD, *many, *many[:40], "the " * 700, "x" * 40 + " w3", *(["w5 the same"] * 300)]


@pytest.mark.parametrize("shard", [1 << 24, 20_000])
def test_search_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "PIECE", 4000)
    texts = search_texts()
    ids = [None if i % 97 == 5 else i // 2 if i % 50 == 0 else i for i in range(len(texts))]
    items = [(1, "the of W3 w7"), (1, "the of W3 w7"), (2, "w190 and w1, w150!"), (3, None), (4, ""), (5, "nowhere absent"), (6, "the"), (7, "w5 the same"), (8, texts[60]), (8, "w9"), (None, "é ü w2"), (9, "one TWO")]
    got = told(lexical.rank(frame(spark, texts, ids=ids), asked(spark, items), scratch(spark, "test-lexical")))
    want = ranked(ids, texts, items)
    assert [g for g in got if g[2] is not None] == [w for w in want if w[2] is not None] and len(got) == len(want)


def test_search_in_rounds_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 3)
    texts, items = search_texts()[:200], [(i, f"w{i} the w{i * 7}") for i in range(12)]
    docs, path = frame(spark, texts), scratch(spark, "test-lexical")
    assert told(lexical.rank(docs, asked(spark, items), path)) == ranked(list(range(200)), texts, items)
    assert lexical.rank(docs.limit(0), asked(spark, items), scratch(spark, "test-lexical")).count() == 0
    assert lexical.search(spark, path, asked(spark, []), 10).count() == 0
    assert lexical.rank(frame(spark, [None, "", "..."]), asked(spark, items), scratch(spark, "test-lexical")).count() == 0


def test_search_rejects_before_decoding(spark):
    """With a threshold set, blocks of lists that can't lift a document over it stay coded."""
    r, path = random.Random(3), scratch(spark, "test-lexical")
    texts = [" ".join(["the"] * r.randrange(1, 4) + ["filler"] * r.randrange(20, 60) + (["rare"] * 3 if i in (700, 705) else [])) for i in range(3000)]
    lexical.build_index(frame(spark, texts).repartition(1), path)
    rows = spark.read.schema(lexical.INDEX).parquet(path).toArrow().to_pylist()
    lengths = next(x for x in rows if x["term"] is None)["lengths"]
    norm_of = {x: 10 + 90 * x * 3000 // sum(lengths) for x in set(lengths)}
    norm = np.array([norm_of[x] for x in lengths])
    held = {x["term"]: lexical.Postings.of(x, norm, norm_of) for x in rows if x["term"]}
    for p in held.values():  # a block's bound is its largest score
        assert all(p.block(i)[1].max() == best for i, best in enumerate(p.best))
        p.known.clear()
    found = lexical.best_of([(50, held["the"]), (9000, held["rare"])], np.arange(3000), 2)
    assert sorted(p for p, _ in found) in ([700, 705], sorted(int(np.flatnonzero([("rare" in t) for t in texts])[i]) for i in (0, 1)))
    assert len(held["the"].known) <= 2 < len(held["the"].blocks)


def test_counts_beyond_a_byte(spark):
    texts = ["a " * n + "b" for n in (254, 255, 256, 70_000)]
    items = [(1, "a"), (2, "b")]
    assert told(lexical.rank(frame(spark, texts), asked(spark, items), scratch(spark, "test-lexical"))) == ranked(list(range(4)), texts, items)


def test_runs_of_bytes_equal_the_pattern():
    import pyarrow as pa

    texts = [*ODD, "", "a", "b", None, "a\x00b", "é1 x", "\U0001f600z z"]
    found, of = Texts.of(pa.array(texts, pa.string())).runs(TERM_BYTES)
    assert list(zip(of.tolist(), found.to_pylist(), strict=True)) == [(i, t) for i, x in enumerate(texts) for t in TERM.findall(x or "")]


def coded(x, entries=64, rounds=2, positions=16):
    x = [[math.floor(256 * float(np.float32(v))) for v in row] for row in x]
    width = len(x[0]) // positions
    parts = [[tuple(row[p * width : (p + 1) * width]) for row in x] for p in range(positions)]
    books = [own[:entries] for own in parts]

    def assign():
        return [[min(range(len(book)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(part, book[c], strict=True)), c)) for part in own] for own, book in zip(parts, books, strict=True)]

    for _ in range(rounds):
        at = assign()
        for p in range(positions):
            members = {}
            for part, c in zip(parts[p], at[p], strict=True):
                members.setdefault(c, []).append(part)
            books[p] = [tuple(sum(v) // len(members[c]) for v in zip(*members[c], strict=True)) if c in members else e for c, e in enumerate(books[p])]
    at = assign()
    code = ["".join(f"{at[p][i]:02x}" for p in range(positions)) for i in range(len(x))]
    error = [sum(sum((a - b) ** 2 for a, b in zip(parts[p][i], books[p][at[p][i]], strict=True)) for p in range(positions)) for i in range(len(x))]
    return code, error, hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()


def codes_of(df, **how):
    return vector_codes.encode(df, **how).orderBy("vec_id").collect()


@pytest.mark.parametrize(("chunk", "subtree"), [(32_768, 4096), (40, 5)])
def test_codes_equal_brute_force(spark, monkeypatch, chunk, subtree):
    monkeypatch.setattr(vector_codes, "CHUNK", chunk)
    monkeypatch.setattr(vector_codes, "SUBTREE", subtree)
    r = np.random.default_rng(2)
    x = np.round(r.normal(0, 0.2, (300, 32)), 2).astype(np.float32)
    x[100:200] = x[:100]
    x[200:210] = 0
    labels = [None if i % 7 == 0 else i % 3 for i in range(300)]
    df = vectors(spark, [*x.tolist(), *BAD[:1], *BAD[2:], []], [*labels, *[1] * 5])
    code, error, sha = coded(x.tolist(), entries=20)
    total = Counter()
    for e, label in zip(error, labels, strict=True):
        total[label] += e
    got = codes_of(df, entries=20)
    assert [(g.vec_id, g.code, g.error, g.label_error, g.codebooks_sha256) for g in got] == [(i, code[i], error[i], total[labels[i]], sha) for i in range(300)]


def test_codes_of_few_and_none(spark):
    x = [[1.0] * 16, [0.5, -0.25] * 8, [0.5, -0.25] * 8]
    got = codes_of(vectors(spark, x, [1, 1, None], ids=[5, 3, 3]))
    code, error, sha = coded([x[1], x[2], x[0]])
    assert [(g.vec_id, g.code, g.error) for g in got] == [(3, code[0], 0), (3, code[1], 0), (5, code[2], 0)] and got[0].codebooks_sha256 == sha
    assert codes_of(vectors(spark, x).limit(0)) == [] and codes_of(vectors(spark, [[], None])) == []
    with pytest.raises(ValueError, match="equal parts"):
        codes_of(vectors(spark, [[1.0] * 17]))
    with pytest.raises(Exception, match="components"):
        codes_of(vectors(spark, [[1.0] * 16, [1.0] * 32]))
    with pytest.raises(ValueError, match="exact"):
        codes_of(vectors(spark, [[1e9] * 16]))


@pytest.mark.parametrize("subtree", [1, 3, 4096])
def test_trie_distances_are_exact(monkeypatch, subtree):
    monkeypatch.setattr(vector_codes, "SUBTREE", subtree)
    r = np.random.default_rng(5)
    parts, counts, number = vector_codes.distinct(r.integers(-3, 4, (500, 4)))
    entries = r.integers(-5, 6, (9, 4))
    assert counts.sum() == 500 and (np.diff(np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]).any(axis=1)])) == 1).all() and number.max() == len(parts) - 1
    at = 0
    for low, high, summed in vector_codes.leaves(parts, entries):
        assert low == at and high > low and (subtree > 1 or high - low == 1)
        assert (summed == np.square(parts[low:high, None] - entries[None]).sum(axis=2)).all()
        at = high
    assert at == len(parts)


def judged(texts, hosts, most=0.5):
    rows = []
    for t in texts:
        w = WORD.findall(t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        repeat = len({i + j for i, g in enumerate(grams) if g in twice for j in range(3)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n, chars, symbols, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines))
        rows.append((n, chars, symbols, dup, repeat, [n < 50, 100 * repeat > 50 * n, n > 0 and not 3 * n <= chars <= 10 * n, 10 * symbols > n, 10 * dup > 3 * len(lines)]))
    bad = set()
    for rule in range(5):
        n, f = Counter(hosts), Counter(h for h, r in zip(hosts, rows, strict=True) if r[5][rule])
        p = rules.prior(sum(f.values()), sum(n.values()), len(n), sum(f[h] ** 2 / n[h] for h in n), sum(v**2 for v in n.values()))
        bad |= {h for h in n if (f[h] + p.mean * p.strength) / (n[h] + p.strength) > most}
    return [(*r[:5], r[5][0] or r[5][1], not (r[5][0] or r[5][1]) and h not in bad) for r, h in zip(rows, hosts, strict=True)]


def test_rules_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rules, "PIECE", 3000)
    line = "a line that comes again and again in this text\n"
    r = random.Random(4)
    fine = [" ".join(f"word{r.randrange(10**6)}" for _ in range(r.randrange(50, 90))) for _ in range(120)]
    texts = [*ODD, line * 9, line * 3 + fine[0], "\n\n" + line + "\r\n" + line, "# $ % & | < > * " * 20 + fine[1], "a\nb\na\n", "a b c a b c", "x y z " * 300, *fine, *["# " * 60 + t for t in fine[:30]], "é" * 9, "\n", "a b a b a"]
    hosts = ["spam" if t and t.startswith("# # ") else [None, "", "h1", "h2", "h3"][i % 5] for i, t in enumerate(texts)]
    hosts[40] = "spam"
    df = frame(spark, texts, ids=[None if i == 3 else i for i in range(len(texts))], sources=hosts).withColumn("n_words", df_lit())
    got = rules.judge(df).collect()
    want = judged(texts, hosts)
    by = {g.doc_id: (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.kept) for g in got}
    assert len(got) == len(texts) and [by[None if i == 3 else i] for i in range(len(texts))] == want
    assert not by[40][5] and not by[40][6] and sum(g.kept for g in got) >= 100  # a clean document of a host that fails goes, the others stay
    assert rules.judge(df.limit(0)).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("mine")


def test_prior_shrinks_small_hosts():
    even = rules.prior(500, 5000, 50, sum(10**2 / 100 for _ in range(50)), 50 * 100**2)
    assert even.strength > 10**5  # hosts alike: each is drawn to the mean
    apart = rules.prior(500, 5000, 50, 5 * 100**2 / 100, 50 * 100**2)
    assert apart.strength < 1 and abs(apart.mean - 0.1) < 1e-12  # five hosts fail whole: rates stand for themselves
    assert rules.prior(0, 0, 0, 0.0, 0.0).mean == 0 and rules.prior(3, 3, 1, 3.0, 9.0).mean == 1
