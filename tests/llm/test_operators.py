"""Each operator against a brute-force version, and its cases of nulls, empties, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.oracle import expected, rows
from tidemark.llm import ann, bpe, components, entries, mixing, pii, pieces, quality, simhash, substring, token_store, vector_dedup, warc
from tidemark.llm.common import scratch
from tidemark.llm.entries import TOKENIZER
from tidemark.sources.scratch import _MADE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_entities string, size string, component_id string, block string, kind string"


def frame(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names clash with those the operators use."""
    ids = range(len(texts)) if ids is None else ids
    data = [(i, t, (langs or ["en"] * len(texts))[n], (sources or ["s"] * len(texts))[n], len(t or ""), "x", "y", "z", "b", "k") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(data, DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) for _ in range(n))


ODD = [None, "", " \t\n ", "one", "one two three", "ONE Two three four", "é ü ß 日本 語", "x" * 30000, "a b c\x1cd \x85 e", "<|endoftext|>mid<|endoftext|>", "we're 'tis it's 12½ ٣", " lead", "trail  ", words(40, 1), words(40, 1), None]


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_matches_sql(spark, name):
    got, want = entries.QUERIES[name](spark, SF).toPandas(), expected(entries.SQL[name], SF)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def test_encoding_equals_the_library(spark, tokenizer):
    own = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = frame(spark, ODD + own)
    got = bpe.encoded_digests(df, TOKENIZER).orderBy("doc_id").collect()
    want = tokenizer.encode_batch([t or "" for t in ODD + own], add_special_tokens=False)
    assert [r.ids_sha256 for r in got] == [hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest() for e in want]
    assert [r.decoded_sha256 for r in got] == [hashlib.sha256(tokenizer.decode(e.ids, skip_special_tokens=False).encode()).hexdigest() for e in want]
    back = bpe.decode(bpe.encode(df, TOKENIZER), TOKENIZER).orderBy("doc_id").collect()
    assert [r.text for r in back] == [t or "" for t in ODD + own]


def test_merges_of_repeated_letters(tokenizer):
    vocab = pieces.load(TOKENIZER)
    texts = ["a" * n for n in range(1, 40)] + ["ha" * n + "!" * n for n in range(30)]
    assert [list(i) for i in bpe.encoded(texts, vocab)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_store_round_trip(spark, tokenizer):
    texts = ODD + [words(900, 3), words(900, 3) + " more", words(900, 3)]
    store = scratch(spark, "test-store")
    token_store.write_store(frame(spark, texts), TOKENIZER, store)
    ids = [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = token_store.stored_digests(spark, store).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == [(sum(map(len, ids[:i])), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]
    rebuilt = token_store.read_store(spark, store).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u2").tolist() for r in rebuilt] == ids
    stored = spark.read.parquet(f"{store}/data").filter("kind = 'chunk'")
    assert stored.count() == stored.select("key").distinct().count()


def test_encoder_tells_the_library_a_piece_once_in_all_tasks(tokenizer, monkeypatch):
    """A worker keeps its encoder; one call of the library takes many pieces, and ids equal those of whole texts before and after it forgets."""
    encoder = token_store.Encoder(TOKENIZER)
    assert token_store.encoder_of(TOKENIZER) is token_store.encoder_of(TOKENIZER)
    told, call = [], encoder.told
    monkeypatch.setattr(encoder, "told", lambda pieces: told.append(pieces) or call(pieces))
    texts = [t or "" for t in ODD] + [words(400, 8), "a\x00 \x00\x00 abcdefg abcdefgh \x00abcdef <|endoftext|>x", "it's we'll" + "\u00e9\u4e2d\U0001f600 " * 3]
    told_ids = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in encoder.encode(texts)] == told_ids
    assert [i.tolist() for i in encoder.encode(texts[::-1])] == told_ids[::-1]
    assert len(told) == 1 and len(set(told[0])) == len(told[0])
    monkeypatch.setattr(token_store, "CACHE", 3)
    monkeypatch.setattr(token_store, "CALL", 7)
    assert [i.tolist() for t in texts for i in encoder.encode([t])] == told_ids


def test_encoder_gives_the_library_one_string_a_call(tokenizer, monkeypatch):
    """Pieces go to the library as one string, parted by a mark that none of them holds, and as a list only where they hold every mark."""

    class Spy:
        def __init__(self, own):
            self.__dict__ |= {"own": own, "given": []}

        def __getattr__(self, name):
            return getattr(self.own, name)

        def __setattr__(self, name, value):
            setattr(self.own, name, value)

        def encode_batch_fast(self, texts, **how):
            self.given.append(type(texts[0]))
            return self.own.encode_batch_fast(texts, **how)

    encoder = token_store.Encoder(TOKENIZER)
    encoder.tokenizer = Spy(encoder.tokenizer)
    marks = [chr(0xE000 + i) for i in range(6400)]
    texts = [words(100, 4), f"x{marks[0]}y and {marks[0]}", "".join(marks), words(100, 5), f"{marks[0]} {marks[100]}{marks[0]} z"]
    told = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for t in texts for i in encoder.encode([t])] == told
    assert encoder.tokenizer.given == [str, str, list, str, str]


def test_chunks_end_alike_wherever_a_document_stands():
    """A document's chunks follow from its ids alone, though the places of a whole batch are found at once."""
    g = np.random.default_rng(6)
    gear, docs = token_store._gear(1000), [g.integers(0, 1000, n) for n in (1, 5, 64, 65, 700, 0, 9000, 15)]
    docs.append(np.zeros(5000, np.int64))
    found, first = token_store.places(np.concatenate(docs), gear).tolist(), 0
    for ids in docs:
        own = token_store.boundaries(token_store.places(ids, gear).tolist(), 0, len(ids))
        inside = [x for x in found if first < x <= first + len(ids)]
        assert [x - first for x in token_store.boundaries(inside, first, first + len(ids))] == own
        assert (own or [0])[-1] == len(ids) and all(b - a <= token_store.MOST for a, b in zip([0, *own], own, strict=False))
        first += len(ids)


def test_encoder_looks_each_distinct_piece_up_once(tokenizer):
    """Known or new, a piece costs one search of what the encoder remembers, and ids equal the library's."""

    class Counted(dict):
        looked = 0

        def get(self, *key):
            Counted.looked += 1
            return dict.get(self, *key)

        def __contains__(self, key):
            Counted.looked += 1
            return dict.__contains__(self, key)

        def __getitem__(self, key):
            Counted.looked += 1
            return dict.__getitem__(self, key)

    encoder = token_store.Encoder(TOKENIZER)
    encoder.places = Counted()
    texts = [t or "" for t in ODD] + [words(400, 9), "a <|endoftext|>x"]
    told = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [i.tolist() for i in encoder.encode(texts)] == told
    assert Counted.looked == 2 * len(pieces.pieces_of(texts, encoder.special)[0])


def test_store_checks_each_chunk_once(spark):
    """The chunks' table is read once for all checksums, not for the frequent and for the other chunks again."""
    store = scratch(spark, "test-store")
    token_store.write_store(frame(spark, [words(300, 5), words(300, 6)]), TOKENIZER, store)
    plan = token_store.stored_digests(spark, store)._jdf.queryExecution().optimizedPlan().toString()
    assert "crcs(" not in plan and "shifted(" in plan


def test_store_notices_damage(spark):
    store = scratch(spark, "test-store")
    token_store.write_store(frame(spark, [words(300, 5)]), TOKENIZER, store)
    spark.read.parquet(f"{store}/manifest").withColumn("root", F.lit("0")).write.parquet(f"{store}/other")
    spark.read.parquet(f"{store}/other").write.mode("overwrite").parquet(f"{store}/manifest")
    with pytest.raises(Exception, match="manifest"):
        token_store.stored_digests(spark, store).collect()


def prints(texts):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        c = Counter(k for s in sh for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for k in range(64) if h >> k & 1)
        out.append(sum(1 << k for k, n in c.items() if n * 2 > len(sh)))
    return out


def joined(n, links):
    part = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(part[a], part[b])
            changed |= part[a] != low or part[b] != low
            part[a] = part[b] = low
    return part


def near_texts():
    base = words(200, 9).split()
    out = list(ODD)
    for i in range(40):
        one = list(base)
        one[i * 5] = f"w{i}"
        out.append(" ".join(one))
    return out + [words(120, s) for s in range(20)]


@pytest.mark.parametrize("chunk", [4096, 8])
def test_simhash_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    texts = near_texts()
    fp = prints(texts)
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    got = simhash.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in fp]
    assert [r.component_id for r in got] == joined(len(fp), links)


def test_similar_documents_find_what_jaccard_finds(spark):
    texts, r = [], random.Random(3)
    for s in range(60):
        base = words(300, 1000 + s).split()
        texts.append(" ".join(base))
        for changes in (2, 60):  # similarities about 0.93 and below 0.2
            one = list(base)
            for at in r.sample(range(300), changes):
                one[at] = f"w{r.random()}"
            texts.append(" ".join(one))
    got = {d.doc_id: d.component_id for d in simhash.similar_documents(frame(spark, texts + ODD)).collect()}
    assert all(got[i] == i and got[i + 1] == i and got[i + 2] == i + 2 for i in range(0, 180, 3))
    assert got[180] == got[181] == got[182] == 180 and got[193] == got[194]


def shingle_sets(texts):
    found = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in found]


def test_similar_documents_equal_exact_jaccard(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 16)
    texts, r = [], random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    for s in range(240):  # pairs of similarities from 0.70 to 0.85: the tail of one is replaced
        base = [word() for _ in range(r.choice((60, 300)))]
        n = len(base) - 4
        cut = round(n * (1 - 2 * (0.7 + s % 16 / 100) / (1.7 + s % 16 / 100)))
        texts += [" ".join(base), " ".join(base[: len(base) - cut] + [word() for _ in range(cut)])]
    for n in [8, 9, 10] * 60:  # short ones: 5 / 6 or less, 4 / 5, and 5 / 7 for a changed last word
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join(base[:-1] + ([word()] if n == 10 else []))]
    line = [word() for _ in range(12)]
    texts += [" ".join(line * 20 + [word() for _ in range(40)]) for _ in range(30)]  # one repeated line, other words
    base = [word() for _ in range(200)]
    texts += [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(100)]  # a group of several chunks
    sets = shingle_sets(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    want = joined(len(texts), links)
    got = {d.doc_id: d.component_id for d in simhash.similar_documents(frame(spark, texts)).collect()}
    wrong = [i for i, p in enumerate(want) if got[i] != p]
    assert all(got[i] == i for i in wrong) and len(wrong) <= 0.01 * len(texts)  # nothing is linked below 0.8; the tables may miss some


def test_pivot_keys_lose_no_pair():
    r = random.Random(4)
    for expected_rows in (10, 10**6, 10**9):
        chosen = simhash.stretches(4, expected_rows)
        a = np.array([r.getrandbits(64) for _ in range(300)], np.uint64)
        b = a ^ np.array([sum(1 << k for k in r.sample(range(64), 4)) for _ in a], np.uint64)
        assert (simhash.pivot_keys(a, chosen) == simhash.pivot_keys(b, chosen)).any(axis=1).all()
        assert (np.abs(simhash.distances(a[:, None], simhash.pivots()) - simhash.distances(b[:, None], simhash.pivots())) <= 4).all()
        c = np.array([r.getrandbits(64) for _ in a], np.uint64)
        assert (simhash.pivot_keys(a, chosen) == simhash.pivot_keys(c, chosen)).any(axis=1).mean() < 0.3


def test_walk_turns_every_bit_once():
    refs = simhash.walk().ravel()
    steps = refs[1:] ^ refs[:-1]
    assert np.bitwise_or.reduce(steps) == np.uint64(2**64 - 1) and (np.bitwise_count(steps) == simhash.STEP).all() and len(refs) == 33


def test_components(spark):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)]
    want = joined(600, links)
    got = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {g.node: g.component for g in got} == {n: want[n] for e in links if e[0] != e[1] for n in e}


def vectors(spark, x, labels=None, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, v, None if labels is None else labels[i], "k") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, key string")


def cloud(n, seed):
    g = np.random.default_rng(seed)
    x = g.standard_normal((n, 16)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + 0.03 * g.standard_normal((n - n // 2, 16)).astype(np.float32)
    return x


BAD = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] + [1.0] * 15]


def cosines(x):
    x = np.asarray(x, np.float64)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return u @ u.T


def test_nearest(spark):
    x = cloud(400, 1)
    df = vectors(spark, x.tolist() + BAD)
    got = ann.nearest(df, df.filter("vec_id % 10 = 0")).collect()
    s = cosines(x)
    np.fill_diagonal(s, -2)
    best = {q: set(np.argsort(-s[q], kind="stable")[:5]) for q in range(0, 400, 10)}
    assert len(got) == 40 * 5 and sum(r.vec_id in best[r.query_id] for r in got) >= 0.9 * len(got)
    assert all(abs(r.score - s[r.query_id, r.vec_id]) < 1e-9 for r in got)


def test_nearest_ties_and_few_rows(spark):
    df = vectors(spark, [[1.0, 0.0]] * 8 + [[0.0, 1.0]])
    got = [(r["rank"], r.vec_id) for r in ann.nearest(df, df.filter("vec_id = 3")).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 1), (3, 2), (4, 4), (5, 5)]
    few = vectors(spark, [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]])
    assert ann.nearest(few, few.filter("vec_id = 0")).count() == 2
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_nearest_counts_repeated_ids_once(spark):
    x = cloud(300, 6)
    rows = [(i, v) for i, v in enumerate(x.tolist()) for _ in range(2 + 4 * (i % 3 == 0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.filter("vec_id % 10 = 0")).collect()
    s = cosines(x)
    np.fill_diagonal(s, -2)
    best = {q: set(np.argsort(-s[q], kind="stable")[:5]) for q in range(0, 300, 10)}
    assert len(got) == len({(r.query_id, r.vec_id) for r in got}) == 30 * 5 and sum(r.vec_id in best[r.query_id] for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize("chunk", [2048, 16])
def test_vector_links_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    x = np.concatenate([cloud(200, 2), np.repeat(cloud(2, 3)[:1], 50, axis=0)])
    labels = [i % 2 for i in range(200)] + [0] * 50
    labels[7] = None
    s = cosines(x) >= 0.98
    links = [(i, j) for i in range(250) for j in range(i) if s[i, j] and labels[i] is not None and labels[i] == labels[j]]
    degree = Counter(n for e in links for n in e)
    got = vector_dedup.near_duplicates(vectors(spark, x.tolist() + BAD, labels + [0] * 5)).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == [degree[i] for i in range(255)]
    part = joined(255, links)
    assert [r.component_id for r in got] == part and [r.kept for r in got] == [p == i for i, p in enumerate(part)]


def test_copies_of_one_vector_are_never_compared(spark, monkeypatch):
    x = np.concatenate([np.repeat(cloud(2, 3), 3000, axis=0), cloud(5, 3)])
    df = vectors(spark, x.tolist(), [0] * len(x))
    classes = df.select("embedding").distinct().count()
    got = vector_dedup.near_duplicates(df).orderBy("vec_id").collect()
    assert classes < 12 and got[0].n_links >= 2999 and got[0].component_id == 0 and got[2999].component_id == 0
    again = vectors(spark, [x[0].tolist(), x[0].tolist(), x[1].tolist(), x[4000].tolist()], [0, 0, 0, 0], ids=[4, 4, 5, 4])
    assert {(r.vec_id, r.n_links) for r in vector_dedup.near_duplicates(again).collect()} == {(4, 2), (5, 2)}  # either vector of 4 links with 5


@pytest.mark.parametrize("chunk", [4096, 16])
def test_nearest_splits_queries_too(spark, monkeypatch, chunk):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    x = np.repeat(cloud(8, 6), 25, axis=0) + np.random.default_rng(1).normal(0, 0.01, (200, cloud(8, 6).shape[1]))
    df = vectors(spark, x.tolist(), [0] * len(x))
    got = ann.nearest(df, df).collect()
    s = cosines(x.astype(np.float32).astype(float))
    np.fill_diagonal(s, -2)
    best = {i: set(np.lexsort((np.arange(len(x)), -s[i]))[:5].tolist()) for i in range(len(x))}
    assert len(got) == 1000 and np.mean([r.vec_id in best[r.query_id] for r in got]) >= 0.9


def removed(texts):
    found = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(found):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, w in enumerate(found):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def test_passages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(substring, "BLOCKS_PER_BUCKET", 1)
    passage = words(30, 77)
    texts = [*near_texts(), "the " * 40, "the " * 13, "x " + "the " * 12 + "y", "a b " * 30, "q a b " + "a b " * 8, *(words(20, 100 + i) + " " + passage[i:] + " " + words(9, i) for i in range(25)), words(12, 5), words(13, 6), words(13, 6)]
    got = substring.kept_digests(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == removed(texts)


def test_passages_shuffle_texts_once(spark):
    """All rounds are one query: no table is written between them, and the texts' one exchange is read by each."""
    made, df = len(_MADE), substring.kept_digests(frame(spark, near_texts()))
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in df.orderBy("doc_id").collect()] == removed(near_texts())
    assert len(df.collect()) == len(near_texts()) and len(_MADE) == made
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"ReusedExchange \[[^\]]*text#", plan)) == 3


def test_symbols_agree_inside_equal_passages():
    r = random.Random(2)
    for trial in range(300):
        shared = [r.choice("abcd") for _ in range(13)]
        found = []
        for side in range(2):
            text = " ".join([*(r.choice("abcd") for _ in range(r.randrange(9))), *shared, *(r.choice("abcd") for _ in range(r.randrange(9)))])
            at = len(text.split()) and next(i for i in range(len(text.split())) if text.split()[i : i + 13] == shared)
            _, _, word, _, of = substring.word_hashes(pa.array([text], pa.large_string()))
            key, _, low, high = substring.inside(*substring.recompressed(word, of))
            assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
            inside = (low >= at) & (high <= at + 13)
            found.append(sorted(zip((low[inside] - at).tolist(), key[inside].tolist(), strict=True)))
        assert found[0] == found[1], trial


def test_symbols_decide_which_windows_go_on():
    """Windows are named by what recompression made of them: equal ones alike, and those of unshared symbols never."""
    passage, r = words(40, 3), random.Random(1)
    texts = [f"{words(r.randrange(3, 30), 50 + i)} {passage} {words(r.randrange(3, 30), 90 + i)} the the the" for i in range(6)]
    block = substring.Block(pa.table({"doc_id": list(range(6)), "text": texts}), 4)
    block.learn(0, block.twice[0])
    block.learn(1, block.twice[1])
    at, name, check = block.windows()
    by, every = {}, block.words.to_pylist()
    for p, n, c in zip(at.tolist(), name.tolist(), check.tolist(), strict=True):
        own = tuple(every[p : p + 13])
        assert by.setdefault((n, c), own) == own
    assert len(set(by.values())) == len(by)
    windows = Counter(tuple(f[k : k + 13]) for f in map(str.split, texts) for k in range(len(f) - 12))
    repeated = {w for w, n in windows.items() if n > 1}
    assert repeated <= set(by.values()) and len(at) < 0.8 * sum(windows.values())
    block.levels[0] = (*block.levels[0][:4], np.zeros(len(block.levels[0][0]), bool))
    assert len(block.windows()[0]) < 0.1 * len(at)


def test_mixing_budgets(spark):
    texts = [words(n, n) for n in range(1, 60)] + ODD
    sources = [("a", "b", "c", None)[i % 4] if i > 20 else "a" for i in range(len(texts))]
    got = mixing.mix(frame(spark, texts, sources=sources)).collect()
    sizes = [len(WORD.findall(t or "")) for t in texts]
    assert sorted((r.doc_id, r["size"]) for r in got) == list(enumerate(sizes))
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * sum(sizes)) < 1e-6
    assert all(abs(sum(r.taken for r in own) - own[0].target) < 1 and own[0].target <= 2 * own[0].source_size for own in by.values())
    mixed = mixing.mixed_documents(frame(spark, texts, sources=sources))
    assert mixed.columns == [f.split()[0] for f in DOCS.split(", ")]
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(WORD.findall(r.text or ""))
    assert all(taken[r.doc_id] == r.taken for r in got)


def test_mixing_judges_rows_and_not_ids(spark):
    texts = [words(n % 17 + 1, n) for n in range(90)]
    ids = [n if n < 40 else (7 if n < 60 else None) for n in range(90)]
    docs = frame(spark, texts, ids=ids, sources=["ab"[n % 2] for n in range(90)]).withColumns({c: F.lit("mine") for c in ("_taken", "_size", "_copy", "number", "copy", "taken", "row")})
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r._taken for r in mixed.collect()} == {"mine"}
    targets = {r.source: r.target for r in mixing.mix(docs).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r.source] += len(WORD.findall(r.text))
    assert got == {s: int(t) for s, t in targets.items()}


def test_archives(spark):
    big = "<p>" + words(60, 1) + "</p>"
    data = [(3, "http://a", big), (1, "http://b", big), (2, None, "short"), (4, "u\r\nv", "short"), (5, "x", None), (6, "y", "é" * 60), (7, "z", big), (None, "n", big), (8, "q", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, scratch(spark, "test-warc")).collect()}
    for i, _, html in data:
        raw = (html or "").encode()
        revisit = html == big and i in (3, 7)
        assert got[i] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None)


def test_archives_repeat_and_roll(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 2000)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sums = []
    for _ in range(2):
        to = scratch(spark, "test-warc")
        warc.write(pages, to)
        sums.append(sorted((r.file, r.sha256) for r in spark.read.parquet(f"{to}/manifest").collect()))
        payloads = {r.page_id: r.payload for r in warc.read(spark, to).collect() if r.record_type == "response"}
        assert all(payloads[r.page_id].decode() == r.html for r in pages.collect() if r.page_id in payloads)
    assert sums[0] == sums[1] and len(sums[0]) > 3


@pytest.mark.parametrize("ids", ["distant", "random", "alike", "one id"])
def test_shards_follow_bytes_not_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(warc, "SHARD", 100_000)
    r = random.Random(4)
    pages = {
        "distant": [(i, "u", f"{i} " + "x" * 1500) for i in range(800)] + [(1 << 62, "u", "far")],
        "random": [(r.randrange(-(1 << 63), 1 << 63), "u", f"{i} " + "x" * 1500) for i in range(800)],
        "alike": [(None, "u", "y" * 1500)] * 800 + [(i, "u", "short") for i in range(9)],
        "one id": [(7, f"http://é\n{i}", "z" * 1500) for i in range(800)] + [(6, "first", "z" * 1500)],
    }[ids]
    to = scratch(spark, "test-warc")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), to)
    listed = spark.read.parquet(f"{to}/manifest").collect()
    by_shard = Counter()
    for m in listed:
        by_shard[m.file.split("-")[0]] += m.records
    assert max(by_shard.values()) * 2012 <= 2 * 100_000 and len(by_shard) >= 13
    got = warc.read(spark, to).collect()
    assert Counter((g.page_id, g.url, g.payload_digest) for g in got) == Counter((i, u, hashlib.sha256(h.encode()).hexdigest()) for i, u, h in pages)
    assert [g.record_type for g in got].count("revisit") == (800 if ids == "one id" else 0) and {g.refers_to for g in got} - {None} == ({6} if ids == "one id" else set())
    raw = [x.content for x in spark.read.format("binaryFile").load(f"{to}/files").collect()]
    names = [h["WARC-Record-ID"] for x in raw for h, _, _ in warc.records(bytes(x))]
    assert len(names) == len(set(names)) == len(pages)
    assert {h["WARC-Refers-To"] for x in raw for h, _, _ in warc.records(bytes(x)) if "WARC-Refers-To" in h} <= set(names)


def test_surrogates(spark):
    texts = [*ODD, "mail a.b@c.example.com or A.B@C.EXAMPLE.COM, call +1 (212) 555-0001 or 212-555-0002", "ip 10.1.2.3, card 4111111111111111, 4111 1111 1111 1111 and ssn 123-45-6789", 'token = "0123456789abcdef0123456789abcdef01234567" a.b@c.example.com', "Mr. John Smith, Mrs. Jane Smith; v4.0. in 2024 costs 1,234.50", "Господин Иванов 10.1.2.3"]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in pii.replace(df, "k").collect()}
    pattern = re.compile(r"a\.b@c|A\.B@C|555-000|10\.1\.2\.3|411111|4111 1111|123-45-6789|0123456789abcdef|John|Jane|Иванов")
    n = len(ODD)
    assert [got[i].n_entities for i in range(len(texts))] == [0] * n + [4, 4, 2, 2, 2]
    assert all(got[i].text == t for i, t in enumerate(ODD)) and not any(pattern.search(got[i].text) for i in range(n, len(texts)))
    first, second, third, fourth, last = (got[n + i].text for i in range(5))
    mail = re.search(r"mail (\S+) or (\S+),", first)
    assert mail[1] in third and mail[2] == mail[1].upper() and mail[1].endswith(".com")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}$", first) and "v4.0. in 2024 costs 1,234.50" in fourth
    card = re.search(r"card (\d{16}), (\d{4} \d{4} \d{4} \d{4})", second)
    digits = [int(c) for c in card[1]]
    assert card[1] == card[2].replace(" ", "") and sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"ip (\S+),", second)[1] == last.split()[-1] and re.search("^Господин [А-Я]", last)
    assert set(got[n].asDict()) == set(df.columns) and "Python" not in pii.replace(df, "k")._jdf.queryExecution().toString()


def test_surrogates_stay_distinct(spark):
    people = [f"Mr. {chr(65 + i)}{c}a{c} {chr(65 + i)}{c}o" for i in range(26) for c in "bcdfghjklm"]
    got = pii.replace(frame(spark, people), "k").orderBy("doc_id").collect()
    assert len({r.text for r in got}) == len(people) and not set(people) & {r.text for r in got}


def test_printed_names_stay_distinct_and_consistent(spark):
    surnames = [f"{a}{b}son" for a in "BCDFGHJKLM" for b in ("a", "e", "i", "o")] + ["Berger", "Abel"]
    russian = [f"{a}{b}нов" for a in "БВГДЗК" for b in "аеиоу"]
    texts = [f"Mr. {n}" for n in surnames] + [f"Mr. Adam {n}" for n in surnames] + [f"Mrs. Clara {n}" for n in surnames] + [f"Господин {n}" for n in russian]
    got = [r.text for r in pii.replace(frame(spark, texts), "k").orderBy("doc_id").collect()]
    n = len(surnames)
    alone = [t.split()[-1] for t in got[:n]]
    assert len(set(alone)) == n and not set(alone) & set(surnames)
    assert [t.split()[-1] for t in got[n : 2 * n]] == alone == [t.split()[-1] for t in got[2 * n : 3 * n]]
    assert all(len(t.split()) == 3 and t.split()[1] not in ("Adam", "Clara") for t in got[n : 3 * n])
    assert len(set(got[3 * n :])) == len(russian) and all(re.fullmatch("Господин [А-Яа-я-]+", t) for t in got[3 * n :])


@pytest.mark.parametrize("secret", ["abcdefab" * 4, "AKIA" + "QWERTYUI" * 2, "ghp_" + "abcdefghi" * 4])
def test_secrets_without_digits_are_found(spark, secret):
    got = pii.replace(frame(spark, [f"the key is {secret} here"]), "k").first()
    assert got.n_entities == 1 and secret not in got.text


def test_real_names_are_never_handed_out(spark):
    people = [f"Mr {g} {a}{b}" for g in pii.GIVEN["latin_m"] for a in pii.STEMS["latin"] for b in pii.ENDINGS["latin"][:1]]
    got = [r.text for r in pii.replace(frame(spark, people), "k").collect()]
    assert len(set(got)) == len(people) and not set(got) & set(people)


def test_kinds_that_run_out_grow(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.io" for a in letters for b in letters]
    got = [r.text for r in pii.replace(frame(spark, mails), "k").collect()]
    assert len(set(got)) == len(mails) and not set(got) & set(mails) and all(t.endswith(".io") for t in got)
    near = [f"192.168.{i // 250}.{i % 250 + 1}" for i in range(1500)]
    got = [r.text for r in pii.replace(frame(spark, near), "k").collect()]
    assert len(set(got)) == len(near) and not set(got) & set(near) and all(t.startswith(("192.168.", "10.")) for t in got)


def test_spellings_of_one_entity_keep_together(spark):
    texts = ["+1 212 555 0199", "212 555 0199", "(212) 555-0199", "+44 20 7946 0958", "020 7946 0958", "+44 (0)20 7946 0958", "+33 6 12 34 56 78", "06 12 34 56 78", "Mr John Smith", "Mr Smith", "Mrs. Smith", "Dr. van der Berg", "Mr Berg", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"]
    got = [r.text for r in pii.replace(frame(spark, texts), "k").orderBy("doc_id").collect()]
    digits = [re.sub(r"\D", "", t) for t in got]
    assert digits[0] == "1" + digits[1] == "1" + digits[2] and digits[3][2:] == digits[4][1:] == digits[5][3:] and digits[6] == "33" + digits[7][1:]
    assert digits[3].startswith("44") and digits[4].startswith("0") and digits[5].startswith("440") and not set(got) & set(texts)
    assert got[8].split()[-1] == got[9].split()[-1] == got[10].split()[-1] and got[11].startswith("Dr. van der ") and got[11].split()[-1] == got[12].split()[-1]
    assert got[13].replace(" ", "") == got[14] and int("".join(str(int(c, 36)) for c in got[14][4:] + got[14][:4])) % 97 == 1


PLANTED = {
    "person": ["Mr Jean-Luc Picard", "Mr O'Brien", "Miss Ada Byron", "Господин Пётр Сидоров", "Frau Müller", "Mr. J. Smith"],
    "phone": ["+44 20 7946 0958", "+49 30 123456", "06 12 34 56 78", "212-555-0187", "+442079460958"],
    "email": ["почта@пример.рф", "j.doe+x@mail.example.org"],
    "ip": ["8.8.4.4", "10.0.0.7"],
    "ip6": ["fe80::1ff:fe23:4567:890a", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"],
    "iban": ["DE89 3702 0400 4400 5320 13"],
    "card": ["4111-1111-1111-1111"],
    "secret": ["AKIA" + "QWERTYUI" * 2, "ghp_" + "aB3" * 12, "0123456789ABCDEF" * 2],
}


def test_surrogates_equal_brute_force(spark):
    """Known entities between known words: all else stays, and each takes the format, script and case of the original, alike in all texts."""
    r, every = random.Random(8), [(k, v) for k, own in PLANTED.items() for v in own]
    plans = [[every[i % len(every)] if i < 60 else r.choice(every) for _ in range(r.randrange(1, 6))] for i in range(120)]
    filler = ["the sum of 12:34:56 was 1,234.50 on 2024-01-02;", "std::vector v4.0. (see 17);", "plain words and Mr, or Frau,"]
    texts, shapes = [], []
    for i, plan in enumerate(plans):
        parts = [filler[(i + j) % 3] for j in range(len(plan) + 1)]
        texts.append("".join(f"{p} {e[1]} " for p, e in zip(parts, plan, strict=False)) + parts[-1])
        shapes.append(parts)
    got, told = {x.doc_id: x for x in pii.replace(frame(spark, texts), "k").collect()}, {}
    mask = lambda t: re.sub("[а-яё]", "я", re.sub("[А-ЯЁ]", "Я", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))))
    for i, plan in enumerate(plans):
        assert got[i].n_entities == len(plan), texts[i]
        found = re.fullmatch(" (.+?) ".join(map(re.escape, shapes[i])), got[i].text)
        assert found, got[i].text
        for (kind, old), new in zip(plan, found.groups(), strict=True):
            assert told.setdefault(old, new) == new and new != old
            if kind in ("phone", "iban", "card", "email"):
                assert mask(new) == mask(old)
            elif kind == "secret":
                assert len(new) == len(old) and new[:4] == old[:4] if old[0] in "Ag" else re.fullmatch("[0-9A-F]{32}", new)
            elif kind == "person":
                assert new.split()[0] == old.split()[0] and bool(re.search("[А-Я]", new.split()[-1])) == bool(re.search("[А-Я]", old.split()[-1])) and len(new.split()) == len(old.split())
            elif kind == "ip":
                assert re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", new) and new.startswith("10.") == old.startswith("10.")
    assert len(set(told.values())) == len(every)


def corpus(spark):
    texts = [words(60, i) for i in range(300)] + ["#@! " * 40, "ZZ$$ QQ%% " * 20, "", None]
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(250)] + [(300, 0, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    return texts, labels


def test_quality_rejects_what_reads_otherwise(spark):
    texts, labels = corpus(spark)
    got = {r.doc_id: r for r in quality.classify(frame(spark, texts), labels).collect()}
    assert not got[300].keep and not got[301].keep and got[302].keep and got[303].keep and got[302].perplexity is None
    assert sum(got[i].keep for i in range(300)) >= 285
    other = quality.classify(frame(spark, ["abc"], ids=[900], langs=["xx"]), labels).first()
    assert other.keep and other.perplexity is None
    assert quality.classify(frame(spark, texts), labels.limit(0)).filter("keep").count() == len(texts)


def test_quality_samples_every_language(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    docs = frame(spark, ["x"] * 1000, langs=["aa" if i % 25 == 3 else "bb" for i in range(1000)])
    got = quality.trusted_ids(labels, 200, docs).collect()
    small = [r for r in got if r.doc_id % 25 == 3]
    assert len(got) == 200 and len(small) == 40 and sum(r.held_out for r in small) == 8
    assert sum(r.held_out for r in got) == 40


def test_quality_fits_on_all_trusted_documents(spark):
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    told = quality.trusted_ids(labels, docs=spark.range(25_000).selectExpr("id AS doc_id", "if(id % 5 = 0, 'aa', 'bb') AS lang")).groupBy("held_out").count().collect()
    assert {r.held_out: r["count"] for r in told} == {True: 5000, False: 20_000}


def test_quality_keeps_no_counts_beside_the_costs(spark):
    """The tables that the costs were made of are deleted before texts and costs meet; what is still read stays."""
    texts, labels = corpus(spark)
    made = set(_MADE)
    scored = quality.perplexities(frame(spark, texts), quality.trusted_ids(labels))
    left = [p.split("/")[-1].rsplit("-", 1)[0] for p in _MADE if p not in made]
    assert "lm-costs" in left and "lm-needed" not in left and "lm-counts" not in left
    assert scored.count() == len(texts)


def test_quality_shards_repeat_few_ngrams(spark):
    """An n-gram is shuffled, and its cost once more, for each shard that has it; the number of shards grows with the text."""
    assert [quality._shards(n) for n in (None, 0, 40 << 20, 816 << 20, 8160 << 20)] == [1, 1, 1, 18, 171]


def test_quality_limits_are_exact_quantiles_of_all_costs(spark):
    g = np.random.default_rng(8)
    costs = {"aa": np.round(g.normal(size=1234), 2), "bb": g.normal(size=quality.HELD), "cc": g.normal(size=quality.HELD - 1)}
    held = spark.createDataFrame([(lang, i, float(x)) for lang, own in costs.items() for i, x in enumerate(own)], "lang string, doc_id long, cost double")
    got = {r.lang: r.limit for r in quality._limits(held).collect()}
    told = {k: np.quantile(v, 0.5) + quality.REACH * (np.quantile(v, quality.UPPER) - np.quantile(v, 0.5)) for k, v in costs.items() if k != "cc"}
    assert got == pytest.approx(told, abs=1e-12)


def test_quality_needs_held_out_documents_and_goes_by_row(spark):
    texts, labels = corpus(spark)
    few = [words(60, 9000 + i).upper() for i in range(12)]  # a language of few trusted documents: one or two are held out
    ids = [*range(300), None, 260, 302, 303, *range(400, 412)]
    labels = labels.select("doc_id", "quality", "toxic").union(spark.createDataFrame([(i, 1, 0) for i in range(400, 406)], "doc_id long, quality int, toxic int"))
    docs = frame(spark, texts + few, ids=ids, langs=["en"] * len(texts) + ["yy"] * 12)
    judged = quality.classify(docs, labels).filter("lang = 'yy'").collect()
    assert len(judged) == 12 and all(r.keep and r.threshold is None for r in judged)
    got = [(r.doc_id, r.text) for r in quality.kept(docs, labels).collect()]
    assert (None, texts[300]) not in got and (260, texts[301]) not in got and (260, texts[260]) in got


def test_long_texts_are_taken_in_slices(spark, monkeypatch):
    texts, labels = corpus(spark)
    whole = {r.doc_id: r.cost for r in quality.perplexities(frame(spark, texts), quality.trusted_ids(labels)).collect()}
    monkeypatch.setattr(quality, "AT_ONCE", 64)
    monkeypatch.setattr(quality, "SHARD_BYTES", 3000)
    sliced = {r.doc_id: r.cost for r in quality.perplexities(frame(spark, texts), quality.trusted_ids(labels)).collect()}
    assert set(whole) == set(sliced) and all((whole[i] is None and sliced[i] is None) or abs(whole[i] - sliced[i]) < 1e-9 for i in whole)
    assert quality.grams(b"abcdef" * 100).tolist() == np.concatenate(list(quality.slices("abcdef" * 100))).tolist()


def test_quality_probabilities_are_kneser_ney(spark):
    texts, labels = corpus(spark)
    df = frame(spark, texts)
    trusted = quality.trusted_ids(labels)
    fitted = [texts[r.doc_id] for r in trusted.filter("NOT held_out").collect()]
    mask = [(1 << 8 * k) - 1 for k in range(6)]
    tables = {5: Counter(int(g) for t in fitted for g in quality.grams(t))}
    for k in (4, 3, 2, 1):
        tables[k] = Counter(g & mask[k] for g in tables[k + 1])

    def discount(k):
        n = [max(1, sum(c == i for c in tables[k].values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [max(0.05, min(i, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]

    d = {k: discount(k) for k in tables}
    context = {k: {} for k in tables}
    for k, table in tables.items():
        for g, c in table.items():
            own = context[k].setdefault(g >> 8, [0, 0.0])
            own[0] += c
            own[1] += d[k][min(c, 3) - 1]

    def cost(gram):
        p = 1 / 256
        for k in range(1, 6):
            g = gram & mask[k]
            if g >> 8 in context[k]:
                total, freed = context[k][g >> 8]
                c = tables[k].get(g, 0)
                p = ((c - d[k][min(c, 3) - 1] if c else 0) + freed * p) / total
        return -np.log(p)

    got = {r.doc_id: r.cost for r in quality.perplexities(df, trusted).collect()}
    for i in (0, 120, 290, 300, 301):
        assert abs(got[i] - np.mean([cost(int(g)) for g in quality.grams(texts[i])])) < 1e-9


@pytest.mark.parametrize("run", [lambda d, s: simhash.near_duplicates(d), lambda d, s: bpe.encoded_digests(d, TOKENIZER), lambda d, s: substring.kept_digests(d), lambda d, s: mixing.mix(d), lambda d, s: mixing.mixed_documents(d), lambda d, s: pii.replace(d, "k"), lambda d, s: simhash.one_of_each(d)])
def test_null_and_repeated_ids_and_empty_tables(spark, run):
    texts = [words(30, 1), words(30, 1), words(30, 2), None, ""]
    df = frame(spark, texts, ids=[None, 5, 5, None, 7])
    assert run(df, spark).count() >= 4
    assert run(df.limit(0), spark).count() == 0


def test_store_archive_and_model_of_nothing(spark):
    store, none = scratch(spark, "test-store"), frame(spark, ["x"]).limit(0)
    token_store.write_store(none, TOKENIZER, store)
    assert token_store.stored_digests(spark, store).count() == 0
    assert warc.round_trip(spark.read.parquet(f"{SF}/pages.parquet").limit(0), scratch(spark, "test-warc")).count() == 0
    assert quality.classify(none, corpus(spark)[1]).count() == 0
    assert vector_dedup.near_duplicates(vectors(spark, cloud(4, 1).tolist(), [1] * 4).limit(0)).count() == 0


def test_surrogates_of_very_long_texts(spark):
    """A megabyte of what a pattern repeats: no text exhausts the matcher's stack."""
    long = ["x@a" + ".a" * 500_000 + ".com", "Mr A" + "-a" * 500_000, "Mr " + "de " * 300_000 + "Silva", "Mr " + "J. " * 300_000 + "Smith", "1 " * 500_000, "AB12 " + "ABCD " * 200_000, "+49 " + "1 " * 500_000, "fe80:" * 200_000, "A. " * 300_000, "sk-" + "a" * 1_000_000]
    got = pii.replace(frame(spark, [*long, "mail jo@b.c.org to Mr J. R. de la Cruz"]), "k").orderBy("doc_id").collect()
    assert len(got) == len(long) + 1 and [r.n_entities for r in got[:4]] == [0, 1, 0, 1] and max(len(r.text) for r in got) < 1.2e6
    assert got[4].text == long[4] and got[len(long)].n_entities == 2 and not re.search("jo@b|Cruz", got[len(long)].text)


def test_surrogates_need_a_key_and_differ_by_it(spark):
    import hmac

    df = frame(spark, ["Mr John Smith wrote", "call 555-123-4567 or 555-123-4568"])
    one, two, again = ([r.text for r in pii.replace(df, k).orderBy("doc_id").collect()] for k in ("one", "two" * 70, "one"))
    assert one == again and one != two
    with pytest.raises(ValueError, match="key"):
        pii.replace(df, "")
    for key in ("k", "long" * 60):
        told = spark.range(1).select(pii.keyed_digest(key, F.lit("a|0|é")).alias("d")).first().d
        assert told == hmac.new(key.encode(), "a|0|é".encode(), "sha512").hexdigest()


def test_a_frequent_entity_is_joined_without_gathering_it(spark):
    texts = ["write to help@corp.example now"] * 3000 + [f"write to u{i}@corp.example now" for i in range(50)]
    got = pii.replace(frame(spark, texts), "k").collect()
    assert len({r.text for r in got}) == 51 and all(r.n_entities == 1 and "@" in r.text for r in got)
