"""The pipeline's stages: each keeps the columns of documents, and each decision takes effect."""

import hashlib
import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF
from tidemark.llm import quality
from tidemark.llm.common import materialise
from tidemark.llm.entries import TOKENIZER, table


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def first_of_each(rows):
    """Brute force over all pairs: the smallest id of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    sets = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    part, ids = {i: i for i in sets}, list(sets)

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            union = len(sets[a] | sets[b])
            if sets[a] == sets[b] or (union and len(sets[a] & sets[b]) / union >= 0.8):
                low, high = sorted((root(a), root(b)))
                part[high] = low
    return {i for i in ids if root(i) == i}


def mixed(rows):
    """Brute force: the words that the mix takes of each document."""
    sizes, keys, by = {}, {}, {}
    for r in rows:
        sizes[r.doc_id], keys[r.doc_id] = len(WORD.findall(r.text or "")), hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()
        by.setdefault(r.source, []).append(r.doc_id)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight, total = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {s: sum(sizes[i] for i in by[s]) for s in order}
    target, budget, open_ = {}, 1.5 * sum(total.values()), set(order)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        if not over:
            break
        target |= {s: 2 * total[s] for s in over}
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for s, ids in by.items():
        epochs, rest = divmod(int(target[s]), total[s]) if total[s] else (0, 0)
        for i in sorted(ids, key=lambda i: (keys[i], i)):
            more = min(sizes[i], rest)
            rest -= more
            taken[i] += epochs * sizes[i] + more
    return Counter({i: n for i, n in taken.items() if n})


def test_stages(spark):
    docs, kept = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append(docs)
    start = table(spark, SF, "documents")
    rejected = {r.doc_id for r in quality.classify(start, table(spark, SF, "labels")).filter("NOT keep").collect()}
    first = {r.doc_id for r in kept[0].collect()}
    assert rejected and first == {r.doc_id for r in start.collect()} - rejected
    assert {r.doc_id for r in kept[1].collect()} == first_of_each(kept[0].collect()) and len(kept[1].collect()) < len(first)
    assert kept[2].count() == kept[1].count()
    texts = {r.doc_id: r.text for r in kept[1].collect()}
    assert any(r.text != texts[r.doc_id] for r in kept[2].collect()) and all(r.n_chars == len(r.text) for r in kept[2].collect())
    words = Counter()
    for r in kept[3].collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == mixed(kept[2].collect())
    last = corpus_pipeline.STAGES[-1][1](spark, kept[3], SF).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = [hashlib.sha256(np.array(tokenizer.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in kept[3].collect()]
    assert sorted(r.ids_sha256 for r in last) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "pii", "mixing", "encoding"] and corpus_pipeline.ORACLE_SQL is None
