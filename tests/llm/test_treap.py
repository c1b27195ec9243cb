import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import WORDS, odd_rows, prose

from flowwarden.llm import treap_index as ti

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, k):
    own = [(i, terms_of(t)) for i, t in docs]
    own = [(i, t, Counter(t)) for i, t in own if t]
    n_docs, n_terms = len(own), sum(len(t) for _, t, _ in own)
    df = Counter(w for _, _, c in own for w in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w in set(terms_of(text)) if df[w]}
        scored = []
        for i, t, c in own:
            m = 100 - 50 + (50 * len(t) * n_docs) // n_terms
            s = sum(x * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w, x in weight.items())
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item_id, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, k, shard_terms=ti.SHARD_TERMS, parts=3):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    found = ti.ranked_search(d, i, k, shard_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("shard_terms, k", [(10**9, 50), (400, 7), (1, 3)])
def test_against_all_scores(spark, shard_terms, k):
    docs = [(i, prose(i, 5 + i % 60, WORDS[: 20 + i % 150])) for i in range(200)]
    docs += [(1000 + i, docs[5][1]) for i in range(90)]  # equal scores at and beyond the k-th place
    items = [(i, prose(5000 + i, 12, WORDS[:160])) for i in range(12)] + [(50, docs[5][1]), (51, "nowhere found"), (52, docs[5][1].upper())]
    assert ranked(spark, docs, items, k, shard_terms) == brute(docs, items, k)


@pytest.mark.parametrize("wave", [1, 2, 1000])
def test_treap_finds_the_best(monkeypatch, wave):
    monkeypatch.setattr(ti, "WAVE", wave)
    rng = np.random.default_rng(wave)
    for n_rows, n_columns in ((1, 1), (3, 50), (700, 9), (40, 40)):
        points = np.unique(rng.integers(0, [n_rows, n_columns], size=(200, 2)), axis=0)
        value = rng.integers(0, 30, size=len(points)).astype(np.int64)
        docs = rng.permutation(n_columns) + 5
        built = ti.build_treap(points[:, 0], points[:, 1], value)
        treap = ti.Treap(*built, docs)
        grid = np.zeros((n_rows, n_columns), np.int64)
        grid[points[:, 0], points[:, 1]] = value
        rows, weights = rng.permutation(n_rows)[:6], rng.integers(1, 4, size=min(6, n_rows))
        total = weights @ grid[rows]
        known = [(40, 2), (3, 10**6)]
        score, name = treap.search(rows, weights, docs, np.array([s for s, _ in known]), np.array([d for _, d in known]), 7)
        want = sorted([(-s, d) for s, d in zip(total.tolist(), docs.tolist()) if s > 0] + [(-s, d) for s, d in known])[:7]
        assert list(zip((-score).tolist(), name.tolist())) == want


def test_ranges_are_pruned():
    rng = np.random.default_rng(1)
    n = 4096
    points = np.unique(np.concatenate([rng.integers(0, [5000, n], size=(40_000, 2)), [[7, c] for c in range(0, n, 500)]]), axis=0)
    value = rng.integers(1, 100, size=len(points))
    docs = np.arange(n)
    treap = ti.Treap(*ti.build_treap(points[:, 0], points[:, 1], value), docs)
    opened = []
    lookup = treap.child

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                opened.append(len(key))
            return np.ndarray.__getitem__(self, key)

    treap.child = lookup.view(Counting)
    score, _ = treap.search(np.array([7, 4000, 4500]), np.array([1, 5, 5]), docs, np.zeros(0, np.int64), np.zeros(0, np.int64), 3)
    assert len(score) == 3 and sum(opened) < n / 2


def test_odd_rows(spark):
    docs = odd_rows() + [(20, "Ä ä É\x00x1 1x"), (21, "_a-b.C"), (22, "a b 𝄞 日本 日本")]
    items = [(1, None), (2, ""), (3, "12 34 !!"), (4, "ONE two"), (4, "ONE two"), (4, "one"), (None, "wort 日本"), (5, prose(1, 60)), (6, "x1 É ä a c 𝄞"), (7, prose(5, 500))]
    assert ranked(spark, docs, items, 5, 50) == brute(docs, items, 5)
    assert ranked(spark, docs[:0], items, 5) == [] and ranked(spark, docs, items[:0], 5) == []
    d = spark.createDataFrame([(*r, 1, 2, "x", 4) for r in docs], "doc_id bigint, text string, term int, df int, terms string, item_id int")
    i = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id bigint, text string, doc_id int, term int")
    assert sorted((tuple(r) for r in ti.ranked_search(d, i, 5).collect()), key=str) == brute(docs, items, 5)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ti, "BLOCK_ITEMS", 2)
    docs = [(i, prose(i, 30, WORDS[:60])) for i in range(120)]
    items = [(i, prose(900 + i, 4, WORDS[:80])) for i in range(90)]  # more blocks than a task keeps answers of
    assert ranked(spark, docs, items, 4, 300) == brute(docs, items, 4)
