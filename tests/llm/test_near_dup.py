import random
import re

import numpy as np
import pytest
from conftest_llm import Links, odd_rows, prose

from flowwarden.llm import near_dup, textops
from flowwarden.llm.common import components


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    """By distinct (id, text): set size and component."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    sets = [shingles(t) for _, t in docs]
    links = Links()
    for i, x in enumerate(sets):
        links.find(i)
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= 75 * (len(x) + len(sets[j]) - both):
                links.join(i, j)
    out = {}
    for i, d in enumerate(docs):
        own = [docs[j][0] for j in range(len(docs)) if links.find(j) == links.find(i) and docs[j][0] is not None]
        out[d] = (len(sets[i]), min(own) if own and sets[i] else d[0])
    return out


def family(seed, n, base_words=60):
    """Copies of one text with more and more words changed, most of them unlike each other."""
    rng = random.Random(seed)
    base = prose(seed, base_words).split()
    out = []
    for i in range(n):
        copy = base.copy()
        for at in rng.sample(range(base_words), rng.choice([0, 1, 1, 2, 3, 5, 8])):
            copy[at] = f"w{rng.random()}"
        out.append(" ".join(copy))
    return out


def check(frame, rows, **kw):
    got = near_dup.near_duplicates(frame(rows), **kw).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    by_size = {}
    for d, (n, c) in want.items():
        by_size.setdefault(d[0], set()).add((n, c))
    for r in got:
        assert (r.n_shingles, r.component_id) in by_size[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_odd_rows(frame):
    check(frame, odd_rows())


@pytest.mark.parametrize("tile", [256, 3])
def test_families_against_all_pairs(frame, monkeypatch, tile):
    monkeypatch.setattr(near_dup, "TILE_NODES", tile)
    monkeypatch.setattr(near_dup, "COLUMNS", 64 if tile == 3 else 4096)
    texts = [t for s in range(3) for t in family(s, 40)] + [prose(100 + i, 50) for i in range(20)]
    random.Random(1).shuffle(texts)
    check(frame, list(enumerate(texts)))


def test_empty_table(frame):
    assert near_dup.near_duplicates(frame([(1, "a")]).limit(0)).count() == 0


def test_other_columns_are_ignored(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 7), (2, "a b c d e f", 5, 7)], "doc_id int, text string, node int, bucket int")
    assert {r.component_id for r in near_dup.near_duplicates(docs).collect()} == {1}


def test_signature_is_the_least_image_under_the_shifted_permutation():
    sets, bounds = textops.shingle_sets([prose(1, 90_000).encode(), b"", b"a b", prose(2, 30).encode()], 5)
    got = near_dup.signatures(sets, bounds, 6)
    folded = near_dup._scatter((sets >> np.uint64(32)).astype(np.uint32))
    for i in range(4):
        own = folded[bounds[i] : bounds[i + 1]]
        for j in range(6):
            want = near_dup._circulant(own, 0 + j).min() if len(own) else 0xFFFFFFFF
            assert got[i, j] == want
    # one shift more is the same permutation of numbers one less
    assert (near_dup._circulant(folded, 3) == near_dup._circulant(folded - np.uint32(1), 2)).all()


def test_word_hashes_follow_the_words():
    texts = [b"Aa  b\tAA", None, b"", b"b" * 200, b"b" * 201, "é É".encode()]
    h, bounds = textops.word_hashes(texts)
    assert bounds.tolist() == [0, 3, 3, 3, 4, 5, 7]
    assert h[0] == h[2] != h[1] and h[3] != h[4] and h[5] != h[6]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(500, i) for i in range(501, 560)]
    links = Links()
    for a, b in edges:
        if a != b:
            links.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int"), "t").collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: min(m for m in nodes if links.find(m) == links.find(n)) for n in nodes}
