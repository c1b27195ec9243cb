import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowwarden.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def laid_out(plan, histogram, capacity):
    """Every place of a plan: each rank of each length once, sequences gapless from 0 and not too long."""
    ranks, places = Counter(), defaultdict(list)
    for length, rank, n, copies, first, offset in plan.runs:
        assert rank == ranks[length]
        ranks[length] += n * copies
        for i in range(n):
            for j in range(copies):
                places[first + i].append((offset + j * length, length))
    assert ranks == Counter(histogram)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) == plan.sequences
    return places


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.integers(1, 9), st.sampled_from([0.0, 0.9, 1.0]))
def test_plans_are_whole(histogram, groups, least_fill):
    plan = packing.Plan(histogram, 64, 1 / 8, groups, least_fill)
    laid_out(plan, histogram, 64)
    total = sum(n * c for n, c in histogram.items())
    assert plan.sequences >= -(-total // 64)


def test_plan_is_nearly_full_and_grows_with_lengths_only():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(6.2, 1.0, 20_000).astype(int), 1, 4096)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.Plan(histogram)
    assert plan.sequences * 4096 <= 1.01 * lengths.sum() + 4096
    many = packing.Plan({n: c * 10_000_000 for n, c in histogram.items()})
    assert len(many.runs) < 60_000


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True):
        i = bisect_left(rooms, n)
        insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - n)
    return len(rooms)


SHAPES = {
    "long tail": lambda rng: np.clip(rng.lognormal(6.0, 1.0, 8_000), 1, 4096),
    "middling": lambda rng: np.clip(rng.lognormal(7.0, 0.8, 8_000), 1, 4096),
    "no small ones": lambda rng: rng.integers(1000, 2500, 4_000),
    "three a sequence": lambda rng: rng.integers(500, 1500, 4_000),
    "any length": lambda rng: rng.integers(1, 4096, 4_000),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_as_few_sequences_as_best_fit(shape):
    lengths = SHAPES[shape](np.random.default_rng(5)).astype(int)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.best_plan(histogram)
    laid_out(plan, histogram, 4096)
    assert plan.sequences <= best_fit_decreasing(lengths, 4096) * 1.001


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(5, 40), min_size=1, max_size=6, unique=True), st.integers(1, 4))
def test_fill_is_the_best_there_is(sizes, count):
    sizes, capacity = sorted(sizes, reverse=True), 64
    chosen = packing.best_fill(sizes, [count] * len(sizes), 0, capacity)
    reach = {sizes[0]}
    for i, s in enumerate(sizes):
        reach = {r + s * k for r in reach for k in range(count + 1 - (i == 0)) if r + s * k <= capacity}
    assert sum(k * s for k, s in zip(chosen, sizes)) == max(reach) and chosen[0] >= 1 and max(chosen) <= count


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


STRANGE = "Á éx KK İstanbul ΑΣ ΟΔΟΣ. naïve x don't we'll '' 's a.b, a.. ..a 12.5! 日本。 <|endoftext|> \x1c y\x1f. É. ß; ÿ: ”. ½ ª º µ ÀÖ×÷ þ"


@pytest.mark.parametrize("text", ["", "  ", STRANGE, "\n".join([STRANGE] * 3), "A" * 5000])
def test_ids_are_the_tokenizers(tokenizer, text):
    encode = packing.WordEncoder(PATH)
    for _ in range(2):
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_without_room_to_remember(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 2)
    monkeypatch.setattr(packing, "_SLICE", 7)
    encode = packing.WordEncoder(PATH)
    text = prose(3, 80) + " " + STRANGE
    assert np.frombuffer(encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packed_documents(frame, tokenizer):
    rows = odd_rows() + [(100 + i, prose(i, 20 + 13 * i)) for i in range(60)]
    got = packing.pack(frame(rows), PATH, with_ids=True).collect()
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            cut = np.array(ids[p : p + 4096], "<u4").tobytes()
            want[r[0], p // 4096, p, len(cut) // 4, zlib.crc32(cut), cut] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.05 * sum(r.length for r in got) / 4096 + 1


def test_empty_table(frame):
    assert packing.pack(frame([(1, "a")]).limit(0), PATH).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, 4, 5)], "doc_id bigint, text string, length int, rank int, bucket int")
    assert packing.pack(docs, PATH).first().length == 3


def test_packed_ids_are_the_tokenizers_default(frame):
    plain = Tokenizer.from_file(PATH)
    texts = ["x <|endoftext|> y", "A<|startoftext|>b. <|endoftext|>.", "<|ENDOFTEXT|> Éa <|EndOfText|>, <|endoftext", STRANGE, "<|endoftext|>" * 3 + " " + prose(1, 9), "no name"]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(frame(list(enumerate(texts))), PATH, with_ids=True).collect()}
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert got[0] == [343, 49407, 344, 1]
