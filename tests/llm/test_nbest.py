import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from flowwarden.llm import nbest

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = nbest.Vocabulary(PATH)
SOLVER = nbest.Solver(VOCAB)
TABLE = nbest.byte_table(VOCAB)


def every_path(text):
    spelt, out = nbest.MARK + text.replace(" ", nbest.MARK), []

    def go(at, score, ids):
        if at == len(spelt):
            out.append((score, ids))
            return
        for end in range(at + 1, len(spelt) + 1):
            i = SOLVER.known.get(spelt[at:end])
            if i is not None:
                go(end, score + VOCAB.scores[i], [*ids, VOCAB.ids[i]])
            elif end == at + 1:
                go(end, score + VOCAB.letter_score(spelt[at]), ids + VOCAB.spelt(spelt[at]))

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@settings(deadline=None, max_examples=80)
@given(st.text(st.sampled_from("abeinst é.,'日\n1"), min_size=1, max_size=9), st.integers(1, 6))
def test_against_every_path(text, n):
    paths = every_path(text)
    scores, ids = nbest.segmentations(nbest.parts_of(text, VOCAB), n, SOLVER)
    assert np.allclose(scores, [s for s, _ in paths[:n]])
    score_of = {np.array(i, "<u4").tobytes(): s for s, i in paths}
    assert len(set(ids)) == len(ids) and np.allclose([score_of[i] for i in ids], scores)
    for i in ids:
        assert nbest.decode(np.frombuffer(i, "<u4").tolist(), TABLE) == text.encode()


def test_parts_put_together_are_the_text():
    text = "  Don't stop, e.g. at 3.14!?  né\n\n日本。 a_b <x> $$$ %%% ²."
    assert "".join(nbest.parts_of(text, VOCAB)) == nbest.MARK + text.replace(" ", nbest.MARK)


def test_rows_and_decoding(frame, monkeypatch):
    monkeypatch.setattr(nbest, "CACHE_PARTS", 50)
    rows = [r for r in odd_rows() if r[0] != 10] + [(20, "▁ mark"), (21, "ab " * 3)]
    got = nbest.n_best(frame(rows), PATH, 3, with_ids=True)
    found = got.collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    for r in found:
        assert r.decodes == (r.doc_id != 20)
        assert r.scores == sorted(r.scores, reverse=True) and 1 <= len(r.scores) <= 3
        assert r.ids_crc32 == [zlib.crc32(i) for i in r.ids] and r.n_pieces == [len(i) // 4 for i in r.ids]
    texts = nbest.decoded(got.selectExpr("doc_id", "ids[0] as ids"), PATH).collect()
    assert sorted(str((r.doc_id, r.text)) for r in texts if r.doc_id != 20) == sorted(str((d, t or "")) for d, t in rows if d != 20)


def test_empty_table(frame):
    assert nbest.n_best(frame([(1, "a")]).limit(0), PATH).count() == 0


@pytest.mark.parametrize("n", [1, 4])
def test_a_long_part(n):
    scores, ids = nbest.segmentations(nbest.parts_of("abc" * 4000, VOCAB), n, SOLVER)
    assert len(scores) == n and nbest.decode(np.frombuffer(ids[0], "<u4").tolist(), TABLE) == b"abc" * 4000
