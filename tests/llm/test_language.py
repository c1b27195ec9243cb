import functools
import math

import numpy as np
import public_tokenizers
from conftest_llm import odd_rows

from flowwarden.llm import lang_id

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
VOCAB = lang_id.vocabulary(PATH)


def every_cut(word, vocab, mark=lang_id.MARK):
    place, text = {p: i for i, p in enumerate(vocab)}, mark + word

    def go(at):
        if at == len(text):
            yield ()
        for end in range(at + 1, len(text) + 1):
            i = place.get(text[at:end], len(vocab) if end == at + 1 else None)
            if i is not None:
                for rest in go(end):
                    yield (i, *rest)

    return list(go(0))


WORDS_ = ["a", "the", "éçan", "日本", "ŵxyz", "tion", "the"]


def by_place(word, logs):
    """log of the sum over all segmentations, place by place in Python's floats."""
    place, text = {p: i for i, p in enumerate(VOCAB)}, lang_id.MARK + word
    longest, sums = max(map(len, VOCAB)), [0.0]
    for end in range(1, len(text) + 1):
        terms = []
        for start in range(max(0, end - longest), end):
            i = place.get(text[start:end], len(VOCAB) if start == end - 1 else None)
            if i is not None:
                terms.append(sums[start] + logs[i])
        top = max(terms)
        sums.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return sums[-1]


def test_long_words_are_summed_whole():
    words = ["日本語" * 30, "a" * 39, "b" * 40, "c" * 41, "thetion" * 100, "ŵ" * 500, "the"]
    probs = np.stack([lang_id.prior(len(VOCAB)), lang_id.prior(len(VOCAB))[::-1]], 1)
    got = lang_id.Lattice(VOCAB).forward(words, probs)
    for w, row in zip(words, got):
        for j in (0, 1):
            assert math.isclose(row[j], by_place(w, np.log(probs[:, j])), rel_tol=1e-9)


def test_expected_counts_of_long_words():
    # the pieces expected in a word cover it, whatever its length: pieces times their lengths add up to it
    sizes = np.array([*[len(p) for p in VOCAB], 1])
    for word in ("thetion" * 100, "ŵ" * 500, "日本語" * 30, "the"):
        got = lang_id.Lattice(VOCAB).expected([word], lang_id.prior(len(VOCAB)), np.array([[3.0]]))[:, 0]
        assert math.isclose(got @ sizes, 3 * (len(word) + len(lang_id.MARK)), rel_tol=1e-9)


def test_texts_with_letters_beside_numbers(frame):
    labelled = frame([(1, "x m the cat", "en"), (2, "le chat le chien", "fr")]).select("text", "lang")
    rows = [(1, "x² m²"), (2, "x m"), (3, "½ ² 12 ⅷ"), (4, "日本語の文章です" * 40), (5, "ไทยไม่มีช่องว่าง" * 30), (6, "the2cat"), (7, "the cat"), (8, "ÄÖ İI")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(frame(rows), labelled, PATH).collect()}
    assert got[1] == got[2] and got[6] == got[7] and got[3] == ("und", 0.0)
    assert all(got[i][0] in ("en", "fr") for i in (1, 4, 5, 6, 8))


def test_forward_sums_over_all_segmentations():
    probs = np.stack([lang_id.prior(len(VOCAB)), lang_id.prior(len(VOCAB))[::-1]], 1)
    got = lang_id.Lattice(VOCAB).forward(WORDS_, probs)
    for w, row in zip(WORDS_, got):
        for j in (0, 1):
            assert math.isclose(row[j], math.log(sum(math.prod(probs[i, j] for i in cut) for cut in every_cut(w, VOCAB))), rel_tol=1e-9)


def test_expected_counts():
    probs = lang_id.prior(len(VOCAB))
    weights = np.arange(1.0, len(WORDS_) + 1)[:, None]
    got = lang_id.Lattice(VOCAB).expected(WORDS_, probs, weights)[:, 0]
    want = np.zeros(len(probs))
    for w, n in zip(WORDS_, weights[:, 0]):
        cuts = every_cut(w, VOCAB)
        share = [math.prod(probs[i] for i in c) for c in cuts]
        for c, s in zip(cuts, share):
            for i in c:
                want[i] += n * s / sum(share)
    assert np.allclose(got, want)


def test_held_out_accuracy_and_that_labels_of_judged_rows_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = lang_id.held_out(F.col("doc_id"))
    labelled = docs.where(~held).select("text", "lang")
    got = lang_id.identify(docs.drop("lang", "source"), labelled, PATH).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(frame):
    learn = [(1, "the cat and the dog of the house", "en"), (2, "le chat et le chien de la maison", "fr"), (3, None, "de"), (4, "das", None)]
    labelled = frame(learn).select("text", "lang")
    rows = odd_rows()
    got = lang_id.identify(frame(rows), labelled, PATH, ("doc_id", "text")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str(r) for r in rows)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred in ({"en", "fr"} if letters else {"und"}) and 0 <= r.score <= 1 and (letters or r.score == 0)
    said = {r.text: r.lang_pred for r in lang_id.identify(frame([(1, "the dog"), (2, "la maison"), (3, "THE HOUSE " * 5)]), labelled, PATH, ("text",)).collect()}
    assert said == {"the dog": "en", "la maison": "fr", "THE HOUSE " * 5: "en"}


def test_nothing_labelled_and_empty_tables(frame):
    none = frame([(1, "a")]).limit(0).select("text", "lang")
    assert [r.lang_pred for r in lang_id.identify(frame([(1, "the")]), none, PATH).collect()] == ["und"]
    assert lang_id.identify(frame([(1, "a")]).limit(0), none, PATH).count() == 0


def test_room_to_remember_makes_no_difference(frame, monkeypatch):
    docs = frame([(i, t) for i, t in enumerate(["the cat", "the dog le chat", "la maison the cat", "zzz"])])
    labelled = frame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr")]).select("text", "lang")
    want = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(docs, labelled, PATH).collect()}
    langs, probs, _ = lang_id.train(labelled, VOCAB)
    place = {p: i for i, p in enumerate(VOCAB)}

    @functools.cache
    def log(word, j):
        s = lang_id.MARK + word

        @functools.cache
        def go(at):
            if at == len(s):
                return 1.0
            ends = ((e, place.get(s[at:e], len(VOCAB) if e == at + 1 else None)) for e in range(at + 1, len(s) + 1))
            return sum(probs[i, j] * go(e) for e, i in ends if i is not None)

        return math.log(go(0))

    for r in docs.collect():
        logs = [sum(log(w, j) for w in r.text.split()) for j in range(len(langs))]
        share = [1 / sum(math.exp(b - a) for b in logs) for a in logs]
        best = max(range(len(langs)), key=lambda j: share[j])
        assert want[r.doc_id][0] == langs[best] and math.isclose(want[r.doc_id][1], share[best], rel_tol=1e-6)
