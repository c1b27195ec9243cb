import random

from conftest_llm import Links, odd_rows, prose
from test_near_dup import family, shingles

from flowwarden.llm import near_dup, paragraph_dedup


def brute(rows, least=20):
    own = [(d, n, len(line.split()), shingles(line)) for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)) for n, line in enumerate((t or "").split("\n"))]
    own = [p for p in own if p[2] >= least]
    links = Links()
    for i, x in enumerate(own):
        for j in range(i):
            both = len(x[3] & own[j][3])
            if 100 * both >= 75 * (len(x[3]) + len(own[j][3]) - both):
                links.join(i, j)
    out = {}
    for i, p in enumerate(own):
        group = [j for j in range(len(own)) if links.find(j) == links.find(i)]
        if len(group) > 1:
            first = min(group)
            out[p[0], p[1]] = (p[2], own[first][0], own[first][1], len(group), first != i)
    return out


def test_against_all_pairs(frame, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE_NODES", 4)
    rng = random.Random(2)
    lines = family(1, 25, 80) + family(2, 25, 40) + [prose(i, rng.randrange(3, 60)) for i in range(60)] + ["", "short line here"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))) for i in range(70)]
    got = paragraph_dedup.repeated_paragraphs(frame(rows)).where("kind = 'paragraph'").collect()
    assert {(r.doc_id, r.paragraph): (r.n_words, r.cluster_doc, r.cluster_paragraph, r.n_paragraphs, r.removed) for r in got} == brute(rows)
    text = dict(rows)
    for r in got:
        assert text[r.doc_id].encode()[r.start_byte : r.start_byte + r.n_bytes] == text[r.doc_id].split("\n")[r.paragraph].encode()


def test_odd_rows(frame):
    rows = [r for r in odd_rows() if r[0] != 7]
    got = paragraph_dedup.repeated_paragraphs(frame(rows)).where("kind = 'paragraph'").collect()
    want = {k: v[1:3] for k, v in brute(rows).items()}
    assert {(r.doc_id, r.paragraph): (r.cluster_doc, r.cluster_paragraph) for r in got} == want
    assert paragraph_dedup.repeated_paragraphs(frame([(1, "a")]).limit(0)).count() == 0
    same = paragraph_dedup.repeated_paragraphs(frame([(1, prose(1, 30)), (None, prose(1, 30))])).collect()
    assert {(r.doc_id, r.cluster_doc, r.removed) for r in same} == {(1, None, True), (None, None, False)}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, prose(1, 30), 1, "x"), (2, prose(1, 30), 2, "y")], "doc_id int, text string, node int, bands string")
    assert paragraph_dedup.repeated_paragraphs(docs).count() == 2


def test_passages_inside_other_text(frame):
    passages = [prose(500 + i, 52 + i) for i in range(8)]
    rows, planted = [], {}
    for d in range(60):
        around = prose(1000 + d, 40), prose(2000 + d, 45)
        if d < 40:
            rows.append((d, "first line\n" + around[0] + " " + passages[d % 8] + " " + around[1] + "\nlast"))
            planted[d] = passages[d % 8]
        else:
            rows.append((d, " ".join(around)))
    rows.append((None, rows[3][1].replace("last", "end")))
    got = paragraph_dedup.repeated_paragraphs(frame(rows)).where("kind = 'passage'").collect()
    by_doc = {r.doc_id: r for r in got}
    assert set(planted) - {3} <= set(by_doc) <= {*planted, None}
    text = dict(rows)
    for d, r in by_doc.items():
        if d is not None:
            part = text[d].encode()[r.start_byte : r.start_byte + r.n_bytes].decode()
            assert len(part.split()) == r.n_words >= 16 and part in passages[d % 8] and r.paragraph == 1
            assert r.removed == (r.cluster_doc != d)


def test_a_passage_of_equal_words_and_repeated_rows(frame):
    rows = [(1, "x " * 500), (1, "x " * 500), (2, prose(1, 100)), (2, prose(1, 100)), (3, None), (4, "")]
    got = paragraph_dedup.repeated_paragraphs(frame(rows)).collect()
    assert {r.doc_id for r in got} <= {1}


def test_passages_in_the_kept_copy_of_a_paragraph(frame):
    passage = prose(500, 60)
    line = prose(1, 40) + " " + passage + " " + prose(2, 40)
    rows = [(1, prose(3, 40) + " " + passage + " " + prose(4, 40)), (2, line), (3, "head\n" + line), (4, line + " tail")]
    got = paragraph_dedup.repeated_paragraphs(frame(rows)).collect()
    whole = {(r.doc_id, r.removed) for r in got if r.kind == "paragraph"}
    inside = {(r.doc_id, r.cluster_doc, r.removed) for r in got if r.kind == "passage"}
    assert whole == {(2, False), (3, True), (4, True)}
    assert inside == {(1, 1, False), (2, 1, True)}


def test_a_passage_is_kept_once_if_its_first_place_is_removed(frame):
    passage, base = prose(500, 60), prose(1, 400).split()
    rows = [(1, " ".join(base)), (2, " ".join(base[:200]) + " " + passage + " " + " ".join(base[200:])), (3, prose(2, 60) + " " + passage + " " + prose(3, 60))]
    got = paragraph_dedup.repeated_paragraphs(frame(rows)).collect()
    assert {(r.doc_id, r.removed) for r in got if r.kind == "paragraph"} == {(1, False), (2, True)}
    assert not [r for r in got if r.doc_id == 3]  # the only place that stays


def test_passages_over_short_lines_however_wrapped(frame):
    def wrapped(words, n):
        return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))

    passage = prose(500, 70).split()
    rows = [(d, prose(10 * d, 9) + "\n" + wrapped(passage, n) + "\n\n" + prose(10 * d + 1, 8)) for d, n in ((1, 9), (2, 9), (3, 6), (4, 70))]
    rows += [(5, wrapped(prose(5, 90).split(), 7)), (6, "a\nb"), (7, None)]
    got = paragraph_dedup.repeated_paragraphs(frame(rows)).collect()
    assert {(r.doc_id, r.kind, r.cluster_doc, r.removed) for r in got} == {(d, "passage", 1, d > 1) for d in (1, 2, 3, 4)}
    text = dict(rows)
    for r in got:
        part = text[r.doc_id].encode()[r.start_byte : r.start_byte + r.n_bytes].decode()
        assert len(part.split()) == r.n_words >= 40 and " ".join(part.split()) in " ".join(passage)
        assert text[r.doc_id].encode()[: r.start_byte].count(b"\n") == r.paragraph
