import random

import pytest
from conftest_llm import odd_rows, prose

from flowwarden.llm import line_dedup

BLANK = b" \t\n\x0b\x0c\r"


def unit_list(text, wrap):
    """(words, line number) of each unit."""
    out = []
    for n, line in enumerate((text or "").encode().split(b"\n")):
        words = line.split()
        out += [(tuple(words[i : i + wrap]), n) for i in range(0, len(words), wrap)]
    return out


def brute(rows, wrap, window):
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for d, t in docs:
        own = unit_list(t, wrap)
        later = set()
        for i in range(len(own) - window + 1):
            key = tuple(w for w, _ in own[i : i + window])
            if first.setdefault(key, (d, t, i)) != (d, t, i):
                later |= set(range(i, i + window))
        stay = {n for j, (_, n) in enumerate(own) if j not in later}
        gone = sorted({n for _, n in own} - stay)
        rest, after = [], False
        for n, line in enumerate((t or "").split("\n")):
            after = n in gone or (after and not line.encode().strip(BLANK))
            if not after:
                rest.append(line)
        out[d, t] = (gone, "\n".join(rest) if t is not None else None)
    return out


def corpus(seed):
    rng = random.Random(seed)
    lines = [prose(i, rng.choice([2, 5, 9, 30, 40])) for i in range(25)] + ["", "  ", "a", "a"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    return list(enumerate(texts + ["a\n" * 12, prose(1, 30) + "\n" + prose(1, 30)]))


@pytest.mark.parametrize("wrap, window", [(16, 3), (4, 2), (8, 5), (3, 1)])
def test_against_all_windows(frame, wrap, window):
    rows = corpus(wrap)
    want = brute(rows, wrap, window)
    got = line_dedup.without_repeated_lines(frame(rows), wrap, window).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        assert (r["_removed"], r.text) == want[r.doc_id, by_id[r.doc_id]], r.doc_id
        assert bool(r["_sources"]) >= bool(r["_removed"]) and all(s <= r.doc_id for s in r["_sources"])


def test_odd_rows(frame):
    rows = [r for r in odd_rows() if r[0] != 7]  # which of two texts of an id comes first is told by a hash
    want = brute(rows, 16, 3)
    got = line_dedup.without_repeated_lines(frame(rows)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((d, want[d, t][1])) for d, t in rows)


def test_one_id_with_two_texts_and_clashing_columns(spark):
    rows = [(7, prose(7, 60), "a", 1), (7, prose(8, 60), "b", 2), (8, prose(7, 60) + "\nnew", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _line_doc string, _removed int")
    got = {r["_line_doc"]: (r.text, r["_removed"]) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {"a": (rows[0][1], []), "b": (rows[1][1], []), "c": ("new", [0])}


def test_empty_table(frame):
    assert line_dedup.without_repeated_lines(frame([(1, "a")]).limit(0)).count() == 0


def test_lines_alone_between_other_neighbours(spark, tmp_path):
    from flowwarden.llm.queries import QUERIES

    cc = "This work is licensed under the GNU license, version three or later."
    long = prose(900, 31)
    rows = [(d, "\n".join([prose(10 * d, 40), cc, prose(10 * d + 1, 40), long, prose(10 * d + 2, 3)])) for d in range(1, 5)]
    rows += [(5, cc), (6, "x\nx"), (7, cc + " " + prose(7, 2)), (8, None), (9, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_winnow_lines"](spark, str(tmp_path)).collect()}
    want = {1: [], 2: [1, 3], 3: [1, 3], 4: [1, 3], 5: [0], 6: [1], 7: [], 8: [], 9: []}
    assert {d: r.removed_lines for d, r in got.items()} == want
    assert got[4].source_docs == [1] and got[6].source_docs == [6]


@pytest.mark.parametrize("least", [1, 9])
def test_against_all_windows_and_lines(frame, least):
    rows = corpus(3)
    seen, want = set(), {d: set(gone) for (d, _), (gone, _) in brute(rows, 16, 3).items()}
    for d, t in rows:
        for n, line in enumerate(t.encode().split(b"\n")):
            words = tuple(line.split())
            if least <= len(words) <= 32:
                want[d] |= {n} if words in seen else set()
                seen.add(words)
    got = {r.doc_id: set(r["_removed"]) for r in line_dedup.without_repeated_lines(frame(rows), alone=least).collect()}
    assert got == want
