import hashlib

from conftest_llm import odd_rows, prose
from pyspark.sql import functions as F

from flowwarden.llm import imatch

MANY = [f"{a}{b}{c}{d}" for a in "bdfgklmn" for b in "aeiou" for c in "prstvz" for d in ("ba", "do", "mi", "ru", "en", "ix", "ol", "ut")]


def edited(rows):
    """(id, edited text) in ascending order of id."""
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        out[d] = (len(t), t[: len(t) - cut] + after[:cut])
    return out


def run(docs, **kw):
    return imatch.edited_fingerprints(docs, **kw).collect()


def test_edited_texts_and_likeness(frame):
    rows = [(3 * i + 1, prose(i, 30 + i, MANY)) for i in range(120)] + [(1000, "é日" * 9), (1001, None), (1002, ""), (1003, prose(3, 33, MANY))]
    got = {r.doc_id: r for r in run(frame(rows))}
    want = edited(rows)
    assert set(got) == set(want)
    for d, (n, text) in want.items():
        assert got[d].n_chars == n and got[d].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[10].fingerprint == got[1003].fingerprint and got[1001].fingerprint == got[1002].fingerprint
    near = [got[d].near_edited for d in want if d < 1000]
    after = [got[d].near_next for d in want if d < 1000]
    assert sum(near) / len(near) > 0.25 > 0.1 > sum(after) / len(after)
    assert got[1001].near_next == 1.0  # two empty texts


def test_terms_of_the_band_only(frame, spark):
    docs = frame([(i, f"all half{i % 2} few{i % 10} own{i}") for i in range(40)])
    known = {r.term for r in imatch.lexicon(docs, 0.05, 0.2).collect()} - {0}
    want = {r[0] for r in spark.createDataFrame([(f"few{i}",) for i in range(10)], "w string").select(F.xxhash64("w")).collect()}
    assert known == want


def test_fingerprint_is_of_sorted_distinct_terms(frame):
    a, b = "ra la mi fa so", "so fa mi, LA ra. ra"
    got = {r.doc_id: r for r in run(frame([(1, a), (2, b), (3, "x y z"), (4, "ra la"), (5, "mi fa so")]), most=1.0)}
    assert got[1].fingerprint == got[2].fingerprint != got[4].fingerprint and got[1].near_next == 1.0


def test_order_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i * i, f"t{i} " * (i % 9)) for i in range(50)]
        got = {r.doc_id: r.edited_sha256 for r in run(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, (_, t) in edited(rows).items()}


def test_odd_rows(spark, frame):
    rows = odd_rows()
    got = run(frame(rows).withColumn("key", F.lit(1)).withColumn("term", F.lit(2)))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in {(d, t or "") for d, t in rows})
    one = run(frame([(5, "abcdefgh")]))
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    assert run(frame([(1, "a")]).limit(0)) == []


def test_groups_that_hold_much_of_the_table(frame):
    rows = [(i, prose(i, 40, MANY)) for i in range(100)]  # other texts
    copy, near = prose(500, 60), prose(501, 60).split()
    rows += [(1000 + i, copy) for i in range(40)]  # equal texts
    for i in range(40):  # near copies: another word in each
        rows.append((2000 + i, " ".join(near[:i] + [f"own{i}"] + near[i + 1 :])))
    got = {r.doc_id: r for r in run(frame(rows))}
    assert not any(r.fingerprint.startswith("text:") for r in got.values())
    copies, nears = ([got[a + i] for i in range(39)] for a in (1000, 2000))
    assert all(r.near_next == 1.0 for r in copies)
    assert min(r.near_edited for r in copies + nears) > 0.2
    assert sum(r.near_next for r in nears) / len(nears) > 0.7
    assert len({r.fingerprint for r in got.values()} - {r.fingerprint for r in copies}) > 100


def test_copies_do_not_count_for_the_band(frame):
    rows = [(i, prose(i, 40, MANY)) for i in range(50)] + [(100 + i, prose(3, 40, MANY)) for i in range(50)]
    plain = {r.doc_id: r.fingerprint for r in run(frame(rows[:50]), most=1 / 5)}
    assert {r.doc_id: r.fingerprint for r in run(frame(rows), most=1 / 5) if r.doc_id < 50} == plain
