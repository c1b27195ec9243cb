import random
import re
from collections import Counter

import pytest
from conftest_llm import odd_rows, prose
from pyspark.sql import functions as F

from flowwarden.llm import quality as q


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered), failed


def cell(v):
    drop = max(v.bit_length() - 6, 0)
    return v >> drop << drop


def brute(rows, least=100):
    """(doc_id, counts, kept) of (doc_id, text, lang, source) rows."""
    found = [(*r, counts(r[1])) for r in rows]
    measures = [("n_words", lambda c: c[1] * 1000 // max(c[0], 1), True, 2000), ("s", lambda c: c[2] * 1000 // max(c[0], 1), False, 100),
                ("l", lambda c: c[4] * 1000 // max(c[3], 1), False, 500), ("r", lambda c: c[5] * 1000 // max(c[0], 1), False, 300)]
    good = [r for r in found if not r[4][6]]
    out = []
    for i, text, lang, source, c in found:
        own = [r for r in good if r[2:4] == (lang, source)]
        if len(own) < least:
            own = [r for r in good if r[2] == lang]
            own = own if len(own) >= least else good
        kept = not c[6]
        for _, of, both, reach in measures if kept else []:
            cells = sorted(cell(of(r[4])) for r in own)
            q1, q3 = cells[-(-len(cells) // 4) - 1], cells[-(-3 * len(cells) // 4) - 1]
            far = max(3 * (q3 - q1), reach)
            kept = kept and of(c) <= q3 + far and (not both or of(c) >= q1 - far)
        out.append((i, c[0], c[1], c[2], c[4], c[5], c[6], kept))
    return out


SCHEMA = "doc_id bigint, text string, lang string, source string"
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def check(spark, rows, least=100):
    got = q.quality(spark.createDataFrame(rows, SCHEMA).repartition(3), least)
    assert got.columns == COLUMNS
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, least), key=key)


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de", None])
        words = prose(seed * 1000 + i, rng.randrange(30, 120)).split()
        if lang == "de":
            words = [w + w for w in words]
        if rng.random() < 0.2:
            at = rng.randrange(len(words))
            words[at:at] = words[: rng.randrange(20)] * rng.randrange(3)
        if rng.random() < 0.1:
            words = [rng.choice(["#", "|", "<b>"]) if rng.random() < 0.5 else w for w in words]
        if rng.random() < 0.1:
            words = ["w" * 30 if rng.random() < 0.8 else w for w in words]
        text = "".join(w + rng.choice([" ", "  ", "\n", " \t"] if rng.random() < 0.2 else " ") for w in words)
        if rng.random() < 0.1:
            text += ("\nthe same line" * rng.randrange(1, 60)) + "\n \n"
        rows.append((i, text, lang, rng.choice(["a", "a", "b", None, f"s{i % 40}"])))
    return rows


@pytest.mark.parametrize("least", [1, 30, 10_000])
def test_against_brute_force(spark, least):
    check(spark, made(least, 300), least)


def test_odd_rows(spark):
    rows = [(i, t, None, "s") for i, t in odd_rows()]
    words = "aa bb cc "
    rows += [(20, words * 40, "en", None), (21, "a b c d\na b c\va\fb\rc " * 20, None, None), (22, "x " * 49, "en", "s"), (23, "|" * 60, "en", "s")]
    rows += [(24, "\n".join(["é 日本 𝄞 x"] * 30), "en", "s"), (25, words + prose(1, 100) + " " + words, "en", "s")]
    check(spark, rows, 1)
    check(spark, rows[:0])
    extra = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], f"{SCHEMA}, n_words int, _lang int, docs int, _s int")
    assert sorted(str(tuple(r)) for r in q.quality(extra, 1).collect()) == sorted(str(r) for r in brute(rows, 1))


def test_large_groups_are_salted(spark, monkeypatch):
    rows = made(7, 200)
    monkeypatch.setattr(q, "SALT_ROWS", 5)
    monkeypatch.setattr(q, "fits", lambda df, rows=0: False)
    check(spark, rows, 10)


def test_sketches_merge(spark):
    frame = spark.range(1000).select(F.col("id").alias("_symbols"), *[F.lit(0).cast("bigint").alias(f"_{m}") for m in q.MEASURES if m != "symbols"], F.col("id") % 7)
    name = frame.columns[-1]
    part = q.merged(q.sketched(frame.withColumnRenamed(name, "part"), ["part"]), [])
    whole = q.sketched(frame, [])
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.collect()))
    found = {r.measure: r for r in q.quartiles(whole, []).collect()}["symbols"]
    assert found.docs == 1000 and abs(found.q1 - 250) <= 250 / 32 and abs(found.q3 - 750) <= 750 / 32


def test_fences_follow_the_language(spark):
    short, long = [prose(i, 80) for i in range(150)], [" ".join(w * 4 for w in prose(1000 + i, 80).split()) for i in range(150)]
    rows = [(i, t, "short", "s") for i, t in enumerate(short)] + [(1000 + i, t, "long", "s") for i, t in enumerate(long)]
    rows += [(5000, long[0], "short", "s"), (5001, short[0], "long", "s")]
    gone = [r.doc_id for r in q.quality(spark.createDataFrame(rows, SCHEMA)).where("not kept").collect()]
    assert sorted(gone) == [5000, 5001]


def test_native(spark):
    plan = q.quality(spark.createDataFrame(made(3, 20), SCHEMA).repartition(2))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
