import zlib

import pytest
from conftest_llm import odd_rows, prose
from test_lines import brute as brute_lines
from test_near_dup import brute as brute_near

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_on_real_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    one = corpus_pipeline.language(spark, docs, SF)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept <= lettered and len(kept) >= 0.98 * len(lettered)

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    two = corpus_pipeline.lines(spark, docs, SF)
    want = {d: rest for (d, _), (gone, rest) in brute_lines(rows, 16, 3).items() if not gone or rest.split()}
    assert {r.doc_id: r.text for r in two.collect()} == want and two.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = corpus_pipeline.near_duplicates(spark, docs, SF)
    first = {d for (d, _), (_, c) in brute_near(rows).items() if c == d}
    assert {r.doc_id for r in three.collect()} == first and three.columns == docs.columns

    four = corpus_pipeline.personal_data(spark, docs, SF)
    assert four.columns == docs.columns and four.count() == docs.count()
    changed = four.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count()
    assert 0 < changed < 0.3 * docs.count()

    five = corpus_pipeline.pack(spark, docs, SF)
    assert {r.doc_id for r in five.select("doc_id").distinct().collect()} == {d for d, _ in rows}


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema) if stage is not corpus_pipeline.pack else stage(spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_and_clashing_columns(spark, name, stage):
    rows = [(d, t, "en" if i % 2 else None, "s", 1, 2, "k", b"n") for i, (d, t) in enumerate(odd_rows())]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred int, near_key string, node binary"
    docs = spark.createDataFrame(rows, schema)
    got = stage(spark, docs, SF)
    if name != "packing":
        assert got.columns == docs.columns
    assert got.count() > 0
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == got.columns


def test_near_stage_keeps_one_of_repeated_rows(spark):
    rows = [(2, prose(1, 50)), (2, prose(1, 50)), (1, prose(1, 50)), (3, prose(3, 50)), (3, prose(3, 50)), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, prose(1, 50)), (3, prose(3, 50)), (4, None), (5, "")], key=str)


def test_held_out_rows_are_told_by_their_id(spark):
    from pyspark.sql import functions as F

    from flowwarden.llm.lang_id import held_out

    got = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "doc_id bigint").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
