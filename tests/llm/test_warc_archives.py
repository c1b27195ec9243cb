import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowwarden.llm import warc
from flowwarden.llm.common import shared_path

SCHEMA = "page_id bigint, url string, html string, file string, head int"


def pages():
    rng = random.Random(4)
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    odd = [None, "", "é" * 700, "x", "WARC/1.", "WARC/1.0\r\n", inner, inner * 40, "a" * 1200 + inner, "WARC/1.1\r\n\r\n\r\n", "WARC/1.0\r\nContent-Length: 999999\r\n\r\n"]
    odd += ["\r\n\r\n" * 300, "HTTP/1.1 200 OK\r\n\r\nnested", "tail WARC/1", "W", "x" * 200_000 + "WARC/1.0\r\n" + "y" * 100_000]
    odd += ["same" * 300] * 5 + ["short"] * 3
    odd += ["".join(rng.choice("ab \r\nWARC/1.0") for _ in range(rng.randrange(3000))) for _ in range(60)]
    return [(i, f"http://h/{i}" if i % 7 else None, t, "clash", 3) for i, t in enumerate(odd)]


def expected(rows):
    best = {}
    for i, _, t, *_ in rows:
        t = (t or "").encode()
        if len(t) >= 1000 and i is not None:
            best[t] = max(i, best.get(t, i))
    out = set()
    for i, _, t, *_ in rows:
        t = (t or "").encode()
        r = best.get(t)
        again = r is not None and r != i
        out.add((i, len(t), hashlib.sha1(t).hexdigest(), "revisit" if again else "response", r if again else None))
    return out


@pytest.mark.parametrize("split", ["128m", "3k"])
def test_round_trip_whatever_the_splits(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = pages()
        got = warc.archived(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == expected(rows)


def test_payloads_and_offsets(spark):
    rows = pages()
    path = shared_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    got = warc.read_warc(spark, path, with_payload=True).collect()
    whole = spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".txt")).first().content
    want = {i: (t or "").encode() for i, _, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert whole[r.offset : r.offset + 10] == b"WARC/1.0\r\n"
        i = int(r.record_id[len("<urn:page:") : -1])
        assert bytes(r.payload) == (b"" if r.warc_type == "revisit" else want[i])
        assert r.payload_digest == hashlib.sha1(r.payload).hexdigest() and r.http_bytes == len(want[i])


def test_null_and_repeated_ids(spark):
    rows = [(None, "u", "z" * 2000, "", 0), (3, "u", "z" * 2000, "", 0), (3, "u", "z" * 2000, "", 0), (2, None, None, "", 0), (None, None, "q" * 1500, "", 0)]
    got = sorted((tuple(r) for r in warc.archived(spark.createDataFrame(rows, SCHEMA)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    assert got == sorted(
        [(None, 2000, "revisit", 3), (3, 2000, "response", None), (3, 2000, "response", None), (2, 0, "response", None), (None, 1500, "response", None)], key=str
    )


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_broken_chain_ends_there(spark):
    good = "WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    path = shared_path(spark, "warc-broken")
    text = good + "WARC/1.0\r\nContent-Length: 50\r\n\r\nshort" + good
    spark.createDataFrame([(text,)], "value string").write.option("lineSep", "\r\n").text(path + "/a")
    spark.createDataFrame([("junk" + good,)], "value string").write.text(path + "/b")
    got = warc.read_warc(spark, path + "/*").select("offset", "payload_bytes").collect()
    assert (0, 3) in [tuple(r) for r in got] and all(r.offset < len(text) for r in got)
    assert not warc.read_warc(spark, path + "/b").collect()
