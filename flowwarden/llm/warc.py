"""WARC archives written and read with the text source, record boundaries verified as chains.

Reading splits files at the record magic wherever it stands, so any task can begin anywhere in a file. Each piece whose
start looks like a record header is a candidate and names its successor's offset. Only candidates that can be reached
from the file's start are records; magic inside payloads is not reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, shared_path

MAGIC = "WARC/1."
END = "\r\n\r\n"
#: Smaller payloads are never written as revisits.
LEAST_SHARED_BYTES = 1000
RECORDS_PER_FILE = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT = ["file", "size", "hash"]


def _one_line(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\r\n]+", " ")


def record(page_id: Column, url: Column, payload: Column, refers_to: Column, date: str) -> Column:
    """A record up to the end mark; a revisit, where refers_to is given, holds the HTTP header only."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END)
    )
    block = F.when(refers_to.isNull(), F.concat(http, payload)).otherwise(http)
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">\r\n"))
    again = F.concat(F.lit("WARC-Refers-To: "), name(refers_to), F.lit(f"WARC-Profile: {PROFILE}\r\n"))
    return F.concat(
        F.lit(f"{MAGIC}0\r\nWARC-Type: "),
        F.when(refers_to.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "),
        name(page_id),
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "),
        _one_line(url),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"),
        F.sha1(payload.cast("binary")),
        F.lit("\r\n"),
        F.coalesce(again, F.lit("")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )


def write_warc(pages: DataFrame, path: str, least: int = LEAST_SHARED_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """A record for each row of pages(page_id, url, html) in text files under `path`.

    Of rows with equal payloads of at least `least` bytes, the one with the greatest page_id is the response and the
    others are revisits that refer to it. A null html is an empty payload, a null url an empty one. A null page_id counts
    as least. Rows that repeat the response's page_id and payload are responses, too. Other columns are ignored.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.sha1(F.col("payload").cast("binary")))
    shared = pages.select("page_id", digest.alias("digest")).where("digest is not null")
    shared = shared.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    # a table of known size: the join below moves no payloads where few are shared
    shared = saved(shared.where("n > 1 and response is not null").select(F.col("digest").alias("shared_digest"), "response"), "warc_shared")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    joined = pages.join(shared, digest == F.col("shared_digest"), "left")
    lines = joined.select(record(F.col("page_id"), F.col("url"), F.col("payload"), refers, date).alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _http(block: Column) -> tuple[Column, Column]:
    """The HTTP header and the payload behind it, from a record's block in binary."""
    text = block.cast("string")
    head = F.substring_index(text, END, 1)
    split = text.startswith("HTTP/") & text.contains(END)
    payload = F.substring(block, 1, 1 << 30)
    return F.when(split, head), F.when(split, F.substr(block, F.octet_length(head) + 1 + len(END), F.octet_length(block))).otherwise(payload)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.octet_length("value").cast("bigint").alias("size"),
        F.xxhash64("value").alias("hash"),
        "value",
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece of the files with its offset; of those that look like records, the header and the successor's offset.

    Offsets are sums over the pieces before: within a split and then over a file's splits.
    """
    known = F.col("value").rlike(r"^[01]\r\n") & F.col("value").contains(END)
    found = _pieces(spark, path).withColumn("header", F.when(known, F.substring_index("value", END, 1)))
    found = found.withColumn("content", F.when(F.col("header").isNotNull(), _header("Content-Length").try_cast("bigint")))
    head = F.octet_length("header") + len(END)
    http, payload = _http(F.substr(F.col("value").cast("binary"), (head + 1).cast("int"), F.least("content", F.lit(1 << 30)).cast("int")))
    alone = F.col("content") + head <= F.col("size")  # the record ends within this piece
    found = found.withColumns(
        {
            "head": head,
            "http": F.when(alone, http),
            "payload_bytes": F.when(alone, F.octet_length(payload).cast("bigint")),
            "payload_digest": F.when(alone, F.sha1(payload)),
        }
    ).drop("value")
    found = saved(found, "warc_pieces")
    step = F.col("size") + len(MAGIC)
    inner = F.sum(step).over(Window.partitionBy("file", "block").orderBy("seq")) - step
    blocks = found.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.col("before") + F.col("inner") - len(MAGIC)
    found = found.withColumn("inner", inner).join(blocks, ["file", "block"]).withColumn("offset", at).drop("inner", "before", "seq")
    behind = F.col("offset") + len(MAGIC) + F.col("head") + F.col("content") + len(END)
    return saved(found.withColumn("next", F.when(F.col("offset") >= 0, behind)), "warc_candidates")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates(file, block, offset, next) that the chain from offset 0 of their file reaches.

    Candidates that follow one another within a split make a run; runs point to the run their last one leads into.
    Pointers are doubled until the chain from the file's start has no run left to add, so the rounds grow with the
    logarithm of a file's runs.
    """
    some = found.where("next is not null")
    order = Window.partitionBy("file", "block").orderBy("offset")
    some = some.withColumn("begins", ~F.coalesce(F.lag("next").over(order) == F.col("offset"), F.lit(False)))
    some = saved(some.withColumn("run", F.max(F.when(F.col("begins"), F.col("offset"))).over(order)).drop("begins"), "warc_runs")
    runs = some.groupBy("file", "run").agg(F.max("next").alias("exit"))
    entries = some.select("file", F.col("offset").alias("exit"), F.col("run").alias("to"))
    jumps = saved(runs.join(entries, ["file", "exit"]).select("file", "run", "to", F.col("exit").alias("entry")), "warc_jumps")
    reached = saved(some.where("offset = 0").select("file", "run", F.lit(0).cast("bigint").alias("entry")), "warc_reached")
    while True:
        more = reached.select("file", "run").join(jumps, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        more = saved(more, "warc_more")
        if more.isEmpty():
            break
        reached = saved(reached.unionByName(more), "warc_reached")
        second = jumps.select("file", F.col("run").alias("to"), F.col("to").alias("end"), F.col("entry").alias("last"))
        jumps = saved(jumps.join(second, ["file", "to"]).select("file", "run", F.col("end").alias("to"), F.col("last").alias("entry")), "warc_jumps")
    return some.join(reached, ["file", "run"]).where("offset >= entry").drop("run", "entry")


def _assembled(records: DataFrame, found: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """file, offset and block (in binary) of `records`, put together from the pieces they extend over."""
    inside = Window.partitionBy("file").orderBy("offset")
    marked = found.where("offset >= 0").select(*SEGMENT, "offset").join(
        records.select("file", "offset", F.col("offset").alias("own")), ["file", "offset"], "left"
    )
    # pieces follow their record; only offsets and hashes are sorted by file, not contents
    owned = marked.withColumn("own", F.last("own", ignorenulls=True).over(inside))
    ends = records.select("file", F.col("offset").alias("own"), "next", "head", "content")
    owned = saved(owned.join(ends, ["file", "own"]).where("offset < next"), "warc_owned")
    contents = _pieces(spark, path).select(*SEGMENT, "value")
    contents = contents.join(owned.select(*SEGMENT).distinct(), SEGMENT).dropDuplicates(SEGMENT)
    parts = owned.join(contents, SEGMENT).groupBy("file", "own", "head", "content")
    whole = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).alias("whole"))
    content = F.substr(F.col("whole").cast("binary"), (F.col("head") + 1).cast("int"), F.col("content").cast("int"))
    return whole.select("file", F.col("own").alias("offset"), content.alias("block"))


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives under `path`: file, offset, warc_type, record_id, target_uri, refers_to, digest (the
    header's), http_bytes (the HTTP header's Content-Length), payload_bytes and payload_digest (SHA-1) of what the record
    holds, and with with_payload the payload.

    Offsets count the bytes before gzip compression. A file that doesn't begin with a record has none; a chain that
    breaks off, in a cut file, ends there. Empty folders give no rows. One record has to fit into memory, a file needn't.
    """
    found = candidates(spark, path)
    records = saved(reachable(found).drop("block"), "warc_records")
    spread = records.where("payload_digest is null")
    if with_payload or not spread.isEmpty():
        wanted = records if with_payload else spread
        http, payload = _http(F.col("block"))
        whole = _assembled(wanted, found, spark, path).select(
            "file",
            "offset",
            http.alias("own_http"),
            F.octet_length(payload).cast("bigint").alias("own_bytes"),
            F.sha1(payload).alias("own_digest"),
            *([payload.alias("payload")] if with_payload else []),
        )
        records = records.join(whole, ["file", "offset"], "left").withColumns(
            {
                "http": F.coalesce("own_http", "http"),
                "payload_bytes": F.coalesce("own_bytes", "payload_bytes"),
                "payload_digest": F.coalesce("own_digest", "payload_digest"),
            }
        )
    return records.select(
        "file",
        "offset",
        _header("WARC-Type").alias("warc_type"),
        _header("WARC-Record-ID").alias("record_id"),
        _header("WARC-Target-URI").alias("target_uri"),
        _header("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        F.regexp_extract("http", r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1).try_cast("bigint").alias("http_bytes"),
        "payload_bytes",
        "payload_digest",
        *(["payload"] if with_payload else []),
    )


def page_number(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def archived(pages: DataFrame) -> DataFrame:
    """pages written as WARC archives in the shared folder and read back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A revisit's bytes and digest are those its headers state of the full payload."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    revisit = F.col("warc_type") == "revisit"
    return read_warc(spark, path).select(
        page_number(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("http_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page_number(F.col("refers_to")).alias("refers_to"),
    )
