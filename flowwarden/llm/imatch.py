"""I-Match fingerprints with DataFrame functions only.

A text's terms are its distinct words whose share of the distinct texts lies in a band: neither so common that they tell
nothing nor so rare that a typing error makes one. A text with few of them has its rarest other words of two documents or
more, too, so that the texts of a group that fills much of the table are told by the words of the group. Random subsets of this lexicon each give a hash of the sorted terms they keep,
so an edit changes only the hashes of the subsets that hold a changed term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_key

#: A term of the lexicon is in at least and at most this share of the distinct texts, and in LEAST_DOCS at least.
LEAST_SHARE = 1 / 1000
MOST_SHARE = 1 / 10
LEAST_DOCS = 2
#: A text with fewer terms of the lexicon is filled up to so many with its rarest words of LEAST_DOCS documents or more.
FEW_TERMS = 16
#: Subsets of the lexicon that a fingerprint has at each of its two levels.
SUBSETS = 32
#: A lexicon has at most (mean terms of a document) / LEAST_SHARE terms; up to so many are broadcast.
BROADCAST_TERMS = 1_000_000
_MARK = 0  # stands in every text, so that texts without terms stay


def terms(text: Column) -> Column:
    """Hashes of the distinct words, runs of letters and digits in lower case, and the mark."""
    words = F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))
    return F.concat(F.array(F.lit(_MARK).cast("bigint")), F.transform(words, lambda w: F.xxhash64(w)))


def word_counts(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """term, n (distinct texts that have it) and `banded` of the words that LEAST_DOCS of docs(text) or more have, and of
    the mark. Copies are told by a column `again`, if docs has it. Counted over all documents, in tasks before the shuffle."""
    first = ~F.col("again") if "again" in docs.columns else F.lit(True)
    each = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"), first.cast("int").alias("first"))
    counts = each.groupBy("term").agg(F.sum("first").alias("n"), F.count("*").alias("rows"))
    counts = saved(counts.where(f"rows >= {LEAST_DOCS} or term = {_MARK}").drop("rows"), "imatch_counts")
    every = counts.where(F.col("term") == _MARK).select(F.col("n").alias("docs"))
    banded = F.col("n").between(F.col("docs") * least, F.col("docs") * most) & (F.col("n") >= LEAST_DOCS)
    banded |= F.col("term") == _MARK
    return counts.join(F.broadcast(every)).select("term", "n", banded.alias("banded"))  # one row


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """The terms of docs(text) in the band, and the mark."""
    return saved(word_counts(docs, least, most).where("banded").select("term"), "imatch_lexicon")


def _told(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs(doc_id, key, text) with `again`: whether a row before it, by doc_id, has the same text."""
    first = ids.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    later = saved(ids.join(first, "key").where("doc_id <> first").select("doc_id", "key"), "imatch_again")
    later = F.broadcast(later) if later.count() <= BROADCAST_TERMS else later
    return docs.join(later.withColumn("again", F.lit(True)), ["doc_id", "key"], "left").withColumn("again", F.coalesce("again", F.lit(False)))


def with_cells(kept: DataFrame, name: str) -> DataFrame:
    """Columns for the fingerprint of the terms in column `name`: the level, and of each level the terms of the first
    SUBSETS cells with the mask that tells a term's cell. They are columns of their own, so that no loop repeats them."""
    kept = kept.withColumn(f"{name}_level", F.floor(F.log2(F.size(name))).cast("int"))
    for n in (0, 1):
        kept = kept.withColumn(f"{name}_mask{n}", F.pow(F.lit(2.0), F.col(f"{name}_level") + n).cast("bigint") - 1)
        own = F.filter(name, lambda t, m=F.col(f"{name}_mask{n}"): t.bitwiseAND(m) < SUBSETS)
        kept = kept.withColumn(f"{name}_cells{n}", own)
    return kept


def fingerprint(name: str, text_hash: Column) -> Column:
    """The fingerprint of a text with the sorted terms in column `name`, the mark not among them, after `with_cells`.

    At level L the lexicon falls into 2^L random subsets; a text has the hashes of the first SUBSETS of them at the level
    that leaves one to two terms in each, and at the next. Without terms the text's own hash stands in.
    """

    def at(n: int) -> Column:
        mask, own = F.col(f"{name}_mask{n}"), F.col(f"{name}_cells{n}")
        cells = F.sequence(F.lit(0), F.least(mask, F.lit(SUBSETS - 1)).cast("int"))
        subsets = F.transform(cells, lambda j: F.filter(own, lambda t: t.bitwiseAND(mask) == j))
        names = F.transform(subsets, lambda h: F.when(F.size(h) == 0, "-").otherwise(F.substr(F.lpad(F.hex(F.xxhash64(h)), 16, "0"), F.lit(9), F.lit(8))))
        # naming `own` here, too, keeps it a column: the planner would put an expression used once into the loop
        some = F.when(F.size(own) >= 0, F.array_join(names, ","))
        return F.concat((F.col(f"{name}_level") + n).cast("string"), F.lit(":"), some)

    return F.when(F.size(name) > 0, F.concat(at(0), F.lit(";"), at(1))).otherwise(F.concat(F.lit("text:"), text_hash))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets that are not empty in both, at the lowest level both texts have."""

    def part(x: Column, i: int) -> Column:
        return F.split(F.get(F.split(x, ";"), F.lit(i)), ":")

    own = [(part(a, i), part(b, j)) for i, j in ((0, 0), (0, 1), (1, 0))]
    pair = F.coalesce(*[F.when(x[0] == y[0], F.struct(F.split(x[1], ",").alias("x"), F.split(y[1], ",").alias("y"))) for x, y in own])
    both = F.filter(F.arrays_zip(pair["x"].alias("x"), pair["y"].alias("y")), lambda p: (p["x"] != "-") | (p["y"] != "-"))
    same = F.size(F.filter(both, lambda p: p["x"] == p["y"]))
    share = F.when(F.size(both) > 0, same / F.size(both)).otherwise(0.0)
    return F.when(a == b, 1.0).when(a.startswith("text:") | b.startswith("text:"), 0.0).otherwise(F.coalesce(share, F.lit(0.0)))


def _following(ids: DataFrame) -> DataFrame:
    """ids(doc_id, key, n_chars) with next_id and next_key, the next in ascending order; the first after the last.

    Rows are ranged into partitions; each looks ahead on its own, and one row per partition tells where the next begins.
    """
    ranged = saved(ids.repartitionByRange("doc_id", "key").withColumn("bucket", F.spark_partition_id()), "imatch_order")
    here = F.struct("doc_id", "key")
    firsts = ranged.groupBy("bucket").agg(F.min(here).alias("first"))
    ends = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.coalesce(F.lead("first").over(Window.orderBy("bucket")), F.first("first").over(ends))
    firsts = firsts.select("bucket", ahead.alias("ahead"))  # as many rows as partitions
    following = F.lead(here).over(Window.partitionBy("bucket").orderBy("doc_id", "key"))
    found = ranged.withColumn("following", following).join(F.broadcast(firsts), "bucket").withColumn("following", F.coalesce("following", "ahead"))
    return saved(
        found.select("doc_id", "key", "n_chars", F.col("following.doc_id").alias("next_id"), F.col("following.key").alias("next_key")), "imatch_next"
    )


def _banded(w: int) -> Column:
    """The sorted terms of a text, or of the edited one, from joined rows of the lexicon."""
    return F.sort_array(F.collect_list(F.when((F.col("w") == w) & (F.col("term") != _MARK), F.col("term"))))


def _filled(w: int) -> Column:
    """As _banded, from joined rows of word_counts; if there are fewer than FEW_TERMS, with the rarest words besides."""
    own = F.collect_list(F.when((F.col("w") == w) & (F.col("term") != _MARK), F.struct((~F.col("banded")).alias("out"), "n", "term")))
    own = F.sort_array(own)  # those of the band first
    return F.sort_array(F.transform(F.filter(own, lambda x, i: ~x["out"] | (i < FEW_TERMS)), lambda x: x["term"]))


def _prints(docs: DataFrame, wanted: DataFrame, known: DataFrame, taken, every: DataFrame | None = None) -> DataFrame:
    """doc_id, key, n_chars, edited_sha256, both fingerprints, and `few`, whether one has fewer than FEW_TERMS terms, of
    docs, whose next ones are in `every`."""
    heads = (docs if every is None else every).join(wanted, ["doc_id", "key"]).select(
        F.col("prev_id").alias("doc_id"), F.col("prev_key").alias("key"), F.substr("text", F.lit(1), F.col("need")).alias("head")
    )
    size = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), (size - F.floor(size / 4)).cast("int")), F.col("head"))
    both = docs.join(heads, ["doc_id", "key"]).select(
        "doc_id", "key", size.cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("sha256"), "text", edited.alias("edited")
    )
    each = both.select(
        "doc_id", "key", "n_chars", "sha256", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("w"), terms(F.col("text")).alias("t")), F.struct(F.lit(1).alias("w"), terms(F.col("edited")).alias("t")))).alias("own"),
    ).select("doc_id", "key", "n_chars", "sha256", "edited_sha256", "own.w", F.explode("own.t").alias("term"))
    known = F.broadcast(known) if known.count() <= BROADCAST_TERMS else known
    # the row of the mark alone carries what is said once for a document
    once = {c: F.when((F.col("term") == _MARK) & (F.col("w") == 0), F.col(c)) for c in ("n_chars", "sha256", "edited_sha256")}
    kept = each.select("doc_id", "key", "w", "term", *[v.alias(c) for c, v in once.items()]).join(known, "term")
    kept = kept.groupBy("doc_id", "key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in once], taken(0).alias("t"), taken(1).alias("e"))
    return with_cells(with_cells(kept, "t"), "e").select(
        "doc_id", "key", "n_chars", "edited_sha256",
        fingerprint("t", F.col("sha256")).alias("fingerprint"),
        fingerprint("e", F.col("edited_sha256")).alias("edited_fingerprint"),
        (F.least(F.size("t"), F.size("e")) < FEW_TERMS).alias("few"),
    )


def edited_fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for docs(doc_id, text).

    The edited text has the last quarter of its code points, rounded down, replaced by as many first ones of the next
    document, in ascending order of doc_id, or by all it has; the first follows the last, and a single document itself.

    A null text is an empty one, whose edited text is empty. Rows that repeat a doc_id and text are one document and give
    one row; other rows of one doc_id follow each other in the order of a hash of their texts. A null doc_id comes first.
    Texts without any word that another document has, too, have a hash of the text as their fingerprint. Other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    ids = docs.select("doc_id", "key", F.length("text").cast("bigint").alias("n_chars"))
    once = ids.groupBy("doc_id", "key").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    once = saved(once, "imatch_ids")
    if not once.where("copies > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "key"])
    counts = saved(word_counts(_told(docs, once.select("doc_id", "key")), least, most), "imatch_words")
    order = _following(once.drop("copies"))
    wanted = order.select(
        F.col("next_id").alias("doc_id"),
        F.col("next_key").alias("key"),
        F.col("doc_id").alias("prev_id"),
        F.col("key").alias("prev_key"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("need"),
    )
    found = saved(_prints(docs, wanted, counts.where("banded").select("term"), _banded), "imatch_prints")
    thin = found.where("few and n_chars > 0").select("doc_id", "key")
    if n_thin := thin.count():
        thin = F.broadcast(thin) if n_thin <= BROADCAST_TERMS else thin
        some = wanted.join(thin.select(F.col("doc_id").alias("prev_id"), F.col("key").alias("prev_key")), ["prev_id", "prev_key"])
        some = F.broadcast(some) if n_thin <= BROADCAST_TERMS else some
        filled = _prints(docs.join(thin, ["doc_id", "key"], "left_semi"), some, counts, _filled, docs)
        found = saved(found.join(thin, ["doc_id", "key"], "left_anti").unionByName(filled), "imatch_prints")
    after = order.select("doc_id", "key", "next_id", "next_key").join(
        found.select(F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint")), ["next_id", "next_key"]
    )
    return found.join(after.select("doc_id", "key", "next_fingerprint"), ["doc_id", "key"]).select(
        F.nullif("doc_id", F.lit(-(1 << 63))).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
