"""Quality rules whose thresholds follow the data: fences from mergeable quantile sketches per language and source.

A sketch of a measure is how many documents have each value, with values rounded down to their 6 leading binary digits.
Sketches of two parts of the data merge by adding counts, so a language's is the sum of its sources', and a quantile is
right to within 1/32 of its value. All is done with DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import fits
from .common import saved

#: Fixed rules, the same for all documents.
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
WINDOW = 3
#: How far beyond the quartiles a fence stands, in quarter ranges, and in units of the measure where these are narrow.
RANGES = 3
#: measure: (numerator, denominator, whether too little is judged, least distance of a fence from its quartile). Measures
#: are whole: numerators times SCALE, divided by the denominator and rounded down.
SCALE = 1000
MEASURES = {
    "word_length": ("word_chars", "n_words", True, 2000),
    "symbols": ("n_symbols", "n_words", False, 100),
    "dup_lines": ("n_dup_lines", "n_lines", False, 500),
    "repeats": ("n_repeat_words", "n_words", False, 300),
}
#: Groups with fewer documents use the sketch of their language, or of all documents if that is small, too.
LEAST_DOCS = 100
#: Most documents of a group that one task of the join with thresholds gets when these can't be broadcast.
SALT_ROWS = 1_000_000
_SPACE = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\f\r"
_BITS = 6


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_BLANK))
    return F.when(bare != "", F.split(bare, _SPACE)).otherwise(F.array().cast("array<string>"))


def _repeat_words(windows: Column) -> Column:
    """Words that lie in a window found twice or more, from the windows' hashes in order of place.

    Sorted with their places, equal windows are neighbours; the union of the runs of WINDOW words that begin at the places
    found is added up from the distance of each to the next.
    """
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    marked = F.transform(
        F.array(F.sort_array(pairs)),  # the one element makes sure that the sorted array is computed once
        lambda s: F.transform(
            s,
            lambda x, k: F.when(
                F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)), x["i"]
            ),
        ),
    )
    places = F.array(F.sort_array(F.array_compact(F.get(marked, 0))))
    covered = F.transform(places, lambda p: F.aggregate(p, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(x - a["last"], F.lit(WINDOW))).alias("n")), lambda a: a["n"]))
    return F.get(covered, 0)


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of the whole text.

    Each column is a step of its own, so that no long array is computed twice.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    out = docs.withColumns(
        {
            "_words": _words(text),
            "_lines": lines,
            "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint"),
        }
    )
    window = lambda i: [F.get("_words", i + k) for k in range(WINDOW)]
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_windows": F.transform(starts, lambda i: F.xxhash64(*window(i))),
        }
    ).drop("_words", "_lines")
    repeated = F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), _repeat_words(F.col("_windows")))
    return out.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("bigint"))).drop("_windows")


def rounded(value: Column) -> Column:
    """A whole number without all but its leading binary digits: the name of its cell in a sketch."""
    drop = F.greatest(F.length(F.bin(value)) - _BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of all measures: keys, measure, cell, n."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), rounded(F.col(f"_{m}")).alias("cell")) for m in MEASURES]))
    return rows.select(*keys, each.alias("_m")).select(*keys, "_m.*").groupBy(*keys, "measure", "cell").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of larger groups: counts add."""
    return sketches.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, docs, q1, q3: the least cell up to which a quarter, or three quarters, of the documents lie."""
    upto = Window.partitionBy(*keys, "measure").orderBy("cell")  # cells of one sketch: a few hundred at most
    within = Window.partitionBy(*keys, "measure")
    run = sketches.withColumn("_upto", F.sum("n").over(upto)).withColumn("_docs", F.sum("n").over(within))
    at = lambda share: F.min(F.when(4 * F.col("_upto") >= share * F.col("_docs"), F.col("cell")))
    return run.groupBy(*keys, "measure").agg(F.max("_docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))


def _fences(found: DataFrame, keys: list[str]) -> DataFrame:
    """A row per group: docs, and low_ and high_ of every measure."""
    aggs = [F.max("docs").alias("docs")]
    for m, (_, _, both, least) in MEASURES.items():
        own = F.col("measure") == m
        reach = F.greatest(RANGES * (F.col("q3") - F.col("q1")), F.lit(least))
        aggs.append(F.max(F.when(own, F.col("q3") + reach)).alias(f"high_{m}"))
        if both:
            aggs.append(F.max(F.when(own, F.col("q1") - reach)).alias(f"low_{m}"))
    return found.groupBy(*keys).agg(*aggs)


def thresholds(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """_lang, _source, docs (of the group itself) and the fences that hold for it."""
    fine = saved(sketched(rows, ["_lang", "_source"]), "quality_sketches")
    by_lang = saved(merged(fine, ["_lang"]), "quality_sketches")
    everything = merged(by_lang, [])
    own, wide = _fences(quartiles(fine, ["_lang", "_source"]), ["_lang", "_source"]), _fences(quartiles(by_lang, ["_lang"]), ["_lang"])
    names = [c for c in own.columns if c not in ("_lang", "_source", "docs")]
    whole = _fences(quartiles(everything, []), [])
    whole = whole.select(*[F.col(c).alias(f"_all_{c}") for c in names])
    wide = wide.select(F.col("_lang").alias("_l"), F.col("docs").alias("_lang_docs"), *[F.col(c).alias(f"_lang_{c}") for c in names])
    joined = own.join(wide, F.col("_lang").eqNullSafe(F.col("_l"))).join(F.broadcast(whole))  # one row
    best = lambda c: (
        F.when(F.col("docs") >= least_docs, F.col(c)).when(F.col("_lang_docs") >= least_docs, F.col(f"_lang_{c}")).otherwise(F.col(f"_all_{c}"))
    )
    return joined.select("_lang", "_source", "docs", *[best(c).alias(c) for c in names])


def quality(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of docs(doc_id, text, lang,
    source).

    `base_failed` are the fixed rules. `kept` are documents that pass these and whose measures lie within the fences of
    their language and source: RANGES quarter ranges beyond the quartiles of all documents there that pass the fixed
    rules. Words are told apart as they stand, lines too; equal windows of words are told by their 64-bit hash within
    one text.

    A null text is an empty one: it has no words, so it fails. A null language or source is a group of its own. Repeated
    rows count and are returned as often as they stand there. Without doc_id, lang or source columns that are null, any
    type will do; other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"))
    counts = measured(rows).drop("text")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed)
    share = lambda a, b: F.call_function("div", F.col(a) * SCALE, F.greatest(F.col(b), F.lit(1)))
    counts = saved(counts.withColumns({f"_{m}": share(a, b) for m, (a, b, _, _) in MEASURES.items()}), "quality_counts")
    limits = saved(thresholds(counts.where("not base_failed"), least_docs), "quality_fences")
    inside = F.lit(True)
    for m, (_, _, both, _) in MEASURES.items():
        inside = inside & (F.col(f"_{m}") <= F.col(f"high_{m}"))
        if both:
            inside = inside & (F.col(f"_{m}") >= F.col(f"low_{m}"))
    judged = _with_limits(counts, limits)
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def _with_limits(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """Every document with the fences of its group. Beyond the size that is broadcast, large groups are salted."""
    limits = limits.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), *[c for c in limits.columns if c[0] != "_"])
    same = F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s"))
    if fits(limits):
        return counts.join(F.broadcast(limits), same, "left")
    salts = F.ceil(F.col("docs") / SALT_ROWS).cast("int")
    large = limits.where(F.col("docs") > SALT_ROWS).select("_l", "_s", salts.alias("_n"))  # rows / SALT_ROWS at most
    counts = counts.join(F.broadcast(large) if fits(large) else large, same, "left").drop("_l", "_s")
    counts = counts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.coalesce("_n", F.lit(1))).cast("int"))
    copies = limits.withColumn("_copy", F.explode(F.sequence(F.lit(0), salts - 1)))
    return counts.join(copies, same & (F.col("_salt") == F.col("_copy")), "left")
