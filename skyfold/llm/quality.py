"""Quality rules: base statistics, then a hashed n-gram log-likelihood ratio.  DataFrame functions only.

Words and word pairs are hashed into a fixed number of buckets.  Two multinomials over the buckets, with add-one
smoothing, are counted: the raw corpus from every document, the trusted target from the documents that labels call good
(at most `target_rows` labelled rows, those with the least hash of their id, so that the ids can be broadcast).  A
document's score is the sum over its n-grams of log(target / raw), divided by their number.  Every document is kept
whose score reaches the threshold and whose base statistics pass; nothing is drawn at random.

Inputs that need a rule: a null text has no words; a document without words fails the base rules and has score 0; a
null id stays null and is never in the target; repeated rows are documents of their own, and each counts; an empty
table gives an empty result, and without good labels all scores are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, rename_inputs

#: So many that junk's own n-grams seldom share a bucket with the target's.
BUCKETS = 1 << 20
TARGET_ROWS = 20_000
#: Nats by n-gram.  The corpus's own text scores near 0, what the target has none of far below.
THRESHOLD = -0.5
#: Up to so many words a 64-bit number holds a window's place and at least 49 bits of its hash.
SHORT = 1 << 15

# What separates words, and what counts as a symbol.
GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _split(text: Column) -> Column:
    """The words of a text without white space at its ends, in order."""
    plain = F.btrim(text, F.lit(GAPS))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, WORD_GAP))


def _hashes(text: Column) -> Column:
    """The 64-bit hash of each word, in order."""
    return F.transform(_split(text), lambda w: F.xxhash64(w))


def _tail(c: str | Column) -> Column:
    return F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))


def with_repeated(d: DataFrame) -> DataFrame:
    """d, which has text and the word hashes _h, with n_repeat_words: words in windows of three that occur twice or more.

    The windows' hashes, each with its place in the low bits, are sorted.  Equal neighbours may be repeats: their places are
    sorted again by the words themselves, which decide.  The places found, sorted, cover up to three words each.  Every array
    is a column of its own, as each is read more than once.
    """
    starts = F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0)))
    d = d.withColumn("_win", F.transform(starts, lambda x, i: F.xxhash64(x, F.get(F.col("_h"), i + 1), F.get(F.col("_h"), i + 2))))
    # most texts have no two windows of one hash, which a set tells without sorting
    d = d.withColumn("_twice", F.size(F.array_distinct("_win")) < F.size("_win"))
    short = F.size("_win") <= SHORT
    packed = F.sort_array(F.transform("_win", lambda x, i: F.shiftleft(x, 15).bitwiseOR(i.cast("long"))))
    # beyond that many words, whole hashes beside the places
    wide = F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("w"), i.cast("long").alias("i"))))
    none = F.array()
    d = d.withColumn("_packed", F.when(~F.col("_twice"), none.cast("array<bigint>")).when(short, packed))
    d = d.withColumn("_wide", F.when(F.col("_twice") & ~short, wide))
    low = lambda x: x.bitwiseAND(SHORT - 1)
    near = F.zip_with("_packed", _tail("_packed"), lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), 15) == 0, F.struct(low(a).alias("a"), low(b).alias("b"))))
    far = F.zip_with("_wide", _tail("_wide"), lambda a, b: F.when(a["w"] == b["w"], F.struct(a["i"].alias("a"), b["i"].alias("b"))))
    d = d.withColumn("_found", F.filter(F.coalesce(near, far), lambda x: x.isNotNull()))
    d = d.withColumn("_maybe", F.array_distinct(F.concat(F.col("_found")["a"], F.col("_found")["b"])))
    d = d.withColumn("_words", F.when(F.size("_maybe") > 0, _split(F.col("text"))))
    word = lambda i, k: F.get(F.col("_words"), i.cast("int") + k)
    d = d.withColumn("_sure", F.sort_array(F.transform("_maybe", lambda i: F.struct(word(i, 0).alias("u"), word(i, 1).alias("v"), word(i, 2).alias("w"), i.alias("i")))))
    same = F.zip_with("_sure", _tail("_sure"), lambda a, b: F.when((a["u"] == b["u"]) & (a["v"] == b["v"]) & (a["w"] == b["w"]), F.struct(a["i"].alias("a"), b["i"].alias("b"))))
    d = d.withColumn("_equal", F.filter(same, lambda x: x.isNotNull()))
    d = d.withColumn("_places", F.sort_array(F.array_distinct(F.concat(F.col("_equal")["a"], F.col("_equal")["b"]))))
    three = F.lit(3).cast("long")
    covered = F.zip_with("_places", _tail("_places"), lambda a, b: F.least(three, F.coalesce(b - a, three)))
    return d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)).drop("_win", "_twice", "_packed", "_wide", "_found", "_maybe", "_words", "_sure", "_equal", "_places")


#: Tells documents apart: rows alike in id and text share one fate.
KEY = ("_id", "_x", "_y")


def _keyed(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """doc_id, text without null, the key, and more."""
    t = F.coalesce(docs[f"`{text}`"], F.lit(""))
    key = [F.coalesce(docs[f"`{doc_id}`"].cast("long"), F.lit(0)).alias("_id"), F.xxhash64(t).alias("_x"), F.xxhash64(F.lit(7), t).alias("_y")]
    return docs.select(docs[f"`{doc_id}`"].alias("doc_id"), t.alias("text"), *key, *more)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the key."""
    bare = lambda x, out: F.length(F.translate(x, out, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(GAPS)) != "")
    d = _keyed(docs, doc_id, text).withColumn("_h", _hashes(F.col("text"))).withColumn("_lines", lines)
    d = d.select(
        *KEY,
        "doc_id",
        "text",
        "_h",
        F.size("_h").cast("long").alias("n_words"),
        bare(F.col("text"), GAPS).cast("long").alias("word_chars"),
        (F.length("text") - bare(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    d = with_repeated(d).drop("_h", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def _neighbours(d: DataFrame, *keep: str) -> DataFrame:
    """A row for each word of text: keep, w and next (null after the last).

    Side by side, so that hashes and buckets are plain columns of generated code, not functions called for each element.
    """
    d = d.select(*keep, _split(F.col("text")).alias("w")).withColumn("next", _tail("w"))
    return d.select(*keep, F.inline(F.arrays_zip(F.col("w").alias("w"), F.col("next").alias("next"))))


def _buckets(buckets: int) -> tuple[Column, Column]:
    """Of a row of neighbours, the buckets of the word and of the pair (null without a next word)."""
    one, two = F.xxhash64("w"), F.xxhash64("next")
    bucket = lambda x: F.pmod(x, F.lit(buckets)).cast("int")
    return bucket(one), F.when(F.col("next").isNotNull(), bucket(F.xxhash64(one, two)))


def log_ratios(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", good: str = "quality", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row: llr, an array with log(target / raw) of each bucket, n_target and n_raw, the n-grams counted.

    Counts are summed within tasks first: a shuffle carries at most a row for each bucket and task.
    """
    chosen = rename_inputs(labels, label_id=label_id, good=good).where("good = 1 AND label_id IS NOT NULL").select("label_id").distinct()
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(target_rows)
    d = rename_inputs(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"), "left").withColumn("trusted", F.col("label_id").isNotNull().cast("long"))
    grams = _neighbours(d, "trusted").select("trusted", F.explode(F.array(*_buckets(buckets))).alias("bucket")).where("bucket IS NOT NULL")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    every = d.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    whole = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    ratio = lambda x: F.log((x["target"] + 1) / (F.col("n_target") + buckets)) - F.log((x["raw"] + 1) / (F.col("n_raw") + buckets))
    return whole.select(F.when(F.col("n_target") > 0, F.transform("all", ratio)).otherwise(F.transform("all", lambda x: F.lit(0.0))).alias("llr"), "n_target", "n_raw")


def scores(docs: DataFrame, llr: Column, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The key and score of every document with a word: the mean ratio of its n-grams."""
    d = _neighbours(_keyed(docs, doc_id, text), *KEY)
    one, two = _buckets(buckets)
    # in one place, so that the optimizer puts the table there and no row carries a copy of it
    d = d.withColumn("_llr", llr)
    value = F.get(F.col("_llr"), one) + F.when(two.isNotNull(), F.get(F.col("_llr"), two)).otherwise(F.lit(0.0))
    d = d.select(*KEY, value.alias("v"), F.col("next").isNotNull().cast("int").alias("pair"))
    return d.groupBy(*KEY).agg((F.sum("v") / (F.count("*") + F.sum("pair"))).alias("score"))


def _judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", good: str = "quality", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    llr = log_ratios(docs, labels, doc_id, text, label_id, good, buckets, target_rows).select("llr").scalar()
    d = statistics(docs, doc_id, text).join(scores(docs, llr, doc_id, text, buckets), list(KEY), "left")
    d = d.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def judge(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, the statistics, score and kept, for every document."""
    return _judged(docs, labels, **settings).drop(*KEY)


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that are kept, with their own columns."""
    # a filter would be pushed below the arrays' projections, and each array computed again wherever it is read
    good = _judged(docs, labels, doc_id, text, **settings).select(F.inline(F.when(F.col("kept"), F.array(F.struct(*KEY))))).distinct()
    return _keyed(docs, doc_id, text, F.struct("*").alias("_row")).join(good, list(KEY)).select("_row.*")
