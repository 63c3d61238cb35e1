"""Mixing sources to target weights by hierarchical budgeting.  DataFrame functions only.

Documents hang on a tree: domain, then language, then source.  Each node's weight is its share of its parent's budget.
From the root down, a node's budget is dealt to its children by weight, but no child gets more than its capacity (the
tokens below it, times the epochs allowed); what a child can't take goes to its siblings by weight, and only when all
of them are full does the parent get less than its share, which its own siblings then take.  A leaf's tokens come from
its stream: each epoch has all of the leaf's documents in an order seeded by the epoch, and the prefix that first
reaches the budget is taken.

Tokens are words: the longest runs of code points outside ASCII white space.

Inputs that need a rule: a null domain, language or source is a value of its own; a null text has no tokens; documents
without tokens cost nothing and are taken as often as the stream passes them; a leaf without tokens is taken once whole;
a node without a weight has weight 1, one of weight 0 or below gets nothing unless its siblings are full (then it shares
what is left); a null id, repeated ids and repeated rows are ordered by their other columns, ties share one fate; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import stored
from .common import WORD_GAP, rename_inputs

LEVELS = ("domain", "lang", "source")
EPOCHS = 2
SEED = 17
#: Ordered slices of a leaf's stream in each epoch; a task sorts one at a time, however many rows the leaf holds.
SLICES = 4096
# The production targets.  A node's weight is its share beside its siblings'; null is below the node meant, and a
# node without a line here has weight 1.
DOMAINS, LANGS = ("domain0", "domain1", "domain2", "domain3", "other"), ("en", "fr", "de", "es")
TARGETS = (
    ("domain0", None, None, 2.0),
    *((d, "en", None, 4.0) for d in DOMAINS),
    *(("domain0", x, "src0", 6.0) for x in LANGS),
)


def targets(spark: SparkSession) -> DataFrame:
    """The production weights as a table."""
    return spark.createDataFrame(list(TARGETS), ", ".join(f"{c} string" for c in LEVELS) + ", weight double")


def source_domain(source: Column) -> Column:
    """The production domain of a source: its number modulo 4, other sources in a domain of their own."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"^src(\d{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), F.pmod(F.expr("try_cast(regexp_extract(coalesce(source, ''), '^src([0-9]{1,9})$', 1) AS INT)"), F.lit(4)).cast("string")))


def n_tokens(text: Column) -> Column:
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, WORD_GAP))).cast("long")


def budgets(leaves: DataFrame, total: Column, weights: DataFrame | None = None, epochs: int = EPOCHS) -> DataFrame:
    """leaves (the levels, tokens) with budget.  weights: (the levels, null below the node that is meant; weight).

    One level at a time: children sorted by capacity by weight are full up to some place, and those behind it share what
    is left by weight.  Both sides of that place follow from running sums, so a level is one window over its siblings.
    """
    tree = leaves.withColumn("cap", F.col("tokens") * F.lit(epochs))
    up = {len(LEVELS): tree.groupBy(*LEVELS).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))}
    for depth in range(len(LEVELS) - 1, 0, -1):
        up[depth] = up[depth + 1].groupBy(*LEVELS[:depth]).agg(F.sum("cap").alias("cap"))
    parents = None
    for depth in range(1, len(LEVELS) + 1):
        keys, outer = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        level = up[depth]
        if weights is None:
            level = level.withColumn("w", F.lit(1.0))
        else:
            below = [F.col(k).isNull() for k in LEVELS[depth:]]
            own = weights.where(F.col(keys[-1]).isNotNull())
            for b in below:
                own = own.where(b)
            own = own.select(*[F.col(k).alias(f"_{k}") for k in keys], F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("_w"))
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
            level = level.join(own, on, "left").withColumn("w", F.coalesce("_w", F.lit(1.0))).drop("_w", *[f"_{k}" for k in keys])
        if parents is None:
            level = level.withColumn("pot", total.cast("double"))
        else:
            p = parents.select(*[F.col(k).alias(f"_{k}") for k in outer], F.col("budget").alias("pot"))
            on = F.lit(True)
            for k in outer:
                on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
            level = level.join(p, on).drop(*[f"_{k}" for k in outer])
        # a weight of 0 counts as one so small that it takes part only when the others are full
        level = level.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(1e-12)))
        near = Window.partitionBy(*outer) if outer else Window.partitionBy(F.lit(0))
        run = near.orderBy(F.col("cap") / F.col("w"), *[F.col(k).asc_nulls_first() for k in keys])
        level = level.withColumn("done", F.coalesce(F.sum("cap").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double"))
        level = level.withColumn("open", F.sum("w").over(run.rowsBetween(0, Window.unboundedFollowing)))
        # the level to which all from here on could be filled, if this child and those before it were not full
        level = level.withColumn("mark", F.greatest(F.col("pot") - F.col("done"), F.lit(0.0)) / F.col("open"))
        level = level.withColumn("full", F.col("cap") <= F.col("mark") * F.col("w"))
        level = level.withColumn("line", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "mark"))).over(near)["mark"])
        level = level.withColumn("budget", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("line") * F.col("w"), F.col("cap").cast("double"))))
        parents = level.drop("w", "pot", "done", "open", "mark", "full", "line")
    return parents.withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain=source_domain, weights: DataFrame | None = None, fraction: float = 1.0, epochs: int = EPOCHS, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """A row for each document: doc_id, domain, lang, source, n_tokens, leaf_budget, copies, and _t, its text's hash.

    copies: how often the leaf's prefix passes the document, 0 to epochs.  The budget is fraction of all tokens.
    Running sums are two-fold: over the ordered slices of a leaf, which are few, then within a slice.
    """
    d = rename_inputs(docs, doc_id=doc_id, text=text, lang=lang, source=source)
    d = d.withColumn("domain", domain(F.col("source")))
    # ties in the order: rows alike in all of this share one fate
    d = d.select("doc_id", "domain", "lang", "source", n_tokens(F.col("text")).alias("n_tokens"), F.md5("text").alias("_t"))
    d = stored(d, "tokens")
    leaves = d.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(fraction))).scalar()
    plan = stored(budgets(leaves, total, weights, epochs), "budgets")
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("int")
    plan = plan.withColumn("whole", full).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0)))
    # leaves are as few as the sources: a shuffle join that Spark may turn into a broadcast where the size allows
    leaf = plan.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], "budget", "whole", "rest")
    on = F.lit(True)
    for k in LEVELS:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    d = d.join(leaf, on).drop(*[f"_{k}" for k in LEVELS])
    # the epoch of which a part is taken is the one after the whole ones
    digest = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "_t", F.lit(str(seed)), F.col("whole").cast("string")))
    d = d.withColumn("_order", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))  # 60 bits
    d = d.withColumn("_slice", F.floor((F.col("_order") / F.lit(2.0**60)) * slices).cast("int"))
    d = d.withColumn("_slice", F.least("_slice", F.lit(slices - 1)))
    by_slice = d.groupBy(*LEVELS, "_slice").agg(F.sum("n_tokens").alias("_sum"))
    run = Window.partitionBy(*LEVELS).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("_before", F.coalesce(F.sum("_sum").over(run), F.lit(0)))
    s = by_slice.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], F.col("_slice").alias("_s"), "_before")
    on = F.col("_slice") == F.col("_s")
    for k in LEVELS:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    d = d.join(s, on).drop("_s", *[f"_{k}" for k in LEVELS])
    # a slice has the order's upper bits; RANGE makes ties share their sum
    within = Window.partitionBy(*LEVELS, "_slice").orderBy("_order")
    ahead = F.coalesce(F.sum("n_tokens").over(within.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = (F.col("_before") + ahead < F.col("rest")).cast("int")
    return d.select("doc_id", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), (F.col("whole") + part).cast("long").alias("copies"), "_t")


def resample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents with their own columns, each as often as the mix takes it."""
    taken = mix(docs, doc_id, text, **settings).where("copies > 0").withColumn("_id", F.col("doc_id"))
    taken = taken.groupBy("_id", "_t", *LEVELS).agg(F.max("copies").alias("copies"))
    lang, source = settings.get("lang", "lang"), settings.get("source", "source")
    d = docs.select(F.struct("*").alias("_row"), docs[f"`{doc_id}`"].alias("_id"), F.md5(docs[f"`{text}`"]).alias("_t"), docs[f"`{lang}`"].alias("_l"), docs[f"`{source}`"].alias("_s"))
    t = taken.select(F.col("_id").alias("_tid"), F.col("_t").alias("_tt"), F.col("lang").alias("_tl"), F.col("source").alias("_ts"), "copies")
    # rows alike in id, text, language and source share one fate
    on = F.lit(True)
    for a, b in (("_id", "_tid"), ("_t", "_tt"), ("_l", "_tl"), ("_s", "_ts")):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return d.join(t, on).select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
