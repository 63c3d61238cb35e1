"""From raw documents to packed sequences, by five of the operators in skyfold.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents:

    quality_rules   documents that the rules reject go
    line_dedup      lines of runs that occurred before go from the texts; a document left without a line goes
    jaccard_join    of each component of near-duplicates the first document stays; documents are held by the texts that
                    they have now and by those that they came with (documents of sf_dir, if it is there), as line dedup
                    leaves only fragments of a later copy
    mixing          each document as often as its leaf's stream passes it, up to twice, by the weights in mixing.TARGETS
    packing         a row for each token piece, with its ids, its sequence and its place there

Rules for odd inputs, the stages' own apart (see their modules): a null text or one without 50 words goes in the first
stage; rows alike in id and text are one document to line dedup and to the Jaccard join, which keeps one of them, the one
whose other columns have the least hash; a null id is a document like any other; a column beyond those of documents, of
whatever name, is carried along by all but the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyfold.llm import jaccard_join, line_dedup, mixing, packing, quality
from skyfold.llm.common import table
from skyfold.sources.files import read_optional
from skyfold.tables import stored


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.rewrite(docs)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # near copies are told by the texts as they came in too: of a later copy line dedup leaves fragments
    return jaccard_join.one_of_each(docs, before=read_optional(spark, f"{sf_dir}/documents.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, weights=mixing.targets(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, ids=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Shingle hashes, tokens and best-fit packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
