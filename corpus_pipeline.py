"""The corpus pipeline: quality, language, exact duplicates, near duplicates, packing.

Each stage takes the documents that the stage before kept, written as Parquet, and all but the last return the
columns of documents. Extra columns, whatever their names, pass through to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.llm import common, exact_dedup, language_id, near_dedup, packing, quality, tokens

#: A language is accepted if it leads the next by this share or knows nearly all of the text, and knows a least share of it in any case.
LEAST_LANGUAGE_SCORE, SURE_COVERAGE, LEAST_COVERAGE = 0.51, 0.8, 0.4
#: Words of a shingle.
SHINGLE = 5
#: Tables that a stage's rows still read; `run` deletes them when these are written.
_SCRATCHES: list[common.Scratch] = []


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose doc_id and text (by hash) are not among the rejected ones; a null doc_id matches itself."""
    doc_id, text_hash = common.fresh(docs, "rejected_id"), common.fresh(docs, "rejected_hash")
    gone = rejected.select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash)).distinct()
    return docs.join(common.bounded(gone), F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text_hash)), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's limit of perplexity.

    Kept as well: rows with a null doc_id, a null or empty text, and texts whose language (null is one) has too few trusted texts. Repeated
    rows stay or go together; an empty table stays empty.
    """
    return _without(docs, quality.scores(docs, common.table(spark, sf_dir, "labels")).where("not kept"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, learnt from the stage's own rows with a language.

    Null texts, empty ones and those without a letter have none and go; a null doc_id or lang doesn't matter; without any row
    with a language nothing can be identified and all go. Repeated rows stay or go together; an empty table stays empty.
    """
    found = common.written(language_id.predict(docs, language_id.fit(docs)), "languages")
    led = (F.col("score") >= LEAST_LANGUAGE_SCORE) | (F.col("coverage") >= SURE_COVERAGE)
    return _without(docs, found.where((F.col("lang_pred") == language_id.UNKNOWN) | ~led | (F.col("coverage") < LEAST_COVERAGE)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id.

    Null text counts as empty; a null doc_id stays only where all of the group are null; of repeated rows one stays; an empty table stays empty.
    """
    scratch = common.Scratch(spark)
    _SCRATCHES.append(scratch)
    return exact_dedup.keepers(docs, scratch)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Rows with a null doc_id and texts without words (null ones too) are linked with nothing and stay; rows that share a doc_id are one document; an empty
    table stays empty.
    """
    return common.restricted(docs, near_dedup.near_duplicates(docs, width=SHINGLE).where("doc_id is not null and not kept").select("doc_id").distinct(), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of at most 4096 tokens.

    A null or empty text is its end id alone; a null doc_id stays null; repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs, tokens.default_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("packing", packing_stage),
]

#: The stages' models and sketches have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    with common.Scratch(spark) as scratch:
        for i, (name, stage) in enumerate(STAGES):
            after = stage(spark, docs, sf_dir)
            after = scratch.written(after, f"stage-{name}") if i < len(STAGES) - 1 else common.written(after, name)
            scratch.dropped(docs)
            while _SCRATCHES:
                _SCRATCHES.pop().__exit__()
            docs = after
    return docs
