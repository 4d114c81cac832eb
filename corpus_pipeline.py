"""A training-data pipeline over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontamination, jaccard_join, language_id, substring_dedup, token_codec
from seqloom.llm.store import discard, fresh, materialize

#: Part of the stages (models, components) cannot be expressed in SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def _columns_of(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with enough confidence; null texts and texts without a letter go. Repeated rows
    stay repeated, an empty table stays empty, and other columns go through, whatever their names."""
    names = fresh(docs.columns, "lang_pred", "score", "rejected")
    out = language_id.identify(docs, language_id.fit_model(docs), carry=tuple(docs.columns), results=names)
    return _columns_of(docs, out.where(~F.col(names[2])))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each component of similar shingle sets. Texts without words and null texts
    are in no component and stay (rows that repeat each other once), an empty table stays empty, other columns go through."""
    return _columns_of(docs, jaccard_join.keep_one(docs))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once; n_chars follows. Texts without one, and null texts, stay as they
    are, an empty table stays empty, other columns go through."""
    names = fresh(docs.columns, *substring_dedup.RESULTS)
    out = substring_dedup.substring_dedup(docs, carry=tuple(docs.columns), results=names)
    removed, kept = F.col(names[1]) > 0, F.col(names[2])
    text = F.when(removed, kept).otherwise(F.col("text"))
    return _columns_of(docs, out.withColumns({"n_chars": F.when(removed, F.length(kept).cast("long")).otherwise(F.col("n_chars")), "text": text}))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null texts and texts without words have none and stay, repeated rows
    stay repeated, an empty table stays empty, other columns go through."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = fresh(docs.columns, *decontamination.RESULTS)
    out = decontamination.decontaminate(docs, benchmark, carry=tuple(docs.columns), results=names)
    return _columns_of(docs, out.where(F.col(names[1]) == 0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of what they decode to; of the columns only doc_id stays. A null text
    counts as empty, repeated rows stay repeated, an empty table gives none."""
    return token_codec.token_digests(docs, *token_codec.public_vocabulary(), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", remove_repeats),
    ("decontamination", decontaminate),
    ("bpe_codec", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again; a stage's table goes when the next one's is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if number:
            discard(before)
    return docs
