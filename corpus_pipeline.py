"""A corpus pipeline: language ID, line dedup, n-gram near duplicates, mixing and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet
and read again. All but the last return the columns of ``documents``.

Defined cases: a null text has no letters and goes in the first stage; rows without doc_id hold no repeated lines, link
with nothing and stay once in the fourth stage; repeated rows of a doc_id share one fate in every stage; ties go to the
smallest doc_id in the third stage and to the largest in the second; an empty table gives no piece; extra columns, and
columns named like those that the stages use, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import language, line_dedup, mixing, ngram_join, packing
from voxelframe.llm.common import table, unused
from voxelframe.storage import materialise

#: The mixture, in multiples of the expected domain tokens: good and poor text as it is, a tenth of the toxic text. Clean
#: documents hold about that much toxic mass by their soft membership, so toxic ones come out at rates near zero.
MIX = {"good": 1.0, "poor": 1.0, "toxic": 0.1}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: those without letters, and those near chance for every language."""
    return language.keep_identified(docs, language.train(docs), least=0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from ``text``; ``n_chars`` follows. Documents with nothing left go."""
    before, gone = unused(docs.columns, "n_lines"), unused(docs.columns, "n_dropped")
    cleaned = line_dedup.LineIndex.build(docs, min_docs=5, min_chars=40).apply(docs, before, gone)
    kept = cleaned.where((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say: most toxic ones go, clean ones stay once but for a few hundredths."""
    return mixing.apply_rates(docs, mixing.mix(docs, table(spark, sf_dir, "labels"), MIX))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 4096 tokens."""
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Model scores and token ids are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
