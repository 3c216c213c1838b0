"""Corpus preparation in five stages, each on all rows that the stage before kept.

toxic documents go; one document of each near-duplicate group stays (the smallest id);
documents that hold benchmark windows go; personal data is replaced by its kind in
brackets; the rest is packed into sequences. Every stage but the last returns the
columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm.best_fit_packing import pack_documents
from creditspark.llm.decontamination import mark_contaminated
from creditspark.llm.jaccard_join import near_duplicate_classes
from creditspark.llm.personal_data import find_personal_data
from creditspark.llm.registry import table
from creditspark.llm.toxicity_ordinal import REJECT, fit_toxicity, score_toxicity
from creditspark.sources.io import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any severity is below the limit."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score_toxicity(docs, model).where(F.col("toxic_probability") < REJECT).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates; documents without shingles all stay.

    Repeated rows of an id stay together or go together; a null id stays.
    """
    classes = near_duplicate_classes(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(classes, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    marked = mark_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return marked.where(F.size("hit_ranges") == 0).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced."""
    found = find_personal_data(docs, redacted="redacted_text")
    return found.withColumns({"text": F.col("redacted_text"), "n_chars": F.when(F.size("pii_spans") > 0, F.length("redacted_text")).otherwise(F.col("n_chars")).cast("long")}
                             ).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", keep_one_of_each_group), ("decontamination", drop_contaminated),
          ("personal_data", redact_personal_data), ("packing", pack)]

ORACLE_SQL = None  # toxicity, personal data and packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
