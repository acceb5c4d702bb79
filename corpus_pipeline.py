"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import classifier, packing, quality_rules, simhash, substrings
from skarn.llm.common import free_name, materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams are not unlike those of trusted documents.

    Null, empty and blank texts and those of fewer than 50 words go; a very long text is judged whole; repeated rows get
    equal verdicts and stay as often as they came; a null id may stay, but is never trusted; without labels the base rules
    alone decide; an empty table stays empty; other columns pass, whatever their names.
    """
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. It learns from the raw table, where both labels occur.

    Null and empty texts score by the bias alone; whole texts are scored; repeated rows score alike; null ids are scored,
    never learned from; without labels all scores are 0.5 and all documents stay; an empty table stays empty; other
    columns pass, whatever their names.
    """
    model = classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return classifier.with_scores(docs, model, score_col=name).where(F.col(name) >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that of the least id, null ids last, then of the least text hash.

    Null, empty and blank texts are one component; repeated rows leave one; an id with unlike texts keeps a row in each
    component where it is the least; an empty table stays empty; other columns pass, whatever their names.
    """
    return simhash.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller id also holds; n_chars follows the text.

    Every row stays: a null text stays null, one that loses all its words becomes empty, one that loses nothing keeps its
    white space. Repeated rows lose nothing to each other; a null id loses to named ones and takes nothing from them; an
    empty table stays empty; other columns pass, whatever their names.
    """
    cut = substrings.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 4096.

    A null or empty text is one piece of the end token; a text longer than a sequence is cut into several; repeated rows
    are packed each; null ids stay null; an empty table gives no pieces; other columns are ignored.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("quality_classifier", classifier_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: Hashes, a trained model and a tokenizer: not for SQL. tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
