"""From documents to a training corpus: language, near-duplicates, benchmark passages, secrets, mixture.

Each stage takes all that its predecessor kept and is written before the next one reads it. ``run`` applies them to ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common, decontam, langid, mixing, secrets, simhash

#: Texts in none of the known languages: their n-grams lie this near to the largest possible distance from every profile.
LEAST_SCORE = 0.15


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones are in; a missing label becomes the predicted one.

    Rejected: texts that are null or have no letter, and those whose n-grams are like none of the languages. Without any label to
    learn from nothing is known and only the first are rejected. Repeated rows are judged each; all columns keep names and values,
    but for a null lang; an empty table gives an empty result.
    """
    profiles = langid.learn_profiles(docs, key="doc_id")
    names = [f"c{i}" for i in range(len(docs.columns))]  # the prediction's columns can't clash with these
    text, lang = (names[docs.columns.index(c)] for c in ("text", "lang"))
    found = langid.predict(docs.toDF(*names), profiles, text)
    if profiles:
        found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn(lang, F.coalesce(lang, "lang_pred"))
    else:
        found = found.where(F.col(text).rlike(r"\p{L}"))
    return found.select(*names).toDF(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more: that of the smallest id.

    Null and empty texts are alike; of equal rows one stays; null ids order last; columns keep names and values; an empty table
    gives an empty result.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text.

    Null and empty texts and repeated rows stay; columns keep names and values; an empty table on either side is fine.
    """
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials masked; n_chars follows the text.

    Null texts stay null (and their n_chars becomes null); repeated rows are masked alike; other columns keep names and values.
    """
    done = secrets.mask_secrets(docs)
    return done.withColumn("n_chars", F.length("text").cast(done.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: its columns and the number of the copy.

    Null texts weigh nothing, a null source is one of its own; repeated rows share their copies; an empty table gives an empty result.
    """
    return mixing.mixed_rows(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", remove_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", mask_secrets),
    ("mixing_sources", mix_sources),
]

#: Fingerprints, profiles and random rounding can't be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is removed when the next one is written."""
    docs, at = common.table(spark, sf_dir, "documents"), f"{common.shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            common.remove(spark, f"{at}/{k - 1}")
    return docs
