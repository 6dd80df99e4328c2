"""A training corpus from documents: language ID, SimHash near-dedup, suffix-array dedup, PII, best-fit packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before kept. All but the last return the
columns of documents; the last returns the packed pieces. run() writes each stage's rows to the shared folder and reads them
again. The stages take whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.llm import bpe, langid, packing, pii, simhash, suffix
from querywright.llm.common import spare, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null texts, texts without letters); a missing label is filled in. With nothing to
    learn from, nothing is dropped but those."""
    model = langid.fit(docs.filter(~langid.held_out()))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    to = spare(docs, "_lang")
    found = langid.with_language(docs, model, to=to).filter(F.col(to) != "und")
    return found.withColumn("lang", F.coalesce("lang", to)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: fingerprints of five-word shingles within two bits, or a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, ngram=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 200 bytes or more that start anywhere else; documents stay."""
    return _recounted(suffix.without_repeats(docs), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, plain or disguised, by its kind."""
    return _recounted(pii.redact(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their sequences and offsets."""
    return packing.best_two_fit(docs, bpe.default_path())


def _recounted(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else df


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: The stages (mixtures, fingerprints, suffix order, packing) are not for SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
