"""Corpus pipeline over ``documents``: toxicity filter, near-duplicate removal, pseudonyms, mixing and BPE codes.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``. Between stages the rows are written as Parquet and read again, so that no stage recomputes
another and a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.llm.bpe import bpe_codes
from geotrail.llm.common import ensure_checkpoint_dir
from geotrail.llm.mixing import in_training_order
from geotrail.llm.pii import pseudonymise
from geotrail.llm.queries import PII_KEY
from geotrail.llm.simhash import one_of_each_group
from geotrail.llm.toxicity import fit_toxicity, toxicity_scores


def with_private(docs: DataFrame, made: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on ``docs`` and its own columns again: those named like one that the stage makes step aside meanwhile."""
    aside = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c.lower() in made}
    back = [F.col(aside[c]).alias(c) if c in aside else F.col(c) for c in docs.columns]
    return stage(docs.withColumnsRenamed(aside)).select(*back)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labels outside its held-out fold, scores 0.5 or more."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_private(docs, ["score", "predicted"], lambda d: toxicity_scores(d, model).where("predicted = 0"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with similar sets of five-word shingles the document with the smallest id stays."""
    return one_of_each_group(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in the text; ``n_chars`` stays that of the document as it came."""
    return with_private(docs, ["n_pii", "pii_kinds"], lambda d: pseudonymise(d, PII_KEY))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by training position; those that it never takes go."""
    return in_training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the digests of the ids and of the decoded text, a row for each pass of the mix."""
    import public_tokenizers

    return bpe_codes(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "source"])


STAGES = [
    ("toxicity", keep_clean),
    ("simhash", keep_one_of_each_group),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier and the fingerprints can't be put in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
