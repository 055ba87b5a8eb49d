"""A corpus pipeline of five stages: language ID, near-duplicate removal, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of
``docs``. ``run`` applies them to ``documents``, each written in the shared folder and read again.

What the stages do:

* language_id: rejects documents without a letter and those whose best language has a mean word marginal below
  ``LEAST_SCORE``; the field is fitted on the labelled rows that are given and aren't held out.
* near_duplicates: of each component of documents of five-word Jaccard similarity 0.8, the smallest doc_id stays (equal sets
  included; documents without words all stay).
* decontaminate: documents with a verified benchmark passage go.
* mix: sources are mixed at a temperature that repeats none more than ``MOST_REPEATS`` times, on the budget of the corpus' tokens. A row
  comes once for each epoch it is in.
* token_files: the token ids are written and read back, one row a document (copies included).

Nulls: a null text has no letter and is rejected; a null doc_id, lang or source is kept as it is. Columns beyond those of documents
pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, jaccard_join, language_id, mixing, token_files
from foliospark.llm.common import table, written
from foliospark.session import ship_package

LEAST_SCORE = 0.35
MOST_REPEATS = 2.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.fit_on(docs), LEAST_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, repetition_limit=MOST_REPEATS).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_output(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def _ready(stage: Callable) -> Callable:
    return lambda spark, docs, sf_dir: stage(ship_package(spark), docs, sf_dir)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _ready(language_stage)),
    ("near_duplicates", _ready(near_duplicate_stage)),
    ("decontaminate", _ready(decontamination_stage)),
    ("mix", _ready(mixing_stage)),
    ("token_files", _ready(token_stage)),
]

#: The language model and the token ids can't be expressed in SQL. A test runs the chain over planted rows and holds near duplicates and token ids
#: against plain Python; of the other stages it only asks that planted rows go and four fifths of the rest arrive.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
