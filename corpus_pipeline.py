"""Corpus pipeline: toxicity, near duplicates, personal data, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; all but the last return the columns of ``documents``.  :func:`run` writes each
stage's result as Parquet in the cluster's shared folder and reads it again.

* toxicity trains on the labelled rows of the given documents and drops the toxic ones;
* near duplicates keep one document of each group;
* personal data replaces findings in the text and adapts ``n_chars``;
* mixing gives each source its share of as many documents as there are, with copies
  of small sources' documents and a sample of large ones';
* token ids encodes the texts: (doc_id, lang, source, n_tokens, token_ids).

A stage's copy goes once the next one's is written, the last one's when the driver ends.

Defined results: a null text is never toxic, a duplicate or changed, and has null ids; an empty text has no ids, and only one row of
those without a word and equal text stays.  Of fully equal rows one stays.  Of equal documents the one of least doc_id stays, nulls
last.  Texts are worked on whole, however long.  Rows that are null in any column pass; a null source is a source of its own.  Further
columns of ``documents``, whatever their names, go along to the last stage.  An empty table gives an empty result; without labels of
both classes nothing is toxic.

SQL can't express training, signatures or encoding, so there is no SQL twin;
tests compare the run with brute-force versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, mixing, neardup, pii, toxicity
from factloom.llm._util import documents, remove, shared_folder, until_exit


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(spark, docs, documents(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, keep=("lang", "source"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", redact_personal_data), ("mixing", mix_sources), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last one's rows."""
    folder = until_exit(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before is not None:
            remove(spark, before)
        before = at
    return docs
