"""A corpus pipeline of five operators; each stage works on what the one before has kept.

1. toxicity: documents whose toxic segments score 0.7 or more go.
2. near_duplicates: of each near-duplicate class the document with the smallest doc_id stays.
3. secrets: findings of the secret scan are replaced in the text; all documents stay.
4. mixing: documents are repeated or left out so that sources meet their target weights.
5. packing: what is left becomes sequences of at most 4096 tokens; one row for each piece.

Contract: a null text is empty and stays unless another row of its doc_id and text does; rows without doc_id go through like
others; of rows that repeat doc_id and text one stays; ties (equal sizes, scores, class members) are settled by doc_id and the
text's hash; an empty table gives an empty result; columns of other names, also ones that clash with the operators' own, are
carried along up to packing, which returns pieces. Each stage's intermediate tables go when its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import mixing, neardup, packing, secrets, toxicity
from helixframe.llm.common import cut, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, sketches and packing are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
