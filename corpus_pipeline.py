"""The corpus pipeline: STAGES, run() and ORACLE_SQL.

Each stage works on all rows its predecessor kept. All but the last return the
columns of ``documents``; the last returns where each piece of each document goes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookledger.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from brookledger.llm.common import fresh, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold go; the model learns from the labelled
    documents among ``docs``. Null texts count as empty and null ids are only scored."""
    model, out = toxicity.fit(docs, table(spark, sf_dir, "labels")), fresh(docs, "_toxic")
    return toxicity.score(docs, model, out).where(F.col(out)["score"] < toxicity.THRESHOLD).drop(out)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest id stays. Null texts
    are empty texts; a null id gives way to any other; of rows that repeat an id and a text one stays."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id stays. Rows without an id,
    and those that repeat the id of a row that stays, stay."""
    return near_dedup.keep(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; texts without any, null ones too, stay as they are. Where there is a
    column ``n_chars`` it follows the text."""
    out = secrets.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id
    and offset. A null text is the closing id alone; rows that repeat an id are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't train the classifier, align texts, unwrap layers or pack.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
