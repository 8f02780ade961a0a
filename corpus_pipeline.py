"""Corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing, packing.

Defined cases: a null or empty text, and one without a letter, goes at the first stage; of equal or similar texts one
document stays; rows with a null doc_id pass the near-duplicate stage; very long texts are taken whole; an empty table
gives no rows; extra columns, whatever their names, stay until the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import documents, keep
from millrace.llm.exact_dedup import keep_unique
from millrace.llm.language_id import keep_identified
from millrace.llm.mixing import mix_sources
from millrace.llm.ngram_join import keep_dissimilar
from millrace.llm.packing import pack_sequences

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", keep_unique),
    ("ngram_join", keep_dissimilar),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A classifier and a tokenizer are not expressible in SQL; a test holds each stage's output against a plain form of it
#: over the stage's own input (of the classifier: what has no letter goes, and hardly anything else).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
