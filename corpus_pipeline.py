"""Corpus pipeline: documents -> quality rules -> near-duplicates -> PII -> mix -> packed sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept.  All stages but the last return the columns of
``documents``; the last returns every piece with its token ids and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import disclosure, mixing, packing, quality_rules, simhash
from pagelake.llm.common import apart, documents, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return quality_rules.keep(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group (4-word shingles, at most 4 differing bits)."""
    return simhash.keep_one(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; ``n_chars`` follows the new text."""
    clean = disclosure.sanitise(docs)
    if "n_chars" not in docs.columns:
        return clean
    d, new, old = apart(clean)
    text, chars = new[old.index("text")], new[old.index("n_chars")]
    kind = docs.schema["n_chars"].dataType
    return d.withColumn(chars, F.length(text).cast(kind)).select(*new).toDF(*old)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources share the words by their weights."""
    return mixing.repeat(docs, fill=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

# SimHash, disclosure counts and tokenization have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
