"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import op1_secrets, op2_language, op5_packing, op6_jaccard, op8_mixing
from murmur.llm.common import Scratch, fresh, table, temporary


#: Near duplicates of the pipeline: words in a shingle and least similarity in per cent; ``op6_jaccard`` has its own.
SHINGLE, THRESHOLD = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go; where ``lang`` is null, the others take the predicted one.

    A null or empty text and one without a letter go; rows are judged one by one, so repeated ones stay or go together; very long
    texts are read whole; ties of languages go to the smaller name; an empty table stays empty; columns of any other name are kept.
    """
    pred = fresh(docs, "_lang_pred")
    found = op2_language.identify(docs, names=(pred, fresh(docs, "_score"))).where(F.col(pred) != op2_language.UNKNOWN)
    return found.select(*[F.coalesce("lang", pred).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    A row without words stays; rows of one doc_id with different texts are documents of their own; of rows that repeat in whole one stays;
    rows without doc_id are compared too and stay only if no row of their group has one; very long texts are compared whole; an empty
    table stays empty; columns of any other name are kept.
    """
    return op6_jaccard.keep_one(docs, SHINGLE, THRESHOLD)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark (and ``n_chars`` follows); the documents stay.

    A null text stays null and an empty one empty; repeated rows are redacted alike; overlapping secrets become one mark; very long
    texts are redacted whole; an empty table stays empty; columns of any other name are kept.
    """
    return op1_secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a document comes as often as its count says, which may be never.

    A null source is a source of its own; repeated rows and rows of one doc_id get the same count; texts are not looked at, whatever
    their length; an empty table stays empty; columns of any other name are kept.  The copies come in the method's order over the whole
    corpus, by the hash of (seed, doc_id, copy).
    """
    return op8_mixing.replicate(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece, as ``op5_packing`` gives it; a document that mixing repeats is packed as often.

    A null or empty text is its end id alone; a text longer than a sequence is cut; pieces of equal length are taken in any order; an
    empty table gives no rows; other columns are ignored.
    """
    return op5_packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Tokenisation and parsing against automata are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "corpus")
    for name, stage in STAGES[:-1]:
        before = docs
        with temporary():
            docs = scratch.write(stage(spark, before, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
