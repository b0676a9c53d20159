"""Whole-document plans: the two cleaners, over all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur import models as M
from murmur.functions import numbers as N
from murmur.functions import text as T
from murmur.functions.rules import PHONE, SENTENCE_SIMILARITY, Names, java
from murmur.operators import runs, vectors
from murmur.operators.clusters import near_components
from murmur.operators.scan import Ranges, row_numbers, written
from murmur.operators.segments import ordered_join
from murmur.sources.transcripts import paragraph_rows


def _ranges(docs: DataFrame, key: str) -> Ranges:
    """How the paragraphs of documents are dealt, counted on the texts as they came."""
    return Ranges(paragraph_rows(docs, key).select(key, "para_idx"), key, "para_idx")


def _renumber(paras: DataFrame, key: str, ranges: Ranges) -> DataFrame:
    """para_idx without holes, within each document."""
    return row_numbers(paras, key, ["para_idx"], "_n", ranges).withColumn("para_idx", F.col("_n").cast("long") - 1).drop("_n")


def _each(docs: DataFrame, key: str, cleaned: DataFrame) -> DataFrame:
    """(key, text) for every document: empty where nothing of it is left."""
    return docs.select(key).join(cleaned, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def strip_fillers(texts: DataFrame, column: str = "text", names: Names = Names()) -> DataFrame:
    """The column cleaned sentence by sentence."""
    return texts.withColumn(column, _stripped(F.col(column), names))


def _stripped(c: Column, names: Names) -> Column:
    return T.after_numbers(N.normalize_numbers(T.strip_filler_sentences(c, names)))


def _computed(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """The column with a costly value, computed once for each row: a filter on a plain column would be moved below it with a copy of the value."""
    return rows.select(*[F.col(c) for c in rows.columns if c != column], F.explode(F.array(value)).alias(column))


def strip_fillers_rendered(docs: DataFrame, key: str = "doc_id", names: Names = Names()) -> DataFrame:
    """(key, text): stamps go, each paragraph is cleaned, empty ones go."""
    p = paragraph_rows(docs, key, strip=False)
    p = _computed(p, "text", _stripped(T.content(F.col("text")), names)).where("text <> ''")
    return _each(docs, key, p.groupBy(key).agg(ordered_join(F.col("text"), F.col("para_idx"), "\n\n").alias("text")))


def gate_paragraphs(paras: DataFrame, names: Names = Names()) -> DataFrame:
    return paras.where(T.passes_gates(F.col("text"), names))


def denoise_paragraphs(docs: DataFrame, key: str = "doc_id", names: Names = Names()) -> DataFrame:
    """(key, para_idx, text) of the first-generation cleaner."""
    p = gate_paragraphs(paragraph_rows(docs, key), names)
    p = p.withColumn("text", N.collapse_spoken_digits(F.col("text")))
    phone = F.col("text").rlike(java(PHONE, ignore_case=False))
    p = p.withColumn("_phone", phone).withColumn("text", F.when(F.col("_phone"), T.strip_phone_numbers(F.col("text"))).otherwise(F.col("text")))
    p = p.where(~F.col("_phone") | (T.trim(T.content(F.col("text"))) != "")).drop("_phone")
    r = _ranges(docs, key)
    return runs.drop_music(_renumber(p, key, r), key, ranges=r)


def denoise(docs: DataFrame, key: str = "doc_id", names: Names = Names()) -> DataFrame:
    """(key, text)."""
    p = denoise_paragraphs(docs, key, names)
    return _each(docs, key, p.groupBy(key).agg(ordered_join(F.col("text"), F.col("para_idx"), "\n\n").alias("text")))


def prepass(docs: DataFrame, key: str = "doc_id", names: Names = Names()) -> DataFrame:
    """Gates and music runs only; stamps go."""
    r = _ranges(docs, key)
    p = runs.drop_music(_renumber(gate_paragraphs(paragraph_rows(docs, key), names), key, r), key, ranges=r)
    return p.withColumn("text", T.content(F.col("text")))


def normalize_paragraphs(p: DataFrame, column: str = "text") -> DataFrame:
    c = F.col(column)
    p = p.withColumn(column, T.phrase_stutter(T.dedup_stutter(T.its_stutter(T.letter_stutter(T.strip_disfluencies(c))))))
    p = p.withColumn(column, T.strip_phone_numbers(N.collapse_spoken_digits(c)))
    return p.withColumn(column, T.trim(F.regexp_replace(T.after_numbers(N.normalize_numbers(c)), " {2,}", " ")))


def regroup(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) of sentences (key, para_idx, sent_idx, text)."""
    p = sentences.groupBy(key, "para_idx").agg(ordered_join(F.col("text"), F.col("sent_idx")).alias("text"))
    return p.groupBy(key).agg(ordered_join(F.col("text"), F.col("para_idx"), "\n\n").alias("text"))


def denoise2(
    docs: DataFrame, key: str = "doc_id", names: Names = Names(), corrector: M.Factory = M.identity, embedder: M.Factory | None = None,
    parser: M.Factory = M.keyword_parser, threshold: float = SENTENCE_SIMILARITY,
) -> DataFrame:
    """(key, text) of the second-generation cleaner; the three models are injected."""
    p = _computed(normalize_paragraphs(prepass(docs, key, names)), "text", F.col("text")).where("text <> ''")
    p = M.guarded_correction(p, "text", "fixed", corrector).select(key, "para_idx", F.col("fixed").alias("text"))
    s = p.select(key, "para_idx", F.posexplode(T.sentences_v2(F.col("text"))).alias("_s", "text")).withColumn("text", T.trim(F.col("text"))).where("text <> ''")
    s = M.map_model(s, "text", "_parse", parser, M.PARSE)
    s = _computed(s, "text", T.strip_parsed_fillers(F.col("text"), F.col("_parse.tokens"))).where("text <> ''")
    s = s.where(T.keep_turn(F.col("text"), F.col("_parse")))
    s = s.withColumn("sent_idx", F.row_number().over(Window.partitionBy(key).orderBy("para_idx", "_s")).cast("long") - 1).drop("_s", "_parse")
    s = M.map_model(s, "text", "embedding", embedder or M.hashed_embedder(), "array<double>")
    s = written(s.withColumn("words", T.word_count(F.col("text"))), "sentences")  # read by the comparison and by what it leaves
    comps = near_components(s, key, "sent_idx", threshold)
    return _each(docs, key, regroup(vectors.keep_longest(s, comps, key, "sent_idx"), key))


def complete(docs: DataFrame, column: str, prompt: str, model: M.Factory, out: str = "notes") -> DataFrame:
    """Notes from texts: the prompt and the text go to an injected completion."""
    asked = docs.withColumn("_ask", F.concat(F.lit(prompt + "\n\n"), F.col(column)))
    return M.map_model(asked, "_ask", out, model).drop("_ask")
