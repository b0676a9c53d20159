"""Chunked inference that can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur import models as M
from murmur import schemas as S
from murmur.operators import segments as seg
from murmur.operators import stages

DONE = f"key string, i int, text string, segments array<{S.RAW_SEGMENT}>"


def resume_chunks(chunks: DataFrame, path: str, infer: M.Factory) -> DataFrame:
    """(key, text, segments) after all chunks (key, i, input) are done.

    Finished chunks are in the table at path and are not inferred again; new ones are appended, so that an
    interrupted run goes on from there.  Texts that are not empty are joined, segments follow one another.
    """
    kind = f"struct<text:string,segments:array<{S.RAW_SEGMENT}>>"

    def work(todo: DataFrame) -> DataFrame:
        return M.map_model(todo, "input", "_r", infer, kind).select("key", "i", "_r.text", "_r.segments")

    stages.run_stage(chunks, path, DONE, ["key", "i"], work)
    done = stages.read_or_empty(chunks.sparkSession, path, DONE).dropDuplicates(["key", "i"])
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "segments"))), lambda x: F.coalesce(x["segments"], F.array().cast(f"array<{S.RAW_SEGMENT}>"))))
    return done.groupBy("key").agg(parts.alias("segments")).join(seg.concat_chunks(done, "key", "i"), "key", "left").select("key", F.coalesce("text", F.lit("")).alias("text"), "segments")
