"""Operators on time-stamped segments: paragraphs, speakers, rendering.

Tables have one row for each segment with its document and position; every operator keys its exchange by
document, and order comes from the position column, never from row order.  What depends on the rows before is a scan in two levels
(``operators.scan``), so a document may hold most of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import rules as R
from murmur.functions import text as T
from murmur.operators.scan import Last, Ranges, Sum
from murmur.schemas import UNKNOWN_SPEAKER


def ordered_join(value: Column, order: Column, sep: str = " ") -> Column:
    """Aggregate: values joined in the order of a column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def gap_segments(segments: DataFrame, gap=R.PARAGRAPH_GAP_S, key="doc_id", order="seg_idx", ranges: Ranges | None = None) -> DataFrame:
    """Adds para_idx: a new paragraph where the pause after the previous segment reaches the gap."""
    r = ranges or Ranges(segments, key, order)
    x = r.scan(r.attach(segments), [order], _before=Last(F.struct("end")))
    x = x.withColumn("_new", F.coalesce((F.col("start") - F.col("_before.end") >= gap).cast("int"), F.lit(0)))
    return r.scan(x, [order], para_idx=Sum(F.col("_new"))).drop("_new", "_before", "_range")


def first_appearance_map(segments: DataFrame, names: list[str] | None = None, key="doc_id", order="seg_idx") -> DataFrame:
    """(key, speaker, rank, name): the k-th label to appear gets the k-th name; UNKNOWN is skipped, the rest stay unnamed."""
    seen = segments.where((F.col("speaker") != UNKNOWN_SPEAKER) & F.col("speaker").isNotNull()).groupBy(key, "speaker").agg(F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("first")).cast("long").alias("rank")
    out = seen.select(key, "speaker", rank)
    given = F.array(*map(F.lit, names or [])).cast("array<string>")
    return out.withColumn("name", F.try_element_at(given, F.col("rank").cast("int")))


def apply_speaker_map(segments: DataFrame, mapping: DataFrame, on: list[str]) -> DataFrame:
    """speaker becomes the mapped name; labels without one stay. mapping: (on..., speaker, name)."""
    m = mapping.where("name is not null").select(*on, "speaker", F.col("name").alias("_name"))
    return segments.join(m, [*on, "speaker"], "left").withColumn("speaker", F.coalesce("_name", "speaker")).drop("_name").select(segments.columns)


def paragraphs(segments: DataFrame, key="doc_id", order="seg_idx") -> DataFrame:
    """One row for each paragraph: start and speaker of its first segment, trimmed texts joined."""
    return segments.groupBy(key, "para_idx").agg(
        F.min_by("start", order).alias("start"), F.min_by("speaker", order).alias("speaker"),
        ordered_join(T.trim(F.col("text")), F.col(order)).alias("text"),
    )


def render_line(start: Column, speaker: Column, text: Column, diarized: bool) -> Column:
    stamp = T.format_seconds(start)
    head = F.concat(F.lit("["), stamp, F.lit(" | "), speaker, F.lit("] ")) if diarized else F.concat(F.lit("["), stamp, F.lit("] "))
    return F.concat(head, text)


def render_paragraphs(segments: DataFrame, gap=R.PARAGRAPH_GAP_S, diarized: bool = False, key="doc_id", order="seg_idx") -> DataFrame:
    p = paragraphs(gap_segments(segments, gap, key, order), key, order)
    return p.select(key, "para_idx", render_line(F.col("start"), F.col("speaker"), F.col("text"), diarized).alias("line"))


def render_document(
    segments: DataFrame, gap=R.PARAGRAPH_GAP_S, diarized: bool = False, names: list[str] | None = None,
    mapping: DataFrame | None = None, key="doc_id", order="seg_idx",
) -> DataFrame:
    """(key, text): rendered documents. Given names win over a mapping; lines are joined by a blank line."""
    if names:
        mapping = first_appearance_map(segments, names, key, order)
    if mapping is not None:
        segments = apply_speaker_map(segments, mapping, [key])
    lines = render_paragraphs(segments, gap, diarized, key, order)
    return lines.groupBy(key).agg(ordered_join(F.col("line"), F.col("para_idx"), "\n\n").alias("text"))


def concat_chunks(chunks: DataFrame, key="doc_id", order="i") -> DataFrame:
    """Texts of chunks that are not empty, joined in order; chunk segments move by the chunk's offset."""
    t = T.trim(F.col("text"))
    return chunks.where(t != "").groupBy(key).agg(ordered_join(t, F.col(order)).alias("text"))


def offset_segments(segments: DataFrame, offset: str = "offset_s", aligned: bool = False) -> DataFrame:
    """Segments of a chunk moved by its offset; aligned: sentences of an aligning recogniser, whose texts get one space before them."""
    out = segments.withColumn("start", F.col("start") + F.col(offset)).withColumn("end", F.col("end") + F.col(offset))
    return out.withColumn("text", F.concat(F.lit(" "), T.trim(F.col("text")))) if aligned else out
