"""How the operators' inputs are formed from the driver's tables.

Every binding has a Spark form and the SQL text of the same relation, so that queries and oracles read the
same rows.  Times are integer microseconds, so that comparisons are exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP_US = 12 * 3600 * 1_000_000
WIDEN = 600


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _micros():
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, seg_idx, start, end, text, speaker; start counts from the document's first segment."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("us", _micros()).withColumn("start", F.col("us") - F.first("us").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.select(
        F.col("user_id").alias("doc_id"), F.row_number().over(w).cast("long").alias("seg_idx"), "start",
        (F.col("start") + F.round(F.col("value") * 1e6).cast("long")).alias("end"), F.col("event_type").alias("text"), F.col("event_type").alias("speaker"),
    )


SEGMENTS = """
base as (select user_id as doc_id, row_number() over (partition by user_id order by ts, event_id) as seg_idx,
  epoch_us(ts) - first_value(epoch_us(ts)) over (partition by user_id order by ts, event_id) as "start", value, event_type from events),
seg as (select doc_id, seg_idx, "start", "start" + cast(round(value * 1e6) as bigint) as "end", event_type as text, event_type as speaker from base)
"""


def wide(spark: SparkSession, d: str, kinds: list[str], index: str) -> DataFrame:
    """Events of some kinds as wide intervals."""
    e = table(spark, d, "events").where(F.col("event_type").isin(kinds)).select("user_id", "event_id", "event_type", "value", "ts")
    s = _micros()
    return e.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias(index), s.alias("start"),
        (s + F.round(F.col("value") * WIDEN * 1e6).cast("long")).alias("end"), F.col("event_type").alias("speaker"),
    )


def wide_sql(name: str, kinds: list[str], index: str) -> str:
    ks = ", ".join(f"'{k}'" for k in kinds)
    return f"""{name} as (select user_id as doc_id, event_id as {index}, epoch_us(ts) as "start", epoch_us(ts) + cast(round(value * {WIDEN} * 1e6) as bigint) as "end", event_type as speaker
  from events where event_type in ({ks}))"""


#: SQL that both engines read: spoken sentences from parts.
SENTENCE = (
    "'So the thing is we cook ' || p_name || ' for ' || cast(p_size as string) || ' minutes at ' || cast(p_size * 10 as string) || ' degrees Celsius, uh, with ' "
    "|| cast(p_size as string) || ' and a half ounces or ' || cast(p_size as string) || ' tablespoons and ' || cast(p_size as string) || ' percent salt or something like that!! "
    "It is, you know, very very good. Yeah. We we visit www dot shop dot com.'"
)
STAMPED = (
    "case when p_partkey % 3 = 0 then '[' || cast(p_size as string) || ':' || lpad(cast(p_partkey % 60 as string), 2, '0') || '] ' || p_name "
    "when p_partkey % 3 = 1 then '[' || cast(p_size % 5 as string) || ':' || lpad(cast(p_size as string), 2, '0') || ':' || lpad(cast(p_partkey % 60 as string), 2, '0') || ' | Ana Li]  ' || p_name "
    "else p_name || ' [1:00]' end"
)
PARAGRAPH = (
    "'[' || cast(p_size % 3 as string) || ':' || lpad(cast(p_partkey % 60 as string), 2, '0') || '] ' || case p_partkey % 9 when 0 then 'Yeah.' when 1 then 'Oh yeah' "
    "when 2 then 'This is Example Radio Network with ' || p_name when 3 then 'You''re listening to ' || p_name || ' on example radio' when 4 then 'Brought to you by ' || p_name "
    "when 5 then 'We talk about food and ' || p_name when 6 then 'thank you' when 7 then 'Thank you for listening' else p_name || ' is next' end"
)
UTTERANCE = (
    "case p_partkey % 10 when 0 then 'Yeah.' when 1 then 'And so' when 2 then 'Welcome back to ' || p_name || '.' when 3 then 'Got it!' when 4 then 'Call in with ' || p_name "
    "when 5 then 'but then' when 6 then 'Thank  you' when 7 then 'etc.' else p_name || ' tastes good.' end"
)


def from_parts(spark: SparkSession, d: str, expr: str, name: str = "text", spread: bool = False) -> DataFrame:
    """spread: the rows are dealt to as many tasks as a shuffle has.  A file of few row groups is read by few tasks, whatever its rows; what
    costs milliseconds a row needs more of them, and a number that is given is not coalesced.
    """
    p = table(spark, d, "part")
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey") if spread else p
    return p.select("p_partkey", F.expr(expr).alias(name))


def lines(spark: SparkSession, d: str, step: str = "7") -> DataFrame:
    """Lines of documents as stamped paragraphs: doc_id, para_idx, text; step: seconds between two, as SQL."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    sec = F.col("p") * F.expr(step)
    stamp = F.format_string("[%d:%02d] ", F.floor(sec / 60).cast("long"), (sec % 60).cast("long"))
    return t.select("doc_id", F.col("p").cast("long").alias("para_idx"), F.concat(stamp, F.col("line")).alias("text"))


LINES = """
ls as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null),
lines as (select doc_id, unnest(range(0, len(l))) as para_idx, unnest(l) as line from ls)
"""


#: Of each thousand events, 900 are frames of recording 0; the others belong to seven short recordings.
_RECORDING = "case when event_id % 1000 < 900 then 0 else 1 + {div} % 7 end"


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of recordings, one of which has 90 % of all: doc_id, frame_idx, rms."""
    at = F.expr("case when event_id % 1000 < 900 then event_id div 1000 * 900 + event_id % 1000 else event_id div 7000 * 100 + event_id % 100 end")
    return table(spark, d, "events").select(F.expr(_RECORDING.format(div="event_id div 1000")).cast("long").alias("doc_id"), at.cast("long").alias("frame_idx"), F.col("value").alias("rms"))


FRAMES = f"""frames as (select cast({_RECORDING.format(div='event_id // 1000')} as bigint) as doc_id,
  cast(case when event_id % 1000 < 900 then event_id // 1000 * 900 + event_id % 1000 else event_id // 7000 * 100 + event_id % 100 end as bigint) as frame_idx, value as rms from events)"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")
