"""Queries over the driver's tables, one for each operator, with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur import models as M
from murmur.functions import numbers as N
from murmur.functions import rules as R
from murmur.functions import text as T
from murmur.functions.vectors import cosine
from murmur.operators import intervals, phrases, runs, segments as S, splits, stages, vectors as V
from murmur.operators.clusters import near_components
from murmur.plans import bindings as B
from murmur.plans import documents as D
from murmur.sources import feed, transcripts

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _stamp(s: str) -> str:
    return f"case when {s} >= 3600 then printf('%d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60) else printf('%d:%02d', {s} // 60, {s} % 60) end"


# ---------------------------------------------------------------- names, stamps, paragraphs


@query("select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-+$', '') as slug from part")
def slugify_part_names(spark, d):
    return B.table(spark, d, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


@query("""select feed_idx, p_partkey, number, printf('%03d', number) || '-' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-+$', '') as slug
from (select *, p_size % 3 as feed_idx, row_number() over (order by p_size % 3, p_partkey desc) as number from part)""")
def episode_numbering(spark, d):
    f = B.table(spark, d, "part").select((F.col("p_size") % 3).alias("feed_idx"), "p_partkey", (-F.col("p_partkey")).alias("pos"), F.col("p_name").alias("title"))
    return stages.episode_numbering(f, ["feed_idx", "pos"]).select("feed_idx", "p_partkey", "number", "slug")


@query(f"""select p_partkey, case when a = '' then -1 when c <> '' then cast(a as bigint) * 3600 + cast(b as bigint) * 60 + cast(c as bigint) else cast(a as bigint) * 60 + cast(b as bigint) end as seconds
from (select p_partkey, regexp_extract(t, '^\\[(\\d+):(\\d\\d)', 1) as a, regexp_extract(t, '^\\[(\\d+):(\\d\\d)', 2) as b, regexp_extract(t, '^\\[\\d+:\\d\\d:(\\d\\d)', 1) as c
from (select p_partkey, {B.STAMPED} as t from part))""")
def parse_timestamp(spark, d):
    return B.from_parts(spark, d, B.STAMPED).select("p_partkey", T.stamp_seconds(F.col("text")).alias("seconds"))


@query(f"select p_partkey, regexp_replace({B.STAMPED}, '^\\[\\d+:\\d\\d(:\\d\\d)?(\\s*\\|\\s*[^\\]]+)?\\]\\s*', '') as content from part")
def strip_timestamp(spark, d):
    return B.from_parts(spark, d, B.STAMPED).select("p_partkey", T.content(F.col("text")).alias("content"))


@query(f"""with {B.LINES} select doc_id, row_number() over (partition by doc_id order by para_idx) - 1 as para_idx, {_strip('line')} as text from lines where {_strip('line')} <> ''""")
def paragraph_split(spark, d):
    docs = B.table(spark, d, "documents").where("text is not null").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return transcripts.paragraph_rows(docs, "doc_id")


@query(f"select event_id, {_stamp('cast(floor(value * 20) as bigint)')} as stamp from events")
def format_timestamp(spark, d):
    return B.table(spark, d, "events").select("event_id", T.format_seconds(F.col("value") * 20).alias("stamp"))


@query("""select p_partkey, array_to_string(list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda x: trim(x)), '|') as speakers,
  len(string_split(replace(p_type, ' ', ' , '), ',')) as n from part""")
def split_speakers(spark, d):
    x = T.split_speakers(F.replace("p_type", F.lit(" "), F.lit(" , ")))
    return B.table(spark, d, "part").select("p_partkey", F.array_join(x, "|").alias("speakers"), F.size(x).cast("long").alias("n"))


@query(f"with {B.SEGMENTS} select doc_id, seg_idx, 'UNKNOWN' as speaker from seg")
def undiarized_segments(spark, d):
    return B.segments(spark, d).select("doc_id", "seg_idx", F.lit("UNKNOWN").alias("speaker"))


@query("""select doc_id, length(text) as chars_before, length(t) as chars_after, round(case when length(text) > 0 then 100.0 * (length(text) - length(t)) / length(text) else 0.0 end, 6) as pct_removed
from (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '\\.+', '.', 'g'), '!+', '!', 'g'), '\\?+', '?', 'g') as t from documents)""")
def denoise_savings(spark, d):
    return B.table(spark, d, "documents").select("doc_id", *stages.savings(F.col("text"), T.normalize_punctuation(F.col("text"))))


@query("""select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'F') then 't' else '-' end
  || case when c_custkey in (select o_custkey from orders where o_orderstatus = 'O') then 'd' else '-' end as status from customer""")
def episode_status(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    e = B.table(spark, d, "customer").select("c_custkey")
    return stages.episode_status(e, o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "c_custkey")


# ---------------------------------------------------------------- speakers and paragraphs


@query(f"""with {B.SEGMENTS}, f as (select *, coalesce("start" - lag("end") over (partition by doc_id order by seg_idx) >= {B.GAP_US}, false) as new from seg)
select doc_id, seg_idx, cast(sum(new::int) over (partition by doc_id order by seg_idx) as bigint) as para_idx from f""")
def gap_segments(spark, d):
    return S.gap_segments(B.segments(spark, d), B.GAP_US).select("doc_id", "seg_idx", "para_idx")


_MAP = f"""{B.SEGMENTS}, m as (select doc_id, speaker, row_number() over (partition by doc_id order by min(seg_idx)) as rank from seg group by doc_id, speaker),
nm as (select *, case rank when 1 then 'Ana' when 2 then 'Bo' end as name from m)"""
NAMES = ["Ana", "Bo"]


@query(f"with {_MAP} select * from nm")
def first_appearance_map(spark, d):
    return S.first_appearance_map(B.segments(spark, d), NAMES)


@query(f"with {_MAP} select doc_id, seg_idx, coalesce(nm.name, seg.speaker) as speaker from seg left join nm using (doc_id, speaker)")
def apply_speaker_map(spark, d):
    s = B.segments(spark, d)
    return S.apply_speaker_map(s, S.first_appearance_map(s, NAMES), ["doc_id"]).select("doc_id", "seg_idx", "speaker")


_PARAS = f"""f as (select *, coalesce("start" - lag("end") over (partition by doc_id order by seg_idx) >= {B.GAP_US}, false) as new from x),
g as (select *, sum(new::int) over (partition by doc_id order by seg_idx) as para_idx from f),
p as (select doc_id, cast(para_idx as bigint) as para_idx, min("start") // 1000000 as s, arg_min(speaker, seg_idx) as speaker, string_agg(text, ' ' order by seg_idx) as text from g group by doc_id, para_idx)"""


def _seconds(df: DataFrame) -> DataFrame:
    """Microseconds to whole seconds, after the gaps are known."""
    return df.withColumn("start", F.floor(F.col("start") / 1_000_000))


@query(f"with {B.SEGMENTS}, x as (select * from seg), {_PARAS} select doc_id, para_idx, '[' || {_stamp('s')} || '] ' || text as line from p")
def render_paragraphs(spark, d):
    p = _seconds(S.paragraphs(S.gap_segments(B.segments(spark, d), B.GAP_US)))
    return p.select("doc_id", "para_idx", S.render_line(F.col("start"), F.col("speaker"), F.col("text"), False).alias("line"))


@query(f"""with {_MAP}, x as (select doc_id, seg_idx, "start", "end", text, coalesce(nm.name, seg.speaker) as speaker from seg left join nm using (doc_id, speaker)), {_PARAS}
select doc_id, string_agg('[' || {_stamp('s')} || ' | ' || speaker || '] ' || text, chr(10) || chr(10) order by para_idx) as text from p group by doc_id""")
def render_document(spark, d):
    s = B.segments(spark, d)
    s = S.apply_speaker_map(s, S.first_appearance_map(s, NAMES), ["doc_id"])
    p = _seconds(S.paragraphs(S.gap_segments(s, B.GAP_US)))
    p = p.select("doc_id", "para_idx", S.render_line(F.col("start"), F.col("speaker"), F.col("text"), True).alias("line"))
    return p.groupBy("doc_id").agg(S.ordered_join(F.col("line"), F.col("para_idx"), "\n\n").alias("text"))


@query(f"""with {B.wide_sql('s', ['purchase'], 'seg_idx')}, {B.wide_sql('t', ['view', 'click'], 'turn_idx')},
h as (select s.doc_id, s.seg_idx, t.speaker, row_number() over (partition by s.doc_id, s.seg_idx order by least(s."end", t."end") - greatest(s."start", t."start") desc, t.turn_idx) as rn
  from s join t on s.doc_id = t.doc_id and t."start" < s."end" and t."end" > s."start" where least(s."end", t."end") > greatest(s."start", t."start"))
select s.doc_id, s.seg_idx, coalesce(h.speaker, 'UNKNOWN') as speaker from s left join h on h.doc_id = s.doc_id and h.seg_idx = s.seg_idx and h.rn = 1""")
def interval_overlap_join(spark, d):
    s, t = B.wide(spark, d, ["purchase"], "seg_idx"), B.wide(spark, d, ["view", "click"], "turn_idx")
    return intervals.overlap_join(s, t, width=86_400_000_000).select("doc_id", "seg_idx", "speaker")


@query(f"""with {B.wide_sql('p', ['purchase'], 'pid')}, {B.wide_sql('m', ['view'], 'mid')},
h as (select p.doc_id, p.pid, m.mid, abs(m."start" - p."start") as dist, row_number() over (partition by p.doc_id, p.pid order by abs(m."start" - p."start"), m.mid) as rn from p join m using (doc_id))
select p.doc_id, p.pid, h.mid as nearest, h.dist as distance from p left join h on h.doc_id = p.doc_id and h.pid = p.pid and h.rn = 1""")
def nearest_boundary(spark, d):
    p = B.wide(spark, d, ["purchase"], "pid").select("doc_id", "pid", "start")
    m = B.wide(spark, d, ["view"], "mid").select("doc_id", "mid", F.col("start").alias("at"))
    out = intervals.nearest_join(p, m, "doc_id", "start", "at", "mid")
    return out.select("doc_id", "pid", F.col("_order").alias("nearest"), F.abs(F.col("_mark").cast("long") - F.col("start")).alias("distance"))


@query(f"""with {B.SEGMENTS} select doc_id, string_agg(text, ' ' order by seg_idx) as text from seg where text <> 'login' group by doc_id""")
def chunk_concat(spark, d):
    c = B.segments(spark, d).select("doc_id", F.col("seg_idx").alias("i"), F.when(F.col("text") != "login", F.col("text")).otherwise("  ").alias("text"))
    return S.concat_chunks(c)


@query(f"""with {B.SEGMENTS} select doc_id, seg_idx, "start" + doc_id * 10 as "start", "end" + doc_id * 10 as "end" from seg""")
def offset_segments(spark, d):
    s = B.segments(spark, d).withColumn("offset_s", F.col("doc_id") * 10)
    return S.offset_segments(s).select("doc_id", "seg_idx", "start", "end")


# ---------------------------------------------------------------- frames, silences, chunks


@query("""select doc_id, frame_idx, round(sqrt(avg(x * x)), 6) as rms from (select user_id as doc_id, value as x, (row_number() over (partition by user_id order by event_id) - 1) // 5 as frame_idx from events)
group by doc_id, frame_idx having count(*) = 5""")
def frame_rms(spark, d):
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    s = B.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), i.alias("i"), F.col("value").alias("x"))
    return runs.frame_rms(s, 5).select("doc_id", "frame_idx", F.round("rms", 6).alias("rms"))


@query("select user_id as doc_id, round(coalesce(quantile_cont(case when value > 0 then value end, 0.75) * 0.15, 0.0), 6) as threshold from events group by user_id")
def energy_threshold(spark, d):
    f = B.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("value").alias("rms"))
    return runs.energy_threshold(f).select("doc_id", F.round("threshold", 6).alias("threshold"))


def _silence(factor: float, least: int) -> str:
    return f"""{B.FRAMES}, q as (select doc_id, quantile_cont(case when rms > 0 then rms end, 0.75) * {factor} as th from frames group by doc_id),
low as (select doc_id, frame_idx, frame_idx - row_number() over (partition by doc_id order by frame_idx) as g from frames join q using (doc_id) where rms < th),
r as (select doc_id, min(frame_idx) as a, max(frame_idx) + 1 as b from low group by doc_id, g having count(*) >= {least})"""


@query(f"with {_silence(0.5, 3)} select doc_id, a * 20 / 1000 as t0, b * 20 / 1000 as t1 from r")
def silence_windows(spark, d):
    return runs.silence_windows(B.frames(spark, d), 0.06, 0.5)


@query(f"with {_silence(0.5, 3)} select doc_id, (a + b) // 2 as mid from r")
def silence_midpoints(spark, d):
    return runs.silence_midpoints(B.frames(spark, d), 0.5, 3)


@query(f"""with recursive {_silence(0.5, 3)}, mids as (select doc_id, (a + b) // 2 as mid from r), n as (select doc_id, max(frame_idx) + 1 as n from frames group by doc_id),
w(doc_id, k, pos) as (select doc_id, 0, 0::bigint from n union all
  select w.doc_id, k + 1, coalesce((select mid from mids where mids.doc_id = w.doc_id and mid > pos and abs(mid - pos - 150) <= 40 order by abs(mid - pos - 150), mid limit 1), pos + 150) from w join n using (doc_id) where pos + 150 < n)
select doc_id, k - 1 as k, pos as at from w where k > 0""")
def greedy_snap_splits(spark, d):
    f = B.frames(spark, d)
    n = f.groupBy("doc_id").agg((F.max("frame_idx") + 1).alias("n_frames"))
    return splits.greedy_split_points(n, runs.silence_midpoints(f, 0.5, 3), 150, 40)


@query("""select doc_id, row_number() over (partition by doc_id order by s0) - 1 as chunk, s0, s1 from (
  select doc_id, s0, lead(s0) over (partition by doc_id order by s0) as s1 from (
    select l_orderkey as doc_id, cast(l_linenumber * 100 as bigint) as s0 from (select distinct l_orderkey, l_linenumber from lineitem)
    union all select distinct l_orderkey, 0::bigint from lineitem union all select distinct l_orderkey, 1000::bigint from lineitem)) where s1 is not null""")
def chunk_bounds(spark, d):
    li = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 100).alias("at")).distinct()
    n = li.groupBy("doc_id").agg(F.lit(1000).alias("n_samples")).select("doc_id", "n_samples")
    return splits.chunk_bounds(li, n)


@query(f"""with recursive {B.SEGMENTS}, w as (select doc_id, "end" as t0, "end" + 1000000 as t1, row_number() over (partition by doc_id order by "end", seg_idx) as k from seg where speaker = 'click'),
l as (select doc_id, list(seg_idx order by seg_idx) as ids, list("start" order by seg_idx) as s, list("end" order by seg_idx) as e from seg group by doc_id),
r as (select doc_id, 0::bigint as k, ids, s, e from l union all
  select doc_id, k, ids, list_transform(s, lambda x, i: case when i = place + 1 then t1 else x end), list_transform(e, lambda x, i: case when i = place then t0 else x end)
  from (select *, list_position(dist, list_min(dist)) as place from (
    select r.doc_id, w.k, ids, s, e, t0, t1, list_transform(e[:-2], lambda x: abs(x - (t0 + t1) / 2)) as dist from r join w on w.doc_id = r.doc_id and w.k = r.k + 1))),
f as (select * from r qualify row_number() over (partition by doc_id order by k desc) = 1)
select doc_id, unnest(ids) as seg_idx, unnest(s) as "start", unnest(e) as "end" from f""")
def apply_silence_breaks(spark, d):
    s = B.segments(spark, d)
    w = s.where("speaker = 'click'").select("doc_id", F.col("end").alias("t0"), (F.col("end") + 1_000_000).alias("t1"))
    return splits.apply_silence_breaks(s, w).select("doc_id", "seg_idx", "start", "end")


#: Stamps of some documents are too far apart for music.
_STEP = "(case doc_id % 3 when 0 then 20 else 7 end)"
_LINE_CHARS = f"""{B.LINES}, pl as (select doc_id, para_idx, para_idx * {_STEP} as t, length(line) <= 80 as short from lines),
sh as (select *, case when coalesce(para_idx - lag(para_idx) over (partition by doc_id order by para_idx) > 2, true) then 1 else 0 end as new from pl where short),
g as (select *, sum(new) over (partition by doc_id order by para_idx) as run from sh),
r as (select doc_id, run, min(para_idx) as lo, max(para_idx) as hi, count(*) as shorts from g group by doc_id, run),
ga as (select doc_id, para_idx, lead(t) over (partition by doc_id order by para_idx) - t as gap from pl),
music as (select r.doc_id, lo, hi, hi - lo + 1 as len, shorts from r where hi - lo + 1 >= 5 and shorts / (hi - lo + 1) >= 0.75
  and (select avg(gap) from ga where ga.doc_id = r.doc_id and para_idx >= lo and para_idx < hi and gap > 0) < 15)"""


@query(f"with {_LINE_CHARS} select * from music")
def music_runs(spark, d):
    return runs.music_runs(B.lines(spark, d, _STEP))


@query(f"with {_LINE_CHARS} select doc_id, para_idx from pl where not exists (select 1 from music m where m.doc_id = pl.doc_id and para_idx between lo and hi)")
def drop_music(spark, d):
    return runs.drop_music(B.lines(spark, d, _STEP)).select("doc_id", "para_idx")


# ---------------------------------------------------------------- vectors

_KNOWN = """known as (select label, list(m order by p) as v from (select label, p, avg(x) as m from (
  select label, unnest(range(1, 65)) as p, unnest(embedding)::double as x from embeddings) group by label, p) group by label)"""


def _known(spark, d):
    e = B.table(spark, d, "embeddings")
    m = V.cluster_means(e.select("label", "embedding"), ["label"])
    return m.select(F.concat(F.lit("speaker-"), F.col("label").cast("string")).alias("name"), F.col("label").alias("known_idx"), "embedding")


@query("""select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, d):
    e = B.table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    j = e.select(F.col("vec_id").alias("a"), "embedding").join(b, "a")
    return j.select("a", "b", F.round(cosine(F.col("embedding"), F.col("v")), 6).alias("similarity"))


@query(f"with {_KNOWN} select label, p::bigint as p, round(x, 6) as x from (select label, unnest(range(0, 64)) as p, unnest(v) as x from known)")
def cluster_mean_embedding(spark, d):
    e = B.table(spark, d, "embeddings").select("label", "embedding")
    return V.cluster_means(e, ["label"]).select("label", F.posexplode("embedding").alias("p", "x")).select("label", F.col("p").cast("long").alias("p"), F.round("x", 6).alias("x"))


@query(f"""with {_KNOWN}, s as (select vec_id, label, list_cosine_similarity(embedding::double[], v) as sim from (select vec_id, embedding from embeddings), known),
b as (select *, row_number() over (partition by vec_id order by sim desc, label) as rn from s where sim > 0)
select vec_id, round(coalesce(b.sim, 0.0), 6) as similarity, case when b.sim >= 0.25 then 'speaker-' || b.label else vec_id::varchar end as name from embeddings left join b using (vec_id) where coalesce(rn, 1) = 1""")
def cosine_match(spark, d):
    e = B.table(spark, d, "embeddings").select("vec_id", "embedding")
    out = V.match_speakers(e, _known(spark, d), 0.25, "vec_id")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"), "name")


@query("""select coalesce(n.name, o.name) as name, case when n.name is not null then 'new' else 'old' end as origin from
(select distinct 'speaker-' || label as name from embeddings) o full join (select 'speaker-' || (label + 5) as name from embeddings group by label) n on o.name = n.name""")
def speaker_upsert(spark, d):
    k = _known(spark, d)
    new = k.select(F.concat(F.lit("speaker-"), (F.col("known_idx") + 5).cast("string")).alias("name"), F.array(F.lit(1.0)).alias("embedding"))
    return V.upsert_speakers(k.select("name", "embedding"), new).select("name", F.when(F.size("embedding") == 1, "new").otherwise("old").alias("origin"))


_EDGES = """pr as (select a.label, a.vec_id as i, b.vec_id as j, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity
  from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id), e as (select * from pr where similarity >= 0.3)"""


def _sentences(spark, d):
    return B.table(spark, d, "embeddings").select("label", F.col("vec_id").alias("i"), "embedding", ((F.col("vec_id") * 7) % 11).alias("words"))


@query(f"with {_EDGES} select label, i, j, round(similarity, 6) as similarity from e")
def similarity_pairs(spark, d):
    return V.similarity_pairs(_sentences(spark, d), "label", "i", 0.3).withColumn("similarity", F.round("similarity", 6))


_COMPS = f"""{_EDGES}, sym as (select i as u, j as v from e union select j, i from e),
reach(u, v) as (select vec_id, vec_id from embeddings union select reach.u, sym.v from reach join sym on sym.u = reach.v),
comps as (select u as i, min(v) as component from reach group by u)"""


@query(f"with recursive {_COMPS} select label, i, component from comps join embeddings on vec_id = i")
def near_dup_components(spark, d):
    return near_components(_sentences(spark, d), "label", "i", 0.3)


@query(f"""with recursive {_COMPS}, r as (select label, i, component, row_number() over (partition by component order by (i * 7) % 11 desc, i) as rn from comps join embeddings on vec_id = i)
select label, i, component from r where rn = 1""")
def dedup_keep_longest(spark, d):
    s = _sentences(spark, d)
    return V.keep_longest(s, near_components(s, "label", "i", 0.3), "label", "i").select("label", "i", "component")


@query(f"""with {B.LINES}, kept as (select doc_id, para_idx // 3 as para, para_idx, line from lines where line <> ''),
p as (select doc_id, para, string_agg(line, ' ' order by para_idx) as t from kept group by doc_id, para)
select doc_id, string_agg(t, chr(10) || chr(10) order by para) as text from p group by doc_id""")
def regroup_paragraphs(spark, d):
    t = B.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("sent_idx", "text")).where("text <> ''")
    return D.regroup(t.withColumn("para_idx", F.floor(F.col("sent_idx") / 3)))


# ---------------------------------------------------------------- text: gates and filters

_ACK = "(" + "|".join(R.PARAGRAPH_ACKS) + ")\\.?"
_GATED = f"""select p_partkey, t, regexp_replace(t, '^\\[\\d+:\\d\\d\\]\\s*', '') as c,
  cast(regexp_extract(t, '^\\[(\\d+)', 1) as int) * 60 + cast(regexp_extract(t, '^\\[\\d+:(\\d\\d)', 1) as int) as s from (select p_partkey, {B.PARAGRAPH} as t from part)"""


@query(f"""select p_partkey, regexp_full_match(c, '(?i){_ACK}') as ack, length(t) < 300 and (contains(t, 'Example Radio Network') or contains(t, 'Thank you for listening')) as boilerplate,
  regexp_matches(t, '(?i)(you are|you''?re) listening to.{{0,80}}(the example hour|example radio)') as bumper, regexp_matches(t, '(?i)\\b(brought to you by|sponsored by)\\b') as sponsor,
  s < 30 and not (contains(lower(c), 'example hour') or contains(lower(c), 'example radio') or contains(lower(c), 'example institute')) as preroll from ({_GATED})""")
def paragraph_gates(spark, d):
    t, n = F.col("text"), R.Names()
    return B.from_parts(spark, d, B.PARAGRAPH).select(
        "p_partkey", T.is_ack(t).alias("ack"), T.is_boilerplate(t, n).alias("boilerplate"), T.is_bumper(t, n).alias("bumper"), T.is_sponsor(t).alias("sponsor"), T.is_preroll(t, n).alias("preroll")
    )


_STOCK = "(" + "|".join([*R.STOCK_SENTENCES, r"the\s+example\s+hour"]) + ")[.!?]?"
_CONN = "(" + "|".join(R.CONNECTORS) + ")[.!?]?"


@query(f"""select p_partkey, t as kept from (select p_partkey, {B.UTTERANCE} as t from part)
where not regexp_full_match(t, '(?i){_STOCK}') and not regexp_full_match(t, '(?i){_CONN}') and not regexp_matches(t, '(?i)\\bcall[- ]?in\\b|\\bwelcome\\s+(back\\s+)?to\\b')""")
def sentence_filters(spark, d):
    k = T.keep_sentence(F.col("text"), R.Names())
    return B.from_parts(spark, d, B.UTTERANCE).select("p_partkey", k.alias("kept")).where("kept is not null")


@query(f"""select p_partkey, len(list_filter(string_split(t, ' '), lambda w: regexp_matches(w, '[a-zA-Z0-9]'))) >= 5 as long_enough from (select p_partkey, {B.UTTERANCE} as t from part)""")
def least_words(spark, d):
    return B.from_parts(spark, d, B.UTTERANCE).select("p_partkey", (T.alnum_words(F.col("text")) >= R.LEAST_TURN_WORDS).alias("long_enough"))


_MARK = "[" + ", ".join(f"'{w}'" for w in [*R.CONTRAST, *R.CAUSAL]) + "]"
_MARKED = "case p_partkey % 4 when 0 then 'because ' || p_name when 1 then p_name || ' though' when 2 then 'sofa ' || p_name else p_name end"


@query(f"select p_partkey, list_has_any(string_split(lower({_MARKED}), ' '), {_MARK}) as marked from part")
def discourse_marker(spark, d):
    t = B.from_parts(spark, d, _MARKED)
    return t.select("p_partkey", T.has_marker_word(F.split(F.lower("text"), " ")).alias("marked"))


_TURN = """case p_partkey % 5 when 0 then 'Well, ' || p_name || ' is, like, good today' when 1 then 'Not ' || p_name when 2 then 'Actually because ' || p_name || ' sort of works'
  when 3 then 'You can''t' else 'By the way ' || p_name end"""


@query("""select p_partkey, out from (select p_partkey, case p_partkey % 5 when 0 then upper(p_name[1]) || substr(p_name, 2) || ' is,, good today' when 1 then case when regexp_matches(p_name, '[a-z]{4}') then 'Not ' || p_name end
  when 2 then 'Because ' || p_name || ' works' end as out from part) where out is not null""")
def parsed_turns(spark, d):
    t = M.map_model(B.from_parts(spark, d, _TURN.replace("can''t", "can\\'t")), "text", "p", M.keyword_parser, M.PARSE)
    t = t.withColumn("out", T.strip_parsed_fillers(F.col("text"), F.col("p.tokens")))
    return t.where(T.keep_turn(F.col("out"), F.col("p"))).select("p_partkey", "out")


_CAND = "case p_partkey % 3 when 0 then p_name || ' again' when 1 then substr(p_name, 1, 6) else replace(p_name, 'e', 'e') || 'ness' end"
_LONG = "list_filter(list_distinct(regexp_extract_all(lower({}), '\\w+')), lambda w: length(w) >= 5)"


@query(f"""select p_partkey, len(list_filter(o, lambda w: not list_contains(c, w) and len(list_filter(c, lambda x: starts_with(x, substr(w, 1, 4)))) = 0)) = 0 as ok
from (select p_partkey, {_LONG.format('p_name')} as o, {_LONG.format(f'({_CAND})')} as c from part)""")
def no_content_dropped(spark, d):
    t = B.table(spark, d, "part").select("p_partkey", "p_name", F.expr(_CAND).alias("c"))
    return t.select("p_partkey", T.no_content_dropped(F.col("p_name"), F.col("c")).alias("ok"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 1000) and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def pending_work(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    ready = B.table(spark, d, "customer").select("c_custkey").join(o.where("o_totalprice > 1000"), "c_custkey", "left_semi")
    return stages.pending(ready, o.where("o_orderstatus = 'P'"), "c_custkey")


@query("select p_partkey, p_name from part where p_partkey = 7")
def episode_by_number(spark, d):
    return stages.select_episode(B.table(spark, d, "part").withColumnRenamed("p_partkey", "number"), 7).select(F.col("number").alias("p_partkey"), "p_name")


# ---------------------------------------------------------------- text: replacements


def _replaced(name: str, f, sql: str, source: str = B.SENTENCE, columns: str = "p_partkey") -> None:
    """A query of f over sentences; sql says what becomes of the sentence t (or of the columns named)."""

    def run(spark, d):
        return B.from_parts(spark, d, source, spread=True).select("p_partkey", f(F.col("text")).alias("out"))

    run.__name__ = name
    t = source.replace("\\'", "''")
    query(f"select p_partkey, {sql} as out from (select {columns}, {t} as t from part)")(run)


def _re(x: str, p: str, to: str, flags: str = "gi") -> str:
    return f"regexp_replace({x}, '{p}', '{to}', '{flags}')"


_FRACTION_TEXT = "cast(p_size as string) || case p_partkey % 4 when 0 then ' and three quarters' when 1 then ' and a half' when 2 then ' and a quarter' else ' and a third' end || ' of ' || p_name"
_frac = "t"
for _p, _to in R.FRACTIONS:
    _frac = _re(_frac, _p, _to.replace("$1", "\\1"))
_replaced("normalize_fractions", T.normalize_fractions, _frac, _FRACTION_TEXT)
_temp = "t"
for _p, _to in R.TEMPERATURES:
    _temp = _re(_temp, _p, _to.replace("$1", "\\1"))
_replaced("normalize_temperatures", T.normalize_temperatures, _re(_temp, R.TEMPERATURE_BARE[0], "\\1°", "g"), "p_name || ' at ' || cast(p_size as string) || case p_partkey % 3 when 0 then ' degrees F' when 1 then ' degree celsius' else ' degrees' end")
_replaced("normalize_percent", T.normalize_percent, _re("t", R.PERCENT[0], "\\1%"))
_units = "t"
for _w, _s in R.UNITS.items():
    _units = _re(_units, f"\\b{_w}s?\\b", _s)
_replaced("normalize_units", T.normalize_units, _units)
_replaced("shorten_phrases", T.normalize_phrases, _re(_re("t", R.PHRASES[0][0], "pain"), R.PHRASES[1][0], "some"), "case p_partkey % 2 when 0 then 'a pain in the butt, ' else 'some of those ' end || p_name")
_replaced("spoken_dot", T.spoken_dots, _re(_re("t", "(\\w)\\s+dot\\s+(\\w)", "\\1.\\2"), "(\\w)\\s+dot\\s+(\\w)", "\\1.\\2"))
_replaced("tag_questions", lambda c: T._subs(c, R.TAGS), _re(_re("t", R.TAGS[0][0], "."), R.TAGS[1][0], "."), "p_name || case p_partkey % 3 when 0 then ', right? ' when 1 then ', you know what I mean?' else ' is that right?' end")
_replaced("stacked_openers", lambda c: T._sub(c, R.opening(), ""), _re("t", rf"^(?:,?\s*\b(?:{'|'.join(R.OPENERS)})\b,?\s*)+", ""), "case p_partkey % 3 when 0 then 'So, like, basically ' when 1 then 'Well ' else 'Somehow ' end || p_name")
_replaced("very_very", lambda c: T._sub(c, r"\bvery,?\s+very\b", "very"), _re("t", "\\bvery,?\\s+very\\b", "very"))
_replaced("its_stutter", lambda c: T._sub(c, *R.ITS_STUTTER), _re("t", R.ITS_STUTTER[0].replace("'", "''"), "it''s"), "'it''s a it''s ' || p_name")
_letters = "t"
for _c in "bcdfghjklmnpqrstvwxyz":
    _letters = _re(_letters, f"\\b{_c}\\s+({_c}[a-z]+)\\b", "\\1")
_cleaned = "t"
for _p, _to in (("So the thing is", "Thing is"), (" or something like that!!", "!!"), (", uh, ", ", "), (", you know, very very", " very"), ("We we", "We")):
    _cleaned = f"replace({_cleaned}, '{_p}', '{_to}')"
_held = _re(_re("t", f"\\b({'|'.join(R.SEMANTIC_PRECEDES)}) you (know|see)\\b", "\\1 you_\\2"), "\\bi (mean|guess|think) (it|so)\\b", "I_\\1 \\2")
_gone = _re(_held, "\\b(" + "|".join(sorted(R.LEXICAL_FILLERS, key=len, reverse=True)) + ")\\b\\s*", "")
_lexical = _re(_re(_re(f"trim({_gone})", " {2,}", " ", "g"), " ([.,!?;:])", "\\1", "g"), "^[,;:\\s]+", "", "g")
_lexical = f"(select replace(replace(upper(x[1]) || substr(x, 2), 'you_', 'you '), 'I_', 'I ') from (select {_lexical} as x))"
#: The number words of p_partkey % 1000, and of its digits one by one, as SQL of both engines.
_words = lambda of, x: f"case {x} " + " ".join(f"when {i} then '{w}'" for w, i in of.items()) + " else '' end"
_SMALL = {w: i for i, w in enumerate(R.DIGIT_WORDS + R.TEEN_WORDS)}
_TENS = {w: i + 2 for i, w in enumerate(R.TENS_WORDS)}
_hundreds, _below = "cast(floor(p_partkey % 1000 / 100) as int)", "p_partkey % 100"
_CARDINAL = (
    f"trim(case when {_hundreds} > 0 then {_words(_SMALL, _hundreds)} || ' hundred ' else '' end || case when {_below} between 1 and 19 or p_partkey % 1000 = 0 then {_words(_SMALL, _below)} "
    f"when {_below} > 0 then {_words(_TENS, f'cast(floor({_below} / 10) as int)')} || case when p_partkey % 10 > 0 then ' ' || {_words(_SMALL, 'p_partkey % 10')} else '' end else '' end)"
)
_EACH = f"{_words(_SMALL, _hundreds)} || '  ' || {_words(_SMALL, f'cast(floor({_below} / 10) as int)')} || ' ' || upper({_words(_SMALL, 'p_partkey % 10')})"
_replaced("collapse_spoken_digits", N.collapse_spoken_digits, "'call ' || lpad(cast(p_partkey % 1000 as string), 3, '0') || ' ' || p_name || ' one'", f"'call ' || {_EACH} || ' ' || p_name || ' one'", columns="p_partkey, p_name")
_replaced("normalize_numbers", N.normalize_numbers, "'take ' || cast(p_partkey % 1000 as string) || ', ' || p_name || ' or ' || cast(p_partkey % 1000 * 1000 as string) || '.'",
  f"'take ' || {_CARDINAL} || ', ' || p_name || '  or ' || case when p_partkey % 1000 = 0 then 'zero' else {_CARDINAL} || ' thousand' end || '.'", columns="p_partkey, p_name")
_replaced("spoken_url", T.spoken_urls, "'visit ' || w || '.' || o || ' and a b'", "'visit ' || rtrim(regexp_replace(split_part(p_name, ' ', 1), '(.)', '$1 ')) || ' dot ' || split_part(p_name, ' ', 2) || ' and a b'",
  columns="p_partkey, p_name, split_part(p_name, ' ', 1) as w, split_part(p_name, ' ', 2) as o")
_replaced("letter_stutter", T.letter_stutter, _letters, "'f floral ' || p_name || ' s something a apple'")
_replaced("phrase_stutter", T.phrase_stutter, "'before we ' || p_name || ' now ' || p_name || ' with a spoon'",
  "repeat('before we ', 1 + cast(p_partkey % 5 as int)) || repeat(p_name || ' ', 1 + cast(p_partkey % 7 as int)) || 'now ' || p_name || ' with a with a spoon'", columns="p_partkey, p_name")
_replaced("clean_sentence", T.clean_sentence, _cleaned)
_replaced("strip_lexical_fillers", T.strip_lexical_fillers, _lexical, "'I mean, ' || p_name || ' is kind of good, do you know, by the way.'")
_replaced("recapitalize", lambda c: T.recapitalize(F.substring(c, 4, 1000), c), "case when substr(t, 4, 1) between 'a' and 'z' and substr(t, 1, 1) between 'A' and 'Z' then upper(substr(t, 4, 1)) || substr(t, 5) else substr(t, 4, 1000) end", "case p_partkey % 2 when 0 then 'So ' else 'so ' end || p_name")
_replaced("strip_phones", T.strip_phone_numbers,
  "trim(" + _re(_re(_re(_re(_re("t", "[.,]?\\s*[Tt]hat(''s| is)\\s+\\d{3}[.-]?\\d{3}[.-]?\\d{4}[,.]?", "", "g"), "\\b\\d{3}[.-]?\\d{3}[.-]?\\d{4}\\b", "", "g"), ",\\s*\\.", ".", "g"), " {2,}", " ", "g"), " ([.,])", "\\1", "g") + ")",
  "'Call ' || p_name || ' at 718-497-2128, that''s 7184972128. Or 718.497.2128 now'")


#: Sentences of the rules that a single one does not show, and what is left of them; {} is the part's name.
_CASES = [
    ("it''s it, {} said", "it''s, {} said"), ("it''s a it''s {}", "it''s {}"), ("You know, {} is here", "{} is here"), ("We bake, you know, {} bread", "We bake {} bread"),
    ("Do you know {} well", "Do you know {} well"), ("If you know {} then go", "If you know {} then go"), ("We bake, you see, {}", "We bake {}"), ("You see, {} rises", "{} rises"), ("I mean, {} is fine", "{} is fine"),
    ("I mean it with {}", "I mean it with {}"), ("By the way, {} is fine", "{} is fine"), ("It is, by the way, {}", "It is {}"), ("Let me just tell you, {} is fine", "{} is fine"), ("I think {} is fine", "{} is fine"),
    ("I think about {} daily", "I think about {} daily"), ("Nice, {} is fine", "{} is fine"), ("Bake {}, basically, today", "Bake {} today"), ("Bake {} or something.", "Bake {}."), ("Bake {} or something like that", "Bake {}"),
    ("Or something like {}", "Or something like {}"), ("The problem is, {} rises", "Problem is {} rises"), ("very, very good {}", "very good {}"), ("We we we bake {}", "We bake {}"), ("Well, um, {} is um good", "{} is good"),
    ("That is {}, right? ", "That is {}."), ("so, like, well {}", "{}"),
]


def _case(texts: list[str]) -> str:
    """The text of a part, by its number, as SQL."""

    def full(t: str) -> str:
        before, after = t.split("{}")
        return " || ".join([*[f"'{x}'" for x in [before] if x], "p_name", *[f"'{x}'" for x in [after] if x]])

    return f"case p_partkey % {len(texts)} " + " ".join(f"when {i} then {full(t)}" for i, t in enumerate(texts)) + " end"


#: The first letter is upper-case again where the sentence's was.
_kept = _case([want for _, want in _CASES])
_upper = "p_partkey % {} in ({})".format(len(_CASES), ", ".join(str(i) for i, (t, w) in enumerate(_CASES) if w.startswith("{}") and t[0].isupper()))
_replaced("sentence_cases", T.clean_sentence, f"case when {_upper} then upper(kept[1]) || substr(kept, 2) else kept end", _case([t for t, _ in _CASES]).replace("''", "\\'"), columns=f"p_partkey, p_name, {_kept} as kept")


@query("select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\.+', '.', 'g'), '!+', '!', 'g'), '\\?+', '?', 'g') as out from documents")
def normalize_punct(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.normalize_punctuation(F.col("text")).alias("out"))


@query(f"""select doc_id, len(s) as n, s[1] as first, s[len(s)] as last from (select doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9"])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as s
from documents where text is not null)""")
def sentence_split(spark, d):
    s = B.texts(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.element_at("s", 1).alias("first"), F.element_at("s", -1).alias("last"))


_low = "|".join(R.LOWER_STARTERS)


@query(f"""select doc_id, len(s) as n from (select doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+([A-Z0-9"])', '\\1' || chr(1) || '\\2', 'g'), '([.!?])\\s+(({_low})\\b)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as s
from documents where text is not null)""")
def sentence_split_v2(spark, d):
    s = B.texts(spark, d).select("doc_id", T.sentences_v2(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"))


_DIS = "(?i)(^|[^a-zA-Z\\-])(uh+|um+|ah+|mm+|hmm+|eh|er)($|[^a-zA-Z\\-])"


@query(f"""select doc_id, regexp_replace(m2, '\\s*' || chr(2) || '\\s*,?', ' ', 'g') as out from (
select doc_id, regexp_replace(regexp_replace(text, '{_DIS}', '\\1' || chr(2) || '\\3', 'g'), '{_DIS}', '\\1' || chr(2) || '\\3', 'g') as m2 from documents where text is not null)""")
def strip_disfluency(spark, d):
    return B.texts(spark, d).select("doc_id", T.strip_disfluencies(F.col("text")).alias("out"))


@query("""select doc_id, count(*) filter (where prev is null or w <> prev) as words from (select doc_id, w, lag(w) over (partition by doc_id order by i) as prev from (
  select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w from (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as ws from documents
  where text is not null))) group by doc_id""")
def stutter_dedup(spark, d):
    t = B.texts(spark, d).select("doc_id", T.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")).alias("t")).where("t <> ''")
    return t.select("doc_id", F.size(F.split(T.dedup_stutter(F.col("t")), " ")).cast("long").alias("words"))


@query("""with recursive b as (select string_split_regex(lower(text), '\\s+') as w from benchmark), ph as (select distinct p from (select w[1:2] as p from b union all select w[1:3] from b union all select w[2:5] from b) where len(p) >= 2),
d as (select doc_id, string_split_regex(lower(text), '\\s+') as w from documents where text is not null),
t as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as a1 from d),
u as (select *, lead(a1) over o as a2, lead(a1, 2) over o as a3, lead(a1, 3) over o as a4 from t window o as (partition by doc_id order by i)),
g as (select doc_id, 2 as n, i, [a1, a2] as gram from u where a2 is not null union all select doc_id, 3, i, [a1, a2, a3] from u where a3 is not null union all select doc_id, 4, i, [a1, a2, a3, a4] from u where a4 is not null),
m as (select doc_id, i as a, i + n - 1 as z from g join ph on ph.p = gram),
e as (select *, coalesce(a > max(z) over (partition by doc_id order by a, z rows between unbounded preceding and 1 preceding), true) as new from m),
q as (select doc_id, a, z, sum(new::int) over (partition by doc_id order by a, z) as isl from e),
c as (select *, row_number() over (partition by doc_id, isl order by z - a desc, a) as k from q),
r as (select distinct doc_id, isl, 0::bigint as k, []::struct(a bigint, z bigint)[] as kept from c union all
  select r.doc_id, r.isl, c.k, case when len(list_filter(kept, lambda x: x.a <= c.z and x.z >= c.a)) = 0 then list_append(kept, {'a': c.a, 'z': c.z}) else kept end
  from r join c on c.doc_id = r.doc_id and c.isl = r.isl and c.k = r.k + 1),
i as (select doc_id, isl, kept from r qualify row_number() over (partition by doc_id, isl order by k desc) = 1),
f as (select doc_id, flatten(list(kept)) as kept from i group by doc_id)
select d.doc_id, len(w) as before, len(w) - coalesce(list_sum(list_transform(kept, lambda x: x.z - x.a + 1)), 0)::bigint as after from d left join f on f.doc_id = d.doc_id""")
def phrase_removal(spark, d):
    words = F.split(F.lower("text"), r"\s+")
    b = B.table(spark, d, "benchmark").select(words.alias("w"))
    p = b.select(F.explode(F.array(F.slice("w", 1, 2), F.slice("w", 1, 3), F.slice("w", 2, 4))).alias("phrase")).where(F.size("phrase") >= 2)
    none = F.lit(None).cast("array<string>")
    t = B.texts(spark, d).select("doc_id", words.alias("tokens"))
    out = phrases.remove_phrases(t, p.withColumn("not_after", none).withColumn("not_before", none))
    return t.select("doc_id", F.size("tokens").cast("long").alias("before")).join(out.select("doc_id", F.size("tokens").cast("long").alias("after")), "doc_id")


# ---------------------------------------------------------------- whole documents


@query("""select p_partkey, 'Thing is we cook ' || p_name || ' for ' || p_size || ' minutes at ' || p_size * 10 || '°C, with ' || p_size || '½ oz or ' || p_size || ' tbsp and ' || p_size
  || '% salt! It is very good. We visit www.shop.com.' as out from part""")
def strip_fillers(spark, d):
    return D.strip_fillers(B.from_parts(spark, d, B.SENTENCE, spread=True)).withColumnRenamed("text", "out")


def _rendered(spark, d):
    return B.lines(spark, d).groupBy("doc_id").agg(S.ordered_join(F.col("text"), F.col("para_idx"), "\n\n").alias("text"))


@query()
def strip_fillers_rendered(spark, d):
    return D.strip_fillers_rendered(_rendered(spark, d))


@query()
def denoise_document(spark, d):
    return D.denoise(_rendered(spark, d))


@query()
def denoise2_document(spark, d):
    return D.denoise2(_rendered(spark, d))


@query(f"""select p_partkey, t as text, case when length(t) % 2 = 1 then replace(t, 'tastes', 'taste') when length(t) <= 6 then substr(t, 1, 5) else t end as out
from (select p_partkey, {B.UTTERANCE} as t from part)""")
def guarded_correction(spark, d):
    t = B.from_parts(spark, d, B.UTTERANCE)
    return M.guarded_correction(t, "text", "out", lambda: lambda xs: [x.replace("tastes", "taste") if len(x) % 2 else x[:5] for x in xs])


@query("select p_partkey, 'Notes: ' || length('Summarise' || chr(10) || chr(10) || p_name) as notes from part")
def extract_notes(spark, d):
    t = B.table(spark, d, "part").select("p_partkey", "p_name")
    return D.complete(t, "p_name", "Summarise", lambda: lambda xs: [f"Notes: {len(x)}" for x in xs]).select("p_partkey", "notes")


# ---------------------------------------------------------------- sources, sizes, sets


@query("""select p_partkey // 40 as feed_idx, -(row_number() over (partition by p_partkey // 40 order by p_partkey) - 1) as pos, p_name as title, 'http://x/' || p_partkey as audio_url from part""")
def parse_feeds(spark, d):
    p = B.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("feed_idx"), "p_partkey", F.concat(F.lit("<item><title>"), F.col("p_name"), F.lit("</title><enclosure url=\"http://x/"), F.col("p_partkey").cast("string"), F.lit("\"/></item>")).alias("x"))
    xml = p.groupBy("feed_idx").agg(F.concat(F.lit("<rss><channel>"), S.ordered_join(F.replace("x", F.lit(" url="), F.lit(" url=")), F.col("p_partkey"), ""), F.lit("</channel></rss>")).alias("xml"))
    return feed.parse_feeds(xml)


@query("""with t as (select user_id as doc_id, event_id, epoch_us(ts) / 1e6 as s, value, event_type from events where event_type in ('view', 'click'))
select doc_id, event_id as turn, round(s, 3) as "start", round(s + value, 3) as "end", event_type as speaker from t""")
def turns_json_roundtrip(spark, d):
    t = B.wide(spark, d, ["view", "click"], "turn").join(B.table(spark, d, "events").select(F.col("event_id").alias("turn"), "value"), "turn")
    one = F.array(F.struct((F.col("start") / 1e6).alias("start"), (F.col("start") / 1e6 + F.col("value")).alias("end"), "speaker"))
    back = transcripts.turns_from_json(transcripts.turns_to_json(one))
    return t.select("doc_id", "turn", F.explode(back).alias("t")).select("doc_id", "turn", F.round("t.start", 3).alias("start"), F.round("t.end", 3).alias("end"), "t.speaker")


@query("select p_partkey, greatest(30, least(cast(trunc(p_retailprice / 20 * 30 / 8.0) as int), 600)) as seconds from part")
def chunk_size(spark, d):
    return B.table(spark, d, "part").select("p_partkey", M.chunk_seconds(F.col("p_retailprice") / 20).alias("seconds"))


@query("""select p_partkey, cast(least(greatest(floor(greatest(greatest(p_size * 2 * 0.70::double - 2.0::double, 2.0::double) - 5.0::double, 0.5::double) * 1024 / (5.0::double / 0.55::double * 0.25::double) * 1024), 4096), 131072) // 1024 * 1024 as bigint) as tokens from part""")
def context_length(spark, d):
    return B.table(spark, d, "part").select("p_partkey", M.context_length(F.col("p_size") * 2, F.lit(5.0)).alias("tokens"))


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'a/' || p_partkey || '.opus' when p_partkey % 3 = 1 then 'a/' || p_partkey || '.mp3' end as audio from part""")
def preferred_audio(spark, d):
    p = B.table(spark, d, "part").select("p_partkey")
    path = lambda ext: F.concat(F.lit("a/"), F.col("p_partkey").cast("string"), F.lit(ext)).alias("path")
    files = p.where("p_partkey % 3 < 2").select("p_partkey", path(".mp3")).union(p.where("p_partkey % 3 = 0").select("p_partkey", path(".opus")))
    return transcripts.preferred_audio(p, files, "p_partkey")


@query("select p_size, array_to_string(list_sort(list_distinct(list(w))), '|') as words from (select p_size, unnest(string_split(p_name, ' ')) as w from part) where w not in (select unnest(string_split(p_type, ' ')) from part where p_partkey = 1) group by p_size")
def word_set_difference(spark, d):
    p = B.table(spark, d, "part")
    words = p.groupBy("p_size").agg(F.collect_set("p_name").alias("n")).select("p_size", F.array_distinct(F.flatten(F.transform("n", lambda x: F.split(x, " ")))).alias("w"))
    other = p.where("p_partkey = 1").select(F.split("p_type", " ").alias("o"), F.lit(1).alias("k"))
    j = words.withColumn("k", F.lit(1)).join(F.broadcast(other), "k", "left")
    return j.select("p_size", F.array_join(F.array_sort(F.array_except("w", F.coalesce("o", F.array().cast("array<string>")))), "|").alias("words"))
