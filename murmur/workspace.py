"""A show's corpus as tables, and the commands on it.

Each stage has one table below ``root/<show>/<backend>``; a stage works on the episodes that its input has and
its output lacks, over all episodes in one plan, and appends what it made, stamped with the time and a mark of the driver.  Of an episode's rows the
latest counts, so drivers that run at once duplicate nothing; what is to be done again is put on a list of episodes whose earlier rows do not count,
so no table is rewritten for one episode.  ``compact`` takes such rows out.  Models, downloads and transcoding
are injected (``Tools``).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur import models as M
from murmur import schemas as S
from murmur.functions import rules as R
from murmur.operators import segments as seg
from murmur.operators import stages, vectors
from murmur.operators.intervals import overlap_join
from murmur.plans import documents as D
from murmur.sources import feed, http

RAW = f"slug string, text string, language string, segments array<{S.RAW_SEGMENT}>"
TURNS = f"slug string, turns array<{S.TURN}>"
STORED = f"slug string, {S.STORED_TRANSCRIPT}"
TEXT = "slug string, diarized boolean, text string"
CLEAN = "slug string, text string"
NOTES = "slug string, model string, notes string"
LEARNT = f"{S.SPEAKERS}, learnt_at double"
FORGOTTEN = "slug string, forgotten_at double"
#: Columns that tell an episode's rows apart, of tables with more than one for each.
PARTS = {"texts": ["diarized"]}
#: Tables whose earlier rows of forgotten episodes do not count.
CACHED = {"raw": RAW, "turns": TURNS, "transcripts": STORED, "texts": TEXT}
#: Seconds of a time bucket, in which segments meet turns.
BUCKET_S = 60.0


@dataclass
class Show:
    """A registered show: its feeds' items, the names that rules use, and its prompts."""

    slug: str
    name: str
    feed_urls: list[str] = field(default_factory=list)
    names: R.Names = R.Names()
    extract_prompt: str = "List what this conversation teaches."
    distill_prompt: str = "Condense these notes."


@dataclass
class Tools:
    """Injected work. Factories are called once in a task and map lists to lists."""

    get: Callable[[str], tuple[int, bytes, dict]] | None = None
    #: feeds, with headers
    fetch: feed.Fetch | None = None
    transcode: Callable[[bytes], bytes] | None = None
    #: audio bytes to {text, language, segments}
    asr: M.Factory | None = None
    #: audio bytes to a list of {start, end, speaker}
    diarizer: M.Factory | None = None
    #: audio bytes to a list of {speaker, start, end, embedding}
    turn_vectors: M.Factory | None = None
    complete: M.Factory | None = None
    corrector: M.Factory = M.identity
    embedder: M.Factory | None = None
    parser: M.Factory = M.keyword_parser


def check_options(command: str, learn: bool = False, speakers: list[str] | None = None, diarize: bool = False) -> None:
    if learn and not speakers:
        raise ValueError("learning voices needs names of speakers")
    if learn and command != "diarize" and not diarize:
        raise ValueError("learning voices needs diarization")


class Workspace:
    def __init__(self, spark: SparkSession, root: str, show: Show, backend: str = "default", tools: Tools | None = None):
        self.spark, self.show, self.backend, self.tools = spark, show, backend, tools or Tools()
        self.root, self.mark = f"{root.rstrip('/')}/{show.slug}", uuid.uuid4().hex

    # ------------------------------------------------------------ tables

    def path(self, table: str, shared: bool = False) -> str:
        return f"{self.root}/{table}" if shared else f"{self.root}/{self.backend}/{table}"

    def read(self, table: str, schema: str, shared: bool = False) -> DataFrame:
        """What counts of a table: of each episode (and part) the latest rows, and of forgotten ones only later rows."""
        t = stages.read_or_empty(self.spark, self.path(table, shared), f"{schema}, made_at double, made_by string")
        if "slug" not in t.columns:
            return t.drop("made_at", "made_by")
        stamp = F.struct(F.coalesce("made_at", F.lit(0.0)).alias("at"), F.coalesce("made_by", F.lit("")).alias("by"))
        on = ["slug", *[c for c in PARTS.get(table, []) if c in t.columns]]
        latest = t.groupBy(*on).agg(F.max(stamp).alias("_latest"))
        if table in CACHED:
            gone = stages.read_or_empty(self.spark, self.path("forgotten"), FORGOTTEN).groupBy("slug").agg(F.max("forgotten_at").alias("_gone"))
            latest = latest.join(gone, "slug", "left").where(F.col("_latest.at") > F.coalesce("_gone", F.lit(-1.0))).drop("_gone")
        return t.join(latest, on).where(stamp == F.col("_latest")).drop("made_at", "made_by", "_latest")

    def _stamped(self, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        return lambda todo: work(todo).withColumn("made_at", F.lit(time.time())).withColumn("made_by", F.lit(self.mark))

    def _stage(self, inputs: DataFrame, table: str, schema: str, work: Callable[[DataFrame], DataFrame], shared: bool = False, dry_run: bool = False) -> DataFrame:
        """Runs work on the inputs that the table lacks and appends; dry_run only returns what would run."""
        todo = stages.pending(inputs, self.read(table, schema, shared), "slug")
        if not dry_run:
            stages.append(self._stamped(work)(todo), self.path(table, shared))
        return todo

    def audio(self) -> DataFrame:
        return self.read("audio", "slug string, audio binary", shared=True)

    def texts(self, diarized: bool = False) -> DataFrame:
        return self.read("texts", TEXT).where(F.col("diarized") == diarized)

    def speakers(self) -> DataFrame:
        """(name, embedding): the voice learnt last for each name."""
        learnt = self.read("speakers", LEARNT, shared=True)
        return learnt.groupBy("name").agg(F.max_by("embedding", F.coalesce("learnt_at", F.lit(0.0))).alias("embedding"))

    # ------------------------------------------------------------ commands

    @staticmethod
    def episodes(rows: DataFrame) -> DataFrame:
        """Numbered episodes of feed rows (feed_idx, pos, title, audio_url)."""
        return stages.episode_numbering(rows, ["feed_idx", "pos"])

    def load_episodes(self, ttl: float = feed.FEED_TTL) -> DataFrame:
        """Numbered episodes of the show's own feeds; copies that are not fresh are downloaded first."""
        return self.episodes(feed.parse_feeds(feed.refresh(self.spark, self.show.feed_urls, self.path("feeds", True), self.tools.fetch, ttl)))

    def status(self, episodes: DataFrame) -> DataFrame:
        return stages.episode_status(episodes, self.texts(False), self.texts(True), "slug")

    def download(self, episodes: DataFrame, dry_run: bool = False) -> DataFrame:
        def work(todo: DataFrame) -> DataFrame:
            got = http.fetch_all(todo.select(F.col("slug").alias("key"), F.col("audio_url").alias("url")), self.tools.get)
            got = got.select(F.col("key").alias("slug"), F.col("body").alias("audio"))
            if self.tools.transcode is None:
                return got
            one = self.tools.transcode
            return M.map_model(got, "audio", "_opus", lambda: lambda xs: [one(x) for x in xs], "binary").select("slug", F.col("_opus").alias("audio"))

        return self._stage(episodes, "audio", "slug string, audio binary", work, True, dry_run)

    def recognise(self, episodes: DataFrame, dry_run: bool = False) -> DataFrame:
        kind = f"struct<text:string,language:string,segments:array<{S.RAW_SEGMENT}>>"

        def work(todo: DataFrame) -> DataFrame:
            rows = self.audio().join(todo.select("slug"), "slug", "left_semi")
            return M.map_model(rows, "audio", "_r", self.tools.asr, kind).select("slug", "_r.*")

        return self._stage(episodes, "raw", RAW, work, dry_run=dry_run)

    def find_turns(self, episodes: DataFrame, dry_run: bool = False) -> DataFrame:
        def work(todo: DataFrame) -> DataFrame:
            rows = self.audio().join(todo.select("slug"), "slug", "left_semi")
            return M.map_model(rows, "audio", "turns", self.tools.diarizer, f"array<{S.TURN}>").select("slug", "turns")

        return self._stage(episodes, "turns", TURNS, work, dry_run=dry_run)

    def _voices(self, slugs: DataFrame) -> DataFrame:
        """(slug, speaker, embedding): a mean vector for each voice of an episode."""
        kind = "array<struct<speaker:string,start:double,end:double,embedding:array<double>>>"
        rows = self.audio().join(slugs.select("slug"), "slug", "left_semi")
        v = M.map_model(rows, "audio", "_v", self.tools.turn_vectors, kind).select("slug", F.explode("_v").alias("v")).select("slug", "v.*")
        return vectors.cluster_means(v, ["slug", "speaker"])

    def store(self, episodes: DataFrame, diarize: bool = False, speakers: list[str] | None = None, learn: bool = False) -> DataFrame:
        """Final transcripts: segments with speakers and, where voices are known, their names."""

        def work(todo: DataFrame) -> DataFrame:
            raw = self.read("raw", RAW).join(todo.select("slug"), "slug", "left_semi")
            s = raw.select("slug", F.posexplode("segments").alias("seg_idx", "s")).select("slug", "seg_idx", "s.*")
            if not diarize:
                s, mapping = s.withColumn("speaker", F.lit(S.UNKNOWN_SPEAKER)), None
            else:
                t = self.read("turns", TURNS).select("slug", F.posexplode("turns").alias("turn_idx", "t")).select("slug", "turn_idx", "t.*")
                s = overlap_join(s, t, key="slug", width=BUCKET_S)
                mapping = self._names(s, todo, speakers)
            one = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.struct("start", "end", "text", "speaker").alias("s")))), lambda x: x["s"])
            full = raw.drop("segments").join(s.groupBy("slug").agg(one.alias("segments")), "slug", "left")
            if mapping is None:
                full = full.withColumn("speaker_mapping", F.create_map().cast("map<string,string>"))
            else:
                m = mapping.where("name is not null").groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "name"))).alias("speaker_mapping"))
                full = full.join(m, "slug", "left")
            return full.select("slug", "text", "language", F.lit(self.backend).alias("backend"), "speaker_mapping", F.coalesce("segments", F.array().cast(f"array<{S.SEGMENT}>")).alias("segments"))

        todo = self._stage(episodes, "transcripts", STORED, work)
        if learn:
            self._learn(episodes, speakers)
        return todo

    def _names(self, s: DataFrame, todo: DataFrame, speakers: list[str] | None) -> DataFrame:
        if speakers is not None:
            return seg.first_appearance_map(s, speakers, "slug").select("slug", "speaker", "name")
        known = self.speakers()
        if self.tools.turn_vectors is None or not known.limit(1).count():
            return seg.first_appearance_map(s, [], "slug").select("slug", "speaker", "name")
        known = known.withColumn("known_idx", F.xxhash64("name"))
        v = self._voices(todo).withColumn("cluster", F.struct("slug", "speaker"))
        out = vectors.match_speakers(v.select(F.to_json("cluster").alias("cluster"), "embedding"), known)
        key = F.from_json("cluster", "slug string, speaker string")
        return out.select(key.alias("k"), F.when(F.col("name") != F.col("cluster"), F.col("name")).alias("name")).select("k.slug", "k.speaker", "name")

    def _learn(self, episodes: DataFrame, speakers: list[str]) -> None:
        """The voices of these episodes under the names given; of several episodes the last one's count."""
        done = self.read("transcripts", STORED).join(episodes.select("slug"), "slug", "left_semi")
        s = done.select("slug", F.posexplode("segments").alias("seg_idx", "s")).select("slug", "seg_idx", "s.*")
        names = seg.first_appearance_map(s, speakers, "slug").where("name is not null")
        new = self._voices(done.select("slug")).join(names, ["slug", "speaker"]).groupBy("name").agg(F.max_by("embedding", "slug").alias("embedding"))
        stages.append(new.withColumn("learnt_at", F.lit(time.time())), self.path("speakers", True))

    def render(self, episodes: DataFrame, gap: float = R.PARAGRAPH_GAP_S, diarize: bool = False, speakers: list[str] | None = None, strip_fillers: bool = False) -> DataFrame:
        def work(todo: DataFrame) -> DataFrame:
            t = self.read("transcripts", STORED).join(todo.select("slug"), "slug", "left_semi")
            s = t.select("slug", F.posexplode("segments").alias("seg_idx", "s")).select("slug", "seg_idx", "s.*")
            stored = t.select("slug", F.explode("speaker_mapping").alias("speaker", "name"))
            mapping = seg.first_appearance_map(s, speakers, "slug") if speakers else stored
            s = seg.apply_speaker_map(s, mapping, ["slug"]) if diarize else s
            p = seg.paragraphs(seg.gap_segments(s, gap, "slug"), "slug")
            if strip_fillers:
                p = D.strip_fillers(p, "text", self.show.names).where("text <> ''")
            lines = p.select("slug", "para_idx", seg.render_line(F.col("start"), F.col("speaker"), F.col("text"), diarize).alias("line"))
            return lines.groupBy("slug").agg(seg.ordered_join(F.col("line"), F.col("para_idx"), "\n\n").alias("text")).select("slug", F.lit(diarize).alias("diarized"), "text")

        todo = stages.pending(episodes.join(self.read("transcripts", STORED), "slug", "left_semi"), self.texts(diarize), "slug")
        stages.append(self._stamped(work)(todo), self.path("texts"))
        return todo

    def produce(
        self, episodes: DataFrame, number: int | None = None, redo: bool = False, diarize: bool = False, speakers: list[str] | None = None,
        learn: bool = False, gap: float = R.PARAGRAPH_GAP_S, strip_fillers: bool = False, dry_run: bool = False, download_only: bool = False,
    ) -> dict[str, int]:
        """All stages from audio to text; how many episodes each stage took (or would take)."""
        check_options("recognise", learn, speakers, diarize)
        e = stages.select_episode(episodes, number)
        if redo:
            self.forget(e)
        if dry_run:
            audio, stored = self.audio(), self.read("transcripts", STORED)
            return {"download": stages.pending(e, audio, "slug").count(), "recognised": stages.pending(e, stored, "slug").count(), "render": stages.pending(e, self.texts(diarize), "slug").count()}
        out = {"download": stages.pending(e, self.audio(), "slug").count()}
        self.download(e)
        if download_only:
            return out
        out["recognised"] = stages.pending(e, self.read("transcripts", STORED), "slug").count()
        self.recognise(e)
        if diarize:
            self.find_turns(e)
        self.store(e, diarize, speakers, learn)
        out["render"] = stages.pending(e, self.texts(diarize), "slug").count()
        self.render(e, gap, diarize, speakers, strip_fillers)
        return out

    def forget(self, episodes: DataFrame) -> None:
        """Cached results of episodes do not count any more; audio stays.  Only their names are written."""
        stages.append(episodes.select("slug", F.lit(time.time()).alias("forgotten_at")), self.path("forgotten"))

    def compact(self) -> None:
        """Takes rows out that do not count, and the list of forgotten episodes; for times when no other driver runs."""
        for table, schema in CACHED.items():
            stages.replace(self.read(table, schema), self.path(table))
        stages.replace(self.spark.createDataFrame([], FORGOTTEN), self.path("forgotten"))

    def savings(self, table: str) -> DataFrame:
        """(slug, chars_before, chars_after, pct_removed) of a cleaner's table."""
        t = self.texts().select("slug", F.col("text").alias("_before")).join(self.read(table, CLEAN), "slug")
        return t.select("slug", *stages.savings(F.col("_before"), F.col("text")))

    def denoise(self, episodes: DataFrame, number: int | None = None) -> DataFrame:
        def work(todo: DataFrame) -> DataFrame:
            t = self.texts().join(todo.select("slug"), "slug", "left_semi")
            return D.strip_fillers_rendered(D.denoise(t, "slug", self.show.names), "slug", self.show.names).select("slug", "text")

        e = stages.select_episode(episodes, number).join(self.texts(), "slug", "left_semi")
        return self._stage(e, "denoised", CLEAN, work)

    def denoise2(self, episodes: DataFrame, number: int | None = None, threshold: float = R.SENTENCE_SIMILARITY) -> DataFrame:
        def work(todo: DataFrame) -> DataFrame:
            t = self.texts().join(todo.select("slug"), "slug", "left_semi")
            return D.denoise2(t, "slug", self.show.names, self.tools.corrector, self.tools.embedder, self.tools.parser, threshold).select("slug", "text")

        e = stages.select_episode(episodes, number).join(self.texts(), "slug", "left_semi")
        return self._stage(e, "denoised2", CLEAN, work)

    def _notes(self, table: str, source: DataFrame, column: str, prompt: str, model: str, episodes: DataFrame) -> DataFrame:
        def work(todo: DataFrame) -> DataFrame:
            t = source.join(todo.select("slug"), "slug", "left_semi").select("slug", F.col(column).alias("_in"))
            return D.complete(t, "_in", prompt, self.tools.complete).select("slug", F.lit(model).alias("model"), "notes")

        e = episodes.join(source, "slug", "left_semi")
        return self._stage(e, f"{table}/{file_slug(model)}", NOTES, work)

    def extract(self, episodes: DataFrame, number: int | None = None, model: str = "small") -> DataFrame:
        return self._notes("extracted", self.read("denoised2", CLEAN), "text", self.show.extract_prompt, model, stages.select_episode(episodes, number))

    def distill(self, episodes: DataFrame, number: int | None = None, extractor: str = "small", model: str = "large") -> DataFrame:
        notes = self.read(f"extracted/{file_slug(extractor)}", NOTES)
        return self._notes(f"distilled/{file_slug(extractor)}", notes, "notes", self.show.distill_prompt, model, stages.select_episode(episodes, number))


def recognise_file(spark: SparkSession, tools: Tools, audio: str, output: str, diarize: bool = False) -> int:
    """Recognises one audio file without a show and writes the transcript (text, language, segments) as JSON; how many segments it has."""
    rows = spark.read.format("binaryFile").load(audio).select(F.lit("file").alias("slug"), F.col("content").alias("audio"))
    raw = M.map_model(rows, "audio", "_r", tools.asr, f"struct<text:string,language:string,segments:array<{S.RAW_SEGMENT}>>").select("slug", "audio", "_r.*").persist()
    s = raw.select("slug", F.posexplode("segments").alias("seg_idx", "s")).select("slug", "seg_idx", "s.*")
    if diarize:
        t = M.map_model(raw.select("slug", "audio"), "audio", "turns", tools.diarizer, f"array<{S.TURN}>")
        t = t.select("slug", F.posexplode("turns").alias("turn_idx", "t")).select("slug", "turn_idx", "t.*")
        s = overlap_join(s, t, key="slug", width=BUCKET_S)
    fields = ["start", "end", "text", *(["speaker"] if diarize else [])]
    one = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.struct(*fields).alias("s")))), lambda x: x["s"])
    full = raw.select("slug", "text", "language").join(s.groupBy("slug").agg(one.alias("segments")), "slug", "left")
    text, n = full.select(F.to_json(F.struct("text", "language", "segments"), {"ignoreNullFields": "false", "pretty": "true"}), F.coalesce(F.size("segments"), F.lit(0))).first()
    raw.unpersist()
    stages.write_text(spark, output, text)
    return n


def file_slug(name: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", "-", name.lower()).rstrip("-")
