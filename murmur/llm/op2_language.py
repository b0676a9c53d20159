"""Language ID by cross-parsing: the language that needs fewest phrases wins.

For each language a suffix automaton is built over labelled text.  A text is parsed greedily
against it: the longest substring of the labelled text that matches from here is one phrase, then the next
begins (a character the automaton does not know is a phrase of its own).  Phrases per character,
normalised by the logarithm of the length of the labelled text, estimate the cross entropy.

Fitting uses a bounded sample: for each of the ``MAX_LANGUAGES`` languages with most labelled rows the ``SAMPLE_DOCS`` different
labelled texts with the smallest hash, of each the first ``SAMPLE_CHARS`` characters after normalisation.  All of every text is
parsed at prediction, whatever its length.

Automata are tables in which the transitions of all states are interleaved: state s has its transition by
character c in cell ``s + c``, and a cell names the state that owns it.  Their size follows the transitions, not states times alphabet,
so an alphabet of thousands of characters costs no more than one of thirty.  One numpy gather advances many texts by a character.

Texts are cut into stretches of ``STRETCH`` characters that are parsed side by side, each as if a phrase began there, and then sewn
together: the phrase that is open at the end of a stretch is followed into the next one until it starts a phrase where that
stretch starts one too.  From there on both parses agree, so the number of phrases is that of one parse of the whole text.  A text in
which a stretch never agrees is parsed in one piece.

Normalisation: lower case; every run of characters that are no letters becomes one space.

Defined cases: a null text or one without letters is ``und`` with score 0; with no labelled text at all every
text is ``und``; ties go to the smaller language name; rows that repeat are judged each; a null doc_id
is not held out and is predicted like any other; very long texts are parsed whole; other columns are ignored (``identify`` keeps them, and
takes the names of its own from the caller); an empty table gives no rows.
``score`` is the margin: 1 minus the winner's phrases over the mean of the others' (1 for one language).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from murmur.llm.common import Scratch, table, text_batches
from murmur.llm.words import chunks, released

MAX_LANGUAGES, SAMPLE_DOCS, SAMPLE_CHARS = 64, 48, 600
STRETCH = 1024
UNKNOWN = "und"
#: Stretches that are parsed side by side.
WIDTH = 4096


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- characters

_letters: np.ndarray | None = None
_lower: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Is a code point a letter, and its lower case (where that is one code point)."""
    global _letters, _lower
    if _letters is None:
        import sys
        import unicodedata

        n = sys.maxunicode + 1
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(n)), dtype=bool, count=n)
        _lower = np.arange(n, dtype=np.uint32)
        for c in np.flatnonzero(_letters):
            low = chr(c).lower()
            if len(low) == 1:
                _lower[c] = ord(low)
    return _letters, _lower


def normalise(cp: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with 32 for a gap, offsets of the texts, has a letter); docs: offsets in cp."""
    letters, lower = _tables()
    is_letter = letters[cp]
    keep = np.ones(len(cp), dtype=bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    inner = docs[(docs > 0) & (docs < len(cp))]
    keep[inner] = True
    upto = np.zeros(len(cp) + 1, dtype=np.int64)
    np.cumsum(keep, out=upto[1:])
    some = np.zeros(len(cp) + 1, dtype=np.int64)
    np.cumsum(is_letter, out=some[1:])
    return np.where(is_letter, lower[cp], np.uint32(32))[keep], upto[docs], some[docs[1:]] > some[docs[:-1]]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32), lead[offsets]


# ---------------------------------------------------------------- automata


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence (Blumer et al.); state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def interleave(steps: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, bases): cell ``bases[s] + c`` holds ``bases[s] << 32 | bases[target]`` for the transition of s by c; others hold -1.

    States with many transitions are placed first, each at the first base where all of its cells are free; no two share a base.
    """
    bases = np.zeros(len(steps), dtype=np.int64)
    used, taken = bytearray(2 * width), set()
    tried: dict[int, int] = {}  # by first character: cells before were tried
    for s in sorted(range(len(steps)), key=lambda s: -len(steps[s])):
        codes = sorted(steps[s])
        first = codes[0] if codes else 0
        at = tried.get(first, first)
        while True:
            at = used.find(0, at) if codes else at
            if at < 0 or at + width >= len(used):
                at = at if at >= 0 else len(used)
                used.extend(bytes(len(used)))
            base = at - first
            if base not in taken and not any(used[base + c] for c in codes):
                break
            at += 1
        tried[first] = at + 1
        taken.add(base)
        bases[s] = base
        for c in codes:
            used[base + c] = 1
    cells = np.full(int(bases.max()) + width + 1, -1, dtype=np.int64)
    for s, step in enumerate(steps):
        for c, to in step.items():
            cells[bases[s] + c] = bases[s] << 32 | bases[to]
    return cells, bases


class Model:
    """Languages, the shared alphabet and one automaton for each; built from labelled samples."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        joined = {lang: " ".join(sorted(t for name, t in samples if name == lang)) for lang in self.languages}
        alphabet = sorted({c for t in joined.values() for c in t})
        self.width = len(alphabet) + 1
        self.lookup = np.zeros(0x110000, dtype=np.int32)  # 0: a character that no sample has
        self.lookup[[ord(c) for c in alphabet]] = np.arange(1, self.width)
        self.automata = []
        for lang in self.languages:
            steps = suffix_automaton(self.lookup[[ord(c) for c in joined[lang]]].tolist())
            # One more state stands before a phrase and has no transitions.  A step that is missing begins a phrase: it goes where the
            # character leads from the start (an unknown one: back before a phrase).
            cells, bases = interleave([*steps, {}], self.width)
            first = np.full(self.width, bases[-1])
            first[list(steps[0])] = bases[list(steps[0].values())]
            self.automata.append((cells, first, int(bases[-1])))
        self.scale = np.asarray([np.log(len(joined[lang]) + 1.0) for lang in self.languages])

    def _walk(self, lang: int, codes: np.ndarray, first: np.ndarray, n: np.ndarray, state: np.ndarray):
        """Parses stretches side by side, longest first; after each step (lanes still running, which of them began a phrase, their states)."""
        cells, begin, _ = self.automata[lang]
        live = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")  # stretches longer than each step
        for step, k in enumerate(live):
            c = codes[first[:k] + step]
            cell = cells[state[:k] + c]
            new = cell >> 32 != state[:k]
            state[:k] = np.where(new, begin[c], cell & 0xFFFFFFFF)
            yield step, k, new

    def phrases(self, cp: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language."""
        codes = self.lookup[cp]
        sizes = np.diff(docs)
        per = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = docs[:-1][owner] + nth * STRETCH
        size = np.minimum(STRETCH, docs[1:][owner] - start)
        counts = np.zeros((len(sizes), len(self.languages)), dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        for lang, (_, _, before) in enumerate(self.automata):
            begins = np.zeros(len(codes), dtype=bool)
            last = np.zeros(len(owner), dtype=np.int64)
            for lo in range(0, len(order), WIDTH):
                part = order[lo : lo + WIDTH]
                first, state = start[part], np.full(len(part), before, dtype=np.int64)
                for step, k, new in self._walk(lang, codes, first, size[part], state):
                    begins[first[:k] + step] = new
                last[part] = state
            upto = np.zeros(len(codes) + 1, dtype=np.int64)
            np.cumsum(begins, out=upto[1:])
            counts[:, lang] = upto[docs[1:]] - upto[docs[:-1]]
            for doc in self._sew(lang, codes, begins, upto, owner, start, size, last, counts[:, lang]):
                counts[doc, lang] = self._plain(lang, codes[docs[doc] : docs[doc + 1]])
        return counts

    def _sew(self, lang, codes, begins, upto, owner, start, size, last, counts) -> np.ndarray:
        """Corrects counts for the phrases that are open at the ends of stretches; the texts in which a stretch does not agree."""
        to = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # stretches that have one before
        to = to[np.argsort(-size[to], kind="stable")]
        failed = []
        for lo in range(0, len(to), WIDTH):
            part = to[lo : lo + WIDTH]
            first, n, state, doc = start[part], size[part], last[part - 1], owner[part]
            cells, begin, _ = self.automata[lang]
            live, step = np.arange(len(part)), 0
            while len(live):
                c = codes[first[live] + step]
                cell = cells[state[live] + c]
                new = cell >> 32 != state[live]
                state[live] = np.where(new, begin[c], cell & 0xFFFFFFFF)
                met = new & begins[first[live] + step]
                np.add.at(counts, doc[live[new & ~met]], 1)
                done = live[met]
                np.subtract.at(counts, doc[done], upto[first[done] + step] - upto[first[done]])
                live, step = live[~met], step + 1
                over = n[live] <= step
                if over.any():
                    # The last stretch of a text just ends; any other would have to go on into the one after.
                    ends = live[over]
                    np.subtract.at(counts, doc[ends], upto[first[ends] + n[ends]] - upto[first[ends]])
                    more = part[ends] + 1
                    failed.append(doc[ends][(more < len(owner)) & (owner[np.minimum(more, len(owner) - 1)] == doc[ends])])
                    live = live[~over]
        return np.unique(np.concatenate(failed)) if failed else np.zeros(0, dtype=np.int64)

    def _plain(self, lang: int, codes: np.ndarray) -> int:
        cells, begin, state = self.automata[lang]
        n = 0
        for c in codes.tolist():
            cell = int(cells[state + c])
            if cell >> 32 == state:
                state = cell & 0xFFFFFFFF
            else:
                state = int(begin[c])
                n += 1
        return n


# ---------------------------------------------------------------- operator


def samples(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample of labelled rows: at most MAX_LANGUAGES x SAMPLE_DOCS texts of SAMPLE_CHARS characters.

    Copies of a text count once.  Ranks are those of hashes; only the rows that are picked bring their texts.
    """
    scratch = Scratch(docs.sparkSession, "samples")
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("h"), "text")
    texts = scratch.write(rows.groupBy("lang", "h").agg(F.count("*").alias("rows")), "texts")
    most = texts.groupBy("lang").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES).select("lang")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = texts.join(F.broadcast(most), "lang").select("lang", "h").withColumn("n", first).where(F.col("n") <= SAMPLE_DOCS).drop("n")
    # At most MAX_LANGUAGES x SAMPLE_DOCS pairs are broadcast.
    found = rows.join(F.broadcast(picked), ["lang", "h"]).mapInArrow(released(_beginnings), "lang string, h long, text string").groupBy("lang", "h").agg(F.min("text").alias("text"))
    out = [(r["lang"], r["text"]) for r in found.select("lang", "text").collect()]
    scratch.drop(texts)
    return out


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts normalised and cut."""
    for batch in batches:
        text = []
        for _, data, offsets in chunks(pa.array(range(batch.num_rows)), batch.column(2)):
            cp, docs, _ = normalise(*code_points(data, offsets))
            text += [cp[a:b].tobytes().decode("utf-32-le").strip()[:SAMPLE_CHARS] for a, b in zip(docs[:-1], docs[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["lang", "h", "text"])


def shared(spark: SparkSession, texts: list[tuple[str, str]]) -> Broadcast:
    """The model and the tables of characters, built once on the driver: their size follows from the bounded sample, not from the corpus."""
    return spark.sparkContext.broadcast((Model(texts), *_tables()))


def _predict(held: Broadcast, keep_text: bool, added: tuple[str, str] = ("_lang_pred", "_score")):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _letters, _lower
        m, _letters, _lower = held.value
        names = np.asarray([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            rest = batch if keep_text else batch.drop_columns(["text"])
            pred, score = [], []
            for _, data, offsets in chunks(pa.array(range(batch.num_rows)), text):
                cp, docs, some = normalise(*code_points(data, offsets))
                if not m.languages:
                    pred.append(np.zeros(len(some), dtype=int))
                    score.append(np.zeros(len(some)))
                    continue
                cost = m.phrases(cp, docs) * m.scale
                best = cost.argmin(1)
                low = cost.min(1)
                others = (cost.sum(1) - low) / max(1, len(m.languages) - 1)
                margin = np.where(others > 0, 1 - low / np.maximum(others, 1e-9), 0) if len(m.languages) > 1 else np.ones(len(low))
                pred.append(np.where(some, best, len(m.languages)))
                score.append(np.where(some, np.clip(margin, 0, 1), 0.0))
            which = np.concatenate(pred) if pred else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(names[which], pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())],
                names=[*rest.schema.names, *added],
            )

    return run


def identify(docs: DataFrame, texts: list[tuple[str, str]] | None = None, names: tuple[str, str] = ("_lang_pred", "_score")) -> DataFrame:
    """docs with two more columns of the names given: the predicted language and the score."""
    text_batches(docs.sparkSession)
    texts = samples(docs) if texts is None else texts
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.mapInArrow(released(_predict(shared(docs.sparkSession, texts), True, names)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents")
    texts = samples(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(released(_predict(shared(spark, texts), False)), "doc_id long, held_out boolean, lang_pred string, score double")
