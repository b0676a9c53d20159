"""Repair of the structure of conversations.

Edits (keep, rerole, delete, insert) bring a conversation to the grammar ``(s?(ua)+)?`` of role initials at the least cost: a
cost-to-go is computed backwards over rows and the grammar's four states, and a walk forwards takes the ASCII-least edit among
those that keep to it.  The repaired turns are then rebuilt and hashed.

No conversation is held by one task:

* rows without their texts (a digest stands for the text) are collapsed where they repeat, dealt by ranges of (conversation, turn, role,
  digest) and cut into blocks of at most ``BLOCK`` rows, one byte each;
* a block gives the 4 x 4 least costs from its first state to its last; these are combined backwards within each conversation, so that
  each block knows the cost-to-go at its end;
* each block walks forward from each of the four states, all blocks at once; the states in which blocks begin are combined forwards, and each
  block keeps the walk that holds;
* texts meet their edits in one sorted stream for each conversation, which goes through SHA-256 row by row: the digest of one text is
  sequential, so one task reads what is kept of a conversation, but it never holds more than a row.

Defined cases: null ids, turns, roles and texts are read as one space (a null conv_id is a conversation of its own, a null turn comes
first and is left out of gaps); rows of one turn are taken by role and then by the SHA-256 of the text, equal rows stand side by side; a
role without a first letter fits nowhere in the grammar; very long texts are hashed as they stream; gaps beyond 64 bits are null; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import Scratch, divided, maybe_broadcast, table, text_batches

BLOCK = 4096
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INF = 1 << 60
#: States: 0 begin, 1 after system, 2 after user, 3 after assistant.  What an inserted or reroled turn leads to:
NEXT = (2, 2, 3, 2)
#: What a kept turn leads to, by state and initial (1 s, 2 u, 3 a).
KEEP = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
INITIAL, FORCED, OPEN_ENDED = 3, 4, 8
#: Role that leads to a state.
ROLE = {2: "user", 3: "assistant"}

_KEY = ["conv", "some", "turn", "role", "dig"]
BLOCKS = (
    "conv string, b long, codes binary, keys array<struct<turn:long,role:string,dig:binary>>, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, turns long, lo long, hi long, costs array<long>"
)
WALKS = "conv string, b long, ends array<int>, audits array<string>, edits array<array<struct<turn:long,role:string,dig:binary,before:string,now:string>>>, tails array<string>"


# ---------------------------------------------------------------- the grammar


def relax(v: list[int]) -> list[int]:
    """Costs-to-go of the states when turns may be inserted first."""
    user, assistant = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return [min(v[0], INSERT + user), min(v[1], INSERT + user), user, assistant]


END = relax([0, INF, INF, 0])


def back(code: int, v: list[int]) -> list[int]:
    """Costs-to-go before a row from those after it."""
    if code & FORCED:
        return relax([DELETE + x for x in v])
    extra, out = TRUNCATED * bool(code & OPEN_ENDED), []
    for q in range(4):
        kept = KEEP.get((q, code & INITIAL))
        out.append(min(DELETE + v[q], REROLE + extra + v[NEXT[q]], INF if kept is None else extra + v[kept]))
    return relax(out)


def block_costs(codes: bytes) -> list[int]:
    """Least costs from each state before the codes to each state after them, row by row."""
    out = []
    for end in range(4):
        v = [0 if q == end else INF for q in range(4)]
        for c in reversed(codes):
            v = back(c, v)
        out.append(v)
    return [min(out[end][q], INF) for q in range(4) for end in range(4)]


def walk(codes: bytes, costs: list[list[int]], q: int, last: bool) -> tuple[int, str, list[tuple[int, str, int | None]], str]:
    """(state after, audit, [(row, inserted before, state it was reroled to or None)] of rows that stay, inserted at the end)."""
    audit, stay, before = [], [], ""
    for i, c in enumerate(codes):
        here, after = costs[i], costs[i + 1]
        while here[q] != DELETE + after[q] and here[q] == INSERT + here[NEXT[q]]:
            q = NEXT[q]
            audit.append("I")
            before += "-" + ROLE[q][0]
        if here[q] == DELETE + after[q]:
            audit.append("D")
            continue
        extra, kept = TRUNCATED * bool(c & OPEN_ENDED), KEEP.get((q, c & INITIAL))
        if kept is not None and here[q] == extra + after[kept]:
            audit.append("K")
            stay.append((i, before, None))
            q = kept
        else:
            q = NEXT[q]
            audit.append("R")
            stay.append((i, before, q))
        before = ""
    while last and END[q]:
        q = NEXT[q]
        audit.append("I")
        before += "-" + ROLE[q][0]
    return q, "".join(audit), stay, before


# ---------------------------------------------------------------- damage and rows


def damage(rows: DataFrame) -> DataFrame:
    """(conv, some, turn, role, text, copies): rows after damage by a hash of their conversation and turn; some tells a turn from none."""
    space = F.lit(" ")
    r = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), space).alias("conv"), F.col("turn").isNotNull().alias("some"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )
    h = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    r = r.withColumn("h", h).where("h <> 0")
    return r.select("conv", "some", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _trimmed() -> Column:
    return F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))


def plain_rows(damaged: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, blank, open_ended, copies, again) without texts; again: the role and text are in an earlier turn."""
    end = F.right("shown", F.lit(1))
    r = damaged.withColumn("shown", _trimmed()).select(
        "conv", "some", "turn", "role", F.unhex(F.sha2("text", 256)).alias("dig"), (F.col("shown") == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open_ended"), "copies"
    )
    g = scratch.write(r.groupBy(*_KEY, "blank", "open_ended").agg(F.sum("copies").alias("copies")), "rows")
    at = F.struct("some", "turn")
    many = g.groupBy("conv", "role", "dig").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    many = scratch.write(many, "repeated")
    alone, rest = divided(g, ["conv", "role", "dig"], many)
    met = rest.join(maybe_broadcast(many, many.count(), 128), ["conv", "role", "dig"], "left")
    met = met.withColumn("again", F.coalesce(F.col("first.some") != F.col("some"), F.lit(False)) | F.coalesce(F.col("first.turn") != F.col("turn"), F.lit(False)))
    return alone.withColumn("again", F.lit(False)).unionByName(met.drop("first"))


# ---------------------------------------------------------------- blocks


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key become blocks of one conversation."""
    out: list[dict] = []
    number, new = TaskContext.get().partitionId() << 33, None

    def fresh(conv: str) -> dict:
        return {"conv": conv, "codes": bytearray(), "keys": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": None, "last": None, "turns": 0, "lo": None, "hi": None}

    def close() -> None:
        nonlocal number
        if new and new["codes"]:
            new["codes"] = bytes(new["codes"])
            out.append(new | {"b": number, "costs": block_costs(new["codes"])})
            number += 1

    for batch in batches:
        for r in batch.to_pylist():
            if new is None or new["conv"] != r["conv"]:
                close()
                new = fresh(r["conv"])
            first = r["role"][:1]
            initial = " sua".find(first) if first in ("s", "u", "a") else 0
            left = r["copies"]
            while left:
                if len(new["codes"]) >= block:
                    close()
                    new = fresh(r["conv"])
                is_first = left == r["copies"]
                if new["last"] is None:
                    new["first"] = first
                elif new["last"] + first not in ("su", "ua", "au"):
                    new["illegal"] += 1
                new["last"] = first
                fault = "blank" if r["blank"] else "duplicate" if r["again"] or not is_first else "truncated" if r["open_ended"] else None
                if fault:
                    new[fault] += 1
                forced = fault in ("blank", "duplicate")
                new["codes"].append(initial | FORCED * forced | OPEN_ENDED * (fault == "truncated"))
                if not forced:
                    new["keys"].append({k: r[k] for k in ("turn", "role", "dig")})
                t = r["turn"]
                if t is not None and t != new["hi"]:
                    new["turns"] += 1
                    new["lo"] = t if new["lo"] is None else new["lo"]
                    new["hi"] = t
                left -= 1
            if len(out) >= 200:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _mapped(rows: DataFrame, f, ddl: str) -> DataFrame:
    """f turns a row (a dict) into rows; schemas are made on the driver."""
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [y for x in b.to_pylist() for y in f(x)]
            for i in range(0, len(out), 500):
                yield pa.RecordBatch.from_pylist(out[i : i + 500], schema)

    return rows.mapInArrow(run, ddl)


def blocks_of(plain: DataFrame) -> DataFrame:
    schema, block = _arrow(BLOCKS), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(batches, schema, block)

    # Ranges, not hashes: one conversation may hold a third of all rows.
    return plain.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, BLOCKS)


def _ends(x: dict) -> list[dict]:
    """Of a conversation's blocks in order: the figures of the whole, and each block's cost-to-go at its end."""
    parts, v, ends = x["parts"], END, []
    for p in reversed(parts):
        ends.append(v)
        v = [min(p["costs"][4 * q + e] + v[e] for e in range(4)) for q in range(4)]
    total = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    known = [p for p in parts if p["lo"] is not None]
    total["turns"] -= sum(a["hi"] == b["lo"] for a, b in zip(known, known[1:]))
    total["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
    gaps = known[-1]["hi"] - known[0]["lo"] + 1 - total.pop("turns") if known else 0
    whole = total | {"gaps": gaps if gaps < 1 << 63 else None, "cost": v[0]}
    return [{"conv": x["conv"], "b": p["b"], "after": e, "closing": p is parts[-1]} | (whole if p is parts[0] else {}) for p, e in zip(parts, reversed(ends))]


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
ENDS = "conv string, b long, after array<long>, closing boolean, " + ", ".join(f"{c} long" for c in FIGURES)


def _walks(x: dict) -> list[dict]:
    costs = [x["after"]]
    for c in reversed(x["codes"]):
        costs.append(back(c, costs[-1]))
    costs.reverse()
    open_rows = {i: k for k, i in enumerate(i for i, c in enumerate(x["codes"]) if not c & FORCED)}
    out = {"conv": x["conv"], "b": x["b"], "ends": [], "audits": [], "edits": [], "tails": []}
    for q in range(4):
        if costs[0][q] >= INF:
            end, audit, stay, tail = q, "", [], ""
        else:
            end, audit, stay, tail = walk(x["codes"], costs, q, x["closing"])
        out["ends"].append(end)
        out["audits"].append(audit)
        out["edits"].append([x["keys"][open_rows[i]] | {"before": before, "now": ROLE.get(to)} for i, before, to in stay])
        out["tails"].append(tail)
    return [out]


def _begins(x: dict) -> list[dict]:
    q, out = 0, []
    for p in x["parts"]:
        out.append({"conv": x["conv"], "b": p["b"], "q": q})
        q = p["ends"][q]
    return out


# ---------------------------------------------------------------- rebuilding


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and texts, sorted so that an edit comes just before its text, through SHA-256: one digest for each conversation."""
    conv, h, empty, edit, out = None, hashlib.sha256(), True, None, []

    def line(role: str, text: str) -> None:
        nonlocal empty
        h.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
        empty = False

    def inserted(before: str) -> None:
        for c in before.split("-")[1:]:
            line("user" if c == "u" else "assistant", "")

    for batch in batches:
        for r in batch.to_pylist():
            if r["conv"] != conv:
                if conv is not None:
                    out.append((conv, h.hexdigest()))
                conv, h, empty, edit = r["conv"], hashlib.sha256(), True, None
            if r["tail"] is not None:
                inserted(r["tail"])
            elif r["text"] is None:
                edit = r
            elif edit and all(edit[k] == r[k] for k in ("turn", "role", "dig")):
                inserted(edit["before"])
                line(edit["now"] or r["role"], r["text"])
                edit = None
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pydict({"conv": [a for a, _ in out], "sha": [b for _, b in out]})
            out.clear()
    if conv is not None:
        out.append((conv, h.hexdigest()))
    if out:
        yield pa.RecordBatch.from_pydict({"conv": [a for a, _ in out], "sha": [b for _, b in out]})


def repair(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of conversations after damage."""
    spark = conversations.sparkSession
    scratch = scratch or Scratch(spark, "conversations")
    text_batches(spark)
    damaged = damage(conversations)
    blocks = scratch.write(blocks_of(plain_rows(damaged, scratch)), "blocks")
    parts = lambda df, *cols: df.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("b", *cols))).alias("parts"))
    ends = parts(blocks, "costs", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "lo", "hi")
    ends = scratch.write(_mapped(ends, _ends, ENDS), "ends")
    walks = blocks.select("conv", "b", "codes", "keys").join(ends.select("conv", "b", "after", "closing"), ["conv", "b"])
    walks = scratch.write(_mapped(walks, _walks, WALKS), "walks")
    begins = _mapped(parts(walks, "ends"), _begins, "conv string, b long, q int")
    held = scratch.write(
        walks.join(begins, ["conv", "b"]).select("conv", "b", *[F.element_at(c, F.col("q") + 1).alias(n) for c, n in (("audits", "audit"), ("edits", "edit"), ("tails", "tail"))]), "held"
    )
    audits = held.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "audit"))), lambda x: x["audit"]), "").alias("audit"))

    null = lambda kind: F.lit(None).cast(kind)
    edits = held.select("conv", F.explode("edit").alias("e")).select("conv", F.lit(0).alias("z"), F.col("e.turn").isNotNull().alias("some"), "e.turn", "e.role", "e.dig", null("string").alias("text"), "e.before", "e.now", null("string").alias("tail"))
    tails = held.where("tail <> ''").select("conv", F.lit(1).alias("z"), F.lit(True).alias("some"), null("long").alias("turn"), null("string").alias("role"), null("binary").alias("dig"), null("string").alias("text"), null("string").alias("before"), null("string").alias("now"), "tail")
    texts = damaged.where(_trimmed() != "").select("conv", F.lit(0).alias("z"), "some", "turn", "role", F.unhex(F.sha2("text", 256)).alias("dig"), "text", null("string").alias("before"), null("string").alias("now"), null("string").alias("tail"))
    stream = edits.union(texts).union(tails).repartition("conv").sortWithinPartitions("conv", "z", "some", "turn", "role", "dig", F.col("text").isNotNull())
    hashes = stream.mapInArrow(_hashes, "conv string, sha string")

    every = conversations.groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).agg(F.first("conv_id").alias("conv_id"))
    out = every.join(ends.where("cost is not null").select("conv", *FIGURES), "conv", "left").join(audits, "conv", "left").join(hashes, "conv", "left")
    figures = [F.when(F.col("cost").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in FIGURES]
    return out.select("conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
