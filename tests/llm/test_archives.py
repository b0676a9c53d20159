"""Source divergence, conversations and archives, against brute force and round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from murmur.llm import op11_divergence as O11
from murmur.llm import op12_conversations as O12
from murmur.llm import op13_warc as O13
from murmur.llm.common import Scratch

GAP = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        c, t = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{c}:{t}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(c, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying everything: least cost, then ASCII-least audit; rows: (fault, role, text)."""
    best = {(0, 0): (0, "", ())}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def offer(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def insert(table, i):
        for _ in range(3):
            for (j, q), (cost, audit, done) in list(table.items()):
                if j == i:
                    for role in ("user", "assistant"):
                        if (q, role[0]) in step:
                            offer(table, (i, step[q, role[0]]), (cost + 5, audit + "I", (*done, f"{role}:")))

    for i, (fault, role, text) in enumerate(rows):
        insert(best, i)
        for q in range(4):
            if (i, q) not in best:
                continue
            cost, audit, done = best[i, q]
            offer(best, (i + 1, q), (cost + 2, audit + "D", done))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (q, role[:1]) in step:
                    offer(best, (i + 1, step[q, role[:1]]), (cost + more, audit + "K", (*done, f"{role}:{text}")))
                for now in ("user", "assistant"):
                    if (q, now[0]) in step:
                        offer(best, (i + 1, step[q, now[0]]), (cost + more + 1, audit + "R", (*done, f"{now}:{text}")))
    insert(best, len(rows))
    return min((best[len(rows), q] for q in (0, 3) if (len(rows), q) in best), key=lambda x: x[:2])


def plain_repair(data):
    out = []
    damaged = plain_damage(data)
    for conv in dict.fromkeys(r[0] for r in data):
        name = " " if conv is None else str(conv)
        rows = sorted((r for r in damaged if r[0] == name), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in rows:
            end = text.rstrip(GAP)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, done = cheapest([(f, r[2], r[3]) for f, r in zip(faults, rows)])
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=repr)


def _talk(seed):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "open", "", " \t", "é ", "Yes. ", "a.b", None, "x" * 20000 + "."]
    data = [(c, r.choice([t, t, t, r.randint(0, 9), None]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "Usher"]), r.choice(texts)) for c in [*range(60), None] for t in range(r.randint(1, 8))]
    data += [(77, t, "user" if t % 2 else "assistant", f"line {t % 40}{'.' if t % 3 else ''}") for t in range(300)]  # a hot one
    data += [(78, 5, "user", "same.")] * 40 + [(79, None, "user", "x.")] * 3 + [data[0]] * 2
    return data


@pytest.mark.parametrize("block", [3, 4096])
def test_conversations_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(O12, "BLOCK", block)
    data = _talk(block)
    df = spark.createDataFrame([(*d, "extra", 1) for d in data], "conv_id long, turn long, role string, text string, conv string, b int")
    got = sorted((tuple(r) for r in O12.repair(df).collect()), key=repr)
    assert got == plain_repair(data)


def test_walks_are_least_in_cost_and_order():
    """All conversations of up to four rows of all kinds."""
    kinds = [(f, r, f"{r}.") for f in (None, "truncated", "blank") for r in ("system", "user", "assistant", "tool")]
    for n in range(4):
        for rows in product(kinds, repeat=n):
            codes = bytes((" sua".find(r[0]) if r[0] in "sua" else 0) | O12.FORCED * (f == "blank") | O12.OPEN_ENDED * (f == "truncated") for f, r, _ in rows)
            costs = [O12.END]
            for c in reversed(codes):
                costs.insert(0, O12.back(c, costs[0]))
            _, audit, *_ = O12.walk(codes, costs, 0, True)
            assert (costs[0][0], audit) == cheapest(rows)[:2]


def test_conversations_of_an_empty_table(spark):
    assert O12.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---------------------------------------------------------------- archives


PAGES = [
    (1, "http://a/", "x" * 1000), (5, "http://b/", "x" * 1000), (3, None, "x" * 1000), (7, "http://c/\r\nX: 1", "x" * 999), (8, "u", "x" * 999), (9, "", None), (10, "u", ""), (None, "u", "x" * 1000),
    (11, "u", "\u00e9" * 500), (12, "u", "\u00e9" * 500), (13, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40), (14, "u", "y" * 300000), (15, "u", "y" * 300000), (15, "u", "y" * 300000),
    (None, "u", "z" * 2000), (None, "v", "z" * 2000),
]


def plain_archive(pages):
    out, top = [], {}
    for page, _, html in pages:
        html = html or ""
        top[html] = max(top.get(html, -1), -1 if page is None else page)
    for page, _, html in pages:
        data = (html or "").encode()
        best = None if top[html or ""] < 0 else top[html or ""]
        again = len(data) >= 1000 and page != best
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compress", [True, False])
def test_archive_round_trip(spark, tmp_path, monkeypatch, compress):
    monkeypatch.setattr(O13, "FILE_BYTES", 5000)
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, top string")
    path = f"file://{tmp_path}/a"
    O13.write(O13.page_records(df, Scratch(spark, "t")), path, compress)
    back = O13.read(spark, path)
    got = sorted(((None if ":null:" in r["record_id"] else int(r["record_id"].split(":")[2]), r["payload_bytes"], r["payload_digest"], r["record_type"], int(r["refers_to"].split(":")[2]) if r["refers_to"] else None) for r in back.collect()), key=repr)
    assert got == plain_archive(PAGES)
    texts = {r["payload_digest"]: bytes(r["payload"]) for r in back.where("record_type = 'response'").collect()}
    assert all(hashlib.sha1(t).hexdigest() == d for d, t in texts.items()) and len(texts) == len({p[2] or "" for p in PAGES})
    assert back.where("record_type = 'revisit' and payload is not null").count() == 0
    headers = O13.read(spark, path, payload=False)
    assert headers.where("payload is not null").count() == 0 and headers.count() == len(PAGES)
    assert headers.where("target_uri is null").count() == 1 and headers.where("target_uri like 'http://%'").count() == 3
    assert headers.where("record_type in ('revisit') and not target_uri is null").count() == back.where("record_type <> 'response'").where("target_uri is not null").count()


def test_predicates_reach_the_headers(spark, tmp_path, monkeypatch):
    """What a filter drops is never decoded: its payload may be damaged."""
    df = spark.createDataFrame([(i, f"http://h{i}/", chr(97 + i) * 3000) for i in range(4)], "page_id long, url string, html string")
    path = f"{tmp_path}/b"
    O13.write(O13.page_records(df, Scratch(spark, "t")).coalesce(1), path, compress=False)
    file = next(tmp_path.glob("b/*.warc"))
    file.write_bytes(file.read_bytes().replace(b"d" * 3000, b"\xff" * 3000))
    want = O13.read(spark, path).where("target_uri = 'http://h2/'")
    assert "PushedFilters" in want._jdf.queryExecution().toString() or want.count() == 1
    seen = []
    with open(file, "rb") as f:
        class Source:
            def read_at(self, n, at):
                seen.append((at, n))
                f.seek(at)
                return f.read(n)
        monkeypatch.setattr(O13, "_READ", 512)
        rows = list(O13.records(Source(), file.stat().st_size, lambda r: r["target_uri"] == "http://h2/"))
    assert len(rows) == 1 and sum(n for _, n in seen) < 8000
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true"


def test_foreign_and_broken_files(spark, tmp_path):
    import gzip

    rec = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(rec) + gzip.compress(rec))
    (tmp_path / "y.warc").write_bytes(rec)
    (tmp_path / "z.txt").write_bytes(b"no archive")
    df = O13.read(spark, str(tmp_path))
    assert [(r["record_type"], bytes(r["payload"])) for r in df.collect()] == [("warcinfo", b"a: b\n")] * 3
    assert df.where("record_type = 'response'").count() == 0
    (tmp_path / "y.warc").write_bytes(rec[:-8])
    with pytest.raises(Exception, match="y.warc"):
        O13.read(spark, str(tmp_path)).collect()


def test_archive_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    O13.write(O13.page_records(df, Scratch(spark, "t")), f"{tmp_path}/e")
    assert O13.read(spark, f"{tmp_path}/e").count() == 0


# ---------------------------------------------------------------- divergence


def plain_audit(docs):
    counts, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        ws = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(ws)
        df[lang].update(set(ws))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        total = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            best = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows, top in (("pair", pairs, None), ("term", best, 200)):
                rows = sorted(rows, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(rows)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk, rounds, held", [(7, 2, 10), (1 << 15, 8, 1 << 18)])
def test_divergence_equals_brute_force(spark, monkeypatch, chunk, rounds, held):
    monkeypatch.setattr(O11, "CHUNK", chunk)
    monkeypatch.setattr(O11, "ROUNDS", rounds)
    monkeypatch.setattr(O11, "HELD", held)
    r = random.Random(5)
    words = ["the", "The", "\u00e9t\u00e9", "\u00c9t\u00e9", "a1b", "x_y", "\u4e2d\u6587", "caf\u00e9\u00a0noir"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs = [(" ".join(r.choices(words, k=r.randint(0, 40))), lang, f"s{r.randint(0, n)}") for lang, n in (("en", 6), ("fr", 2), ("de", 0)) for _ in range(80)]
    docs += [(None, "en", "s0"), ("", "en", "only empty"), ("the the", None, None), ("the", "", ""), ("the", None, ""), ("the", "", "z"), ("one", "few", "a"), ("two", "few", "b"), ("w " * 50000, "fr", "s1")]
    docs += [docs[0]] * 3
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, chunk int, term string")
    assert sorted((tuple(x) for x in O11.audit(df).collect()), key=repr) == plain_audit(docs)


def test_every_two_slots_meet_once(spark):
    from pyspark.sql import functions as F

    for slots in range(1, 9):
        even = slots + slots % 2
        t = spark.range(slots).crossJoin(spark.range(even - 1).toDF("turn"))
        met = t.select("id", O11.partner(F.col("id"), F.col("turn"), F.lit(even)).alias("peer"), "turn").where(f"peer < {slots}").collect()
        assert sorted((x["id"], x["peer"]) for x in met) == [(a, b) for a in range(slots) for b in range(slots) if a != b]


def test_large_counts_stay_exact():
    c = np.asarray([0, 5, 1 << 40, (1 << 62) // 7], dtype="<i8")
    total = sum(c.tolist())
    assert O11.shares(zlib.compress(c.tobytes()), total, 4).tolist() == [1 + 10**9 * (x + 1) // (total + 4) for x in c.tolist()]


def test_divergence_of_an_empty_table(spark):
    assert O11.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
