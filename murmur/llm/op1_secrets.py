"""Secret scans behind a trigram inverted index.

Native: DataFrame functions only.

* From each rule's regular expression ``trigram_query`` derives a Boolean trigram query: an OR of ANDs of three-letter strings
  (lower case) of which every match must hold one conjunction.  A rule without mandatory trigrams
  has none and scans every text.
* The index lists, for each trigram of any query, the texts that hold it (postings).  Intersecting the
  postings of a conjunction and uniting the conjunctions gives a rule's candidates.
* Candidates are verified with the regular expression itself.  The pieces between matches
  (``split``) and the matches (``regexp_extract_all``) give the places, in code points; sums over them are taken in a logarithmic number
  of rounds, so a text with very many secrets costs little more for each than one with few.

Base kinds are assign, access and hex; the others are added by this operator and never
replace a base span.

Defined cases: a null text is empty; empty texts have no spans and the digest of the empty string;
rows that repeat are scanned each and come back each; a null doc_id stays null; very long texts are scanned whole; spans of one start
come in the order of the rules; other columns are ignored (``redact`` keeps them, whatever their names); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import Scratch, divided, fresh, keyed, table

# ---------------------------------------------------------------- trigram queries

#: A class of more characters than CLASS, or more strings than STRINGS together, end what is known of a match; more
#: conjunctions than STRINGS leave the part of an AND out that has more.  All of this only makes a query weaker.
CLASS, STRINGS = 8, 64
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


def _least(query: Query) -> Query:
    """Conjunctions that ask for more than another one are left out."""
    return frozenset(c for c in query if not any(d < c for d in query))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > STRINGS:
        return min(a, b, key=len)
    return _least(frozenset(x | y for x in a for y in b))


def _of_strings(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in strings))


#: What a part of a pattern matches: a set of strings (one of them), a query (something that meets it), or None (anything).
Part = set[str] | Query | None


def _parts(pattern) -> list[Part]:
    out: list[Part] = []
    for op, arg in pattern:
        if op is C.LITERAL:
            out.append({chr(arg).lower()})
        elif op is C.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is C.RANGE and x[1] - x[0] < 2 * CLASS:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            out.append(chars if chars and len(chars) <= CLASS else None)
        elif op is C.SUBPATTERN:
            out += _parts(arg[3])
        elif op is C.BRANCH:
            ways = [_joined(_parts(x)) for x in arg[1]]
            if all(len(w) == 1 and isinstance(w[0], set) for w in ways):
                out.append(set().union(*[w[0] for w in ways]))
            else:
                out += [None, _least(frozenset().union(*[_query(w) for w in ways])), None]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, x = arg
            once = _joined(_parts(x))
            if (low, high) == (0, 1) and len(once) == 1 and isinstance(once[0], set):
                out.append(once[0] | {""})
            else:
                out += once * min(low, 3) + ([None] if high > min(low, 3) else [])
        elif op is not C.AT:
            out.append(None)
    return out


def _joined(parts: list[Part]) -> list[Part]:
    """Neighbouring sets of strings put together."""
    out: list[Part] = [{""}]
    for p in parts:
        if isinstance(p, set) and isinstance(out[-1], set) and len(out[-1]) * len(p) <= STRINGS:
            out[-1] = {a + b for a in out[-1] for b in p}
        else:
            out.append(p)
    return out


def _query(parts: list[Part]) -> Query:
    query = ALWAYS
    for p in parts:
        if p is not None:
            query = _both(query, _of_strings(p) if isinstance(p, set) else p)
    return query


def trigram_query(pattern: str) -> tuple[tuple[str, ...], ...] | None:
    """The OR of ANDs of lower-case trigrams that every match of the pattern meets; None if there is none to ask for."""
    query = _query(_joined(_parts(_parser.parse(pattern))))
    return None if frozenset() in query else tuple(sorted(tuple(sorted(c)) for c in query))


# ---------------------------------------------------------------- rules


def _either(word: str) -> str:
    """The word in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length must reach ``least``.
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def query(self) -> tuple[tuple[str, ...], ...] | None:
        return trigram_query(self.pattern)


_KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
RULES = (
    Rule("assign", "(" + "|".join(_either(k) for k in _KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, base=True),
    # A run shorter than the limit holds no longer one, so the limit can stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)


def trigrams(rules=RULES) -> list[str]:
    return sorted({t for r in rules for conj in r.query or () for t in conj})


# ---------------------------------------------------------------- index


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: (gram, did, th), by the keys of rows."""
    low = keyed(docs.select("doc_id", "text")).select("did", "th", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams(rules)]))
    return low.select("did", "th", F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(did, th, rules): the rules whose trigram query the text meets."""
    grams = index.groupBy("did", "th").agg(F.collect_set("gram").alias("grams"))
    meets = []
    for r in rules:
        if r.query is None:
            continue
        conjs = [F.size(F.array_intersect("grams", F.array(*map(F.lit, c)))) == len(c) for c in r.query]
        test = conjs[0]
        for c in conjs[1:]:
            test = test | c
        meets.append(F.when(test, F.lit(r.kind)))
    return grams.select("did", "th", F.array_compact(F.array(*meets)).alias("rules")).where(F.size("rules") > 0)


# ---------------------------------------------------------------- spans


_SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each place the values up to it combined: rounds of doubling reach, each one pass."""

    def rounds(v: Column) -> Column:
        n = F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int")
        steps = F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda r: F.pow(F.lit(2.0), r).cast("int"))
        return F.aggregate(steps, v, lambda a, by: F.transform(a, lambda x, i: F.coalesce(combine(x, F.get(a, i - by)), x)))

    return let(values, rounds)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """All spans of one rule in a text that is known to match."""
    gaps = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else found
    steps = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"), checked.alias("c")),
        lambda x: F.struct((F.length(x["g"]) + F.length(x["m"])).alias("both"), F.length(x["m"]).alias("m"), (F.length(x["c"]) >= rule.least).alias("ok")),
    )

    def place(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: x["both"]), lambda x, y: x + y)
        known = let(ends, lambda e: F.transform(s, lambda x, i: F.struct(x["ok"], F.get(e, i).alias("end"), x["m"])))
        return F.transform(
            F.filter(known, lambda x: x["ok"]),
            lambda x: F.struct((x["end"] - x["m"]).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")),
        )

    return let(steps, place)


def _with_spans(docs: DataFrame, rules, name: str) -> DataFrame:
    """docs with their spans (array of start, ord, kind, end, sorted); only candidates by a bit map of fixed size meet the index."""
    did, th, some = fresh(docs, "_did"), fresh(docs, "_th"), fresh(docs, "_rules")
    # Written, so that both sides of the join are plain exchanges: a row with very many copies can be split.
    found = Scratch(docs.sparkSession, "secrets").write(candidates(postings(docs, rules), rules).toDF(did, th, some), "candidates")
    clear, maybe = divided(keyed(docs, did, th), [did, th], found)
    rows = maybe.join(found, [did, th], "left").select(*docs.columns, some).unionByName(clear.select(*docs.columns, F.lit(None).cast("array<string>").alias(some)))
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast(_SPAN)
    parts = []
    for i, r in enumerate(rules):
        gate = F.lit(True) if r.query is None else F.array_contains(some, r.kind)
        parts.append(F.when(gate & text.rlike(r.pattern), _spans(text, r, i)).otherwise(none))
    return rows.withColumn(name, F.array_sort(F.flatten(F.array(*parts)))).drop(some)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, text and spans (array of start, ord, kind, end, sorted) of each row."""
    return _with_spans(docs.select("doc_id", "text"), rules, "spans")


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def report(scanned: DataFrame, rules=RULES) -> DataFrame:
    n_base = sum(r.base for r in rules)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *[count(r.kind) for r in rules if r.base],
        F.sha2(joined(F.filter("spans", lambda x: x["ord"] < n_base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


#: Characters of a page, so that a piece of a long text is found without counting from its beginning.
PAGE = 1000


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark in place of each span; overlapping ones become one."""

    def pieces(pages: Column, s: Column, upto: Column) -> Column:
        def chars(a: Column, b: Column) -> Column:
            lo, hi = F.floor(a / PAGE).cast("int"), F.floor(b / PAGE).cast("int")
            begin = F.substring(F.get(pages, lo), (a % PAGE + 1).cast("int"), F.least(b - a, F.lit(PAGE)))
            rest = F.concat(F.array_join(F.slice(pages, lo + 2, F.greatest(hi - lo - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(pages, hi), F.lit(1), b % PAGE), F.lit("")))
            return F.coalesce(F.when(lo == hi, begin).otherwise(F.concat(begin, rest)), F.lit(""))

        before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0))
        marked = F.transform(s, lambda x, i: F.when(x["start"] >= before(i), F.concat(chars(before(i), x["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(marked, ""), chars(F.get(upto, F.size(upto) - 1), F.length(text)))

    ends = running(F.transform(spans, lambda x: x["end"]), F.greatest)
    pages = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0))
    return let(pages, lambda p: let(spans, lambda s: let(ends, lambda e: pieces(p, s, e))))


def redact(docs: DataFrame, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret replaced by a mark; overlapping spans become one mark."""
    name = fresh(docs, "_spans")
    rows = _with_spans(docs, rules, name)
    some = F.size(name) > 0
    # Lengths are taken from the text as it will be, in a step of its own.
    rows = rows.withColumn("text", F.when(some, _cut(F.col("text"), F.col(name), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _oracle() -> str:
    lists = []
    for i, r in enumerate(RULES):
        pat = r.pattern.replace("'", "''")
        ok = f"length(regexp_extract_all(t, '{pat}', {r.group})[i]) >= {r.least}" if r.least else "true"
        lists.append(
            f"""case when regexp_matches(t, '{pat}') then list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pat}')) + 1), lambda i:
              {{'s': length(array_to_string(string_split_regex(t, '{pat}')[1:i], '')) + length(array_to_string(regexp_extract_all(t, '{pat}')[1:i-1], '')),
                'o': {i}, 'k': '{r.kind}',
                'e': length(array_to_string(string_split_regex(t, '{pat}')[1:i], '')) + length(array_to_string(regexp_extract_all(t, '{pat}')[1:i], '')),
                'ok': {ok}}}), lambda x: x.ok) else [] end"""
        )
    counts = ", ".join(f"len(list_filter(sp, lambda x: x.k = '{r.kind}')) as n_{r.kind}" for r in RULES if r.base)
    show = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    n_base = sum(r.base for r in RULES)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as (select doc_id, list_sort(list_concat({", ".join(lists)})) as sp from d)
select doc_id, {counts}, sha256({show.format(f"list_filter(sp, lambda x: x.o < {n_base})")}) as base_sha256, {show.format("sp")} as spans from s
"""


ORACLE = _oracle()
