"""Number words, Column to Column, inside whole-stage code generation.

Runs of number words are found by one pattern and decided on arrays: values come from a table, places of the scales decide where a run is
split into sections, and a section's value follows from its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions import rules as R
from murmur.functions.text import let

_DIGITS = {w: str(i) for i, w in enumerate(R.DIGIT_WORDS)}
_VALUES = (
    {w: i for i, w in enumerate(R.DIGIT_WORDS)}
    | {w: 10 + i for i, w in enumerate(R.TEEN_WORDS)}
    | {w: 20 + 10 * i for i, w in enumerate(R.TENS_WORDS)}
    | R.MULTIPLIERS
)
_TAIL = ".,!?;:"
_digit, _any = "|".join(R.DIGIT_WORDS), "|".join(sorted(_VALUES, key=len, reverse=True))
_DIGIT_RUN = R.java(rf"\b(?:{_digit})(?:\s++(?:{_digit})\b)++")
_said = rf"(?:{_any})[{_TAIL}]*+(?![^ ])"
#: Number words with a space or an end on both sides, each with the punctuation that follows it.
_SPOKEN = rf"(?i)(?<![^ ]){_said}(?: {_said})*+"
_GAP = r"(?U)[\s\x1c-\x1f]++"
#: A gap that is not one space.
_ODD_GAP = r"(?U)  |[\s\x1c-\x1f&&[^ ]]"


def _table(of: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def _runs_replaced(c: Column, pattern: str, run) -> Column:
    """Each match of the pattern replaced by run(match)."""

    def replaced(x: Column) -> Column:
        parts, runs = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(parts, runs, lambda p, r: F.concat(p, F.when(r.isNull(), "").otherwise(run(r)))), "")

    return let(c, lambda x: F.when(x.rlike(pattern), replaced(x)).otherwise(x))


def collapse_spoken_digits(c: Column) -> Column:
    """Two or more digit words in a row become digits."""
    table = _table(_DIGITS)
    return _runs_replaced(c, _DIGIT_RUN, lambda r: F.array_join(F.transform(F.split(r, R.java(r"\s++")), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), ""))


def _section(v: Column) -> Column:
    """Value of a section, by its length: two are multiplied if one is a hundred; three and four begin with a product; of more the first counts."""
    n, at = F.size(v), lambda i: F.get(v, F.lit(i))
    two = F.when(F.array_contains(v, F.lit(100)), at(0) * at(1)).otherwise(at(0) + at(1))
    return F.when(n == 2, two).when(n == 3, at(0) * at(1) + at(2)).when(n == 4, at(0) * at(1) + at(2) + at(3)).otherwise(at(0))


def _number(words: Column, values: Column) -> Column:
    """Words of a run with the longest end of it that is a number as digits; what comes before it stays.

    A scale may come once and needs a section before it, millions before thousands; a multiplier alone is no number.
    """
    n = F.size(values)
    places = lambda x: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, i) == F.lit(x))
    nth = lambda a, k: F.coalesce(F.try_element_at(a, F.lit(k)), F.lit(-1))
    last_word = F.element_at(words, -1)
    bare = F.rtrim(last_word, F.lit(_TAIL))
    tail = F.substring(last_word, F.length(bare) + 1, F.length(last_word))

    def with_places(p: Column) -> Column:
        million, thousand = p["m"], p["t"]

        def is_number(k: Column) -> Column:
            m, t = million >= k, thousand >= k
            once = (k > p["m2"]) & (k > p["t2"]) & ~(m & t & (thousand < million))
            full = (~m | (million > k)) & (~t | (thousand > F.when(m, million + 1).otherwise(k)))
            return once & full & ~((k == n - 1) & F.element_at(values, -1).isin(*R.MULTIPLIERS.values()))

        def spoken(k: Column) -> Column:
            m, t = million >= k, thousand >= k
            after = F.when(t, thousand + 1).when(m, million + 1).otherwise(k)
            zero = F.lit(0).cast("long")
            millions = F.when(m, _section(F.slice(values, k + 1, F.greatest(million - k, F.lit(0)))) * 1_000_000).otherwise(zero)
            begin = F.when(m, million + 1).otherwise(k)
            thousands = F.when(t, _section(F.slice(values, begin + 1, F.greatest(thousand - begin, F.lit(0)))) * 1000).otherwise(zero)
            rest = F.when(after < n, _section(F.slice(values, after + 1, n))).otherwise(zero)
            digits = F.concat((millions + thousands + rest).cast("string"), tail)
            return F.array_join(F.concat(F.slice(words, 1, k), F.array(digits)), " ")

        first = F.try_element_at(F.filter(F.sequence(F.lit(0), n - 1), is_number), F.lit(1))
        return let(first, lambda k: F.when(k.isNull(), F.array_join(words, " ")).otherwise(spoken(k)))

    m, t = places(1_000_000), places(1000)
    return let(F.struct(nth(m, -1).alias("m"), nth(m, -2).alias("m2"), nth(t, -1).alias("t"), nth(t, -2).alias("t2")), with_places)


def normalize_numbers(c: Column) -> Column:
    """Runs of number words become numbers; white space becomes single spaces."""
    table = _table({w: v for w, v in _VALUES.items()})

    def run(r: Column) -> Column:
        words = F.split(r, " ")
        value = lambda w: F.element_at(table, F.lower(F.rtrim(w, F.lit(_TAIL)))).cast("long")
        both = F.struct(words.alias("w"), F.transform(words, value).alias("v"))
        return let(both, lambda x: _number(x["w"], x["v"]))

    gaps = lambda x: F.when(x.rlike(_ODD_GAP), F.regexp_replace(x, _GAP, " ")).otherwise(x)
    single = F.trim(let(c, gaps))
    return _runs_replaced(single, _SPOKEN, run)
