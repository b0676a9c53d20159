"""Text functions, Column to Column, inside whole-stage code generation.

Callbacks become one replacement for each alternative, loops to a fixed point a fold that ends its work when nothing changes.

Texts may be of any form: a word or a run of a million characters must neither recurse nor take quadratic time.  So a group is repeated only
possessively (Java's engine then loops, where it recurses for every other repeated group), a run of one class is taken possessively where what
follows is outside the class, and a pattern that begins with white space begins only where a run of it does.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions import rules as R
from murmur.functions.rules import Names, java


def _sub(c: Column, pattern: str, to: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(c, java(pattern, ignore_case), to)


def _subs(c: Column, table: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: _sub(x, *r), table, c)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def if_any(c: Column, hints: list[str], body) -> Column:
    """body(c) where c holds one of the lower-case ASCII strings in either case, else c.

    For rules of which every match holds a hint: without one the first of them changes nothing, so neither does the next, and looking for
    strings costs a fraction of looking for patterns.  Four characters outside ASCII are cases of ASCII letters to the patterns but not
    to ``lower``; texts with one of these take the rules.
    """

    return let(c, lambda x: F.when(_holds(x, hints), body(x)).otherwise(x))


def _holds(x: Column, hints: list[str]) -> Column:
    """Has x one of the strings in either case, or a character that is a case of an ASCII letter only to the patterns?"""
    held = lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in hints])
    if not any(ch.isalpha() for h in hints for ch in h):
        return held(x)
    return let(F.lower(x), held) | x.rlike("[\u0130\u0131\u017f\u212a]")


def trim(c: Column) -> Column:
    white = lambda x: x.rlike(java(r"\s"))
    return let(c, lambda x: F.when(white(F.substring(x, 1, 1)) | white(F.substring(x, -1, 1)), _sub(x, r"^\s++|(?<!\s)\s++$", "")).otherwise(x))


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(c, F.lit(java(r"\S+")))


# ---------------------------------------------------------------- names, stamps, paragraphs


def slugify(title: Column) -> Column:
    """Lower case, other runs to one dash, trailing dashes off (a leading one stays)."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "-+$", "")


def episode_slug(number: Column, title: Column) -> Column:
    return F.concat(F.format_string("%03d", number), F.lit("-"), slugify(title))


def stamp_seconds(para: Column) -> Column:
    """Seconds of a leading stamp, -1 without one."""
    a, b, c = (F.regexp_extract(para, R.STAMP_PARTS, i) for i in (1, 2, 3))
    n = lambda x: x.cast("long")
    return F.when(a == "", F.lit(-1).cast("long")).when(c != "", n(a) * 3600 + n(b) * 60 + n(c)).otherwise(n(a) * 60 + n(b))


def content(para: Column) -> Column:
    return _sub(para, rf"^{R.STAMP}\s*", "")


def paragraphs(text: Column, strip: bool = True) -> Column:
    """Array of paragraphs between blank lines."""
    parts = F.split(text, "\n\n", -1)
    return F.filter(F.transform(parts, trim), lambda p: p != "") if strip else parts


def format_seconds(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from one hour on."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("long"), (F.floor(s / 60) % 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def split_speakers(value: Column) -> Column:
    """Comma-separated names, trimmed; null for nothing."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.transform(F.split(value, ",", -1), trim))


# ---------------------------------------------------------------- normalisation


def normalize_fractions(c: Column) -> Column:
    return _subs(c, R.FRACTIONS)


def normalize_temperatures(c: Column) -> Column:
    return _sub(_subs(c, R.TEMPERATURES), *R.TEMPERATURE_BARE, ignore_case=False)


def normalize_percent(c: Column) -> Column:
    return _sub(c, *R.PERCENT)


def normalize_measures(c: Column) -> Column:
    """Fractions, temperatures, per cent and units, in this order."""
    return if_any(c, R.MEASURE_HINTS, lambda x: normalize_units(normalize_percent(normalize_temperatures(normalize_fractions(x)))))


def normalize_units(c: Column) -> Column:
    return _subs(c, [(rf"\b{word}s?\b", short) for word, short in R.UNITS.items()])


def join_letters(c: Column) -> Column:
    """Three or more single letters in a row lose the spaces between them."""
    run, mark = r"\b([a-zA-Z](?:\s++[a-zA-Z]\b){2,}+)", "\ue000"

    def joined(x: Column) -> Column:
        parts = F.split(_sub(x, run, f"{mark}$1{mark}"), mark, -1)
        return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(" "), F.lit(""))).otherwise(x)), "")

    return let(c, lambda x: F.when(x.rlike(java(run)) | F.contains(x, F.lit(mark)), joined(x)).otherwise(x))


def spoken_dots(c: Column) -> Column:
    return if_any(c, ["dot"], lambda x: _sub(x, r"(?<=\w)\s+dot\s+(?=\w)", "."))


def spoken_urls(c: Column) -> Column:
    return spoken_dots(join_letters(c))


def normalize_phrases(c: Column) -> Column:
    return if_any(c, R.PHRASE_HINTS, lambda x: _subs(x, R.PHRASES))


def normalize_punctuation(c: Column) -> Column:
    return if_any(c, ["..", "!!", "??"], lambda x: _sub(x, r"([.!?])\1+", "$1"))


def strip_disfluencies(c: Column) -> Column:
    return let(c, lambda x: F.when(x.rlike(java(R.DISFLUENCY_HINT)), _sub(x, R.DISFLUENCY, " ")).otherwise(x))


def _until_stable(c: Column, pattern: str, to: str) -> Column:
    """The replacement repeated until nothing changes.

    Each round that changes something takes a word away, so the words bound the rounds.  Those after the last change only pass the text on; they
    are taken in stretches, so that their number goes as the root of the words.
    """

    def rounds(x: Column) -> Column:
        stretch = F.sequence(F.lit(0), F.ceil(F.sqrt(word_count(x))).cast("int"))
        start = F.struct(x.alias("t"), F.lit(True).alias("more"))
        again = lambda s: let(_sub(s["t"], pattern, to), lambda y: F.struct(y.alias("t"), (y != s["t"]).alias("more")))
        while_more = lambda inner: lambda s, _: F.when(s["more"], inner(s)).otherwise(s)
        several = lambda s: F.aggregate(stretch, s, while_more(again))
        return F.aggregate(stretch, start, while_more(several), lambda s: s["t"])

    return let(c, lambda x: F.when(x.rlike(java(pattern)), rounds(x)).otherwise(x))


def dedup_stutter(c: Column) -> Column:
    """Runs of equal words, in either case, keep the first; to the fixpoint, as one collapse can make another.

    A round takes every second word of a run away, so a run needs as many rounds as its length has binary digits.
    """
    return _until_stable(c, R.WORD_STUTTER, "$1")


def letter_stutter(c: Column) -> Column:
    return _sub(c, *R.LETTER_STUTTER)


def phrase_stutter(c: Column) -> Column:
    """Repeated phrases of two to four words keep the first, however often they are said."""
    return _until_stable(c, *R.PHRASE_STUTTER)


def its_stutter(c: Column) -> Column:
    return if_any(c, ["it's"], lambda x: _subs(x, [R.ITS_STUTTER, R.ITS_IT]))


def strip_phone_numbers(c: Column) -> Column:
    """After spoken digits are collapsed: phone numbers go, with what announces them."""
    numbers = lambda x: _sub(_sub(x, R.PHONE_REPEAT, "", ignore_case=False), R.PHONE, "", ignore_case=False)
    c = let(c, lambda x: F.when(x.rlike(java(r"\d{3}", ignore_case=False)), numbers(x)).otherwise(x))
    c = if_any(c, [","], lambda x: _sub(x, r",\s*\.", "."))
    c = if_any(c, ["  "], lambda x: _sub(x, r" {2,}", " "))
    return trim(if_any(c, [" .", " ,"], lambda x: _sub(x, r" ([.,])", "$1")))


# ---------------------------------------------------------------- sentences


def sentences(c: Column) -> Column:
    return F.split(c, java(R.SENTENCE_BREAK, ignore_case=False), -1)


def sentences_v2(c: Column) -> Column:
    """Also before the lower-case starters."""
    starters = "|".join(R.LOWER_STARTERS)
    return F.split(c, java(rf'(?<=[.!?])\s+(?=[A-Z\d"]|(?:{starters})\b)', ignore_case=False), -1)


def tidy(c: Column) -> Column:
    single = if_any(c, ["  "], lambda x: _sub(x, r" {2,}", " "))
    return trim(if_any(single, [" .", " ,", " !", " ?"], lambda x: _sub(x, r" ([.,!?])", "$1")))


def recapitalize(cleaned: Column, original: Column) -> Column:
    """An upper-case first letter if the original had one and the cleaned text lost it."""
    lost = cleaned.rlike(r"^\p{Ll}") & original.rlike(r"^\p{Lu}")
    return F.when(lost, F.concat(F.upper(F.substring(cleaned, 1, 1)), F.substring(cleaned, 2, 1 << 30))).otherwise(cleaned)


def clean_sentence(text: Column) -> Column:
    c = if_any(text, R.OPENING_HINTS, lambda x: _subs(its_stutter(_subs(x, R.TAGS)), R.PARENTHETICALS))
    c = _sub(c, R.opening(), "")
    c = _sub(c, *R.NICE_OPENER)
    c = _subs(c, [(rf"^the\s+{n}\s+is\b,?\s*", f"{n.capitalize()} is ") for n in R.OPENING_NOUNS])
    c = if_any(c, R.MIDDLE_HINTS, lambda x: _sub(_sub(x, *R.BASICALLY_MID), *R.OR_SOMETHING))
    c = tidy(dedup_stutter(strip_disfluencies(c)))
    return let(c, lambda x: F.when(x.rlike(java(r"\w")), recapitalize(x, text)).otherwise(""))


def keep_sentence(s: Column, names: Names) -> Column:
    """What is left of a cleaned sentence: null for stock sentences, fragments and noise."""
    noise = R.noise(names)
    stock, fragment = java(R.stock_sentence(names)), java("^(?:" + "|".join(R.CONNECTORS) + ")[.!?]?$")

    def excise(x: Column) -> Column:
        cut = trim(_sub(_subs(x, [(R.CALL_IN, ""), (R.intro(names), "")]), r" {2,}", " "))
        return let(cut, lambda y: F.when(word_count(y) >= R.EXCISE_LEAST_WORDS, y))

    def keep(x: Column) -> Column:
        return F.when((x == "") | x.rlike(stock) | x.rlike(fragment), None).when(~x.rlike(java(noise)), x).when(word_count(x) > R.EXCISE_ABOVE_WORDS, excise(x))

    return let(s, keep)


def strip_filler_sentences(text: Column, names: Names) -> Column:
    """Sentences cleaned and filtered, joined by spaces."""
    return F.array_join(F.array_compact(F.transform(sentences(text), lambda s: keep_sentence(clean_sentence(s), names))), " ")


def after_numbers(c: Column) -> Column:
    """The steps that follow the conversion of number words."""
    return normalize_punctuation(normalize_phrases(spoken_urls(normalize_measures(c))))


# ---------------------------------------------------------------- paragraph gates


def is_ack(para: Column) -> Column:
    return para.rlike(java(rf"^{R.STAMP} (?:{'|'.join(a + r'\.?' for a in R.PARAGRAPH_ACKS)})$"))


def is_boilerplate(para: Column, names: Names) -> Column:
    return (F.length(para) < R.SHORT_PARAGRAPH) & (F.contains(para, F.lit(names.network_full)) | F.contains(para, F.lit(R.THANKS_LISTENING)))


def is_bumper(para: Column, names: Names) -> Column:
    return _matches(para, R.bumper(names), ["listening to", names.host])


def is_sponsor(para: Column) -> Column:
    return _matches(para, R.SPONSOR, ["brought to you by", "sponsored by"])


def _matches(c: Column, pattern: str, hints: list[str]) -> Column:
    """Does c hold a match, of which each holds a hint in either case? The pattern is tried as in ``if_any``; hints that are no plain ASCII words leave it to the pattern."""
    if not all(re.fullmatch("[A-Za-z0-9 ]+", h) for h in hints):
        return c.rlike(java(pattern))
    return let(c, lambda x: _holds(x, [h.lower() for h in hints]) & x.rlike(java(pattern)))


def is_preroll(para: Column, names: Names) -> Column:
    early = let(stamp_seconds(para), lambda t: (t >= 0) & (t < R.PREROLL_SECONDS))
    named = let(F.lower(content(para)), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in names.preroll]))
    return early & ~named


def passes_gates(para: Column, names: Names) -> Column:
    return ~(is_ack(para) | is_boilerplate(para, names) | is_bumper(para, names) | is_sponsor(para) | is_preroll(para, names))


# ---------------------------------------------------------------- second generation


def has_marker_word(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, sorted({*R.CONTRAST, *R.CAUSAL}))))


def alnum_words(c: Column) -> Column:
    """Words with an ASCII letter or digit; each is looked at once, from its beginning."""
    return F.regexp_count(c, F.lit(java(r"(?<!\S)[^\sa-zA-Z0-9]*+[a-zA-Z0-9]", ignore_case=False)))


def long_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(java(r"\w+")), F.lit(0)), lambda w: F.length(w) >= 5))


def no_content_dropped(original: Column, candidate: Column) -> Column:
    """Each longer word of the original is in the candidate, or one there shares its first four letters."""
    o, c = long_words(original), long_words(candidate)
    return F.forall(F.array_except(o, c), lambda w: F.exists(c, lambda x: F.startswith(x, F.substring(w, 1, 4))))


#: Around a token that its part of speech makes a filler.
_MARK, _END = "\ue000", "\ue001"


def _filler_pattern() -> str:
    """Filler phrases as whole words, longest first, and marked tokens, each with the white space after it.

    One pattern, so that what stands before and after a phrase is judged on the sentence as it was said.
    """
    before = "".join(rf"(?<!\b{w}\s)" for w in R.SEMANTIC_PRECEDES)
    follows = {"i mean": R.SEMANTIC_FOLLOWS, "i guess": R.SEMANTIC_FOLLOWS, "i think": [*R.SEMANTIC_FOLLOWS, *R.THINK_FOLLOWS]}
    phrases = []
    for p in sorted(R.LEXICAL_FILLERS, key=lambda p: -len(p.split())):
        words = r"\s+".join(f"{_MARK}?{w}{_END}?" for w in p.split())
        after = rf"(?!\s+(?:{'|'.join(follows[p])})\b)" if p in follows else ""
        phrases.append((before if p in ("you know", "you see") else "") + rf"(?<!\w){words}(?!\w){after}")
    return rf"(?:{'|'.join(phrases)}|{_MARK}[^{_END}]*{_END})\s*"


def _without_fillers(marked: Column, original: Column) -> Column:
    """The phrases and marked tokens go; then the stutters that this leaves."""
    hints = sorted({max(reversed(p.split()), key=len) for p in R.LEXICAL_FILLERS})
    c = trim(if_any(marked, [_MARK, *hints], lambda x: _sub(x, _filler_pattern(), "")))
    c = if_any(c, ["  "], lambda x: _sub(x, r" {2,}", " "))
    c = if_any(c, [f" {x}" for x in ".,!?;:"], lambda x: _sub(x, r" ([.,!?;:])", "$1"))
    c = let(c, lambda x: F.when(F.substring(x, 1, 1).rlike(java(r"[,;:\s]")), _sub(x, r"^[,;:\s]+", "")).otherwise(x))
    return let(dedup_stutter(its_stutter(c)), lambda x: recapitalize(x, original))


def strip_lexical_fillers(text: Column) -> Column:
    """Filler phrases but for their semantic uses."""
    return _without_fillers(text, text)


def strip_parsed_fillers(text: Column, tokens: Column) -> Column:
    """Filler phrases, and tokens that the parse shows to be fillers: "like" and openers as interjections, adverbs set apart.

    tokens: array of (text, ws, pos, dep) in the sentence's order, which together are the text.
    """

    openers = ["like", *R.INTERJECTIONS]

    def marked(t: Column) -> Column:
        low = F.lower(t["text"])
        opener = low.isin(*openers) & (t["pos"] == "INTJ")
        adverb = low.isin(*R.ADVERBS) & t["dep"].isin(*R.ADVERB_RELATIONS)
        word = F.when(opener | adverb, F.concat(F.lit(_MARK), t["text"], F.lit(_END))).otherwise(t["text"])
        return F.concat(word, F.coalesce(t["ws"], F.lit("")))

    joined = lambda f: F.array_join(F.transform(tokens, f), "")
    plain = joined(lambda t: F.concat(t["text"], F.coalesce(t["ws"], F.lit(""))))
    # Tokens are looked at one by one only where the sentence has such a word at all.
    return _without_fillers(if_any(plain, [*openers, *R.ADVERBS], lambda _: joined(marked)), text)


def has_discourse_marker(tokens: Column) -> Column:
    """A negation, or a contrasting or causal word."""
    return F.exists(tokens, lambda t: F.coalesce(t["dep"] == "neg", F.lit(False))) | has_marker_word(F.transform(tokens, lambda t: F.lower(t["text"])))


def keep_turn(cleaned: Column, parse: Column) -> Column:
    """Short sentences stay only with a content word and with an entity or a marker of discourse."""
    content_word = F.exists(parse["tokens"], lambda t: F.coalesce(t["pos"].isin(*R.CONTENT_POS), F.lit(False)))
    worth = content_word & (F.coalesce(parse["entity"], F.lit(False)) | has_discourse_marker(parse["tokens"]))
    return (alnum_words(cleaned) >= R.LEAST_TURN_WORDS) | worth
