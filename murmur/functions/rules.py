"""Rule tables of the text functions, as data.

All patterns are Java regular expressions; ``java`` adds the flags that make classes Unicode-aware, ``$`` and
``.`` care for newlines alone, and letters match in either case.
"""

from __future__ import annotations

from dataclasses import dataclass


#: No place between two ASCII word characters, where a word can't begin or end: told sooner than by the Unicode-aware ``\\b``.
EDGE = r"(?<!(?-U:\w)(?=(?-U:\w)))"


def java(pattern: str, ignore_case: bool = True) -> str:
    return ("(?iUd)" if ignore_case else "(?Ud)") + (EDGE if pattern.startswith(r"\b") else "") + pattern


@dataclass(frozen=True)
class Names:
    """What is special to a show; all rules that name it take it from here."""

    show: str = "the example hour"
    network: str = "example radio"
    network_full: str = "Example Radio Network"
    host: str = "Jo Host"
    preroll: tuple[str, ...] = ("example hour", "example radio", "example institute")


# ------------------------------------------------------------------------------------------------
# Patterns, word lists, constants and formats that results depend on.

STAMP = r"\[\d+:\d{2}(?::\d{2})?(?:\s*\|\s*[^\]]+)?\]"
STAMP_PARTS = r"^\[(\d+):(\d{2})(?::(\d{2}))?"

DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TEEN_WORDS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS_WORDS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
MULTIPLIERS = {"hundred": 100, "thousand": 1000, "million": 1_000_000}

FRACTIONS = [
    (r"\b(\d+)\s+and\s+(?:three|3)\s+quarters?\b", "$1¾"),
    (r"\b(\d+)\s+and\s+a\s+half\b", "$1½"),
    (r"\b(\d+)\s+and\s+a\s+quarter\b", "$1¼"),
    (r"\b(\d+)\s+and\s+a\s+third\b", "$1⅓"),
]
TEMPERATURES = [
    (r"\b(\d+)\s*degrees?\s+(?:Fahrenheit|F)\b", "$1°F"),
    (r"\b(\d+)\s*degrees?\s+(?:Celsius|Centigrade|C)\b", "$1°C"),
]
TEMPERATURE_BARE = (r"\b(\d+)\s*degrees?\b", "$1°")  # this one heeds case
PERCENT = (r"\b(\d+)\s+percent\b", "$1%")
UNITS = {
    "tablespoon": "tbsp", "teaspoon": "tsp", "ounce": "oz", "pound": "lb",
    "gram": "g", "milliliter": "ml", "liter": "L", "kilogram": "kg",
}
PHRASES = [
    (r"\bpain in the (?:butt|ass)\b", "pain"),
    (r"\bsome of (?:them|those|these|it)\b", "some"),
]
PHONE = r"\b\d{3}[.-]?\d{3}[.-]?\d{4}\b"
PHONE_REPEAT = r"(?:[.,]\s*+|(?<!\s)\s++)?[Tt]hat(?:'s| is)\s+\d{3}[.-]?\d{3}[.-]?\d{4}[,.]?"

DISFLUENCY = r"(?:(?<!\s)\s++)?(?<![a-zA-Z-])(?:uh+|um+|ah+|mm+|hmm+|eh|er)(?![a-zA-Z-])\s*,?"
ITS_STUTTER = (r"\bit's\s+\w+\s+it's\b", "it's")
ITS_IT = (r"\bit's\s+it\b(?=\s*[.,!?]|\s*$)", "it's")
#: Weaker and cheaper than DISFLUENCY: where it finds nothing, neither does that.
DISFLUENCY_HINT = r"(?=[aehmu])(?<!(?-U:\p{Alpha}))(?:uh|um|ah|mm|hmm|eh|er)"
OPENERS = ["basically", "essentially", "like", "so", "yeah", "anyway", "well", "now", "listen", "look"]
OPENING_NOUNS = ["problem", "thing", "issue"]
TAGS = [
    (r",\s*right\?\s*", "."),
    (r",\s*(?:you\s+know\s+)?what\s+I\s+mean\?\s*", "."),
]
PARENTHETICALS = [
    (r"(?:,\s*+|(?<!\s)\s++)?(?<!\bdo )(?<!\bif )\byou know\b\s*,?", " "),
    (r",\s*you see\b,?\s*|\byou see\s*,\s*", " "),
    (r"^,?\s*I mean\b(?:,\s*|\s+(?!it\b))|,\s*I mean\b,\s*", " "),
    (r"^by the way\b,?\s*|,\s*by the way\s*,\s*", " "),
    (r"^let me just (?:tell you|say)\b,?\s*|,\s*let me just (?:tell you|say)\b,?\s*", " "),
    (r"\bI think,?\s+(?!about\b|of\b|so\b)", ""),
    (r"\bvery,?\s+very\b", "very"),
]
NICE_OPENER = (r"^nice\s*,\s*", "")
BASICALLY_MID = (r",\s*\b(?:basically|essentially)\b,?\s*", " ")
OR_SOMETHING = (r"\bor something(?:\s+like\s+that)?\b(?=\s*[.,!?]|\s*$)", "")

SENTENCE_BREAK = r'(?<=[.!?])\s+(?=[A-Z\d"])'
LOWER_STARTERS = ["and", "but", "so", "then", "well", "now", "also", "because", "although", "however"]

STOCK_SENTENCES = [
    r"yeah", r"oh\s+yeah", r"yep", r"yup", r"okay", r"ok", r"right", r"alright", r"all\s+righty?", r"sure", r"exactly", r"absolutely",
    r"totally", r"nice", r"great", r"anyway", r"said", r"hey", r"mm+", r"hmm+", r"ah+", r"ooh+", r"oh+", r"uh-?huh", r"mm-?hmm",
    r"got\s+it", r"gotcha", r"thank\s+you", r"what\s+do\s+you\s+think", r"etc\.?", r"and\s+so\s+on\.?",
    r"blah(?:[\s-]+blah(?:[\s-]+blah)?)?\.?", r"you\s+know\s+what\s+I\s+mean", r"what\s+I\s+mean", r"I\s+think",
]
CONNECTORS = [r"and\s+so", r"but\s+then", r"and\s+then", r"or\s+so", r"go\s+to\s+break", r"back\s+after\s+this", r"stay\s+tuned"]
CALL_IN = r"\bcall[- ]?in\b"
INTRO = [r"\bwelcome\s+(?:back\s+)?to\b", r"\bhost\s+of\b", r"\bhosted\s+by\b", r"\bcoming\s+to\s+you\s+live\b", r"\bthank\s+our\s+sponsors\b"]
EXCISE_ABOVE_WORDS, EXCISE_LEAST_WORDS = 25, 4

PARAGRAPH_ACKS = [
    r"Yeah", r"Oh\s+yeah", r"Mm+", r"Ah+", r"Ooh+", r"Right", r"Alright", r"All\s+righty?", r"Uh-?huh", r"M?hm", r"Sure", r"Okay",
    r"Yep", r"Ha+", r"Hmm+", r"Hey", r"Thank\s+you",
]
SPONSOR = r"\bbrought to you by\b|\bsponsored by\b"
THANKS_LISTENING = "Thank you for listening"
SHORT_PARAGRAPH, PREROLL_SECONDS = 300, 30
MUSIC_CHARS, MUSIC_RUN, MUSIC_GAP_S, MUSIC_SHORT_RATIO = 80, 5, 15, 0.75

WORD_STUTTER = r"\b([\w']++)\s++\1\b"
LETTER_STUTTER = (r"\b([b-df-hj-np-tv-z])\s+(\1[a-z]+)\b", "$2")
PHRASE_STUTTER = (r"\b(\w+(?:\s+\w+){1,3})\s+\1\b", "$1")
CONTRAST = ["but", "however", "although", "yet", "while", "whereas", "nevertheless", "though", "still"]
CAUSAL = ["because", "since", "so", "therefore", "thus", "hence"]
SEMANTIC_FOLLOWS = ["it", "it's", "this", "that", "him", "her", "them", "what", "why", "how"]
THINK_FOLLOWS = ["about", "of", "so"]
SEMANTIC_PRECEDES = ["do", "did", "does", "if", "whether"]
LEXICAL_FILLERS = [
    "you know what i mean", "let me just tell you", "or something like that", "does that make sense", "by the way",
    "let me just say", "you know", "you see", "i mean", "i think", "i guess", "sort of", "kind of", "or something",
]
INTERJECTIONS = ["well", "okay", "ok", "alright", "anyway"]
ADVERBS = ["basically", "essentially", "literally", "actually"]
ADVERB_RELATIONS = ["advmod", "discourse"]
CONTENT_POS = ["NOUN", "VERB", "PROPN"]
LEAST_TURN_WORDS = 5
LEAST_RATIO = 0.85

PARAGRAPH_GAP_S = 0.5
SPEAKER_SIMILARITY, SENTENCE_SIMILARITY = 0.75, 0.90
FRAME_MS, LEAST_SILENCE_S, LEAST_SPLIT_SILENCE_MS, SEARCH_S = 20, 0.5, 300, 10
SILENCE_FACTOR, SPLIT_FACTOR = 0.15, 0.05
LEAST_TURN_S = 0.5

#: Lower-case strings of which every match of the rules named holds one.
OPENING_HINTS = ["it's", "right?", "mean?", "you know", "you see", "i mean", "by the way", "let me just ", "i think", "very"]  # ITS_STUTTER, ITS_IT, TAGS, PARENTHETICALS
MIDDLE_HINTS = ["basically", "essentially", "or something"]  # BASICALLY_MID, OR_SOMETHING
MEASURE_HINTS = ["quarter", "half", "third", "degree", "percent", *UNITS]  # FRACTIONS, TEMPERATURES, TEMPERATURE_BARE, PERCENT, UNITS
PHRASE_HINTS = ["pain in the ", "some of "]  # PHRASES

# End of the fixed values.
# ------------------------------------------------------------------------------------------------


def stock_sentence(names: Names) -> str:
    return "^(?:" + "|".join([*STOCK_SENTENCES, r"\s+".join(names.show.split())]) + ")[.!?]?$"


def opening() -> str:
    return rf"^(?:,?\s*\b(?:{'|'.join(OPENERS)})\b,?\s*)++"


def intro(names: Names) -> str:
    return "|".join([*INTRO, rf"\b{r'\s+'.join(names.network.split())}\b"])


def noise(names: Names) -> str:
    """CALL_IN or intro, with the boundary that all of them begin with said once."""
    return rf"\b(?:{'|'.join(p.removeprefix(chr(92) + 'b') for p in (CALL_IN, *INTRO, intro(names)[len('|'.join(INTRO)) + 1 :]))})"


def bumper(names: Names) -> str:
    return rf"(?:you are|you'?re) listening to.{{0,80}}(?:{names.show}|{names.network})|I'?m {names.host}.{{0,20}}{names.show}"
