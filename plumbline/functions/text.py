"""Text expressions: trimming, accent folding, masks, normalised forms and tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value".
PLACEHOLDERS = [
    "n/a", "na", "n.a.", "-", "--", "---", "sin dato", "sin datos", "sin nombre",
    "s/n", "s/d", "null", "none", "ninguno", ".", "0",
]

# Legal-form suffixes and stop-words ignored when names are compared.
LEGAL_SUFFIXES = [
    "sac", "s.a.c.", "s.a.c", "sa", "s.a.", "s.a", "eirl", "e.i.r.l.", "e.i.r.l",
    "srl", "s.r.l.", "s.r.l", "sas", "s.a.s.", "s.a.s", "ltda", "ltda.", "sc", "s.c.",
    "scrl", "sociedad", "anonima", "cerrada", "limitada", "individual", "responsabilidad",
]
NAME_STOPWORDS = [
    "del", "de", "la", "las", "los", "el", "y", "e", "en", "al", "a", "con", "para", "por",
]

# Last words that mark a company name, and marks of a street address.
COMPANY_ENDINGS = [
    "sac", "s.a.c", "s.a.c.", "sa", "s.a", "s.a.", "eirl", "e.i.r.l", "e.i.r.l.",
    "srl", "s.r.l", "s.r.l.", "sas", "s.a.s.", "ltda", "ltda.",
]
STREET_MARKS = [
    "av.", "av ", "jr.", "jr ", "calle", "mz.", "mz ", "psje", "pasaje",
    "urb.", "urb ", "carretera", "panamericana",
]

# Letters that fold to more than one ASCII letter or do not decompose.
SPECIAL_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}
STROKED_LETTERS = {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ı": "i", "ħ": "h", "ŧ": "t"}


def _accent_table() -> tuple[str, str]:
    """Latin letters U+00C0..U+017F whose decomposition starts with an ASCII letter."""
    source, target = [], []
    for code in range(0xC0, 0x180):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def bind(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once per row. A plain reference inside a lambda is computed per element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"\S")


def strip_accents(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


def fold(c: Column) -> Column:
    """Latin letters with accents, strokes or ligatures become plain ASCII letters (lower-case input)."""
    folded = F.translate(strip_accents(c), "".join(STROKED_LETTERS), "".join(STROKED_LETTERS.values()))
    for letter, plain in SPECIAL_LETTERS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded


def number(c: Column) -> Column:
    """The number a value spells; NULL for other text and for the text NaN, which names no number."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def is_missing(c: Column, data_type: str) -> Column:
    """NULL, or NaN in floating-point columns."""
    return (c.isNull() | F.isnan(c)) if data_type in ("double", "float") else c.isNull()


def is_placeholder(c: Column) -> Column:
    """NULL, blank or one of the texts that stand for no value."""
    value = F.lower(strip(c))
    return c.isNull() | (value == "") | value.isin(PLACEHOLDERS)


def mask(c: Column) -> Column:
    """Shape of a text: upper L, lower l, digit D, space s, anything else unchanged."""
    # Lower first would turn the 'L' of the next step into 'l', so upper-case letters go first.
    shape = F.regexp_replace(c, r"\p{Lu}", "\u0001")
    shape = F.regexp_replace(shape, r"\p{Ll}", "l")
    shape = F.regexp_replace(shape, r"\p{Nd}", "D")
    shape = F.replace(F.replace(shape, F.lit(" "), F.lit("s")), F.lit("\u0001"), F.lit("L"))
    return F.coalesce(shape, F.lit("-null-"))


def normalise(c: Column, full: bool = True) -> Column:
    """Comparable form of a name. ``full=False`` only lower-cases and trims."""
    low = strip(F.lower(c))
    if not full:
        return low
    out = fold(low)
    out = F.regexp_replace(out, r"\.(?=\s)", " ")
    out = F.regexp_replace(out, r"\.$", "")
    out = F.regexp_replace(out, r"(?<=\w)\.(?=\w)", "")
    out = F.regexp_replace(out, r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def words(c: Column) -> Column:
    """Non-empty words of a text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def clean_tokens(c: Column, min_length: int = 3) -> Column:
    """Words without legal suffixes, stop-words and short words; all words if nothing is left."""
    ignored = LEGAL_SUFFIXES + NAME_STOPWORDS

    def kept(every: Column) -> Column:
        return F.filter(every, lambda w: (F.char_length(w) >= min_length) & ~w.isin(ignored))

    return bind(
        words(F.lower(c)), lambda every: bind(kept(every), lambda k: F.when(F.size(k) > 0, k).otherwise(every))
    )


def grams(c: Column, size: int = 3) -> Column:
    """Distinct character n-grams of a text (empty array when the text is shorter than n)."""

    def cut(text: Column) -> Column:
        starts = F.sequence(F.lit(1), F.char_length(text) - (size - 1))
        pieces = F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))
        return F.when(F.char_length(text) >= size, pieces).otherwise(F.array().cast("array<string>"))

    return bind(c, cut)


def padded_trigrams(c: Column) -> Column:
    """Trigram set with two pad characters at both ends."""
    return grams(F.concat(F.lit("##"), c, F.lit("##")), 3)


def word_soundex(w: Column) -> Column:
    """Soundex code; the first character is kept as it is even when it is a digit."""
    return F.concat(
        F.upper(F.substring(w, 1, 1)),
        F.when(
            F.substring(w, 1, 1).rlike("[0-9]"),
            F.substring(F.soundex(F.concat(F.lit("a"), F.substr(w, F.lit(2)))), 2, 3),
        ).otherwise(F.substring(F.soundex(w), 2, 3)),
    )
