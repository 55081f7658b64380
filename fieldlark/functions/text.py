"""String functions: accent folding, name search, slugs and labels. All Column -> Column."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, functions as F

# white space as str.split and str.strip see it
BLANKS = "".join(chr(code) for code in range(0x10000) if chr(code).isspace())
SPACES = "[" + "".join(f"\\u{ord(blank):04x}" for blank in BLANKS) + "]+"

# fixed values: letters without a canonical decomposition
LETTER_PAIRS = {"æ": "ae", "Æ": "ae", "ß": "ss", "œ": "oe", "Œ": "oe", "þ": "th", "Þ": "th"}
LETTER_SINGLES = {"ø": "o", "Ø": "o", "å": "a", "Å": "a", "ð": "d", "Ð": "d"}

# fixed values: the narrower fold, lower-case letters only, applied before lower-casing
COMPAT_FROM = "éèêëàâäùûüîïôöçøå"
COMPAT_TO = "eeeeaaauuuiioocoa"


@lru_cache(maxsize=1)
def _single_letter_table() -> tuple[str, str]:
    """Every character whose decomposition leaves exactly one ASCII letter behind."""
    table = dict(LETTER_SINGLES)
    for code in range(0x80, 0x10000):
        char = chr(code)
        if char in table or char in LETTER_PAIRS:
            continue
        base = [c for c in unicodedata.normalize("NFD", char) if c < "\x80"]
        if len(base) == 1:
            table[char] = base[0]
    return "".join(table), "".join(table.values())


def fold_full(text: Column) -> Column:
    """Case- and accent-insensitive form: 'Épervier' and 'epervier' both give 'epervier'."""
    source, target = _single_letter_table()
    for letter, pair in LETTER_PAIRS.items():
        text = F.replace(text, F.lit(letter), F.lit(pair))
    return F.lower(F.regexp_replace(F.translate(text, source, target), r"[^\x00-\x7F]+", ""))


def fold_compat(text: Column) -> Column:
    """Accents stripped from lower-case letters only, then lower-cased ('Épervier' keeps its accent)."""
    return F.lower(F.replace(F.translate(text, COMPAT_FROM, COMPAT_TO), F.lit("æ"), F.lit("ae")))


FOLDS = {"compat": fold_compat, "full": fold_full}


def forms(name: Column) -> list[Column]:
    """The forms of a name that searches compare: lower case and both folds."""
    return [F.lower(name).alias("lower"), *[fold(name).alias(f"folded_{kind}") for kind, fold in FOLDS.items()]]


def name_matches(name: Column, query: str, fold: str = "full") -> Column:
    """Substring match, either as typed (case aside) or with accents removed on both sides.

    An empty *query* matches every name that is present; a missing name gives NULL.
    """
    typed = F.lower(F.lit(query))
    plain = fold_full(F.lit(query))
    return F.lower(name).contains(typed) | FOLDS[fold](name).contains(plain)


def any_name_matches(names: list[Column], query: str, fold: str = "compat") -> Column:
    return reduce(lambda a, b: a | b, [name_matches(name, query, fold) for name in names])


def contains_ignore_case(text: Column, part: str) -> Column:
    return F.lower(text).contains(F.lower(F.lit(part)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    return F.split(strip(text), SPACES)


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(strip(text), SPACES, " ")


def first_word(text: Column) -> Column:
    return F.substring_index(single_spaced(text), " ", 1)


def binomial(name: Column) -> Column:
    """First two words of a scientific name, without author and year."""
    return F.substring_index(single_spaced(name), " ", 2)


def iri_slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_-]", "_"), F.lit("_"))


def name_slug(text: Column) -> Column:
    """Slug in which hyphens are replaced too."""
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]", "_"), F.lit("_"))


def dbpedia_slug(common_name: Column) -> Column:
    """'Great Crested Grebe' -> 'Great_crested_grebe'; the first word keeps its case."""
    parts = words(common_name)
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)
    return F.array_join(F.concat(F.slice(parts, 1, 1), tail), "_")


def last_segment(iri: Column) -> Column:
    return F.element_at(F.split(iri, "/"), -1)


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_non_empty(*texts: Column) -> Column:
    return F.coalesce(*[non_empty(text) for text in texts])


def number_text(value: Column) -> Column:
    """Shortest decimal text of a double; the exponent form only below 1e-4 and from 1e16 on."""
    raw = value.cast("string")
    size = F.abs(value)
    exponent = F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(raw, r"E-?\d+$", ""), r"\.0$", "")
    scientific = F.concat(
        mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    fixed = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    return (
        F.when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), fixed)
        .otherwise(scientific))
