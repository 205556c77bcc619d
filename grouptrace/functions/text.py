"""Names and text: normalisation, tokens, splitting, search predicates."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _accent_pairs() -> tuple[str, str]:
    """Characters that lose their marks under decomposition, with what remains of them."""
    source, target = [], []
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF) + 1):
        if 0xAC00 <= code <= 0xDFFF:  # Hangul syllables and surrogates carry no marks
            continue
        char = chr(code)
        if char != char.lower():
            continue
        parts = unicodedata.normalize("NFD", char)
        kept = [c for c in parts if not unicodedata.category(c).startswith("M")]
        if len(parts) > len(kept) == 1:
            source.append(char)
            target.append(kept[0])
    return "".join(source), "".join(target)


def trim_spaces(col: Column) -> Column:
    """Strip leading and trailing Unicode spaces; tabs and line breaks stay."""
    return F.regexp_replace(col, r"^\p{Zs}+|\p{Zs}+\z", "")


def normalize_name(col: Column) -> Column:
    """Lower case, trim Unicode spaces, delete full stops and commas, drop accents.

    Spaces are trimmed before the punctuation goes, so ``'foo .'`` keeps one trailing space.
    Composed and decomposed input give the same key. Letters without a decomposition (ß, ø, ł) stay.
    """
    accented, plain = _accent_pairs()
    # translate() deletes the characters that have no counterpart: the two punctuation marks.
    folded = F.translate(trim_spaces(F.lower(col)), accented + ".,", plain)
    return F.regexp_replace(folded, r"\p{M}+", "")


def tokens(col: Column) -> Column:
    """The runs of a-z in the normalised text, in order."""
    return F.array_remove(F.split(normalize_name(col), "[^a-z]+"), "")


def strip_leading_chars(col: Column, chars: str) -> Column:
    """Strip any leading characters that belong to the set ``chars`` (not a prefix)."""
    return F.ltrim(col, F.lit(chars))


def split_at(col: Column, delimiter: str, position: int) -> Column:
    """1-based part of a delimited text; NULL beyond the last part."""
    return F.try_element_at(F.split(col, re.escape(delimiter)), F.lit(position))


def file_name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def regex_struct(col: Column, pattern: str, names: list[str]) -> Column:
    """Struct with one text field per capture group of ``pattern``."""
    return F.struct(*[F.regexp_extract(col, pattern, i).alias(n) for i, n in enumerate(names, start=1)])


def snake_case(name: str) -> str:
    """``registrationIndex`` -> ``registration_index``."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


# Search modes of the registry's form and their labels there.
NAME_MODES = {
    "begins_with": "Comenzando con",
    "exact": "Pareo exacto",
    "any_word": "Cualquier palabra",
    "all_words": "Todas las palabras",
}
NUMBER_MODES = {
    "equal": "Es igual a",
    "greater": "Mayor que",
    "less": "Menor que",
    "at_least": "Mayor o igual que",
    "at_most": "Menor o igual que",
}


def _mode(given: str, modes: dict[str, str]) -> str:
    for mode, label in modes.items():
        if given in (mode, label):
            return mode
    raise ValueError(f"unknown search mode: {given!r}")


def name_matches(col: Column, mode: str, text: str) -> Column:
    """Predicate for a name search; both sides normalised, words are separated by spaces."""
    mode = _mode(mode, NAME_MODES)
    name, wanted = normalize_name(col), normalize_name(F.lit(text))
    if mode == "begins_with":
        return F.startswith(name, wanted)
    if mode == "exact":
        return name == wanted
    words, wanted_words = F.split(name, " +"), F.array_remove(F.split(wanted, " +"), "")
    if mode == "any_word":
        return F.arrays_overlap(words, wanted_words)
    return (F.size(wanted_words) > 0) & (F.size(F.array_except(wanted_words, words)) == 0)


def number_matches(col: Column, mode: str, number: int) -> Column:
    """Predicate for a search by registration number."""
    mode = _mode(mode, NUMBER_MODES)
    if mode == "equal":
        return col == number
    if mode == "greater":
        return col > number
    if mode == "less":
        return col < number
    return col >= number if mode == "at_least" else col <= number
