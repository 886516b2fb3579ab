"""Text columns: repairs, keyword tests, hints.  Every function is Column -> Column."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import patterns as P
from ..rules.constants import ANCHOR_WORDS, EXCLUDE_WORDS, PRIMARY_WORDS

# two control characters frame matches inside a marked text (see tokens.py)
MATCH_MARK, FIELD_MARK = "\x01", "\x02"


def _decimal_digits() -> tuple[str, str]:
    """All Unicode decimal digits beyond ASCII, and the ASCII digit each one stands for."""
    found = [c for c in map(chr, range(128, 0x20000)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


OTHER_DIGITS, ASCII_OF_OTHER_DIGITS = _decimal_digits()


def clean(text: Column) -> Column:
    """Free the two mark characters and turn separator controls into spaces; length is kept."""
    return F.translate(text, "\x01\x02\x1c\x1d\x1e\x1f", "\x03\x03    ")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, OTHER_DIGITS, ASCII_OF_OTHER_DIGITS)


def repair(text: Column) -> Column:
    """Apply the ordered text repairs."""
    for _, regex, replacement in P.REPAIRS:
        text = F.regexp_replace(text, regex, replacement)
    return text


def mask_clocks(text: Column) -> Column:
    """Overwrite HH:MM[:SS] by ``#`` of the same length, longest forms first."""
    masked = text
    for hour, hour_len in ((P.TWO_DIGIT_HOUR, 2), (P.ONE_DIGIT_HOUR, 1)):
        for parts in (2, 1):
            regex = P.CLOCK_BEFORE + hour + P.MINUTE_OR_SECOND * parts + P.CLOCK_AFTER
            masked = F.regexp_replace(masked, regex, "#" * (hour_len + 3 * parts))
    return F.when(text.contains(":"), masked).otherwise(text)


def words_regex(words) -> str:
    """Korean words match anywhere; Latin ones not inside a longer A-Z word.

    Longer words come first so that a match covers the widest spelling at its place.
    """
    ordered = sorted(words, key=len, reverse=True)
    latin = "|".join(w for w in ordered if w.isascii())
    other = [w for w in ordered if not w.isascii()]
    parts = other + ([f"(?<![A-Z])(?:{latin})(?![A-Z])"] if latin else [])
    return "|".join(parts)


ANCHOR_REGEX = words_regex(ANCHOR_WORDS)
PRIMARY_REGEX = words_regex(PRIMARY_WORDS)
EXCLUDE_REGEX = words_regex(EXCLUDE_WORDS)


def has_word(text: Column, words) -> Column:
    return F.upper(text).rlike(words_regex(words))


def words_found(upper_text: Column, words) -> Column:
    """The words of a list present in an upper-cased text, as one comparable string."""
    return F.concat_ws(",", *[F.when(upper_text.rlike(words_regex([w])), F.lit(w)) for w in words])


def matches_any(text: Column, regexes) -> Column:
    hit = F.lit(False)
    for regex in regexes:
        hit = hit | text.rlike(regex)
    return hit


def squeezed_length(text: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def is_expiry_label(text: Column) -> Column:
    """The whole text is one anchor word, apart from trailing punctuation."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), r"[:. ]+\z", "")
    return F.upper(bare).isin(*ANCHOR_WORDS)
