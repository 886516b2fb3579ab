"""A rule set is plain data handed to the parser and the cascade.

``RuleSet()`` is the production rule set.  ``variant(rules, "a+b")`` derives the named
ablation variants, and ``EARLIER`` is the rule set before the accepted variants were merged,
so that accepted variants can be measured against it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from . import patterns as P
from .constants import YEAR_MAX, YEAR_MIN


@dataclass(frozen=True)
class RuleSet:
    year_min: int = YEAR_MIN
    year_max: int = YEAR_MAX
    patterns: tuple[P.DatePattern, ...] = P.DATE_PATTERNS
    until_after: str = P.UNTIL_AFTER
    yearless_hour: bool = True          # read "MM.DDHH시" in the year-less fallback
    hinted_word: bool = True            # tolerate one letter between month name and year
    six_digit: bool = True
    period: str = "computed"            # computed | printed_base | off
    preserve_complete: bool = True      # a retry may not only lose fields
    retry_partial: bool = False
    retry_damaged_day: bool = True
    retry_bare_date: bool = False
    empty_retry_contrast: str = "anchored"   # anchored | any | off
    trim_two_digit_first: bool = False  # also trim a 3-digit day after a 2-digit first field
    early_stop: bool = True             # conclusive originals are not re-read


PRODUCTION = RuleSet()

CASCADE_FIELDS = ("preserve_complete", "retry_partial", "retry_damaged_day", "retry_bare_date", "empty_retry_contrast", "early_stop")


def split(rules: RuleSet) -> tuple[RuleSet, str, RuleSet]:
    """A rule set in three: how tokens are read, how stated periods are used, how the cascade decides. The first and the
    last are rule sets with production values in all other fields, so that equal ones can be shared between variants."""
    cascade = {f: getattr(rules, f) for f in CASCADE_FIELDS}
    reading = {f: getattr(PRODUCTION, f) for f in (*CASCADE_FIELDS, "period")}
    return replace(rules, **reading), rules.period, replace(PRODUCTION, **cascade)

_ACCEPTED = {P.YEAR_WORD_DAY.name, P.COMMA_THEN_DOT.name, P.DOT_THEN_COMMA.name}

EARLIER = RuleSet(
    patterns=tuple(p for p in P.DATE_PATTERNS if p.name not in _ACCEPTED),
    until_after=P.UNTIL_AFTER_GLUED,
    preserve_complete=False,
    retry_damaged_day=False,
    empty_retry_contrast="off",
    early_stop=False,
)


def _front(rules: RuleSet, *new: P.DatePattern) -> RuleSet:
    names = {p.name for p in new}
    return replace(rules, patterns=new + tuple(p for p in rules.patterns if p.name not in names))


VARIANTS = {
    "baseline": lambda r: r,
    "year_month_word": lambda r: _front(r, P.YEAR_WORD_DAY),
    "mixed_comma": lambda r: _front(r, P.DOT_THEN_COMMA, P.COMMA_THEN_DOT),
    "split_until": lambda r: replace(r, until_after=P.UNTIL_AFTER),
    "preserve_complete": lambda r: replace(r, preserve_complete=True),
    "retry_partial": lambda r: replace(r, retry_partial=True),
    "retry_damaged_day": lambda r: replace(r, retry_damaged_day=True),
    "retry_bare_date": lambda r: replace(r, retry_bare_date=True),
    "clahe_after_empty_retry": lambda r: replace(r, empty_retry_contrast="any"),
    "clahe_after_empty_anchored_retry": lambda r: replace(r, empty_retry_contrast="anchored"),
    "no_period": lambda r: replace(r, period="off"),
    "printed_period_base": lambda r: replace(r, period="printed_base"),
    "no_six": lambda r: replace(r, six_digit=False),
}

# boundary probes are measured against the rule set that has none of the three rules
BEFORE_PROBES = replace(
    PRODUCTION,
    patterns=tuple(p for p in P.DATE_PATTERNS if p.name != P.COMMA_YEAR_FIRST.name),
    yearless_hour=False, hinted_word=False)

PROBES = {
    "comma_year": lambda r: _front(r, P.COMMA_YEAR_FIRST),
    "yearless_hour": lambda r: replace(r, yearless_hour=True),
    "hint_month_separator": lambda r: replace(r, hinted_word=True),
    "combined": lambda r: replace(_front(r, P.COMMA_YEAR_FIRST), yearless_hour=True, hinted_word=True),
    "two_digit_tail": lambda r: replace(r, trim_two_digit_first=True),
}


def variant(rules: RuleSet, name: str) -> RuleSet:
    """Apply one named variant, or several joined by ``+``, to a rule set."""
    table = {**VARIANTS, **PROBES}
    for part in name.split("+"):
        if part not in table:
            raise ValueError(f"unknown rule variant: {part}")
        rules = table[part](rules)
    return rules
