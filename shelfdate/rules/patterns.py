"""The date pattern table.

A pattern is a row of data: the regular expression (Java dialect), the kind of each
captured field, the roles those fields may take, whether that order is fixed, and a cheap
marker the text must hold for the expression to be worth running.

Field kinds: ``n`` number, ``m`` month name, ``c`` misread month name, ``d`` number next to
a misread month name.  Roles: ``Y`` year, ``M`` month, ``D`` day.
"""

from __future__ import annotations

from itertools import permutations
from typing import NamedTuple

from .constants import MISREAD_MONTHS, MONTHS


class DatePattern(NamedTuple):
    name: str
    regex: str
    kinds: str
    roles: str
    fixed: bool
    needs: str = ""          # "", "month" (a month name), "label" (EXP/BB) or a literal

    def orders(self) -> list[str]:
        """Field orders to try, in the order that breaks ties."""
        if self.fixed:
            return [self.roles]
        return ["".join(p) for p in permutations(self.roles)]


# --- fixed values: building blocks ------------------------------------------

DIG = r"[0-9OoUu]"
LOOSE = r"[0-9OoUuiIl]"
SEP = r"[.\-/\s·×]+"
OSEP = r"[.\-/\s·×]*"
MON = "|".join(MONTHS)
BADMON = "|".join(MISREAD_MONTHS)
FULL = r"[0-9]{4}[.\-/][0-9]{1,2}[.\-/][0-9]{2}"
UNIT = r"(?:g|mg|kg|ml|mL|l|L|kcal|Kcal|%|원|개|cm|mm|FL|fl|OZ|oz)"

# --- fixed values: patterns, most specific first -----------------------------

YEAR_WORD_DAY = DatePattern(
    "year_word_day",
    rf"(?iU)(?<![0-9A-Za-z])(20[0-9]{{2}}){OSEP}({MON}){OSEP}([0-9]{{1,2}})(?![0-9A-Za-z])",
    "nmn", "YMD", True, "month")
COMMA_THEN_DOT = DatePattern(
    "comma_then_dot",
    r"(?U)(?<![0-9A-Za-z])([0-9]{4})\s*,\s*([0-9]{1,2})\s*\.\s*([0-9]{1,3})(?![0-9])",
    "nnn", "YMD", False, ",")
DOT_THEN_COMMA = DatePattern(
    "dot_then_comma",
    r"(?U)(?<![0-9A-Za-z])([0-9]{4})\s*\.\s*([0-9]{1,2})\s*,\s*([0-9]{1,3})(?![0-9])",
    "nnn", "YMD", False, ",")
COMMA_YEAR_FIRST = DatePattern(
    "comma_year_first",
    r"(?U)(?<![0-9A-Za-z])([0-9]{4})\s*,\s*([0-9]{1,2})\s*,\s*([0-9]{1,3})(?![0-9])",
    "nnn", "YMD", False, ",")

DATE_PATTERNS: tuple[DatePattern, ...] = (
    YEAR_WORD_DAY,
    COMMA_THEN_DOT,
    DOT_THEN_COMMA,
    DatePattern("ddmm_space_year", r"(?U)\A\s*([0-9]{2})([0-9]{2})\s+(20[0-9]{2})\s*\z",
                "nnn", "DMY", False),
    COMMA_YEAR_FIRST,
    DatePattern("korean_year_month_day", r"(?U)(?<!\d)(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일",
                "nnn", "YMD", True, "월"),
    DatePattern("korean_year_month", r"(?U)(?<!\d)(\d{4})년\s*(\d{1,2})월(?!\s*\d{1,2}일)",
                "nn", "YM", True, "월"),
    DatePattern("korean_month_day", r"(?U)(?<!\d)(\d{1,2})월\s*(\d{1,2})일",
                "nn", "MD", True, "월"),
    DatePattern("misread_word_spaced",
                rf"(?iU)(?<![0-9A-Za-z])({LOOSE}{{1,2}}){SEP}((?:{BADMON})){SEP}({LOOSE}{{2,4}})(?![0-9A-Za-z])",
                "dcd", "YMD", False, "month"),
    DatePattern("misread_word_glued",
                rf"(?iU)(?<![0-9A-Za-z])({LOOSE}{{1,2}})((?:{BADMON}))({LOOSE}{{2}}|{LOOSE}{{4}})(?![0-9A-Za-z])",
                "dcd", "YMD", False, "month"),
    DatePattern("day_word_year_spaced",
                rf"(?iU)(?<!\d)(\d{{1,2}}){SEP}({MON}){SEP}(\d{{2,4}})(?!\d)",
                "nmn", "YMD", False, "month"),
    DatePattern("day_word_glued_year",
                rf"(?iU)(?<!\d)(\d{{1,2}}){OSEP}({MON}){SEP}(\d{{2,4}})(?!\d)",
                "nmn", "YMD", False, "month"),
    DatePattern("day_word_year_glued",
                rf"(?iU)(?<!\d)({DIG}{{1,2}})({MON})({DIG}{{2}}|{DIG}{{4}})(?!\d)",
                "nmn", "YMD", False, "month"),
    DatePattern("year_word_day_spaced",
                rf"(?iU)(?<!\d)(\d{{2,4}}){SEP}({MON}){SEP}(\d{{1,2}})(?!\d)",
                "nmn", "YMD", False, "month"),
    DatePattern("word_day_year_spaced",
                rf"(?iU)(?<!\d)({MON}){SEP}(\d{{1,2}}){SEP}(\d{{2,4}})(?!\d)",
                "mnn", "YMD", False, "month"),
    DatePattern("word_day_year_glued",
                rf"(?iU)(?<!\d)({MON}){OSEP}(\d{{1,2}}){OSEP}(\d{{4}})(?!\d)",
                "mnn", "YMD", False, "month"),
    DatePattern("word_year", rf"(?iU)(?<!\d)({MON}){OSEP}(\d{{4}})(?!\d)",
                "mn", "MY", True, "month"),
    DatePattern("short_comma_first",
                r"(?U)(?<![0-9])([0-9]{1,2}),([0-9]{1,2})[.,]([0-9]{1,2})(?![0-9])",
                "nnn", "YMD", False, ","),
    DatePattern("short_comma_second",
                r"(?U)(?<![0-9])([0-9]{1,2})\.([0-9]{1,2}),([0-9]{1,2})(?![0-9])",
                "nnn", "YMD", False, ","),
    DatePattern("comma_year_last",
                r"(?U)(?<![0-9])([0-9]{1,2}),([0-9]{1,2}),([0-9]{4})(?![0-9])",
                "nnn", "YMD", False, ","),
    DatePattern("odd_separators_year_last",
                r"(?U)(?<![0-9])(?<![0-9][.,/\-·×])([0-9]{1,2})\s*[.,/\-·×]\s*([0-9]{1,2})\s*[.,/\-·×>\s]\s*([0-9]{4})(?![0-9])",
                "nnn", "YMD", False),
    DatePattern("yyyymm_space_dd", r"(?U)(?<![0-9])([0-9]{4})([0-9]{2})\s+([0-9]{2})(?![0-9])",
                "nnn", "YMD", True),
    DatePattern("label_ddmm_year",
                r"(?U)(?i:EXP)[:.\s]*([0-9]{2})([0-9]{2})[\s\-./]+([0-9]{4})(?![0-9])",
                "nnn", "DMY", True, "label"),
    DatePattern("label_mmyyyy", r"(?U)(?i:EXP|BBE|BB)[:.\s]*([0-9]{2})([0-9]{4})(?![0-9])",
                "nn", "MY", True, "label"),
    DatePattern("label_month_slash_year",
                r"(?U)\A\s*(?i:EXP(?:IRY|IRATION)?)[.\s]*(?:(?i:DATE)[.\s]*)?:?\s*([0-9]{1,2})\s*/\s*([0-9]{2})\s*\z",
                "nn", "MY", True, "label"),
    DatePattern("ddmmyyyy", r"(?U)(?<![0-9])([0-9]{2})([0-9]{2})([0-9]{4})(?![0-9])",
                "nnn", "DMY", False),
    DatePattern("separated_triple",
                rf"(?U)(?<!\d)({DIG}{{1,4}}){SEP}({DIG}{{1,4}}){SEP}({DIG}{{1,4}})(?!\d)(?!\s*:\s*\d)",
                "nnn", "YMD", False),
    DatePattern("yyyymmdd", rf"(?U)(?<!\d)({DIG}{{4}})({DIG}{{2}})({DIG}{{2}})(?!\d)",
                "nnn", "YMD", False),
    DatePattern("year_first_loose",
                rf"(?U)(?<!\d)({DIG}{{4}})[:.\-/\s,()xX×·]+({DIG}{{2}})[:.,()/\-\s·]?({DIG}{{2}})(?!\d)",
                "nnn", "YMD", False),
    DatePattern("year_month", rf"(?U)(?<!\d)({DIG}{{4}}){SEP}({DIG}{{1,2}})(?!\d)",
                "nn", "YM", False),
    DatePattern("year_comma_month", rf"(?U)(?<!\d)({DIG}{{4}}),({DIG}{{1,2}})(?!\d)",
                "nn", "YM", False, ","),
    DatePattern("month_year", rf"(?U)(?<!\d)({DIG}{{1,2}})[.\-/\s,]+({DIG}{{4}})(?!\d)",
                "nn", "YM", False),
)

# only read when the image prints a month/year format hint
HINTED_PATTERNS: tuple[DatePattern, ...] = (
    DatePattern("hinted_month_yy",
                r"(?U)(?<![0-9.,:])([0-9]{1,2})\s*[./\-]\s*([0-9]{2})(?![0-9.,:])",
                "nn", "MY", True),
    DatePattern("hinted_word_year",
                rf"(?iU)\A\s*[-.(\[]*({MON})[A-Za-z]([0-9]{{4}})[.)\]]*\s*\z",
                "mn", "MY", True, "month"),
)

# fallbacks, each only read when nothing above it was found in the image
COMPACT_PATTERNS = (
    DatePattern("compact_year_month", r"(?U)\A\s*(20[0-9]{2})(0[1-9]|1[0-2])\s*\z", "nn", "YM", True),
)
YEARLESS_PATTERNS = (
    DatePattern("yearless_month_day",
                rf"(?U)(?<![0-9.,:])(0[1-9]|1[0-2])\s?\.\s?(0[1-9]|[12][0-9]|3[01])(?![0-9])(?!\s?{UNIT}(?![A-Za-z]))",
                "nn", "MD", True),
)
SIX_DIGIT_PATTERNS = (
    DatePattern("six_digit_year_month",
                r"(?U)(?<![0-9A-Za-z])([0-9]{4})([0-9]{2})(?![0-9])(?!\s*[./\-:]\s*[0-9])",
                "nn", "YM", True),
    DatePattern("six_digit_year_month_day",
                r"(?U)(?<![0-9A-Za-z])([0-9]{2})([0-9]{2})([0-9]{2})(?![0-9])(?!\s*[./\-:]\s*[0-9])",
                "nnn", "YMD", True),
)
PADDED_PATTERNS = (
    DatePattern("padded_eight_digit",
                r"(?U)(?<![0-9])(20[0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?:[0-9](?![0-9])|[0-9]{1,3}(?=\s*[가-힣]?지))",
                "nnn", "YMD", True),
)

# --- fixed values: text repairs before matching ------------------------------

_LETTERS_APART = "|".join(r"\s*".join(f"({c})" for c in month) for month in MONTHS)
_LETTER_GROUPS = "".join(f"${i}" for i in range(2, 2 + 3 * len(MONTHS)))

# (what it repairs, expression, replacement), applied in this order
REPAIRS: tuple[tuple[str, str, str], ...] = (
    ("C read for 0", r"(?U)(?<=[.\-/])[Cc](?=[0-9][.\-/])", "0"),
    ("year split by a space",
     r"(?U)(?<![0-9])(20)\s+([0-9]{2})(?=[.\-/][0-9]{1,2}[.\-/][0-9]{1,2}(?![0-9]))", "$1$2"),
    ("noise digit before a date that ends in 까지",
     r"(?U)(?<![0-9])([0-9])(20[0-9]{2}[.\-/][0-9]{1,2}[.\-/][0-9]{2})(?=\s*[가-힣]?지)", "$1 $2"),
    ("day split by a space",
     r"(?U)\A(\s*20[0-9]{2}\s*[.\-/]\s*[0-9]{1,2}\s*[.\-/]\s*)([0-9])\s+([0-9])(\s*)\z", "$1$2$3$4"),
    ("month name split by spaces",
     rf"(?iU)(?<![0-9A-Za-z])([0-9]{{1,2}})\s*(?:{_LETTERS_APART})\s*([0-9]{{4}}|[0-9]{{2}})(?![0-9A-Za-z])",
     rf"$1 {_LETTER_GROUPS} ${2 + 3 * len(MONTHS)}"),
    ("two dates glued", rf"(?U)({FULL})(?={FULL})", "$1 "),
    ("date and time glued", rf"(?U)({FULL})(?=[0-9]{{1,2}}:[0-9]{{2}})", "$1 "),
    ("noise digits after a year-last date",
     r"(?U)(?<![0-9])([0-9]{1,2}\s*[.\-/]\s*[0-9]{1,2}\s*[.\-/]\s*20[0-9]{2})(?=[0-9])", "$1 "),
)

CLOCK_BEFORE = r"(?<![0-9A-Za-z.:/\-])"
CLOCK_AFTER = r"(?![0-9./\-])"
TWO_DIGIT_HOUR = r"(?:[01][0-9]|2[0-3])"
ONE_DIGIT_HOUR = r"[0-9]"
MINUTE_OR_SECOND = r":[0-5][0-9]"

YEARLESS_HOUR = (
    r"(?U)\A\s*(0[1-9]|1[0-2])\.\s*(0[1-9]|[12][0-9]|3[01])([01][0-9]|2[0-3])시", "$1.$2 $3시")

# --- fixed values: context expressions ---------------------------------------

UNTIL_AFTER = r"(?U)\A(?:까[\s-]+지|[가-힣]?지)"
UNTIL_AFTER_GLUED = r"(?U)\A(?:[가-힣]?지)"
LABEL_BEFORE = r"(?:E?XP+|EXD|BBE?)[^0-9A-Z]{0,2}(?=\n?\z)"
YEAR_MONTH_AT_END = r"(?U)20[0-9]{2}[./-][0-9]{2}\s*\z"
LONE_DAY = r"(?U)\A\s*(0[1-9]|[12][0-9]|3[01])\s*\z"
LONE_YEAR = r"(?U)\A\s*(20[0-9]{2})\s*[.,]?\s*\z"
SHORT_SLASH = r"(?<![0-9])([0-9]{2})/([0-9]{2})/([0-9]{2})(?![0-9])"
LONG_SLASH = r"(?<![0-9])([0-9]{2})/([0-9]{2})/(20[0-9]{2})(?![0-9])"
YEAR_FIRST_SLASH = r"(?<![0-9])20[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}(?![0-9])"
PERIOD = r"(?U)제조일\s*로\s*부터\s*([0-9]{1,2})\s*(년|개월|일)"
BARE_DATE = r"(?U)\A[0-9\s./-]+\z"

DAY_FIRST_HINTS = (
    r"(?U)일\s*[,./·]\s*월\s*[,./·]\s*년",
    r"(?iU)\b[DJ][D0OJ]\s*[./\-]\s*MM\s*[./\-]\s*(?:YY|AA)",
)
MONTH_YEAR_HINTS = (
    r"(?iU)Monat\s*/\s*Jahr",
    r"(?iU)Month\s*/\s*Year",
    r"(?iU)(?<![DJ]\s[./\-]\s)(?<![DJ][./\-])\bMM\s*[./]\s*(?:YY|AA)",
    r"(?U)(?<!일\s)(?<!일)월\s*/\s*년",
)
