"""Fixed values of the date rules: word lists, windows, priors and thresholds.

Everything in this file is data that results depend on; no logic lives here.
"""

# --- fixed values -----------------------------------------------------------

YEAR_MIN = 2015
YEAR_MAX = 2040

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN",
          "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

# month spellings with one misread character, and the month they stand for
MISREAD_MONTHS = {"0CT": 10, "AU6": 8}

# letters read as the digit 0, and the extra ones read as 1 next to a misread month
ZERO_LETTERS = "OoUu"
ONE_LETTERS = "iIl"

# score of a field order (Y, M, D = year, month, day); orders not listed score 0
ORDER_SCORE = {"YMD": 3, "DMY": 2, "MDY": 1, "YM": 3, "MY": 0}
ORDER_SCORE_DAY_FIRST = {"DMY": 3, "YMD": 2, "MDY": 1, "YM": 3, "MY": 0}
ORDER_SCORE_MONTH_NAME = {"DMY": 3, "YMD": 2, "MDY": 1}
FOUR_DIGIT_YEAR_BONUS = 10
AFTER_MANUFACTURE_BONUS = 100

ANCHOR_WORDS = ("소비기한", "유통기한", "사용기한", "까지", "EXP", "EXD", "BBD", "BB",
                "BEST BEFORE", "BEST BY")
PRIMARY_WORDS = ("소비기한", "사용기한")
EXCLUDE_WORDS = ("제조일자", "제조년월일", "제조일", "포장일자", "포장일", "산란일자", "산란일",
                 "제조", "PRO", "PROD", "PRD", "MFD", "PACK", "MFG")

STAGES = ("original_512", "rotation_270", "highres_1024", "clahe", "clahe_1024")

RETRY_CONFIDENCE = 0.90
SHORT_TEXT_CHARS = 8
NEAR_HEIGHTS = 3

NONE = "NONE"
UNKNOWN = "unknown"
DATE_COLUMNS = ("image_id", "year", "month", "day", "final_date")
