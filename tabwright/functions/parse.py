"""Text-to-value expressions as SQL text: each takes the text of an expression and returns
the text of another, null on bad input."""

from __future__ import annotations

from tabwright.functions.text import one_of, pattern

# Words read as booleans.
TRUE_WORDS = ["true", "yes", "1", "t", "y"]
FALSE_WORDS = ["false", "no", "0", "f", "n"]

# Value sets that make a column boolean.
BOOLEAN_PAIRS = [
    ("true", "false"),
    ("0", "1"),
    ("0.0", "1.0"),
    ("yes", "no"),
    ("y", "n"),
    ("active", "inactive"),
    ("t", "f"),
]

# Text read as a missing value by the delimited-text reader.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The characters that count as whitespace around a text, one by one and as a
# character class (control blanks, next line, no-break, ogham, en quad to hair, line and
# paragraph separators, narrow no-break, mathematical, ideographic).
_BLANK_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
]
_BLANK_CLASS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0  -  -   　"

# Currency text, the characters removed before it is read, and plain numbers.
CURRENCY_SIGNS = "$€£₹¥"
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Starts that make text look like a date.
DATE_LOOKS = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{4}/\d{2}/\d{2})"

# Month names, in order, and the names of days that may come first.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_MONTH = (
    "((?i:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|"
    "Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?))[.]?"
)
_DAY_NAME = "(?:(?i:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[A-Za-z]{0,6},? +)?"

# Whole-text date shapes, and the orders in which their parts make
# year-month-day (month first, then day first). A shape may be followed by a time of day.
ISO_DATE = r"\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?"
ZONED_DATE = r"\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s?(?:[Zz]|UTC|GMT|[+-]\d{2}(?::?\d{2})?)"
DATE_SHAPES = [
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", ["$3-$1-$2", "$3-$2-$1"]),
    (r"(\d{1,2})-(\d{1,2})-(\d{4})", ["$3-$1-$2", "$3-$2-$1"]),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", ["$1-$2-$3"]),
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", ["$1-$2-$3"]),
    (r"((?:19|20)\d{2})(\d{2})(\d{2})", ["$1-$2-$3"]),
    # Two-digit years from 69 on belong to the 1900s.
    (r"(\d{1,2})[/-](\d{1,2})[/-](69|[7-9]\d)", ["19$3-$1-$2", "19$3-$2-$1"]),
    (r"(\d{1,2})[/-](\d{1,2})[/-]([0-5]\d|6[0-8])", ["20$3-$1-$2", "20$3-$2-$1"]),
]
# The same with the month as a word, which becomes its number.
NAMED_SHAPES = [
    (rf"{_DAY_NAME}{_MONTH} +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}})", "$3", "$1", "$2"),
    (rf"{_DAY_NAME}(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH},?[ -](\d{{4}})", "$3", "$2", "$1"),
]
_TIME = r"(?:,?[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(?:\s?([AaPp])[.]?[Mm][.]?)?)?"

# Unix times from 2000-01-01 up to the 32-bit end, in seconds.
EPOCH_FIRST = 946_684_800
EPOCH_LAST = 2_147_483_647

_BLANKS = "'" + "".join(f"\\u{code:04x}" for code in _BLANK_CODES) + "'"
_BLANK = f"[{_BLANK_CLASS}]*"


def _whole(x: str, shape: str) -> str:
    """Whether the text, blanks around it aside, has a shape. Anchored: other text fails at once."""
    return f"{x} RLIKE {pattern(f'^{_BLANK}{shape}{_BLANK}$')}"


def strip(x: str) -> str:
    """Remove every kind of leading and trailing whitespace, not only spaces."""
    return f"btrim({x}, {_BLANKS})"


def strip_to_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def word(x: str) -> str:
    """The text folded to lower case when it is one short word, else null."""
    return f"CASE WHEN {_whole(x, '[A-Za-z0-9.]{1,8}')} THEN lower({strip(x)}) END"


def is_bool(x: str) -> str:
    return one_of(word(x), TRUE_WORDS + FALSE_WORDS)


def read_bool(x: str) -> str:
    return f"CASE WHEN {one_of(word(x), TRUE_WORDS)} THEN true WHEN {one_of(word(x), FALSE_WORDS)} THEN false END"


def is_currency(x: str) -> str:
    return _whole(x, rf"[{CURRENCY_SIGNS}]?\s*[\d,]+\.?\d*")


def read_currency(x: str) -> str:
    """Number from text with currency signs, thousands commas and blanks anywhere."""
    possible = rf"[{CURRENCY_SIGNS},\d+\-.eE{_BLANK_CLASS}]+"
    bare = f"translate({x}, '{CURRENCY_SIGNS},' || {_BLANKS}, '')"
    return f"CASE WHEN {x} RLIKE {pattern(f'^{possible}$')} THEN {read_number(bare)} END"


def read_number(x: str) -> str:
    return f"CASE WHEN {x} RLIKE {pattern(NUMBER_TEXT)} THEN try_cast({x} AS DOUBLE) END"


def read_date(x: str) -> str:
    """Timestamp from text in one of the fixed shapes; a bare number of other than eight digits is not a date.

    Months come before days where both readings are possible. A time with a zone or an offset is
    given in UTC, as timestamps here carry no zone. Impossible dates and times are null.
    """
    names = "Mon|Tue|Wed|Thu|Fri|Sat|Sun|" + "|".join(MONTHS)
    possible = rf"^{_BLANK}(?:\d{{1,4}}[-/]\d{{1,2}}[-/]\d|(?:19|20)\d{{6}}|\d{{1,2}}(?:st|nd|rd|th)?[ -][A-Za-z]{{3}}|(?i:{names}))"
    instant = f"unix_micros(try_cast({strip(x)} AS TIMESTAMP))"
    branches = [
        f"WHEN NOT {x} RLIKE {pattern(possible)} THEN NULL",
        f"WHEN {_whole(x, ISO_DATE)} THEN try_cast({strip(x)} AS TIMESTAMP_NTZ)",
        f"WHEN {_whole(x, ZONED_DATE)} THEN timestampadd(MICROSECOND, {instant}, TIMESTAMP_NTZ '1970-01-01 00:00:00')",
    ]
    spelled = []
    for shape, orders in DATE_SHAPES:
        whole = pattern(f"^{_BLANK}{shape}{_TIME}{_BLANK}$")
        spelled.append(f"WHEN {x} RLIKE {whole} THEN regexp_replace({x}, {whole}, '{orders[0]}|{orders[-1]}|$4|$5')")
    for shape, year, month, day in NAMED_SHAPES:
        whole = pattern(f"^{_BLANK}{shape}{_TIME}{_BLANK}$")
        word = f"lower(substring(regexp_replace({x}, {whole}, '{month}'), 1, 3))"
        number = f"(instr('{''.join(MONTHS).lower()}', {word}) + 2) div 3"
        rest = f"regexp_replace({x}, {whole}, '-{day}||$4|$5')"
        spelled.append(f"WHEN {x} RLIKE {whole} THEN concat(regexp_replace({x}, {whole}, '{year}-'), {number}, {rest})")
    # (day, day in the other order, time, a or p), bound once so that the expression stays small.
    parts = f"split(CASE {' '.join(spelled)} END, '[|]')"
    first, second = (f"try_cast(btrim(p[{i}] || ' ' || p[2]) AS TIMESTAMP_NTZ)" for i in (0, 1))
    moved = (
        "CASE lower(p[3]) WHEN '' THEN 0 WHEN 'a' THEN if(hour(t) = 12, -12, if(hour(t) BETWEEN 1 AND 11, 0, NULL)) "
        "ELSE if(hour(t) = 12, 0, if(hour(t) BETWEEN 1 AND 11, 12, NULL)) END"
    )
    read = f"transform(array(coalesce({first}, {second})), t -> timestampadd(HOUR, {moved}, t))[0]"
    return f"CASE {' '.join(branches)} ELSE transform(array({parts}), p -> {read})[0] END"


def looks_like_date(x: str) -> str:
    return f"{x} RLIKE {pattern(f'^{_BLANK}{DATE_LOOKS}')}"


def epoch_unit(low: str, high: str) -> str:
    """'s' or 'ms' when every value between low and high is a plausible unix time."""
    return (
        f"CASE WHEN {low} >= {EPOCH_FIRST} AND {high} <= {EPOCH_LAST} THEN 's' "
        f"WHEN {low} >= {EPOCH_FIRST}000 AND {high} <= {EPOCH_LAST}000 THEN 'ms' END"
    )


def nan_to_null(x: str) -> str:
    return f"nullif({x}, double('NaN'))"


def finite(x: str) -> str:
    """Double value, or null for NaN and both infinities."""
    return f"CASE WHEN abs(double({x})) < double('Infinity') THEN double({x}) END"


def iso_text(x: str, dtype: str) -> str:
    """Text form used in reports: ISO dates, plain text for everything else."""
    return f"replace(string({x}), ' ', 'T')" if dtype.startswith("timestamp") else f"string({x})"


def shorten(x: str, limit: int = 50) -> str:
    """Text beyond the limit keeps its first limit-3 characters and gets an ellipsis."""
    return f"CASE WHEN length({x}) > {limit} THEN substring({x}, 1, {limit - 3}) || '...' ELSE {x} END"
