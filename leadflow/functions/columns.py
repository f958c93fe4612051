"""Column helpers (all JVM-side expressions, no Python UDFs).

Every helper takes and returns a ``Column`` so it composes inside
``select``/``filter``/``agg`` and stays in whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt
import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Patterns for the accepted date texts; a time and offset may follow any of them.
_OFFSET = r"(?:Z|UTC|[+-]\d{2}(?::?\d{2})?)"
_TIME = r"(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,9})?)?"
_MONTH = (r"(?=(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
          r"sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b)([a-z]{3})[a-z]*\.?")
ISO_DATE_RE = rf"^\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]{_TIME})?{_OFFSET}?$"
# Applied in turn, these bring a text to year-month-day.
DATE_FORMS = (
    (rf"(?i)[T ] *{_TIME}(?: ?[ap]m)?(?: ?{_OFFSET})?$", ""),
    (r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?,? +", ""),
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"),
    (r"^(1[3-9]|[2-9]\d)([-/.])(\d{1,2})\2(\d{4})$", "$4-$3-$1"),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$", "$4-$1-$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (rf"(?i)^{_MONTH} +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}})$", "$3-$1-$2"),
    (rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH},?[ -](\d{{4}})$", "$3-$2-$1"),
)
_YMD_RE = r"^\d{4}-(?:\d{1,2}|[A-Za-z]{3})-\d{1,2}$"
EMBEDDED_DATE_RE = r"\d{4}-\d{2}-\d{2}"
# Plain decimal / scientific numbers and the special float words.
PLAIN_NUMBER_RE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
SPECIAL_NUMBER_RE = r"^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
RUN_FILE_RE = r"(\d{8}_\d{6})"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _memo_on_names(fn):
    """Reuse the built Column when every argument is a plain value (column
    names, dates): expression trees are immutable, and building them costs
    one JVM round trip per node."""
    cached = functools.lru_cache(maxsize=512)(fn)

    @functools.wraps(fn)
    def wrapper(*args):
        try:
            return cached(*args)
        except TypeError:           # a Column argument: not hashable
            return fn(*args)
    return wrapper


# Two-digit years, at the end of the day texts above.
_SHORT_YEAR_RE = rf"(?i)^(\d{{1,2}}([-/.])\d{{1,2}}\2|{_MONTH} +\d{{1,2}}(?:st|nd|rd|th)?,? +|\d{{1,2}}(?:st|nd|rd|th)?[ -]{_MONTH},?[ -])(\d{{2}})$"


@_memo_on_names
def coerce_date(c: ColumnOrName, pivot_year: int | None = None) -> Column:
    """Mixed-format text -> ``DateType``; unparsable text -> null.

    Accepted: year first (``2024-01-05``, ``2024/1/5``, ``20240105``), year last
    with ``-``, ``/`` or ``.`` (month first; day first where the first number is over
    12) and month names (``Jan 5, 2024``, ``5-Jan-2024``), each with an optional
    weekday before and time and offset after it (the *written* wall date is kept,
    never shifted). Impossible calendar dates give null.
    Date and timestamp inputs are converted directly.

    A two-digit year gives null, as its century depends on the reader's time, unless
    ``pivot_year`` names the last year it may mean: with 2030, ``30`` is 2030 and ``31`` is 1931.
    """
    t = F.trim(_col(c).cast("string"))
    day = t
    for i, (pattern, to) in enumerate(DATE_FORMS):
        if i == 2 and pivot_year is not None:       # time and weekday are off
            short = F.regexp_extract(day, _SHORT_YEAR_RE, 5)
            year = F.lit(pivot_year) - F.pmod(F.lit(pivot_year) - short.try_cast("int"), F.lit(100))
            day = F.when(short == "", day).otherwise(F.concat(F.regexp_extract(day, _SHORT_YEAR_RE, 1), year.cast("string")))
        day = F.regexp_replace(day, pattern, to)
    day = F.regexp_extract(day, _YMD_RE, 0)
    return (F.when(t.rlike(ISO_DATE_RE), F.substring(t, 1, 10).try_cast("date"))
             .otherwise(F.coalesce(day.try_cast("date"), F.try_to_date(day, "yyyy-MMM-d"))))


@_memo_on_names
def in_date_range(c: ColumnOrName, start, end) -> Column:
    """Inclusive range test on the coerced date; null dates are outside."""
    first, last = ((_as_date(x) - _dt.date(1970, 1, 1)).days for x in (start, end))
    # As a distance from the middle (in half days), which names the date once only:
    # `between` would parse the text twice.
    off_middle = F.abs(F.unix_date(coerce_date(c)).cast("long") * 2 - F.lit(first + last))
    return F.coalesce(off_middle <= F.lit(last - first), F.lit(False))


def _as_date(v):
    if isinstance(v, _dt.datetime):
        return v.date()
    if isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v)[:10])


def extract_date(c: ColumnOrName) -> Column:
    """First ``dddd-dd-dd`` inside the text as a string, else null.

    No calendar check (``2024-13-45`` is returned as is).
    """
    return F.nullif(F.regexp_extract(_col(c), EMBEDDED_DATE_RE, 0), F.lit(""))


@_memo_on_names
def to_number(c: ColumnOrName) -> Column:
    """Text -> double; non-numbers, blanks, nulls and NaN -> 0.0.

    Only plain decimal/scientific numbers and inf/nan words are numbers
    (Spark alone would also accept ``1d``/``1f`` suffixes and hex).
    Infinity is kept, as a numeric coercion does.
    """
    t = F.trim(_col(c).cast("string"))
    ok = t.rlike(PLAIN_NUMBER_RE) | t.rlike(SPECIAL_NUMBER_RE)
    v = F.when(ok, t.try_cast("double"))
    return F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0))


def safe_divide(n: ColumnOrName, d: ColumnOrName) -> Column:
    """``n / d`` with 0 for a zero/null denominator and for NaN or +-inf."""
    q = F.try_divide(_col(n).cast("double"), _col(d).cast("double"))
    return (F.when(q.isNull() | F.isnan(q) | (F.abs(q) == F.lit(float("inf"))),
                   F.lit(0.0))
             .otherwise(q))


def rate(n: ColumnOrName, d: ColumnOrName) -> Column:
    """Percentage: ``safe_divide(n, d) * 100``."""
    return safe_divide(n, d) * F.lit(100.0)


def revenue_per(revenue: ColumnOrName, base: ColumnOrName) -> Column:
    return safe_divide(revenue, base)


def month_of(c: ColumnOrName) -> Column:
    """``yyyy-MM`` calendar month."""
    return F.date_format(_col(c), "yyyy-MM")


def weekday_of(c: ColumnOrName) -> Column:
    """English weekday name (``Monday`` ...)."""
    return F.date_format(_col(c), "EEEE")


def uri_tail(c: ColumnOrName) -> Column:
    """Last ``/``-separated path segment."""
    return F.element_at(F.split(_col(c), "/"), -1)


def key_hash(c: ColumnOrName) -> Column:
    """SHA-256 hex digest of the plain key text."""
    return F.sha2(_col(c).cast("string"), 256)


def key_id(c: ColumnOrName) -> Column:
    """Key id: first 8 hex characters of the key hash (input: the hash)."""
    return F.substring(_col(c), 1, 8)


def is_expired(expires_at: ColumnOrName, now) -> Column:
    """``now > expires_at``; a null expiry never expires."""
    e = _col(expires_at)
    return F.coalesce(F.lit(now).cast("timestamp") > e.cast("timestamp"), F.lit(False))


def is_valid(is_active: ColumnOrName, expires_at: ColumnOrName, now) -> Column:
    return _col(is_active) & ~is_expired(expires_at, now)


def run_timestamp_from_name(c: ColumnOrName) -> Column:
    """``combined_output_20240102_030405.csv`` -> timestamp 2024-01-02 03:04:05."""
    s = F.regexp_extract(_col(c), RUN_FILE_RE, 1)
    return F.try_to_timestamp(F.nullif(s, F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def truthy_or(new: ColumnOrName, old: ColumnOrName, kind: str = "string") -> Column:
    """Python-truthiness patch: keep ``old`` when ``new`` is null or falsy
    (``''`` for text, ``0`` for numbers)."""
    n = _col(new)
    falsy = F.lit("") if kind == "string" else F.lit(0)
    return F.coalesce(F.nullif(n, falsy), _col(old))
