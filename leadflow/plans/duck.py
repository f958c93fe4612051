"""DuckDB twins of the column helpers, used only to write oracle SQL.

Each function returns a SQL expression text with the same semantics as the
Spark helper of the same name in ``leadflow.functions.columns``, written out
independently of it: no pattern is shared.
"""

from __future__ import annotations

_DATE_FORMATS = [
    "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y",
    "%b %d, %Y", "%B %d, %Y", "%b %d %Y", "%B %d %Y", "%d %b %Y", "%d %B %Y", "%d-%b-%Y", "%a, %d %b %Y"]
_CLOCK = ("(?i)[t ] *([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]{1,9})?)?( ?[ap]m)?"
          "( ?(z|utc|[+-][0-9][0-9](:?[0-9][0-9])?))?$")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def coerce_date(c: str) -> str:
    day = f"regexp_replace(trim(CAST({c} AS VARCHAR)), {q(_CLOCK)}, '')"
    formats = ", ".join(map(q, _DATE_FORMATS))
    # The year has four digits, at the start or the end.
    return (f"(CASE WHEN regexp_matches({day}, '^[0-9]{{4}}[^0-9].*[0-9]$|[^0-9][0-9]{{4}}$|^[0-9]{{8}}$') "
            f"THEN CAST(try_strptime({day}, [{formats}]) AS DATE) END)")


def in_range(c: str, start: str, end: str) -> str:
    return f"coalesce({coerce_date(c)} BETWEEN DATE {q(start)} AND DATE {q(end)}, false)"


def to_number(c: str) -> str:
    t = f"trim(CAST({c} AS VARCHAR))"
    number = "[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[-+]?[0-9]+)?|[-+]?(inf|infinity|nan)"
    v = f"(CASE WHEN regexp_full_match(lower({t}), {q(number)}) THEN coalesce(TRY_CAST({t} AS DOUBLE), 0.0) ELSE 0.0 END)"
    return f"(CASE WHEN isnan({v}) THEN 0.0 ELSE {v} END)"


def safe_divide(n: str, d: str) -> str:
    qd = f"(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0.0))"
    return f"(CASE WHEN {qd} IS NULL OR isnan({qd}) OR isinf({qd}) THEN 0.0 ELSE {qd} END)"


def rate(n: str, d: str) -> str:
    return f"({safe_divide(n, d)} * 100.0)"


def count_if(cond: str) -> str:
    return f"CAST(count_if({cond}) AS BIGINT)"


def month_of(c: str) -> str:
    return f"strftime({c}, '%Y-%m')"


def weekday_of(c: str) -> str:
    return f"dayname({c})"


def uri_tail(c: str) -> str:
    return f"string_split({c}, '/')[-1]"


def nearest_double(decimal: str) -> str:
    """The double nearest to a decimal. DuckDB's direct cast (and that of a double to a decimal)
    can miss it by one place, as it scales in doubles; its reading of text does not."""
    return f"CAST(CAST({decimal} AS VARCHAR) AS DOUBLE)"
