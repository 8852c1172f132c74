"""Field validators (account names, mail, phone, URLs) as native predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: acceptance patterns that must equal the reference's
# Java spelling of full-string matches: ^(?:...)\z.  (?d): only '\n' ends a
# line, as in Python, so '$' also accepts one trailing '\n' where the
# reference used re.match with '$'.
ACCOUNT_NAME_PATTERN = r"(?d)^[a-zA-Z0-9_.-]*$"
MAIL_PATTERN = r"^(?:\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b)\z"
PHONE_PATTERN = r"^(?:\+[0-9]*)\z"
URL_PATTERN = (
    r"(?iU)^(?:http|ftp)s?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|"
    r"localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?"
    r"(?:/?|[/?]\S+)(?d)$"
)
ACCOUNT_NAME_MAX = 20
DISPLAY_NAME_MAX = 20
MAIL_MAX = 50
PHONE_MAX = 16
# --- end of fixed values


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def account_name_ok(c, size: int = ACCOUNT_NAME_MAX) -> Column:
    c = _as_col(c)
    return c.isNotNull() & (F.length(c) <= size) & c.rlike(ACCOUNT_NAME_PATTERN)


def mail_ok(c, size: int = MAIL_MAX) -> Column:
    c = _as_col(c)
    return c.isNotNull() & (F.length(c) <= size) & c.rlike(MAIL_PATTERN)


def phone_ok(c, size: int = PHONE_MAX) -> Column:
    c = _as_col(c)
    return c.isNotNull() & (F.length(c) <= size) & c.rlike(PHONE_PATTERN)


def url_origin(url) -> Column:
    """``scheme://host[:port]`` of an absolute URL, else null."""
    o = F.regexp_extract(_as_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(o != "", o)


def normalize_url(url, origin) -> Column:
    """``//x`` -> ``https://x``; ``/x`` -> origin + ``/x``; keep only valid URLs."""
    url, origin = _as_col(url), _as_col(origin)
    full = (F.when(url.startswith("//"), F.concat(F.lit("https:"), url))
             .when(url.startswith("/"), F.concat(origin, url))
             .otherwise(url))
    return F.when(full.rlike(URL_PATTERN), full)
