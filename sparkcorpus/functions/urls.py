"""URL parts as Catalyst expressions that never fail on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Host in lower case without user, port and final dot; '' where the URL has none."""
    authority = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:\d*)?$", "")


def path(url: Column) -> Column:
    """Path percent-decoded and without slashes at its ends; a path with broken escapes stays as it is."""
    raw = F.regexp_extract(url, _PATH, 1)
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw), r"^/+|/+$", "")


def permalink(url: Column) -> Column:
    """The article's permalink: its path, or '' for pages of the kind the site map lists but the store leaves out."""
    p = path(url)
    return F.when(p.startswith(".temaside"), F.lit("")).otherwise(p)
