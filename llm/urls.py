"""Parts of URLs, as column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one or if null."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """From there to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """From there to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rest(url: Column) -> Column:
    """Everything behind the host."""
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*(.*)$", 1)


def reversed_host_key(url: Column) -> Column:
    """A key under which a domain, its subdomains and their pages sort together: ``com,example,www)/path?query``."""
    return F.concat(F.concat_ws(",", F.reverse(F.split(host(url), r"\."))), F.lit(")"), rest(url))
