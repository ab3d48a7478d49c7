"""Names of languages, domains and article types."""

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsfold import fixed_values as V

# Most entries a name list may have before it no longer belongs in a plan.
MAX_LIST = 20_000


def _named(key: Column, names: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])[key]


def lang_code(name: Column, codes: Mapping[str, str] = V.LANGUAGE_CODES) -> Column:
    """ISO code of a language name; null where unknown."""
    return _named(name, codes)


def lang_name(code: Column, codes: Mapping[str, str] = V.LANGUAGE_CODES) -> Column:
    """Language name of an ISO code; null where unknown."""
    return _named(code, {c: n for n, c in codes.items()})


def domain_name(domain: Column, names: Mapping[str, str] = V.DOMAIN_NAMES) -> Column:
    """Display name of a domain; null where unknown."""
    return _named(domain, names)


def article_type(label: Column, for_file: bool = False) -> Column:
    """"sarcastic" for label 1, else "non-sarcastic"; with "_" in file names."""
    return F.when(label == 1, "sarcastic").otherwise("non_sarcastic" if for_file else "non-sarcastic")


def registered_domain(
    url: Column, suffixes: Sequence[str] = V.DOMAIN_SUFFIXES, allow: Sequence[str] | None = None
) -> Column:
    """Domain and public suffix of a URL's host, by the longest listed suffix.

    Null for hosts without a listed suffix, for bare suffixes and, where
    ``allow`` is given, for domains outside it. The lists are part of the plan;
    for long ones there is ``operators.domains.with_registered_domain``.
    """
    if max(len(suffixes), len(allow or ())) > MAX_LIST:
        raise ValueError(f"at most {MAX_LIST} entries; use operators.domains for more")
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    parts = F.split(F.when(~host.isin(list(suffixes)), host), r"\.")
    tails = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
        lambda i: F.struct(
            F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("suffix"),
            F.array_join(F.slice(parts, i - 1, F.size(parts)), ".").alias("domain"),
        ),
    )
    domain = F.get(F.filter(tails, lambda t: t["suffix"].isin(list(suffixes))), F.lit(0))["domain"]
    return domain if allow is None else F.when(domain.isin(list(allow)), domain)
