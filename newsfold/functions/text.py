"""Text functions on string and token-array columns. All are built-in expressions."""

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsfold import fixed_values as V


def strip(text: Column) -> Column:
    """Remove all Unicode white space at both ends."""
    return F.trim(text, F.lit(V.WHITE_SPACE))


def normalize_headline(text: Column) -> Column:
    """Lower-case, delete ASCII punctuation, strip: the input form of a scoring model."""
    return strip(F.translate(F.lower(text), V.ASCII_PUNCTUATION, ""))


def strip_site_suffix(title: Column, site_name: str) -> Column:
    """Delete every " <site name>" and then every "|". A blank left at the end stays."""
    return F.replace(F.replace(title, F.lit(f" {site_name}")), F.lit("|"))


def _apply_rules(text: Column, rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement.replace("\\", "$"))
    return text


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where one of the words occurs."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def split_sentence_ends(text: Column, abbreviations: Column | Sequence[str] = V.ABBREVIATIONS) -> Column:
    """Part the period of each sentence end from its word by a blank.

    A single period before white space ends a sentence, unless its word is a single letter or one of the abbreviations
    (lower case, without the last period): a list for all rows, or a column with the row's own array.
    """

    def stays(word: Column) -> Column:
        listed = F.array_contains(abbreviations, word) if isinstance(abbreviations, Column) else word.isin(list(abbreviations))
        return (word != "") & (listed | word.rlike(r"^\p{L}\z"))

    def parted(part: Column) -> Column:
        # No word has a blank in it, so only what is behind the last one is searched.
        tail = F.lower(F.concat(F.substring_index(part, " ", -1), F.lit(".")))
        word = F.regexp_extract(tail, V.LAST_WORD, 1)
        return F.concat(part, F.when(bound(word, stays), F.lit(".")).otherwise(F.lit(" .")))

    def all_parted(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.concat(F.array_join(F.transform(F.slice(parts, F.lit(1), last), parted), ""), F.get(parts, last))

    return F.when(text.rlike(V.SENTENCE_END), bound(F.split(text, V.PERIOD_OF_SENTENCE_END), all_parted)).otherwise(text)


def word_tokens(text: Column, abbreviations: Column | Sequence[str] = V.ABBREVIATIONS) -> Column:
    """Split text into words, contractions and punctuation by the Treebank rules.

    Most headlines have no mark that the long list of rules looks for; for them
    three rules give the same words. A period that ends a sentence is a word.
    """
    return bound(split_sentence_ends(text, abbreviations), _treebank_words)


def _treebank_words(text: Column) -> Column:
    contracted = bound(F.lower(text), lambda lowered: contains_any(lowered, V.CONTRACTED_WORDS))
    quoted = F.concat(F.lit(" "), _apply_rules(text, V.TREEBANK_BEFORE_PADDING), F.lit(" "))
    quoted = _apply_rules(quoted, V.TREEBANK_CLOSING_QUOTES)
    spaced = (
        F.when(contracted, _apply_rules(quoted, V.TREEBANK_CONTRACTIONS))
        .when(text.rlike(V.TREEBANK_MARKS) | contains_any(text, V.TREEBANK_MARK_PAIRS), quoted)
        .otherwise(_apply_rules(text, V.TREEBANK_PERIOD_AND_COMMA))
    )
    return F.filter(F.split(spaced, r"\s+"), lambda token: token != "")


def default_stop_words(languages: Sequence[str] = ("english", "italian", "dutch")) -> list[str]:
    """The stop words Spark ships for these languages, as one list."""
    return sorted({w for language in languages for w in StopWordsRemover.loadDefaultStopWords(language)})


def remove_stopwords(
    tokens: Column,
    stop_words: Sequence[str] | Mapping[str, Sequence[str]],
    lang: Column | None = None,
) -> Column:
    """Drop stop words and keep repeats of other words.

    ``stop_words`` is one list for every row, or a list per language code, which
    needs ``lang``; rows of a language without a list keep all their tokens.
    """
    if not isinstance(stop_words, Mapping):
        return F.filter(tokens, lambda token: ~token.isin(list(stop_words)))
    if lang is None:
        raise ValueError("stop words by language need a language column")
    kept = tokens
    for code, words in stop_words.items():
        kept = F.when(lang == code, remove_stopwords(tokens, words)).otherwise(kept)
    return kept


def alpha_tokens(tokens: Column) -> Column:
    """Keep tokens made of letters only."""
    return F.filter(tokens, lambda token: token.rlike(r"^\p{L}+\z"))


def render_tokens(tokens: Column) -> Column:
    """Write a token array the way Python prints a list of strings."""

    def quoted(token):
        escaped = F.replace(token, F.lit("\\"), F.lit("\\\\"))
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), escaped, F.lit('"'))
        return F.when(F.contains(token, F.lit("'")) & ~F.contains(token, F.lit('"')), double).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(tokens, quoted), ", "), F.lit("]"))


def parse_tokens(rendered: Column) -> Column:
    """The token array behind the text that ``render_tokens`` writes; null for null."""
    quoted = F.regexp_extract_all(rendered, F.lit(V.RENDERED_TOKEN), F.lit(0))

    def plain(token: Column) -> Column:
        inside = F.substring(token, F.lit(2), F.length(token) - 2)
        return F.regexp_replace(inside, r"(?s)\\(.)", "$1")

    return F.transform(quoted, plain)


def terms(text: Column) -> Column:
    """Lower-cased terms of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(V.TERM_PATTERN), F.lit(0))
