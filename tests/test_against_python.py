"""Column functions against Python's own, over many random texts in one job each."""

import random
import re
import string

import pytest
import regex
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.functions import html, text

PIECES = (
    list("abcXYZ019éßñœ日") + list(string.punctuation) + list(" \t\n\r\x1f\xa0\u2003") + list("«»“”‘’„")
    + ["...", "--", "''", "``", "n't", "'s", "'ll", "cannot", "gonna", "wanna ", "'tis ", "<b>", "</i\r>", "<a\n>", "&amp;", "&#39;", "&AMP;", "1.5", ", "]
    + [" "] * 20
)


def texts(seed, n=600):
    draw = random.Random(seed)
    return ["".join(draw.choices(PIECES, k=draw.randrange(14))) for _ in range(n)]


def evaluated(spark, column, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(column(F.col("c"))).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_clean_strip_normalize(spark, seed):
    values = texts(seed)
    assert evaluated(spark, html.clean_html, values) == [re.sub(V.MARKUP_PATTERN, "", v) for v in values]
    assert evaluated(spark, text.strip, values) == [v.strip() for v in values]
    no_marks = str.maketrans("", "", string.punctuation)
    assert evaluated(spark, text.normalize_headline, values) == [v.lower().translate(no_marks).strip() for v in values]


@pytest.mark.parametrize("seed", [3, 4])
def test_word_tokens_equal_all_rules(spark, seed):
    """The short way for plain texts gives what the whole rule list gives."""

    def applied(value, rules):
        for pattern, replacement in rules:
            pattern = regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), pattern).replace(r"\s", r"[ \t\n\x0b\f\r]")
            pattern = pattern.replace("[^.[ \\t\\n\\x0b\\f\\r]]", "[^. \\t\\n\\x0b\\f\\r]")
            value = regex.sub(pattern.replace("[^[ \\t\\n\\x0b\\f\\r]]", "[^ \\t\\n\\x0b\\f\\r]"), replacement, value)
        return value

    def ended(value):
        parts = regex.split(r"(?<=[^. \t\n\x0b\f\r]\.)(?=[ \t\n\x0b\f\r])", value)
        for i, part in enumerate(parts[:-1]):
            word = regex.search(V.LAST_WORD.replace(r"\z", r"\Z"), part.lower())
            if not word or word[1] not in V.ABBREVIATIONS and not regex.fullmatch(r"\p{L}", word[1]):
                parts[i] = part[:-1] + " ."
        return "".join(parts)

    def expected(value):
        value = applied(ended(value), V.TREEBANK_BEFORE_PADDING)
        return [t for t in regex.split(r"[ \t\n\x0b\f\r]+", applied(f" {value} ", V.TREEBANK_AFTER_PADDING)) if t]

    values = texts(seed)
    for value, found in zip(values, evaluated(spark, text.word_tokens, values)):
        assert found == expected(value), value


def test_alpha_and_terms(spark):
    values = texts(5)
    df = spark.createDataFrame([(re.findall(r"\S+", v),) for v in values], "t array<string>")
    assert [r[0] for r in df.select(text.alpha_tokens(F.col("t"))).collect()] == [[w for w in re.findall(r"\S+", v) if w.isalpha()] for v in values]
    assert evaluated(spark, text.terms, values) == [re.findall(r"\w\w+", v.lower()) for v in values]


def test_default_stop_words(spark):
    words = text.default_stop_words()
    assert {"the", "della", "het"} <= set(words) and words == sorted(set(words))
