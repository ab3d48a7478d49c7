"""Abbreviations learned from the corpus, language by language: words whose period does not end a sentence.

The measure is that of Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006), for word types: how
much likelier the counts of a word with and without a period are if it nearly always had one than if it had one as often as
any word, scaled down for long words and for words that often go without.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.session import lookup_join, reliable_checkpoint


def period_words(text: Column) -> Column:
    """The words of a text, lower-cased, each with the period behind it, if there is one.

    A word begins with a letter; inside are letters, digits, hyphens, apostrophes and single periods between letters. An
    ellipsis is no period.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(V.PERIOD_WORD), F.lit(0))


def abbreviation_scores(df: DataFrame, text: str = "article_title", lang: str = "lang") -> DataFrame:
    """``lang``, ``word``, ``with_period``, ``without_period`` and ``score`` of all words that occur with a period.

    One count of words with and without period, summed in map tasks first, is all that is shuffled; what the measure needs
    of a language is summed up from it. Null texts have no words; rows without a language are one language.
    """
    words = df.select(F.col(lang).alias("lang"), F.explode(period_words(F.col(text))).alias("found"))
    bare = F.regexp_replace("found", r"\.$", "")
    ends = F.col("found").endswith(".").cast("long")
    counts = words.groupBy("lang", bare.alias("word")).agg(F.sum(ends).alias("with_period"), F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("with_period").alias("periods"), F.sum("n").alias("total"))
    candidates = counts.filter("with_period > 0")
    joined = candidates.join(F.broadcast(totals), candidates["lang"].eqNullSafe(totals["lang"])).select(candidates["*"], "periods", "total")
    p = F.col("periods") / F.col("total")
    without = F.col("n") - F.col("with_period")

    def likelihood(chance: Column) -> Column:
        # A language in which every word has a period: nothing speaks for the rest.
        return F.col("with_period") * F.log(chance) + F.when(without > 0, without * F.log(1 - chance)).otherwise(F.lit(0.0))

    ratio = -2 * (likelihood(p) - likelihood(F.lit(V.ABBREVIATION_CHANCE)))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    scaled = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -without)
    return joined.select("lang", "word", "with_period", without.alias("without_period"), scaled.alias("score"))


def learned_abbreviations(df: DataFrame, text: str = "article_title", lang: str = "lang", least: float = V.ABBREVIATION_SCORE) -> DataFrame:
    """``lang`` and ``abbreviations`` (a sorted array) for each language that has any: words of a score of ``least`` or more."""
    found = abbreviation_scores(df, text, lang).filter(F.col("score") >= least)
    return found.groupBy("lang").agg(F.array_sort(F.collect_set("word")).alias("abbreviations"))


def with_abbreviations(df: DataFrame, table: DataFrame, out: str = "abbreviations", lang: str = "lang") -> DataFrame:
    """Add the array of the row's language; empty where the table has none. The table is broadcast if it is small.

    It has a row a language, but a pass over all texts may be behind it: it is written first, so that its size check and
    the join don't make that pass each.
    """
    named = reliable_checkpoint(table.select(F.col("lang").alias(lang), F.col("abbreviations").alias(out)))
    return lookup_join(df, named, [lang]).withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>")))
