"""Learned abbreviations: the published measure, and a labelled set of headlines."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.functions import text
from newsfold.operators import abbreviations

#: Language, abbreviations that its headlines use, ordinary words. "am" ends sentences and is no abbreviation in English here.
LANGUAGES = {
    "de": (["bzw", "dr", "z.b", "hr", "nr"], "minister regierung heute morgen zug stadt wetter sagt neue alte haus am bahn streik berlin köln weiter wieder gegen"),
    "it": (["dott", "sig", "ing", "p.es", "on"], "governo ministro oggi domani treno città tempo dice nuova vecchia casa sciopero roma milano ancora contro dopo prima"),
    "nl": (["dhr", "mevr", "bv", "m.b.t", "drs"], "minister regering vandaag morgen trein stad weer zegt nieuwe oude huis staking utrecht leiden opnieuw tegen na voor"),
    "en": (["mr", "gov", "approx", "vs", "e.g"], "minister government today tomorrow train city weather says new old house am strike london leeds again against after before"),
}


def headline(rng, lang):
    """A headline of two sentences, and its words: the first sentence's period is one, an abbreviation's is not."""
    short, words = LANGUAGES[lang]
    words = words.split()
    pick = lambda k: rng.choices(words, k=k)
    first, second = pick(rng.randrange(2, 5)), pick(rng.randrange(2, 5))
    inside = rng.choice(short) + "."
    first.insert(rng.randrange(len(first)), inside)
    return " ".join(first) + ". " + " ".join(second), [*first, ".", *second]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    rows = [(lang, headline(rng, lang)[0]) for lang in LANGUAGES for _ in range(400)]
    return spark.createDataFrame(rows, "lang string, article_title string")


def test_a_hundred_labelled_headlines(spark, corpus):
    rng = random.Random(99)
    labelled = [(lang, *headline(rng, lang)) for lang in LANGUAGES for _ in range(25)]
    assert len(labelled) == 100
    df = spark.createDataFrame(labelled, "lang string, article_title string, words array<string>")
    table = abbreviations.learned_abbreviations(corpus)
    found = abbreviations.with_abbreviations(df, table).select("words", text.word_tokens(F.col("article_title"), F.col("abbreviations")).alias("found"))
    wrong = [(r.words, r.found) for r in found.collect() if r.words != r.found]
    assert len(wrong) <= 2, wrong[:3]
    learned = {r.lang: r.abbreviations for r in table.collect()}
    for lang, (short, words) in LANGUAGES.items():
        assert set(short) <= set(learned[lang])
        assert not set(words.split()) & set(learned[lang])


def test_scores_equal_the_formula(spark):
    lines = ["Dr. Who met dr. No.", "who knows... the doctor.", "The no. of i.e. e.g. things", None, "", "1.5 3. x-ray. l'été. l'été", "dr who"]
    df = spark.createDataFrame([("en", t) for t in lines] + [(None, "wer. so"), (None, "so")], "lang string, article_title string")
    words = {
        "en": "dr. who met dr. no. who knows the doctor. the no. of i.e. e.g. things x-ray. l'été. l'été dr who".split(),
        None: "wer. so so".split(),
    }
    expected = {}
    for lang, found in words.items():
        periods, every = Counter(w[:-1] for w in found if w.endswith(".")), Counter(w.rstrip(".") for w in found)
        p = sum(periods.values()) / len(found)
        for w, many in periods.items():
            few = every[w] - many
            ratio = -2 * (many * math.log(p) + few * math.log(1 - p) - many * math.log(0.99) - few * math.log(0.01))
            letters = len(w.replace(".", ""))
            expected[lang, w] = (many, few, ratio * math.exp(-letters) * (w.count(".") + 1) * letters**-few)
    told = {(r.lang, r.word): (r.with_period, r.without_period, r.score) for r in abbreviations.abbreviation_scores(df).collect()}
    assert told.keys() == expected.keys()
    for key, (many, few, score) in expected.items():
        assert told[key][:2] == (many, few) and told[key][2] == pytest.approx(score)


def test_nothing_learned(spark):
    df = spark.createDataFrame([("en", "a b c"), ("xx", None)], "lang string, article_title string")
    table = abbreviations.learned_abbreviations(df)
    assert table.count() == 0
    assert [r.abbreviations for r in abbreviations.with_abbreviations(df, table).collect()] == [[], []]
    every = spark.createDataFrame([("en", "ab. cd. ef.")], "lang string, article_title string")
    assert all(r.score <= V.ABBREVIATION_SCORE for r in abbreviations.abbreviation_scores(every).collect())


def test_learned_table_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame([("en", ["mr"])], "lang string, abbreviations array<string>").mapInArrow(count, "lang string, abbreviations array<string>")
    df = spark.createDataFrame([("en",), ("de",), (None,)], "lang string")
    found = {r["lang"]: r["abbreviations"] for r in abbreviations.with_abbreviations(df, table).collect()}
    assert found == {"en": ["mr"], "de": [], None: []} and made.value == 1
