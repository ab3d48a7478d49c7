import re
import string

import pytest
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.functions import labels, text
from newsfold.operators import tokens


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("value", [" a b ", "\t\na ", "\x1fa　", "", " ", "a", None])
def test_strip_equals_python(spark, value):
    assert one(spark, text.strip, value) == (None if value is None else value.strip())


@pytest.mark.parametrize(
    "value",
    [
        "CIA Realizes It's Been Using Black Highlighters All These Years.",
        " " + string.punctuation + "É “x” ",
        "naïve ÀÉ-Ö …",
    ],
)
def test_normalize_headline(spark, value):
    expected = value.lower().translate(str.maketrans("", "", string.punctuation)).strip()
    assert one(spark, text.normalize_headline, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("abc Lercio x | Lercio", "abc x "),
        ("plain title", "plain title"),
        ("a | b | Lercio", "a  b "),
        ("Lercio first", "Lercio first"),
    ],
)
def test_strip_site_suffix(spark, value, expected):
    assert one(spark, lambda c: text.strip_site_suffix(c, "Lercio"), value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("good muffins cost $3.88 in new york.", "good muffins cost $ 3.88 in new york ."),
        ("they'll save and invest more.", "they 'll save and invest more ."),
        ("hi, my name can't hello,", "hi , my name ca n't hello ,"),
        ("it's 10:30, isn't it?", "it 's 10:30 , is n't it ?"),
        ('"quoted" words', "`` quoted '' words"),
        ("i cannot and gonna wanna go", "i can not and gon na wan na go"),
        ("a--b (c) [d] {e}", "a -- b ( c ) [ d ] { e }"),
        ("wait... what?!", "wait ... what ? !"),
        ("well-known state-of-the-art", "well-known state-of-the-art"),
        ("l'été à l'école", "l'été à l'école"),
        ("the dogs' bones", "the dogs ' bones"),
        ("by j. r. r. tolkien. it ends.", "by j. r. r. tolkien . it ends ."),
        ("e.g. mr. smith", "e.g. mr. smith"),
        ("the u.s. dr. no", "the u.s. dr. no"),
        ("u.s. u.k. e.g. a.m. all of them", "u.s. u.k. e.g. a.m. all of them"),
        ("it's. that's it. what... a\x01bc. so", "it 's . that 's it . what ... a\x01bc . so"),
        ("(mr. x.) no.  yes.\tmaybe", "( mr. x. ) no . yes . maybe"),
        ("", ""),
        ("   ", ""),
    ],
)
def test_word_tokens(spark, value, expected):
    assert one(spark, text.word_tokens, value) == expected.split()


def test_stop_words_keep_repeats_and_nulls(spark):
    df = spark.createDataFrame([("en", ["the", "cat", "cat"]), ("fr", ["the", "le"]), (None, ["the"])], "lang string, t array<string>")
    everywhere = [r[0] for r in df.select(text.remove_stopwords(F.col("t"), ["the", "le"])).collect()]
    assert everywhere == [["cat", "cat"], [], []]
    by_lang = text.remove_stopwords(F.col("t"), {"en": ["the"], "fr": ["le"]}, F.col("lang"))
    assert [r[0] for r in df.select(by_lang).collect()] == [["cat", "cat"], ["the"], ["the"]]
    with pytest.raises(ValueError):
        text.remove_stopwords(F.col("t"), {"en": ["the"]})


def test_alpha_tokens(spark):
    words = ["abc", "été", "a1", "'s", "日本", "", "x-y", "ß"]
    df = spark.createDataFrame([(words,)], "t array<string>")
    assert df.select(text.alpha_tokens(F.col("t"))).first()[0] == [w for w in words if w.isalpha()]


@pytest.mark.parametrize("value", [[], ["a"], ["a", "b c"], ["it's"], ['say "x"'], ["b'oth\""], ["back\\slash"]])
def test_render_tokens_equals_python(spark, value):
    df = spark.createDataFrame([(value,)], "t array<string>")
    assert df.select(text.render_tokens(F.col("t"))).first()[0] == str(value)


def test_terms(spark):
    assert one(spark, text.terms, "A bc, D_e l'été 12 x") == ["bc", "d_e", "été", "12"]


def test_lemmatize(spark):
    df = spark.createDataFrame(
        [(1, "en", ["was", "better", "was"], ["VBD", "JJR", "NN"]), (2, "it", ["was"], ["VBD"]), (3, "en", [], [])],
        "id long, lang string, t array<string>, tags array<string>",
    )
    table = spark.createDataFrame(
        [("en", "was", "v", "be"), ("en", "better", "a", "good"), ("en", "was", "n", "wa")],
        "lang string, word string, pos string, lemma string",
    )
    tagged = tokens.lemmatize(df, ["id", "lang"], "t", table, tags="tags")
    assert {r["id"]: r["lemmas"] for r in tagged.collect()} == {1: ["be", "good", "wa"], 2: ["was"], 3: []}
    nouns = tokens.lemmatize(df, ["id", "lang"], "t", table)
    assert {r["id"]: r["lemmas"] for r in nouns.collect()} == {1: ["wa", "better", "wa"], 2: ["was"], 3: []}


def test_lemmatize_with_a_large_table_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "en", ["was", "x", "was"]) for i in range(50)], "id long, lang string, t array<string>")
    table = spark.createDataFrame([("en", "was", "n", "be"), ("en", "y", "n", "z")], "lang string, word string, pos string, lemma string")


    def found():
        return {r["id"]: r["lemmas"] for r in tokens.lemmatize(df, ["id", "lang"], "t", table).collect()}

    small = found()
    monkeypatch.setattr(tokens, "DICTIONARY_ROWS", 1)  # the words that occur fit
    fitting = found()
    monkeypatch.setattr(tokens, "DICTIONARY_ROWS", 0)  # they don't
    joined = found()
    monkeypatch.setattr("newsfold.session.BROADCAST_ROWS", 1)
    assert small == fitting == joined == found() == {i: ["be", "x", "be"] for i in range(50)}


def test_lemmatize_of_odd_rows(spark, monkeypatch):
    """Null and empty arrays, null tokens, other lengths of tags, repeated rows and names that might clash."""
    rows = [(1, "en", ["was", None, "is"], ["VBD"], "a"), (1, "en", ["was", None, "is"], ["VBD"], "a"), (2, None, ["was"], ["N", "V"], "b"), (3, "en", None, None, "c"), (4, "en", [], ["V"], "d"), (5, "en", ["is"], None, "e")]
    df = spark.createDataFrame(rows, "row long, lang string, t array<string>, tags array<string>, lemma string")
    table = spark.createDataFrame([("en", "was", "v", "be"), ("en", "is", "n", "be'\"\\"), (None, "was", "n", "no")], "lang string, word string, pos string, lemma string")
    expected = [(1, "a", ["be", None, "be'\"\\"])] * 2 + [(2, "b", ["was"]), (3, "c", []), (4, "d", []), (5, "e", ["be'\"\\"])]

    def found():
        return sorted((r["row"], r["lemma"], r["lemmas"]) for r in tokens.lemmatize(df, ["row", "lang", "lemma"], "t", table, tags="tags").collect())

    assert found() == expected
    monkeypatch.setattr(tokens, "DICTIONARY_ROWS", 0)
    assert found() == expected
    assert tokens.lemmatize(df.limit(0), ["row", "lang"], "t", table).count() == 0


def test_lemmatize_shuffles_no_tokens(spark):
    df = spark.createDataFrame([(1, "en", ["was"])], "id long, lang string, t array<string>")
    table = spark.createDataFrame([("en", "was", "n", "be")], "lang string, word string, pos string, lemma string")
    plan = tokens.lemmatize(df, ["id", "lang"], "t", table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://www.huffingtonpost.com/a/b", "huffingtonpost.com"),
        ("http://Speld.NL", "speld.nl"),
        ("https://a.b.shop.co.uk/x", "shop.co.uk"),
        ("https://co.uk/x", None),
        ("https://x.uk:80/", "x.uk"),
        ("https://localhost/", None),
        ("no url", None),
        (None, None),
    ],
)
def test_registered_domain(spark, url, expected):
    suffixes = ("nl", "com", "uk", "co.uk")
    assert one(spark, lambda c: labels.registered_domain(c, suffixes), url) == expected


def test_registered_domain_allow_list(spark):
    domain = lambda c: labels.registered_domain(c, ("nl", "com"), ("speld.nl",))
    assert one(spark, domain, "https://speld.nl/x") == "speld.nl"
    assert one(spark, domain, "https://other.nl/x") is None


def test_names(spark):
    assert one(spark, labels.lang_code, "Dutch") == "nl"
    assert one(spark, labels.lang_code, "Klingon") is None
    assert one(spark, labels.lang_name, "it") == "Italian"
    assert one(spark, labels.domain_name, "nos.nl") == "NOS (nl)"


def test_each_part_is_searched_once_and_only_its_last_word(spark):
    texts = ["He saw Mr. Smith. Then l'etc. came", "a\tmr. x", "x  vs. y. Z", "é. b. c.d. e", "(mr. a", "..mr. a", "\u00a0mr. a", "no. end.", ". x", "A.  B", "MR. A"]
    df = spark.createDataFrame([(i, t, ["mr", "x", "c.d"]) for i, t in enumerate(texts)], "id int, t string, own array<string>")

    def by_hand(t, words):
        out = re.split(r"(?<=[^.\s]\.)(?=\s)", t)
        for i, part in enumerate(out[:-1]):
            found = re.search(r"(?:^|[^\w.'’])(\w+(?:\.\w+)*)\.\Z", part.lower())
            word = found[1] if found else ""
            out[i] = part if word and (word in words or re.fullmatch(r"[^\W\d_]", word)) else part[:-1] + " ."
        return "".join(out)

    rows = df.select("t", "own", text.split_sentence_ends(F.col("t")).alias("listed"), text.split_sentence_ends(F.col("t"), F.col("own")).alias("named")).collect()
    for r in rows:
        assert r["listed"] == by_hand(r["t"], V.ABBREVIATIONS), r["t"]
        assert r["named"] == by_hand(r["t"], r["own"]), r["t"]
    plan = df.select(text.split_sentence_ends(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1
