"""Token operators that need a lookup table."""

from collections.abc import Sequence
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.session import lookup_join, reliable_checkpoint, unused_name

#: Entries that a dictionary in the plan may have; a larger one is joined.
DICTIONARY_ROWS = 100_000
#: Characters of its words and lemmas.
DICTIONARY_CHARS = 8_000_000
_ENTRY = "array<array<struct<lang: string, word: string, pos: string, lemma: string>>>"


def _word_class(tag: Column | None) -> Column:
    found = F.lit(V.DEFAULT_WORD_CLASS)
    if tag is not None:
        for letter, name in V.WORD_CLASSES.items():
            found = F.when(F.startswith(tag, F.lit(letter)), F.lit(name)).otherwise(found)
    return found


def _slot(slots: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def _bounded(lemmas: DataFrame) -> list | None:
    """The table's rows, or None if they are too many or too long for the plan."""
    size = F.sum(F.length("word") + F.length("lemma"))
    n, chars = lemmas.limit(DICTIONARY_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if n > DICTIONARY_ROWS or chars > DICTIONARY_CHARS:
        return None
    slots = 1 << max(1, n.bit_length())
    rows = lemmas.select(_slot(slots, F.col("lang"), F.col("word"), F.col("pos")).alias("slot"), "*").collect()
    table: list = [[] for _ in range(slots)]
    for row in rows:
        table[row["slot"]].append(row.asDict() | {"slot": None})
    return table


def lemmatize(
    df: DataFrame, keys: Sequence[str], tokens: str, lemmas: DataFrame, out: str = "lemmas", tags: str | None = None
) -> DataFrame:
    """Rows of ``keys`` and ``out``: each token replaced by its lemma.

    ``lemmas`` has lang, word, pos ("n", "v", "a", "r") and lemma, at most one
    row per first three; absent words stay as they are. ``tags`` names an array of
    part-of-speech tags next to the tokens; without it every token is a noun.
    ``keys`` must include ``lang``. They need not identify a row: equal rows stay
    apart. Null tokens give an empty array, a null token in an array stays null.

    A table that fits the plan becomes a dictionary in it, an array of hash slots:
    a token is one array access away from its lemma, and no token is shuffled. Of a
    larger table, the words that occur in ``df`` are joined first, each once; if
    these fit, they are the dictionary. Else the tokens themselves are joined.
    """
    known = lemmas.select("lang", "word", "pos", "lemma").filter("lang is not null and word is not null and lemma is not null")
    table = _bounded(known)
    if table is None:
        occurring = _tokens(df, tokens, tags).distinct()
        met = reliable_checkpoint(known.join(occurring, ["lang", "word", "pos"], "left_semi"))
        table = _bounded(met)
        if table is None:
            return _joined(df, keys, tokens, met, out, tags)
    slots = F.from_json(F.lit(json.dumps(table)), _ENTRY)

    def lemma(word: Column, pos: Column) -> Column:
        near = F.get(slots, _slot(len(table), F.col("lang"), word, pos))
        entry = F.filter(near, lambda e: (e["word"] == word) & (e["pos"] == pos) & (e["lang"] == F.col("lang")))
        return F.coalesce(F.get(entry, F.lit(0))["lemma"], word)

    if tags:
        found = F.transform(_pairs(tokens, tags), lambda p: lemma(p["word"], _word_class(p["tag"])))
    else:
        found = F.transform(tokens, lambda w: lemma(w, _word_class(None)))
    return df.select(*keys, F.coalesce(found, F.array().cast("array<string>")).alias(out))


def _pairs(tokens: str, tags: str | None) -> Column:
    """Tokens with their tags; tags beyond the last token go, null tags are as none."""
    tag = F.coalesce(F.col(tags), F.array().cast("array<string>")) if tags else F.col(tokens)
    return F.slice(F.arrays_zip(F.col(tokens).alias("word"), tag.alias("tag")), F.lit(1), F.size(tokens))


def _tokens(df: DataFrame, tokens: str, tags: str | None) -> DataFrame:
    pairs = df.select("lang", F.explode(_pairs(tokens, tags)).alias("_pair"))
    return pairs.select("lang", F.col("_pair.word").alias("word"), _word_class(F.col("_pair.tag") if tags else None).alias("pos"))


def _joined(df: DataFrame, keys: Sequence[str], tokens: str, lemmas: DataFrame, out: str, tags: str | None) -> DataFrame:
    """The join of tokens for a dictionary of any size.

    Rows are numbered after they were written, so that a task that is run again gives them the same numbers.
    """
    row = unused_name("row", [*keys, "lang", "word", "pos", "lemma", "place"])
    written = reliable_checkpoint(df.select(*dict.fromkeys([*keys, "lang", tokens, *([tags] if tags else [])])))
    numbered = written.withColumn(row, F.monotonically_increasing_id())
    each = numbered.select(row, "lang", F.posexplode(_pairs(tokens, tags)).alias("place", "_pair"))
    words = each.select(row, "lang", "place", F.col("_pair.word").alias("word"), _word_class(F.col("_pair.tag") if tags else None).alias("pos"))
    known = lookup_join(words, lemmas, ["lang", "word", "pos"])
    ordered = F.array_sort(F.collect_list(F.struct("place", F.coalesce("lemma", "word").alias("lemma"))))
    found = known.groupBy(row).agg(ordered["lemma"].alias("_found"))
    both = numbered.select(row, *keys).join(found, row, "left")
    return both.select(*keys, F.coalesce("_found", F.array().cast("array<string>")).alias(out))
