"""Operators on single rows: language ID, decontamination, personal data, byte-level BPE."""

import random
import re
import sys

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from llm import byte_bpe, decontamination, language_id, pii
from llm.digests import span_text

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def tools():
    return byte_bpe.tools(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = byte_bpe.load(public_tokenizers.path(byte_bpe.RANKS)).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pieces = ["a", "b", " ", "  ", "\n", "é", "ß", "漢", "😀", "\x00", "\x1c", "1", "٣", ".", "'s", "the", "ing", "\u0301", "Ù", "zz"]
    return ["".join(rng.choice([*pieces, chr(rng.randrange(0x20, 0xD7FF))]) for _ in range(rng.choice([0, 1, 5, 80]))) for _ in range(n)]


def test_bpe_equals_the_library(tools, theirs):
    split, pieces, decoder = tools
    for text in [*random_texts(600), "a" * 9000, " " * 9000, "ab" * 5000, "!" * 5001]:
        ids = [i for piece in split(text) for i in pieces[piece]]
        assert ids == theirs.encode_ordinary(text), text[:50]
        assert decoder.decode(ids) + decoder.end() == text


def test_bpe_tables_may_overflow(theirs, monkeypatch):
    for name in ("MOST_STATES", "MOST_PAIRS", "MOST_PIECES", "MOST_STEPS"):
        monkeypatch.setattr(byte_bpe, name, 50)
    fresh = byte_bpe.Transducer(theirs._mergeable_ranks)
    pieces = byte_bpe.Pieces(fresh)
    split = byte_bpe.tools(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)[0]
    for text in random_texts(60, 2):
        assert [i for p in split(text) for i in pieces[p]] == theirs.encode_ordinary(text)


def test_decoder_replaces_what_is_not_utf8():
    rng = random.Random(3)
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0]) for _ in range(rng.randrange(8)))
        pending, out = byte_bpe.Decoder.advance(b"", data)
        assert out + ("\ufffd" if pending else "") == data.decode("utf-8", "replace")


def test_bpe_frames(spark, theirs):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "hé the 漢", None)], "doc_id long, text string, Decoded string")
    rows = byte_bpe.encode(df, decoded=True).collect()
    assert [r.token_ids for r in rows] == [[], [], theirs.encode_ordinary("hé the 漢")]
    assert [r.decoded for r in rows] == ["", "", "hé the 漢"]
    assert [r.decoded for r in byte_bpe.decode(byte_bpe.encode(df)).collect()] == ["", "", "hé the 漢"]
    assert byte_bpe.encode(df.limit(0)).count() == 0


def test_bpe_tables_are_compact(theirs):
    fresh = byte_bpe.Transducer(theirs._mergeable_ranks)
    rng = random.Random(4)
    for _ in range(3000):
        fresh.encode("".join(rng.choice("abcdeinorst") for _ in range(12)).encode())
    n = len(fresh.states)
    tables = [fresh.states, fresh.steps, fresh.places]
    seen = {id(x): sys.getsizeof(x) for t in tables for x in [t, *t, *(t.values() if isinstance(t, dict) else ())]}
    assert n > 10_000 and sum(seen.values()) < 400 * n


def test_a_carried_text_is_sent_once(spark):
    df = spark.createDataFrame([(1, "hé"), (2, None)], "doc_id long, text string")
    coded = byte_bpe.encode(df, decoded=True)
    assert "text_of_row" not in coded._jdf.queryExecution().executedPlan().toString()
    assert [(r.text, r.decoded) for r in coded.orderBy("doc_id").collect()] == [("hé", "hé"), (None, "")]
    assert [r.decoded for r in byte_bpe.encode(df, carry=["doc_id"], decoded=True).orderBy("doc_id").collect()] == ["hé", ""]


def brute_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[i : i + size]:
                    hit |= set(range(p, p + size))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(5)
    words = ["a", "B", "ü", "d1", "e-f", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 6, 9]))) for i in range(4, 12)] + [(20, None), (21, ""), (22, "..."), (4, "ü ü ü ü ü")]
    docs = [(i, text(rng.choice([0, 1, 3, 30, 60])), "en") for i in range(30)] + [(31, None, "en"), (None, text(40), None), (None, text(40), None)]
    df = spark.createDataFrame(docs, DOCS).withColumn("N_HIT", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("extra", F.lit(1))
    for r in decontamination.scan(df, bench, window=4, block_bytes=block_bytes, carry=["doc_id", "text"]).collect():
        assert (r.n_words, r.n_hit, r.hit_items) == brute_hits(r.text, items, 4)
    clean = decontamination.remove_contaminated(df, bench, window=4, block_bytes=block_bytes)
    assert clean.columns == df.columns
    assert sorted(r.text or "" for r in clean.collect()) == sorted(t or "" for _, t, _ in docs if not brute_hits(t, items, 4)[1])


def test_decontamination_without_rows(spark):
    df = spark.createDataFrame([(1, "a b", "en")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontamination.scan(df, none).collect()] == [0]
    assert decontamination.scan(df.limit(0), none).count() == 0


def test_longest_matches(spark):
    df = spark.createDataFrame([(1, "z a b c d e y", "en")], DOCS)
    bench = spark.createDataFrame([(7, "q a b c d e r")], "item_id long, text string")
    (row,) = decontamination.scan(df, bench, window=3).collect()
    assert [tuple(m) for m in row.matches] == [("7", 1, 1, 5)]


def test_short_item_before_a_long_one(spark):
    """A match at the start of an item or a document doesn't continue what lies before it."""
    long = " ".join(f"b{i}" for i in range(1, 13))
    items = [(1, "a"), (2, long)]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    docs = [(1, f"a {long}", "en"), (2, "x a", "en"), (3, f"{long} y", "en"), (4, "x y", "en")]
    df = spark.createDataFrame(docs, DOCS).coalesce(1)
    found = {r.doc_id: r for r in decontamination.scan(df, bench).collect()}
    for i, t, _ in docs:
        assert (found[i].n_words, found[i].n_hit, found[i].hit_items) == brute_hits(t, items, 10)
    assert [tuple(m) for m in found[1].matches] == [("1", 0, 0, 1), ("2", 0, 1, 12)]
    assert [r.doc_id for r in decontamination.remove_contaminated(df, bench).collect()] == [4]


def test_automaton_holds_all_substrings():
    import numpy as np

    text = np.array([2, 3, 2, 2, 3, 4, 2, 3, 3, 2, 3])
    table = language_id.automaton(text, 5)
    own = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    rng = random.Random(1)
    for _ in range(2000):
        word = tuple(rng.choice([2, 3, 4]) for _ in range(rng.randrange(1, 6)))
        state = 0
        for c in word:
            state = table[state, c] if state is not None and table[state, c] else None
            if state is None:
                break
        assert (state is not None) == (word in own)


def brute_phrases(text, sample):
    """Phrases of a greedy parse of the whole text."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("block", [1, 7, 50, 512])
def test_phrases_are_longest_matches(block):
    rng = random.Random(block)
    samples = {"x": "abcabcd bca" * 3, "y": "dddd aaaa " + "".join(rng.choices("abcd ", k=300)).replace("  ", " "), "z": "".join(rng.choices("ab", k=900))}
    samples = {k: " ".join(v.split()) for k, v in samples.items()}
    model = language_id.build({k: [v] for k, v in samples.items()})
    texts = ["abcdabc", "ddaa", "zz", "", "abc" * 400, samples["z"] * 2, samples["z"][100:800], "a b" * 300, "éa" * 100, "q" + samples["y"] + "q"]
    texts += [" ".join("".join(rng.choices("abcdz ", k=rng.choice([3, 60, 700, 3000]))).split()) for _ in range(30)]
    count, sizes, has_letter = language_id.phrases(model, pa.array([*texts, None]), block=block)
    for language, sample in enumerate(samples.values()):
        assert count[:, language].tolist() == [brute_phrases(t, sample) for t in texts] + [0]
    assert sizes.tolist() == [len(t) for t in texts] + [0]
    assert has_letter.tolist() == [bool(t) for t in texts] + [False]


def test_languages_of_eight_scripts(spark):
    rng = random.Random(8)
    firsts = {"el": 0x3B1, "ru": 0x430, "hy": 0x561, "he": 0x5D0, "ar": 0x627, "hi": 0x915, "th": 0xE01, "am": 0x1200, "zh": 0x4E00, "ja": 0x3042}
    spans = {"am": 250, "zh": 3000, "ja": 80}

    def text(lang, words):
        span = spans.get(lang, 24)
        letters = [chr(firsts[lang] + i) for i in range(span) if chr(firsts[lang] + i).isalpha()]
        return " ".join("".join(rng.choices(letters, weights=[1 / (i + 3) for i in range(len(letters))], k=rng.randrange(2, 8))) for _ in range(words))

    learn = [(i, text(lang, 400), lang) for i, lang in enumerate(list(firsts) * 12)]
    told = [(i, text(lang, 25), lang) for i, lang in enumerate(list(firsts) * 20)]
    model = language_id.train(spark.createDataFrame(learn, DOCS))
    found = language_id.identify(spark.createDataFrame(told, DOCS), model).collect()
    right = {lang: sum(r.lang_pred == lang for r in found if r.lang == lang) for lang in firsts}
    assert min(right.values()) >= 19, right


def test_equal_shares_of_a_sample():
    assert language_id._equal_shares(["a" * 10, "b" * 100, "c" * 100], 70) == "a" * 10 + " " + "b" * 30 + " " + "c" * 30
    assert language_id._equal_shares(["ab", ""], 70) == "ab " and language_id._equal_shares([], 9) == ""


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter(~language_id.held_out()))
    held = language_id.identify(docs.filter(language_id.held_out()), model).filter(F.length("text") > 100).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, "de"), (1, "", None), (2, "12 !?", "xx"), (3, "漢" * 3000, "x")], DOCS).withColumn("SCORE", F.lit("x"))
    found = {r.text: r for r in language_id.identify(odd, model).collect()}
    assert [found[t].lang_pred for t in (None, "", "12 !?")] == ["und"] * 3 and found[None].score == 0
    assert 0 <= found["漢" * 3000].score <= 1
    assert language_id.identify(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.build({})).collect()} == {"und"}


STRICT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        odd = [int(c) for c in digits[::-1]]
        return 16 <= len(digits) <= 19 and sum(c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c) for i, c in enumerate(odd)) % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(7)
    pieces = ["a", "@", ".", "b.cc", "x@y.org", "1", "12", "255", "256", " ", "-", "+", "+1 (", "555", "4111 1111 1111 1111", "é", "😀", "001", "(", "\n"]
    texts = [None, "", *("".join(rng.choice(pieces) for _ in range(rng.choice([3, 12, 40]))) for _ in range(400)), *(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("Spans", F.lit(1))
    for r in pii.detect(df, carry=["text"]).select("text", span_text(F.filter("spans", lambda s: s["strict"])).alias("base")).collect():
        assert r.base == ",".join(f"{k}:{m.start()}:{m.end()}" for k in STRICT for m in re.finditer(STRICT[k], r.text or "") if passes(k, m.group()))


def test_added_spans_and_redaction(spark):
    clean = [(i, f"order {i} has version 1.2.{i} and 12345678901{i} items", "en") for i in range(20)]
    plain = [(100 + i, f"call +1 (569) 555-66{i:02d} or write to joe{i}@example.com now", "en") for i in range(30)]
    odd = [(200, "+1 (569) 555-6633 4795326016703902 x", "en"), (201, None, None), (202, "joe (at) example (dot) com", "en"), (203, "1" * 60_000, "en"), (203, "a." * 30_000 + "@b", "en")]
    df = spark.createDataFrame(clean + plain + odd, DOCS)
    spans = {(r.doc_id, len(r.text or "")): [(s.kind, r.text[s.start : s.end]) for s in r.spans] for r in pii.detect(df).collect()}
    assert all(spans[i, len(t)] == [] for i, t, _ in clean)
    assert ("phone", "+1 (569) 555-6633") in spans[200, 36] and ("email", "joe (at) example (dot) com") in spans[202, 26]
    out = {r.doc_id: r.text for r in pii.redact(df).filter("doc_id <> 203").collect()}
    assert out[100] == "call [PHONE] or write to [EMAIL] now" and out[201] is None and out[0] == clean[0][1]
    assert pii.redact(df).columns == df.columns
    assert pii.detect(df.limit(0)).count() == 0


def test_em_finds_the_unreliable_labeler(spark):
    """Three labelers that agree, one that is random."""
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        y = rng.choice([1, -1])
        rows.append(("card", [0, y, y if rng.random() < 0.9 else -y, y if rng.random() < 0.9 else -y, rng.choice([1, -1]), 0]))
    df = spark.createDataFrame(rows, "kind string, votes array<int>").groupBy("kind", "votes").count().withColumnRenamed("count", "n")
    got = df.groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("p")).select(pii._estimated(F.col("p")).alias("m")).first().m
    assert got.reliability[1] > 0.9 and got.reliability[2] > 0.8 and got.reliability[4] < 0.65 and 0.4 < got.prior < 0.6
