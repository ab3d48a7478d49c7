"""Packing: ids against the library, places against the rules, costs against other ways to pack."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import packing
from llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def texts(n, seed=4):
    rng = random.Random(seed)
    parts = ["the", "a", "é", "漢", "😀", " ", " ", " ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "᠎", "\x85", "'s", ".", "1", "٣", "́", "<|endoftext|>", "ing"]
    return ["".join(rng.choices(parts, k=rng.choice([0, 1, 3, 40]))) for _ in range(n)]


def test_ids_equal_the_library(theirs, monkeypatch):
    monkeypatch.setattr(packing, "PARTS", 50)
    coder = packing.Ids(PATH)
    every = texts(1500) + ["a" * 5000, " " * 3000, "word " * 4000]
    for i in range(0, len(every), 64):
        for text, ids in zip(every[i : i + 64], coder.of(every[i : i + 64])):
            assert np.frombuffer(ids, dtype="<u4").tolist() == theirs(text), text[:40]


@pytest.mark.parametrize("lengths", [[], [1], [1024], [1025], [5000, 3, 3, 3], [1] * 3000, [1023] * 7, [700, 700, 700, 700], list(range(1, 2100, 7))])
def test_every_id_has_one_place(lengths):
    placed, sizes, costs = packing.assign(np.array(lengths, dtype=np.int64))
    for d, n in enumerate(lengths):
        own = sorted((s, k) for doc, s, k, _, _ in placed.tolist() if doc == d)
        assert [s for s, _ in own] == np.cumsum([0] + [k for _, k in own])[:-1].tolist() and sum(k for _, k in own) == n
    for s, size in enumerate(sizes):
        own = sorted((o, k) for _, _, k, sequence, o in placed.tolist() if sequence == s)
        assert [o for o, _ in own] == np.cumsum([0] + [k for _, k in own])[:-1].tolist() and sum(k for _, k in own) == size
        assert size == 1024 or size < 1024 and size & size - 1 == 0
        assert costs[s] == pytest.approx(sum(k * packing.LINEAR + k * k * packing.QUADRATIC for _, k in own))
    assert sum(sizes < 1024) <= 10


def test_costs_are_balanced():
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(5, 1.2, 4000).astype(np.int64) + 1, 600)
    _, sizes, costs = packing.assign(lengths)
    # With prices of zero, the first sequence with room is the one of lowest cost.
    placed, _, _ = packing.assign(lengths, linear=0.0, quadratic=0.0)
    first_fit = np.bincount(placed[:, 3], weights=placed[:, 2] * packing.LINEAR + placed[:, 2] ** 2 * packing.QUADRATIC, minlength=len(sizes))
    assert np.std(costs[sizes == 1024]) < np.std(first_fit[sizes == 1024]) / 2
    pieces_of = np.bincount(packing.assign(lengths)[0][:, 0])
    assert (pieces_of > 1).mean() < 0.2


def test_pack(spark, theirs):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, None, "x"), (2, "", "x"), (2, "same text", "y"), (2, "same text", "y"), (None, "one two", None), (5, long, "z")] + [(10 + i, t, "r") for i, t in enumerate(texts(60, 6))]
    df = spark.createDataFrame(rows, "doc_id long, text string, Start string").coalesce(2)
    for chunk in (packing.CHUNK, 3000):
        packed = packing.pack(df.withColumn("note", df.text), PATH, chunk=chunk)
        found = packed.collect()
        assert packed.columns == ["doc_id", "text", "note", *(f.name for f in packing.NEW)]
        assert all(r.note == r.text for r in found)
        assert sum(r.length for r in found) == sum(len(theirs(t)) + 1 for _, t, _ in rows)
        ids = np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in sorted((r for r in found if r.doc_id == 5), key=lambda r: r.start)])
        assert ids.tolist() == [*theirs(long), 0]
        assert sorted(r.doc_tokens for r in found if r.doc_id == 2 and r.start == 0) == [1, len(theirs("same text")) + 1, len(theirs("same text")) + 1]
        whole = packing.sequences(packed).collect()
        assert sum(len(r.ids) // 4 for r in whole) == sum(r.length for r in found)
        for r in whole:
            assert sum(p.length for p in r.parts) == len(r.ids) // 4 <= 1024
    assert packing.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, PATH, limit=1000)


def test_query(spark, theirs):
    found = QUERIES["op12_cost_packing"](spark, SF).collect()
    docs = {r.doc_id: theirs(r.text) + [0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    covered = dict.fromkeys(docs, 0)
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        ids = docs[r.doc_id]
        assert (r.start, r.doc_tokens) == (covered[r.doc_id], len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
        covered[r.doc_id] += r.length
    assert covered == {d: len(x) for d, x in docs.items()}
