"""Source divergence: quadtrees against dense matrices, the audit against a plain program."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import divergence
from llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
def test_pair_sums_equal_dense(seed):
    rng = np.random.default_rng(seed)
    n_a, n_b, n_cols = rng.integers(1, 40, 3) if seed else (9, 17, 100)
    trees, dense, zeros = [], [], []
    for n in (n_a, n_b):
        zero = rng.integers(1, 1000, n)
        m = np.where(rng.random((n, n_cols)) < 0.05, rng.integers(1, 10**9, (n, n_cols)), 0)
        m[:, n_cols // 2 :] = 0
        r, c = np.nonzero(m)
        trees.append(divergence.quadtree(r, c, m[r, c], 4))
        dense.append(np.where(m == 0, zero[:, None], m))
        zeros.append(zero)
    expected = divergence.divergence(dense[0][:, None, :], dense[1][None, :, :]).sum(axis=2)
    assert (divergence.pair_sums(*trees, *zeros, n_cols) == expected).all()


def test_tree_without_counts():
    none = np.zeros(0, dtype=np.int64)
    tree = divergence.quadtree(none, none, none, 2)
    assert divergence.pair_sums(tree, tree, np.array([5, 9]), np.array([5, 9]), 30).tolist() == [[0, 30], [30, 0]]


def test_shares_are_exact():
    counts = np.array([0, 3, 2**62], dtype=np.int64)
    assert divergence.shares(counts, np.int64(2**62 + 3), 7).tolist() == [1 + 10**9 * (int(c) + 2) // (2**62 + 3 + 14) for c in counts]


def brute(rows, least=10, top=10):
    terms = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, l, s in rows]
    in_docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in terms:
        in_docs[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang in in_docs:
        kept = {t for t, n in in_docs[lang].items() if n >= least}
        v = len(kept)
        own = {s: {t: n for t, n in c.items() if t in kept} for (l, s), c in count.items() if l == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c.get(t, 0) + 2) // (total + 2 * v) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            found = [(-sum((p[s][t] - p[x][t]) ** 2 // (p[s][t] + p[x][t]) for t in kept), x.encode(), "pair") for x in own if x != s]
            out += [(lang, s, part, item.decode(), -f, i + 1) for i, (f, item, part) in enumerate(sorted(found))]
            found = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), "term") for t in own[s] if p[s][t] > q[t]]
            out += [(lang, s, part, item.decode(), -f, i + 1) for i, (f, item, part) in enumerate(sorted(found)[:top])]
    return sorted(out)


def told(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"columns": 16, "band": 2}])
def test_audit_equals_brute_force(spark, sizes):
    rng = random.Random(8)
    words = ["a", "B", "é", "漢字", "x1y", "it's"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(" ".join(rng.choices(words, k=rng.choice([0, 2, 30]))), rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "s2", "s2", "ü", None, "z"])) for _ in range(250)]
    rows += [(None, "en", "blank"), ("1 2 3", "en", "digits"), ("only here", "xx", "a"), ("other", "xx", "b"), ("alone", "yy", "a"), ("same same", "fr", "s1"), ("same same", "fr", "s1")]
    rows += [("word " * 5000 + "long", "fr", "s2")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, Block int")
    assert told(divergence.audit(df, **sizes)) == brute(rows)


def test_ties_and_nothing(spark):
    rows = [("b a c", "en", s) for s in ("x", "y") for _ in range(6)] + [("d", "en", "z")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert told(divergence.audit(df)) == brute(rows)
    assert divergence.audit(df.limit(0)).collect() == []


def test_query(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert told(QUERIES["op13_source_divergence"](spark, SF)) == brute(rows)
