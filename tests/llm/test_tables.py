"""Operators over whole tables: language model, sharding, URL filter, top-k, WARC, near duplicates, pipeline."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import decontamination, lm_scoring, near_dedup, sharding, topk, url_filter, urls, warc
from llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.001"


def test_language_model_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "B", "ü", "the", "of"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, weights=[9, 5, 4, 9, 7] + [1] * 40, k=rng.choice([0, 1, 5, 60]))) for _ in range(80)] + [None, "", "new words here", "the\tOF\n b"]
    df = spark.createDataFrame([(i, t, i % 4 == 0) for i, t in enumerate(texts)], "doc_id long, text string, score boolean")
    model = lm_scoring.train(df.filter("not score"), shards=5)
    tokens = [[w.encode() for w in (t or "").lower().split()] + ["E"] for t in texts]
    train = [t for i, t in enumerate(tokens) if i % 4]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["S", *t], t))
    n, v = sum(count.values()), len(count)

    def discounts(counts):
        own = Counter(counts)
        return lm_scoring.discounts([own[k] for k in (1, 2, 3, 4)])

    left = Counter(w for _, w in pairs)
    d1, d2 = (0, *discounts(left.values())), (0, *discounts(pairs.values()))
    mass = sum(d1[min(c, 3)] for c in left.values()) / len(pairs)
    total, held = Counter(), defaultdict(float)
    for (u, _), c in pairs.items():
        total[u] += c
        held[u] += d2[min(c, 3)]

    def chance(u, w):
        lower = (left[w] - d1[min(left[w], 3)]) / len(pairs) + mass / (v + 1)
        return lower if not total[u] else (pairs[u, w] - d2[min(pairs[u, w], 3)]) / total[u] + held[u] / total[u] * lower

    assert sum(chance("S", w) for w in [*count, "unknown"]) == pytest.approx(1)
    for r in lm_scoring.score(df, model, carry=["doc_id", "score"]).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in count for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.score == pytest.approx(sum(math.log10(chance(u, w)) for u, w in zip(["S", *t], t)))


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert [r.score for r in lm_scoring.score(df, lm_scoring.train(df.limit(0), shards=2)).collect()] == [0, 0]
    assert lm_scoring.score(df.limit(0), lm_scoring.train(df, shards=2)).count() == 0


def test_shards_fit_and_only_large_buckets_split(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("Depth", F.lit("clash"))
    rows = sharding.shard(df, limit=20_000).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.n_bytes
    for r in rows:
        assert r.shard_bytes == sizes[r.shard] and (sizes[r.shard] <= 20_000 or sum(x.shard == r.shard for x in rows) == 1)
        parent = r.shard[:-1]
        assert r.depth == 0 or sum(n for s, n in sizes.items() if s.startswith(parent)) > 20_000
    assert len(rows) == 200


def test_equal_keys_overflow(spark):
    df = spark.createDataFrame([(7, "x" * 60)] * 50 + [(8, "y" * 10), (None, None), (9, "z" * 500)], "doc_id long, text string")
    rows = sharding.shard(df, limit=300, bits=8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.n_bytes
    assert len(rows) == 53 and all(r.shard_bytes == sizes[r.shard] for r in rows)
    assert all(n <= 300 or n == 500 for n in sizes.values())
    assert sharding.shard(df.limit(0)).count() == 0


def test_written_shards_hold_what_they_say(spark, tmp_path):
    """The byte limit of the files themselves, all rows back, null and empty texts, clashing names, the root alone."""
    docs = [(i % 40, None if i % 9 == 0 else "" if i % 10 == 0 else "té" * (i % 70)) for i in range(400)] + [(7, "w" * 90)] * 60 + [(None, None), (90, "z" * 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("bits_of_key", "part_of_row", "Depth", "_row")})
    for limit in (700, 10**9):
        path = str(tmp_path / str(limit))
        sharding.write_shards(sharding.shard(df, limit=limit, bits=10), path)
        rows = sharding.read_shards(spark, path, df.schema).collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(docs)
        sizes = Counter()
        for r in rows:
            assert r.n_bytes == len((r.text or "").encode()) and (r.bits_of_key, r.part_of_row, r._row) == ("clash",) * 3
            sizes[r.shard] += r.n_bytes
        assert all(r.shard_bytes == sizes[r.shard] and r.depth == len(r.shard.split("-")[0]) for r in rows)
        assert all(n <= limit or n == 900 for n in sizes.values()) and (len(sizes) > 40 if limit == 700 else list(sizes) == [""])
    labels = sharding.shard(df, limit=700, bits=10).groupBy("shard").agg(F.sum("n_bytes").alias("n")).collect()
    assert sum(r.n for r in labels) == sum(len((t or "").encode()) for _, t in docs)


def test_url_parts(spark):
    cases = [None, "", "no scheme/x", "http://A.net", "HTTP://a.b/c?d://e", "x://h?q/r", "x://H#f/", "http://u@h:80/p/", "://a/b"]
    got = spark.createDataFrame([(c,) for c in cases], "url string").select(urls.host(F.col("url")), urls.path(F.col("url"))).collect()
    want = [("", ""), ("", ""), ("", ""), ("a.net", ""), ("a.b", "/c"), ("h", ""), ("h", ""), ("u@h:80", "/p/"), ("a", "/b")]
    assert [tuple(r) for r in got] == want


def plain_templates(pages, apart=3.0, least=20, smoothing=10.0):
    """The tree of ``url_filter.templates`` with dictionaries: (host, segments) to template and share."""
    leaves = defaultdict(lambda: [0, 0])
    for host, parts, bad in pages:
        leaves[host, tuple(parts)][0] += bad is not None
        leaves[host, tuple(parts)][1] += bad or 0
    total = (sum(b for _, b in leaves.values()) + 0.5) / (sum(n for n, _ in leaves.values()) + 1)
    template, share = dict.fromkeys(leaves, ""), dict.fromkeys(leaves, total)
    deepest = max(len(parts) for _, parts in leaves)
    for level in range(max(url_filter.ROUNDS, deepest) + 1):
        active = [x for x in leaves if level <= url_filter.ROUNDS or len(x[1]) >= level - 1]
        if level:
            part = {x: x[1][level - 1] if len(x[1]) >= level else None for x in active}
            branch, node = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
            for x in active:
                for group in (branch[x[0], template[x], part[x]], node[x[0], template[x]]):
                    group[0] += leaves[x][0]
                    group[1] += leaves[x][1]
            for x in active:
                (n, b), (all_n, all_b) = branch[x[0], template[x], part[x]], node[x[0], template[x]]
                part[x] = part[x], n, b, all_n, all_b
            for x in active:
                name, n, b, all_n, all_b = part[x]
                if name is None:
                    continue
                rest_n, rest_b, pooled = all_n - n, all_b - b, (all_b + 1) / (all_n + 2)
                error = math.sqrt(pooled * (1 - pooled) * (1 / max(n, 1) + 1 / max(rest_n, 1)))
                differs = n >= least and rest_n >= least and abs(b / n - rest_b / rest_n) > apart * error
                template[x] += "/" + (name if name.startswith("{v}") or name == "/" or differs else "*")
        sums = defaultdict(lambda: [0, 0, 0.0])
        for x in active:
            group = sums[x[0], template[x]]
            group[0] += leaves[x][0]
            group[1] += leaves[x][1]
            group[2] = max(group[2], share[x])
        for x in active:
            n, b, parent = sums[x[0], template[x]]
            if len(x[1]) >= level or level <= url_filter.ROUNDS:
                share[x] = (b + smoothing * parent) / (n + smoothing)
    return {x: (template[x], share[x]) for x in leaves}


def test_templates_equal_plain_tree(spark):
    """Random trees with deep paths, ties between branches, hosts without labels and empty paths."""
    rng = random.Random(3)
    pages = []
    for _ in range(3000):
        host = rng.choice(["a", "a", "b", "c", ""])
        parts = rng.choices(["x", "y", "{v}", "{v}.html", "z"], k=rng.choice([0, 1, 2, 3, 4])) + ["deep"] * rng.choice([0] * 20 + [5, 9])
        bad = None if host == "c" or rng.random() < 0.3 else int(rng.random() < (0.8 if "y" in parts[:2] else 0.1))
        pages.append((host, parts + ["/"] * (rng.random() < 0.2), bad))
    df = spark.createDataFrame(pages, "host string, segments array<string>, bad int")
    found = {(r.host, tuple(r.segments)): (r.template, r.share) for r in url_filter.templates(df).collect()}
    expected = plain_templates(pages)
    assert found.keys() == expected.keys()
    for x, (template, share) in expected.items():
        assert found[x] == (template, pytest.approx(share, rel=1e-9)), x
    assert len({t for t, _ in expected.values()}) > 8


def test_rules_of_equal_length_go_to_the_first(spark):
    host, path = F.lit("a.b.net"), F.lit("/x/y")
    rules = [("net", "/x/y", "allow"), ("b.net", "/x", "block"), ("b.net", "/", "block")]
    got = [spark.range(1).select(url_filter.rule_of(host, path, r)["verdict"]).first()[0] for r in (rules, [rules[1], rules[0]])]
    assert [len(a + b) for a, b, _ in rules[:2]] == [7, 7] and got == ["allow", "block"]


def test_url_rules_and_templates(spark):
    good = [(i, f"http://h.com/good/{i}.html") for i in range(100)]
    bad = [(200 + i, f"http://h.com/bad/{i}.html") for i in range(100)]
    ruled = [(400, "http://x.net/"), (401, "http://www.example.net/en/5"), (402, "http://example.com/de/5"), (403, "http://a.org/fr/1"), (404, "http://net"), (405, None), (405, None), (None, "x")]
    df = spark.createDataFrame(good + bad + ruled, "page_id long, url string").withColumn("template", F.lit(1))
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in [*range(60), *range(200, 260)]] + [(0, None), (999, 1)], "page_id long, bad int")
    rows = url_filter.judge(df, labels, RULES).collect()
    found = {r.page_id: r for r in rows}
    assert len(rows) == len(good + bad + ruled)
    assert {found[i].verdict for i, _ in good} == {"allow"} and {found[i].verdict for i, _ in bad} == {"block"}
    assert found[99].template == "/good/{v}.html" and found[299].template == "/bad/{v}.html"
    assert [(found[i].rule, found[i].verdict) for i in range(400, 404)] == [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert (found[404].host, found[404].path, found[404].rule) == ("net", "", None) and found[405].host == ""
    assert url_filter.judge(df.limit(0), labels, RULES).count() == 0


def test_similar_branches_merge(spark):
    df = spark.createDataFrame([(i, f"http://h.com/{'abcd'[i % 4]}/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 == 3)) for i in range(400)], "page_id long, bad int")
    found = {r.page_id: r for r in url_filter.judge(df, labels, []).collect()}
    assert {found[i].template for i in range(0, 400, 4)} <= {"/*/{v}", "/a/{v}"} and found[3].template == "/d/{v}"
    assert found[3].verdict == "block" and found[0].verdict == "allow"


def test_deep_branches_part(spark):
    kinds = {"good": "a/b/c/d/e/good/1", "bad": "a/b/c/d/e/bad/1", "fine": "a/b/c/d/e/f/g/h/fine/", "worse": "a/b/c/d/e/f/g/h/worse/"}
    pages = [(1000 * k + i, f"http://{h}.com/{p}") for k, (h, p) in enumerate((h, p) for h in ("h", "o") for p in kinds.values()) for i in range(50)]
    df = spark.createDataFrame([*pages, (-1, "http://h.com/"), (-2, "http://z.com/" + "x/" * 12)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int("/bad/" in u or "/worse/" in u)) for i, u in pages if i % 1000 < 40], "page_id long, bad int")
    rows = url_filter.judge(df, labels, []).collect()
    found = {r.page_id: r for r in rows}
    assert len(rows) == len(pages) + 2
    assert all(found[i].verdict == ("block" if "/bad/" in u or "/worse/" in u else "allow") for i, u in pages)
    assert found[0].template.endswith("/good/{v}") and found[1000].template.endswith("/bad/{v}")
    assert found[2000].template.endswith("/fine//") and found[3000].template.endswith("/worse//")
    alone = {r.page_id: r for r in url_filter.judge(df.filter("page_id > -2"), labels, []).collect()}
    assert all(alone[i] == found[i] for i in alone)


@pytest.mark.parametrize("size", [1.0, 1e12])
def test_topk_equals_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-0.5, 0.1, 0.25, 1.5]) * size for _ in range(40)]) for i in range(200)]
    odd = [(500, None), (501, [None] * 40), (502, [float("nan")] * 40), (503, [float("inf")] * 40), (None, [1.0] * 40), (520, [0.5 * size] * 3), (0, vectors[0][1]), (540, [])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("RANK", F.lit(1))
    own = {i: [math.floor(64 * x) for x in v] for i, v in [*vectors, odd[5], odd[7]]}
    want = []
    for q in own:
        if q % 20 == 0:
            scored = sorted((-min(sum(a * b for a, b in zip(own[q], v)), 2**63 - 1), i) for i, v in own.items() if i != q)[:7]
            want += [(q, k + 1, i, max(-s, -(2**63))) for k, (s, i) in enumerate(scored)]
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    pages = [(i, f"http://www.h{i % 5}.com/p{i}?q\n\t%é", "x" * (i % 7)) for i in range(60)] + [(100, None, None), (101, "u", "dup ü"), (102, "u", "dup ü"), (None, "u", "dup ü"), (None, "u", "alone"), (-5, "v", "dup ü")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    manifest = warc.write(df, folder=f"file://{tmp_path}/w")
    rows = warc.look_up(df, manifest, payload=True).collect()
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -(2**63)), i if i is not None else -(2**63))
    want = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        first = best[h or ""] == (i if i is not None else -(2**63))
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert all(bytes(r.payload).decode() in {h or "" for _, _, h in pages} for r in rows if r.record_type == "response")
    packed = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz")]
    assert sum(p.count(b"WARC/1.1\r\n") for p in packed) == len(pages)
    one = warc.look_up(df.filter("page_id = 7"), manifest).collect()
    assert [r.page_id for r in one] == [7]
    small = warc.look_up(df, warc.write(df, revisit_from=6, folder=f"file://{tmp_path}/v")).filter("payload_bytes < 6").collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.look_up(df.limit(0), warc.write(df.limit(0))).count() == 0


def brute_components(docs):
    sets, parent = [], list(range(len(docs)))
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), name), name)
    return Counter((name, len(sets[i]), least[root(i)]) for i, (name, _) in enumerate(docs))


def test_single_look_ups_of_odd_urls(spark):
    urls_ = [f"http://h.example/a{x}" for x in ("\tx", "$x", " b", "!c", "\ny", "#z", "", "\tz", "%09x", "%", "\n", "%0A")]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls_)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(pages)
    for i in range(len(urls_)):
        found = warc.look_up(pages.filter(F.col("page_id") == i).select("page_id", "url"), manifest).collect()
        assert [r.page_id for r in found] == [i], urls_[i]


@pytest.mark.parametrize("chunk,large", [(8, 1 << 18), (8, 5), (4096, 1 << 18)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, chunk, large):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "LARGE", large)
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40))
    docs = []
    for _ in range(6):  # drifting chains of copies, at about the limit
        text = [word() for _ in range(rng.choice([30, 80]))]
        for _ in range(25):
            docs.append(" ".join(text))
            text = [word() if rng.random() < 0.012 else w for w in text]
    docs += ["A b", "a  B", "c", "", None, "  ", docs[3], docs[3].upper(), " ".join(word() for _ in range(3000))]
    rng.shuffle(docs)
    rows = [(i * 3, t) for i, t in enumerate(docs)] + [(0, "another text under the same name as the first one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Node", F.lit("clash"))
    found = near_dedup.near_duplicates(df, pivots=3, growth=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_group_below_the_limit(spark, monkeypatch):
    """Copies of one text whose similarity to each other is mostly just below the limit, in several chunks."""
    monkeypatch.setattr(near_dedup, "CHUNK", 64)
    rng = random.Random(12)
    text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" if rng.random() < 0.018 else w for w in text)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows)
    assert len({c for _, _, c in expected}) > 20
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, pivots=16).collect()) == expected


def test_near_duplicates_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()) == brute_components(rows)
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect() if r.doc_id) == [(3, 3, True)]
    assert [r.kept for r in near_dedup.near_duplicates(odd).filter("doc_id is null").collect()] == [True, True]
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "...", "en", "s", 3), (10**6 + 2, "one copy of me", "en", "s", 14), (10**6 + 2, "one copy of me", "en", "s", 14)], docs.schema)
    docs = docs.union(odd)
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, SF)
    assert told.columns == docs.columns and docs.count() - told.count() == 2
    once = stages["near_dedup"](spark, told, SF)
    kept = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in told.collect()])}
    assert sorted(r.doc_id for r in once.collect()) == sorted(kept)
    clean = stages["decontamination"](spark, once, SF)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.scan(clean, bench).filter("n_hit > 0").count() == 0
    assert clean.count() + decontamination.scan(once, bench).filter("n_hit > 0").count() == once.count()
    hidden = stages["pii"](spark, clean, SF)
    assert hidden.count() == clean.count() and hidden.filter("text rlike '@mail[0-9]'").count() == 0
    last = stages["byte_bpe"](spark, hidden, SF).collect()
    assert len(last) == clean.count() and all(r.decodes and r.n_tokens == len(r.token_ids) for r in last)


def test_near_dedup_stage_decides_by_rows(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l m"), (2, "n o p q r s"), (None, "t u v w x y"), (None, "t u v w x y"), (None, None), (None, None), (7, "t u v w x y")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, Row string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert texts == sorted([(1, "a b c d e f"), (3, "g h i j k l m"), (2, "n o p q r s"), (7, "t u v w x y"), (None, None), (None, None)], key=str)


def test_pipeline_runs_over_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_have_one_row_per_input(spark, name):
    if name.split("_")[0] in ("op11", "op12", "op13"):
        return
    table = {"op3": "pages", "op6": "pages"}.get(name.split("_")[0], "documents")
    if name.startswith("op4"):
        return
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
