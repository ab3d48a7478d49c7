import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from newsfold import schemas
from newsfold.operators import features, kernels, svm
from newsfold.plans.experiments import Run
from newsfold.plans.prediction import predict_external, predict_svm
from newsfold.plans.training import prepare_text, train_run, train_runs
from newsfold.sources import readers, writers


@pytest.fixture(scope="module")
def titles(spark):
    texts = ["the cat sat", "the cat cat ran", "dogs ran far", "a b", "", "the the the", "zebra far far"]
    return spark.createDataFrame(list(enumerate(texts)), "id long, article_title string").cache()


def by_hand(texts, max_features):
    docs = [[w for w in t.split() if len(w) > 1] for t in texts]
    counts = Counter(w for d in docs for w in d)
    vocab = sorted(counts, key=lambda w: (-counts[w], w))[:max_features]
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1 for w in vocab}
    out = {}
    for i, doc in enumerate(docs):
        weights = {w: n * idf[w] for w, n in Counter(doc).items() if w in idf}
        length = math.sqrt(sum(x * x for x in weights.values()))
        out.update({(i, w): x / length for w, x in weights.items()})
    return vocab, out


@pytest.mark.parametrize("max_features", [1, 3, 5, 100])
def test_vocabulary_and_tfidf(spark, titles, max_features):
    vocab, expected = by_hand([r[1] for r in titles.orderBy("id").collect()], max_features)
    assert [r["term"] for r in features.vocabulary(titles, max_features).collect()] == vocab
    found = {(r["id"], r["term"]): r["tfidf"] for r in features.tfidf(titles, "id", max_features).collect()}
    assert found == pytest.approx(expected)


def test_fit_on_other_rows(spark, titles):
    train = titles.filter("id < 3")
    found = {r["term"] for r in features.tfidf(titles, "id", 100, fit_on=train).collect()}
    assert "zebra" not in found and "cat" in found


def test_vectors_equal_rows_and_survive_saving(spark, titles, tmp_path):
    model = features.fit_tfidf_vectors(titles, 100)
    writers.save_model(model, str(tmp_path / "m"))
    again = readers.load_model(str(tmp_path / "m"))
    vectors = {r["id"]: r["features"].toArray() for r in again.transform(titles).collect()}
    terms = features.vocabulary_terms(again)
    for r in features.tfidf(titles, "id", 100).collect():
        assert vectors[r["id"]][terms.index(r["term"])] == pytest.approx(r["tfidf"])
    for i, v in vectors.items():
        assert np.linalg.norm(v) == pytest.approx(0.0 if i in (3, 4) else 1.0)


def ring(spark, n=400, seed=5):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        radius, angle = (0.4, 1.6)[i % 2] + draw.gauss(0, 0.1), draw.uniform(0, 2 * math.pi)
        rows.append((i, i % 2, Vectors.dense([radius * math.cos(angle), radius * math.sin(angle)])))
    return spark.createDataFrame(rows, ["id", "is_sarcastic", "features"]).coalesce(1)


def test_landmark_kernel_is_exact_on_its_landmarks(spark):
    df = ring(spark, 40)
    points = np.array([r["features"].toArray() for r in df.orderBy("id").collect()])
    kernel = kernels.Kernel("rbf", 0.7)
    mapped = kernels.kernel_features(df, df, kernel).orderBy("id").select(vector_to_array("kernel_features")).collect()
    z = np.array([r[0] for r in mapped])
    exact = np.exp(-0.7 * ((points[:, None] - points[None]) ** 2).sum(-1))
    assert np.allclose(z @ z.T, exact, atol=1e-4)


def test_sparse_and_dense_vectors_agree(spark):
    rows = [(0, Vectors.sparse(5, [1, 3], [1.0, 2.0]), Vectors.dense([0, 1.0, 0, 2.0, 0])), (1, Vectors.sparse(5, [], []), Vectors.dense([0] * 5)), (2, Vectors.sparse(5, [0, 3], [3.0, 1.0]), Vectors.dense([3.0, 0, 0, 1.0, 0]))]
    df = spark.createDataFrame(rows, ["id", "s", "d"])
    sparse, dense = (df.select("id", F.col(c).alias("features")) for c in "sd")
    assert kernels.scale_gamma(sparse) == pytest.approx(kernels.scale_gamma(dense))
    cells = np.array([r["d"].toArray() for r in rows_of(df)])
    assert kernels.scale_gamma(sparse) == pytest.approx(1 / (5 * cells.var()))
    for name in ("linear", "poly", "rbf", "sigmoid"):
        k = kernels.Kernel(name, 0.5, 2)
        a, b = (sorted((r["id"], tuple(r["kernel_features"])) for r in kernels.kernel_features(x, x.orderBy("id"), k).collect()) for x in (sparse, dense))
        assert np.allclose([x[1] for x in a], [x[1] for x in b])


def rows_of(df):
    return df.orderBy("id").collect()


def test_rbf_beats_linear_on_a_ring(spark):
    df = ring(spark).cache()
    train, test = df.filter("id % 4 < 3"), df.filter("id % 4 = 3 or id % 4 = 2")
    n = train.count()
    linear = svm.fit_trial(train, svm.Trial("linear", 1.0, 1), n, "id")
    rbf = svm.fit_trial(train, svm.Trial("rbf", 1.0, 1), n, "id", n_landmarks=40)
    assert svm.macro_f1(rbf, test) > 0.95 > 0.8 > svm.macro_f1(linear, test)


def test_search_takes_the_best_trial(spark):
    df = ring(spark, 200).cache()
    trials = [svm.Trial("linear", 1.0, 1), svm.Trial("rbf", 2.0, 1), svm.Trial("poly", 1.0, 2)]
    model, scores = svm.search(df.filter("id < 150"), df.filter("id >= 150"), "id", trials, n_landmarks=30)
    assert [t for t, _ in scores] == trials
    best = max(s for _, s in scores)
    assert model.trial == next(t for t, s in scores if s == best) and best > 0.9


def test_halving_finds_the_same_trial_with_fewer_rows(spark):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(600, 2))
    rows = [(f"k{i}", Vectors.dense(p), int(p @ p > 1.4)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, ["key", "features", "is_sarcastic"]).coalesce(1)
    val, train = df.filter(F.crc32("key") % 4 == 0), df.filter(F.crc32("key") % 4 != 0)
    trials = [svm.Trial("linear", 0.1, 1), svm.Trial("linear", 5.0, 1), svm.Trial("rbf", 5.0, 1)]
    full, scores = svm.search(train, val, "key", trials, n_landmarks=12)
    model, rounds = svm.halving_search(train, val, "key", trials, n_landmarks=12)
    assert model.trial == full.trial == trials[2]
    assert [len(r.scores) for r in rounds] == [3, 2, 1] and [r.share for r in rounds] == [0.25, 0.5, 1.0]
    assert rounds[-1].scores[0][1] == pytest.approx(dict(scores)[trials[2]])
    assert sum(r.row_passes for r in rounds) < train.count() * len(trials)


def test_nested_samples(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    sets = [{r[0] for r in svm.nested_sample(df, s, "key", 3).collect()} for s in (0.1, 0.3, 1.0)]
    assert sets[0] < sets[1] < sets[2] and len(sets[2]) == 4000
    assert 300 < len(sets[0]) < 500 and 1050 < len(sets[1]) < 1350


def test_halving_of_one_trial_and_of_a_table_of_one_class_at_first(spark):
    rows = [(f"k{i}", Vectors.dense([float(i % 2), 1.0]), i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, ["key", "features", "is_sarcastic"]).coalesce(1)
    model, rounds = svm.halving_search(df, df, "key", [svm.Trial("linear", 1.0, 1)])
    assert len(rounds) == 1 and rounds[0].scores[0][1] == 1.0
    many = [svm.Trial("linear", c, 1) for c in (1.0, 2.0)]
    model, rounds = svm.halving_search(df, df, "key", many)
    assert rounds[-1].share == 1.0 and model.trial in many
    with pytest.raises(ValueError):
        svm.halving_search(df, df, "key", [])


def test_trials_are_repeatable():
    assert svm.draw_trials() == svm.draw_trials() and len(svm.draw_trials()) == 10
    for t in svm.draw_trials(50, 1):
        assert t.kernel in ("linear", "poly", "rbf", "sigmoid") and 0.01 <= t.c <= 10 and t.degree in range(1, 6)


def test_softmax(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0), (3.0, 1.0), (1000.0, -1000.0)], "a double, b double")
    rows = [tuple(r)[2:] for r in svm.score_softmax(df, F.col("a"), F.col("b")).collect()]
    p = 1 / (1 + math.exp(-2))
    assert rows == [(0, 0.5), (1, pytest.approx(p)), (0, pytest.approx(p)), (0, 1.0)]


def test_external_model_is_loaded_per_worker(spark):
    df = spark.createDataFrame([("aa",), ("b",), ("",)], "t string")

    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=float)

    scored = svm.score_external(df, "t", load, batch_size=2).collect()
    assert {r["t"]: r["scores"] for r in scored} == {"aa": [2.0, 1.0], "b": [1.0, 1.0], "": [0.0, 1.0]}


def test_external_model_sees_a_bounded_text(spark):
    rng = random.Random(3)
    texts = [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 400))) for _ in range(300)] + [None, "  lead  two ", "a\n b\tc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)

    def load():
        def predict(batch):
            words = np.array([len((t or "").split()) for t in batch])
            return np.stack([words, np.full(len(batch), words.max() - words.min())], axis=1).astype(float)

        return predict

    found = {r["id"]: r for r in svm.score_external(df, "t", load, batch_size=8, max_tokens=50).collect()}
    assert {i: r["t"] for i, r in found.items()} == dict(enumerate(texts))
    assert all(r["scores"][0] == min(50, len((r["t"] or "").split())) for r in found.values())
    assert sum(r["scores"][1] for r in found.values()) / len(found) < 8  # in the order of rows, it is over 40
    whole = svm.score_external(df, "t", load, max_tokens=None).collect()
    assert max(r["scores"][0] for r in whole) > 300


def corpus(spark):
    rows = []
    for i in range(300):
        lang, label = ("en", "it", "nl")[i % 3], (i // 3) % 2
        word = {"en": ("report", "absurd"), "it": ("governo", "assurdo"), "nl": ("kabinet", "bizar")}[lang][label]
        rows.append((f"u{i}", f"{word} title number {i} word{i % 7}", label, 20, lang))
    return spark.createDataFrame(rows, schemas.HEADLINE).coalesce(1).cache()


@pytest.mark.parametrize("fit_on", ["train", "all"])
def test_train_run(spark, tmp_path, fit_on):
    df = corpus(spark)
    trials = [svm.Trial("linear", 1.0, 1)]
    trained = train_run(df, Run("m-svm-all", "svm", ("en", "it", "nl")), trials=trials, fit_on=fit_on)
    rows = {r["split"]: r for r in trained.records.collect()}
    assert set(rows) == {"eval", "test"}
    row = rows["test"]
    assert (row["training_data_size"], row["evaluation_data_size"], row["test_data_size"]) == (243, 27, 30)
    assert row["true_negative"] + row["false_positive"] + row["false_negative"] + row["true_positive"] == 30
    assert row["f1"] > 0.95 and row["parameters"]["kernel"] == "linear"
    writers.write_run_record(trained.records, str(tmp_path / "runs"))
    assert {r["f1"] for r in readers.read_run_records(spark, str(tmp_path / "runs")).collect()} == {r["f1"] for r in rows.values()}
    scored = predict_svm(df, trained.text_model, trained.model)
    assert scored.filter("confidence < 0.5 or confidence > 1").isEmpty() and scored.count() == 300


def test_held_out_runs(spark):
    """Trained on one language, a model knows nothing about the words of the others."""
    options = {"trials": [svm.Trial("linear", 1.0, 1)], "max_features": 50}
    records, matrix = train_runs(corpus(spark), [Run("m-bert-en", "svm", ("en",), True), Run("it-svm", "svm", ("it",))], **options)
    rows = {(r["run"], r["split"]): r for r in records.collect()}
    assert rows["m-bert-en", "test"]["test_data_size"] == 200
    assert rows["m-bert-en", "eval"]["f1"] > 0.95 > rows["m-bert-en", "test"]["f1"]
    assert {(r["run"], r["lang"]) for r in matrix.collect()} == {("m-bert-en", "it"), ("m-bert-en", "nl"), ("it-svm", "it")}


@pytest.mark.parametrize("trial", [svm.Trial("linear", 1.0, 1), svm.Trial("rbf", 1.0, 1)])
def test_saved_svm_scores_the_same(spark, tmp_path, trial):
    df = ring(spark, 60).cache()
    model = svm.fit_trial(df, trial, 60, "id", n_landmarks=20)
    writers.save_svm(model, str(tmp_path / "svm"))
    again = readers.load_svm(spark, str(tmp_path / "svm"))
    assert again.trial == trial
    a, b = (sorted(map(tuple, svm.score(df, m).select("id", "prediction", F.round("confidence", 9)).collect())) for m in (model, again))
    assert a == b


def test_predict_external(spark):
    df = spark.createDataFrame([("A, b!",), (None,)], "article_title string")

    def load():
        import numpy as np

        return lambda texts: np.array([[0.0, float(t == "a b")] for t in texts])

    rows = {r["article_title"]: r for r in predict_external(df, load).collect()}
    assert rows["A, b!"]["is_sarcastic"] == 1 and rows["A, b!"]["confidence"] == pytest.approx(1 / (1 + math.exp(-1)))
    assert rows[None]["is_sarcastic"] == 0 and rows[None]["confidence"] == 0.5


def test_prepare_text(spark):
    df = spark.createDataFrame([("u", "The Cats don't RUN 2 miles", "en"), ("v", "", "it")], "article_url string, article_title string, lang string")
    lemmas = spark.createDataFrame([("en", "cats", "n", "cat")], "lang string, word string, pos string, lemma string")
    found = {r["article_url"]: r["article_title_preprocessed"] for r in prepare_text(df, ["the"], lemmas).collect()}
    assert found == {"u": ["cat", "do", "run", "miles"], "v": []}
    plain = {r["article_url"]: r["article_title_preprocessed"] for r in prepare_text(df, {"en": ["the", "do"]}, by_lang=True).collect()}
    assert plain == {"u": ["cats", "run", "miles"], "v": []}
