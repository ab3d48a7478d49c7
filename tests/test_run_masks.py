"""Masks of runs against the grid that repeats rows, and counts per mask against counts per run."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsfold.operators import features, metrics, svm
from newsfold.plans import experiments, run_masks
from newsfold.plans.experiments import Run

RUNS = [
    Run("en", "svm", ("en",)),
    Run("all", "svm", ("en", "nl", "it")),
    Run("m-en", "bert", ("en",), True),
    Run("m-nl-it", "bert", ("nl", "it"), True),
    Run("none", "svm", ("xx",)),
]
SCHEMA = "article_url string, article_title string, is_sarcastic int, lang string"


def rows():
    made = [(f"u{i}", f"word{i % 7} title {'odd' if i % 2 else 'even'}", (None, 0, 1, 1)[i % 4], ("en", "nl", "it", "de")[i // 5 % 4]) for i in range(400)]
    return made + [("same", "copies", 1, "en")] * 60 + [(None, f"t{i}", 0, "nl") for i in range(40)] + [("u", "x", 1, None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def masked(df):
    return run_masks.split_masks(df, RUNS).persist()


def test_masks_are_the_grid(df, masked):
    grid = experiments.experiment_grid(df, RUNS)
    expected = Counter((r.run, r.article_url, r.article_title, r.split) for r in grid.collect())
    found = Counter()
    for r in masked.collect():
        for i, run in enumerate(RUNS):
            for split, mask in (("train", r.train_of), ("val", r.val_of), ("test", r.test_of)):
                if mask >> i & 1:
                    found[run.name, r.article_url, r.article_title, split] += 1
    assert found == expected
    assert masked.count() == len(rows())
    assert [tuple(r)[-3:] for r in masked.filter("lang is null").collect()] == [(0, 0, 0)]


def test_masks_of_an_empty_table_and_clashing_names(spark, df):
    assert run_masks.split_masks(df.limit(0), RUNS).count() == 0
    odd = df.filter("article_url is not null and article_url <> 'same'").withColumns({c: F.lit(7) for c in ("run_code", "run_places", "_part", "run")})
    found = run_masks.split_masks(odd, RUNS)
    assert found.columns == [*odd.columns, "train_of", "val_of", "test_of"] and {r.run_code for r in found.collect()} == {7}
    with pytest.raises(ValueError):
        run_masks.split_masks(df, RUNS * 2)
    with pytest.raises(ValueError):
        run_masks.split_masks(df, [Run(str(i), "svm", ("en",)) for i in range(63)])


def test_label_counts(df, masked):
    grid = experiments.experiment_grid(df, RUNS)
    expected = Counter((r.run, r.split, r.is_sarcastic) for r in grid.collect())
    found = {(r.run, r.split, r.is_sarcastic): r.n for r in run_masks.label_counts_by_run(masked, RUNS).collect()}
    assert found == expected


def test_terms_of_each_run(masked):
    found = {(r.run, r.term): (r.n, r.docs) for r in run_masks.term_counts_by_run(masked, RUNS).collect()}
    small = {}
    for r in run_masks.vocabularies(masked, RUNS, sizes={run.name: 3 for run in RUNS}).collect():
        small.setdefault(r.run, []).append(r.term)
    for i, run in enumerate(RUNS):
        alone = masked.filter(run_masks.has_run("train_of", F.lit(i)))
        expected = {(run.name, r.term): (r.n, r.docs) for r in features.term_counts(alone).collect()}
        assert {k: v for k, v in found.items() if k[0] == run.name} == expected
        assert sorted(small.get(run.name, [])) == sorted(r.term for r in features.vocabulary(alone, 3).collect())


def test_all_models_in_one_pass(masked):
    """Fitted runs predict every row at once; their scores are those of each run by itself."""
    models = []
    for i, langs in ((0, ["en"]), (1, ["en", "nl"])):
        train = masked.filter(run_masks.has_run("train_of", F.lit(i)) & F.col("is_sarcastic").isNotNull())
        text_model = features.fit_tfidf_vectors(train, 50)
        models.append((text_model, svm.linear_svm(text_model.transform(train), 1.0)))
    predicted = run_masks.predict_all(masked, models)
    assert predicted.columns == [*masked.columns, "predicted_of"]
    plan = predicted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]
    found = {(r.run, r.lang): (r.f1, r.accuracy) for r in run_masks.transfer_of_runs(predicted, RUNS[:2], 1.0).collect()}
    for i, (text_model, model) in enumerate(models):
        test = masked.filter(run_masks.has_run("test_of", F.lit(i)) & F.col("is_sarcastic").isNotNull())
        scored = model.transform(text_model.transform(test)).withColumn("prediction", F.col("prediction").cast("int"))
        expected = metrics.macro_prf(scored, 1.0, "is_sarcastic", "prediction", ["lang"]).collect()
        assert {lang: x for (run, lang), x in found.items() if run == RUNS[i].name} == {r.lang: pytest.approx((r.f1, r.accuracy)) for r in expected}
