import pytest
from pyspark.sql import functions as F

from newsfold.operators import metrics
from newsfold.plans import experiments
from tests.golden import SCORES


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_pred int")


def test_published_scores_follow_from_the_matrices(spark):
    cells = "run string, split string, true_negative long, false_positive long, false_negative long, true_positive long"
    matrices = spark.createDataFrame([(run, part, *matrix) for run, part, matrix, _ in SCORES], cells)
    by = ["run", "split"]
    found = metrics.macro_from_pairs(metrics.confusion_pairs(matrices, by), 0.0, by)
    scores = {(r["run"], r["split"]): (r["precision"], r["recall"], r["f1"], r["accuracy"]) for r in found.collect()}
    for run, part, _, expected in SCORES:
        assert scores[run, part] == pytest.approx(expected, abs=1e-12)


def test_confusion_matrix_of_rows(spark):
    run, _, (tn, fp, fn, tp), expected = SCORES[0]
    cells = spark.createDataFrame([(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)], "y_true int, y_pred int, n int")
    rows = cells.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert tuple(metrics.confusion_matrix(rows).first()) == (tn, fp, fn, tp)
    macro = metrics.macro_prf(rows, 0.0).first()
    assert (macro["precision"], macro["recall"], macro["f1"], macro["accuracy"]) == pytest.approx(expected, abs=1e-12)
    assert metrics.accuracy(rows).first()[0] == pytest.approx(expected[3], abs=1e-12)


@pytest.mark.parametrize(("zero_division", "precision"), [(0.0, 0.25), (1.0, 0.75)])
def test_zero_division(spark, zero_division, precision):
    row = metrics.macro_prf(pairs_of(spark, [(0, 0), (1, 0)]), zero_division).first()
    assert row["precision"] == precision
    assert row["recall"] == 0.5
    assert row["f1"] == pytest.approx((2 * 0.5 / 1.5) / 2)


def test_many_classes(spark):
    row = metrics.macro_prf(pairs_of(spark, [(0, 0), (1, 2), (2, 2), (2, 2)]), 0.0).first()
    assert row["precision"] == pytest.approx((1 + 0 + 2 / 3) / 3)
    assert row["recall"] == pytest.approx(2 / 3)


def test_leaderboard_and_gap(spark):
    runs = spark.createDataFrame(
        [("bert", run, part, *scores) for run, part, _, scores in SCORES],
        "family string, run string, split string, precision double, recall double, f1 double, accuracy double",
    )
    board = metrics.leaderboard(runs).collect()
    assert [r["run"] for r in board[:2]] == ["en-bert", "it-bert"] and len(board) == 10
    gaps = {r["run"]: r for r in metrics.transfer_gap(runs).collect()}
    assert round(gaps["m-bert-it"]["f1_trained"], 4) == 0.9023 and round(gaps["m-bert-it"]["f1_unseen"], 4) == 0.7017
    assert gaps["m-bert-it"]["gap"] == pytest.approx(0.9023 - 0.7017, abs=1e-3)


def test_gap_is_that_of_one_record(spark):
    rows = [("r", {"C": "1"}, "eval", 0.9), ("r", {"C": "1"}, "test", 0.2), ("r", {"C": "2"}, "eval", 0.5), ("r", {"C": "2"}, "test", 0.8), ("s", None, "eval", 0.4)]
    runs = spark.createDataFrame(rows, "run string, parameters map<string,string>, split string, f1 double")
    gaps = {r["run"]: (r["f1_trained"], r["f1_unseen"]) for r in metrics.transfer_gap(runs).collect()}
    assert gaps == {"r": (0.9, 0.2), "s": (0.4, None)}


def test_transfer_matrix(spark):
    df = spark.createDataFrame([("r", "en", 0, 0), ("r", "en", 1, 1), ("r", "it", 1, 0)], "run string, lang string, y_true int, y_pred int")
    scores = {r["lang"]: r["f1"] for r in experiments.transfer_matrix(df).collect()}
    assert scores == {"en": 1.0, "it": 0.0}
