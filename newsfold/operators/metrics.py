"""Classification metrics. The rows are read once into a table of (group, label, prediction) counts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, y: str = "y_true", p: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """True and false negatives and positives per group."""

    def cell(label: int, prediction: int) -> Column:
        return F.count_if((F.col(y) == label) & (F.col(p) == prediction))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("true_negative"),
        cell(0, 1).alias("false_positive"),
        cell(1, 0).alias("false_negative"),
        cell(1, 1).alias("true_positive"),
    )


def accuracy(df: DataFrame, y: str = "y_true", p: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions per group."""
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def pair_counts(df: DataFrame, y: str = "y_true", p: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, label, prediction), in columns y, p and n."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_pairs(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The four confusion cells of each row as pair counts."""
    cells = ((0, 0, "true_negative"), (0, 1, "false_positive"), (1, 0, "false_negative"), (1, 1, "true_positive"))
    pair = [F.struct(F.lit(y).alias("y"), F.lit(p).alias("p"), F.col(c).alias("n")) for y, p, c in cells]
    return df.select(*by, F.inline(F.array(*pair))).filter(F.col("n") > 0)


def macro_from_pairs(pairs: DataFrame, zero_division: float, by: Sequence[str] = ()) -> DataFrame:
    """Macro precision, recall and F1 and the accuracy from pair counts, for any number of classes.

    ``zero_division`` is the precision of a class never predicted and the recall
    of a class that never occurs. F1 is 0 where both are 0.
    """
    n = F.col("n")
    hit = F.col("y") == F.col("p")
    role = F.inline(
        F.array(
            F.struct(F.col("y").alias("class"), n.alias("actual"), F.lit(0).cast("long").alias("predicted"), F.when(hit, n).otherwise(0).alias("right")),
            F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("actual"), n.alias("predicted"), F.lit(0).cast("long").alias("right")),
        )
    )
    sums = [F.sum(c).alias(c) for c in ("actual", "predicted", "right")]
    per_class = pairs.select(*by, role).groupBy(*by, "class").agg(*sums)
    precision = F.when(F.col("predicted") > 0, F.col("right") / F.col("predicted")).otherwise(F.lit(float(zero_division)))
    recall = F.when(F.col("actual") > 0, F.col("right") / F.col("actual")).otherwise(F.lit(float(zero_division)))
    scored = per_class.withColumns({"precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    scored = scored.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
    return scored.groupBy(*by).agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        (F.sum("right") / F.sum("actual")).alias("accuracy"),
    )


def macro_prf(
    df: DataFrame, zero_division: float, y: str = "y_true", p: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """Macro precision, recall and F1 and the accuracy of predictions per group."""
    return macro_from_pairs(pair_counts(df, y, p, by), zero_division, by)


def leaderboard(runs: DataFrame, split: str = "test") -> DataFrame:
    """One row per run with the scores of its best record, best F1 first; files without a split count as the test."""
    best = F.max(F.struct("f1", "precision", "recall", "accuracy")).alias("_best")
    return (
        runs.filter((F.coalesce("split", F.lit("test")) == split) & F.col("f1").isNotNull())
        .groupBy("family", "run")
        .agg(best)
        .select("family", "run", "_best.*")
        .orderBy(F.desc("f1"), "family", "run")
    )


def transfer_gap(runs: DataFrame, trained: str = "eval", unseen: str = "test") -> DataFrame:
    """F1 on trained and on unseen languages per run, and the difference.

    Both come from one record of the run: rows that agree in ``family`` and ``parameters`` (where there are such columns).
    Of several records, that with the best F1 on trained languages counts, then on unseen ones, as a run is chosen.
    """

    def f1_on(split):
        return F.max(F.when(F.col("split") == split, F.col("f1")))

    record = ["run"] + [c for c in ("family",) if c in runs.columns]
    settings = [F.to_json(F.map_from_entries(F.array_sort(F.map_entries("parameters")))).alias("settings")] if "parameters" in runs.columns else []
    both = runs.groupBy(*record, *settings).agg(f1_on(trained).alias("f1_trained"), f1_on(unseen).alias("f1_unseen"))
    return (
        both.groupBy("run")
        .agg(F.max(F.struct("f1_trained", "f1_unseen")).alias("best"))
        .select("run", "best.f1_trained", "best.f1_unseen", (F.col("best.f1_trained") - F.col("best.f1_unseen")).alias("gap"))
    )
