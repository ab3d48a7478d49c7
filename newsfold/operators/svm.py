"""Linear SVM training, hyperparameter search and scoring."""

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
import math
import random

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfold import fixed_values as V
from newsfold.operators.kernels import Kernel, kernel_features, pick_landmarks, scale_gamma
from newsfold.operators.metrics import macro_prf


def linear_svm(
    train: DataFrame, c: float, n_rows: int | None = None, features: str = "features", label: str = "is_sarcastic"
) -> Model:
    """Hinge loss with an L2 penalty of weight 1 / (C n), on the features as they are.

    The solver keeps its own blocks of the rows, so they are read once, and once more where ``n_rows`` isn't given.
    """
    rows = train.select(features, F.col(label).cast("double").alias(label))
    penalty = 1.0 / (c * (rows.count() if n_rows is None else n_rows))
    return LinearSVC(
        featuresCol=features, labelCol=label, regParam=penalty, standardization=False, maxIter=100, tol=1e-4
    ).fit(rows)


@dataclass(frozen=True)
class Trial:
    """One point of the search space."""

    kernel: str
    c: float
    degree: int


def draw_trials(n: int = V.TRIALS, seed: int = V.SEED, kernels: Sequence[str] = V.SVM_KERNELS) -> list[Trial]:
    """Seeded random points of the search space."""
    draw = random.Random(seed)
    return [Trial(draw.choice(kernels), draw.uniform(*V.SVM_C_RANGE), draw.choice(V.SVM_DEGREES)) for _ in range(n)]


@dataclass
class SvmModel:
    """A fitted SVM with the kernel map in front of it; the linear kernel needs no map."""

    trial: Trial
    model: Model
    kernel: Kernel | None = None
    landmarks: DataFrame | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.kernel is None:
            return self.model.transform(df)
        return self.model.transform(kernel_features(df, self.landmarks, self.kernel))


def fit_trial(
    train: DataFrame,
    trial: Trial,
    n_rows: int,
    key: str,
    gamma: float | None = None,
    n_landmarks: int = 200,
    label: str = "is_sarcastic",
    seed: int = V.SEED,
) -> SvmModel:
    """Fit one point. Kernels other than the linear one are approximated over landmarks."""
    if trial.kernel == "linear":
        return SvmModel(trial, linear_svm(train, trial.c, n_rows, "features", label))
    kernel = Kernel(trial.kernel, scale_gamma(train) if gamma is None else gamma, trial.degree)
    landmarks = pick_landmarks(train, n_landmarks, key, seed)
    mapped = kernel_features(train.select("features", label), landmarks, kernel)
    model = linear_svm(mapped, trial.c, n_rows, "kernel_features", label)
    return SvmModel(trial, model, kernel, landmarks)


def macro_f1(model: SvmModel, df: DataFrame, label: str = "is_sarcastic") -> float:
    """Macro F1 of a model, with undefined precision counted as 1."""
    scored = model.transform(df.select("features", label))
    return macro_prf(scored, 1.0, label, "prediction").first()["f1"]


def search(
    train: DataFrame,
    val: DataFrame,
    key: str,
    trials: Sequence[Trial] | None = None,
    threads: int = 2,
    n_landmarks: int = 200,
    label: str = "is_sarcastic",
    seed: int = V.SEED,
) -> tuple[SvmModel, list[tuple[Trial, float]]]:
    """Fit all trials, then refit the best by macro F1 on ``val`` (the first on ties).

    Trials are Spark jobs sent from a few driver threads over the same cached
    features. Returns the refitted model and the score of each trial.
    """
    trials = draw_trials(seed=seed) if trials is None else list(trials)
    train, val = train.persist(), val.persist()
    try:
        n_rows = train.count()
        gamma = scale_gamma(train) if any(t.kernel != "linear" for t in trials) else None

        def fit(trial):
            return fit_trial(train, trial, n_rows, key, gamma, n_landmarks, label, seed)

        def score(trial):
            return macro_f1(fit(trial), val, label)

        with ThreadPoolExecutor(threads) as pool:
            jobs = [pool.submit(inheritable_thread_target(train.sparkSession)(score), t) for t in trials]
            scores = [job.result() for job in jobs]
        best = max(range(len(trials)), key=lambda i: (scores[i], -i))
        return fit(trials[best]), list(zip(trials, scores))
    finally:
        train.unpersist()
        val.unpersist()


@dataclass(frozen=True)
class Round:
    """One round of a halving search: the share of the training rows, how many there were, and the score of each trial."""

    share: float
    n_rows: int
    scores: tuple[tuple[Trial, float], ...]

    @property
    def row_passes(self) -> int:
        """Rows that were fitted on, once for each trial."""
        return self.n_rows * len(self.scores)


def nested_sample(df: DataFrame, share: float, key: str | Sequence[str], seed: int = V.SEED) -> DataFrame:
    """About ``share`` of the rows, by a hash of the key: a smaller share of the same seed is a part of a larger one."""
    keys = [key] if isinstance(key, str) else list(key)
    place = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 30))
    return df if share >= 1 else df.filter(place < F.lit(int(share * (1 << 30))))


def halving_search(
    train: DataFrame,
    val: DataFrame,
    key: str,
    trials: Sequence[Trial] | None = None,
    keep: float = 0.5,
    threads: int = 2,
    n_landmarks: int = 200,
    label: str = "is_sarcastic",
    seed: int = V.SEED,
) -> tuple[SvmModel, list[Round]]:
    """Successive halving: all trials start on a small sample, the better part goes on to a larger one that contains it.

    With ``keep`` 0.5, each round has half the trials on twice the rows, so that every round costs about the same and the
    last one takes the whole table; a full search reads it once for each trial. Trials are ranked by macro F1 on ``val``,
    the first on ties. A sample without two classes sends all its trials on. Returns the model of the best trial, fitted on
    all of ``train``, and what each round found.
    """
    trials = draw_trials(seed=seed) if trials is None else list(trials)
    if not trials or not 0 < keep < 1:
        raise ValueError("need trials, and a part of them to keep")
    rounds = 1
    while len(trials) * keep ** (rounds - 1) > 1:
        rounds += 1
    history: list[Round] = []
    left, model = trials, None
    train, val = train.persist(), val.persist()
    try:
        for i in range(rounds):
            share = keep ** (rounds - 1 - i)
            rows = nested_sample(train, share, key, seed)
            counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes")).first()
            if counts["classes"] < 2 and i < rounds - 1:
                continue
            gamma = scale_gamma(rows) if any(t.kernel != "linear" for t in left) else None

            def fit(trial, rows=rows, n=counts["n"], gamma=gamma):
                return fit_trial(rows, trial, n, key, gamma, n_landmarks, label, seed)

            def score(trial, fit=fit):
                fitted = fit(trial)
                return fitted, macro_f1(fitted, val, label)

            with ThreadPoolExecutor(threads) as pool:
                jobs = [pool.submit(inheritable_thread_target(train.sparkSession)(score), t) for t in left]
                found = [job.result() for job in jobs]
            history.append(Round(share, counts["n"], tuple((t, f1) for t, (_, f1) in zip(left, found))))
            ranked = sorted(range(len(left)), key=lambda j: (-found[j][1], j))
            model = found[ranked[0]][0]
            left = [left[j] for j in ranked[: max(1, math.ceil(len(left) * keep))]]
        return model, history
    finally:
        train.unpersist()
        val.unpersist()


def softmax_columns(score_0: Column, score_1: Column) -> tuple[Column, Column]:
    """Predicted label (0 on ties) and its softmax probability, from two scores."""
    gap = F.abs(score_1 - score_0)
    return F.when(score_1 > score_0, 1).otherwise(0), 1.0 / (1.0 + F.exp(-gap))


def score_softmax(df: DataFrame, score_0: Column, score_1: Column) -> DataFrame:
    """Add the predicted label and its confidence."""
    label, confidence = softmax_columns(score_0, score_1)
    return df.withColumns({"is_sarcastic": label, "confidence": confidence})


def score(df: DataFrame, model) -> DataFrame:
    """Add ``prediction`` and ``confidence`` of a fitted model with raw scores."""
    raw = vector_to_array("rawPrediction")
    label, confidence = softmax_columns(F.get(raw, F.lit(0)), F.get(raw, F.lit(1)))
    scored = model.transform(df)
    return scored.withColumns({"prediction": label.cast("double"), "confidence": confidence})


def score_external(
    df: DataFrame,
    text: str,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    batch_size: int = 64,
    out: str = "scores",
    max_tokens: int | None = V.MAX_TOKENS,
) -> DataFrame:
    """Add ``out``: the two scores of a model of the caller, as an array.

    ``make_predict`` loads the model once per Python worker and returns a
    function from a batch of texts to an array of shape (rows, 2). It sees the
    first ``max_tokens`` words (between white space) of a text, as a model sees no
    more tokens than that (None: whole texts); the column itself stays whole. Rows
    are sorted by length inside each task, so the texts of a batch are of about
    one length and padding stays small; nothing is shuffled.
    """
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    seen = F.col(text) if max_tokens is None else F.regexp_extract(text, rf"^\s*(?:\S+\s+){{0,{max_tokens - 1}}}+\S*", 0)
    return df.sortWithinPartitions(F.length(seen)).withColumn(out, predict(seen))


def parameters(model: SvmModel) -> dict[str, str]:
    """Trial parameters as text, for a run record."""
    return {k: str(v) for k, v in asdict(model.trial).items()}
