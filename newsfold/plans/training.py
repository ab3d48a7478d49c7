"""Training runs, from headlines to saved models and run records."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold import schemas
from newsfold.functions.text import alpha_tokens, remove_stopwords, word_tokens
from newsfold.operators import features, metrics, svm
from newsfold.operators.rows import select_langs, union_sources
from newsfold.operators.split import holdout_langs, stratified_split, train_val_test
from newsfold.operators.tokens import lemmatize
from newsfold.plans.experiments import Run


def prepare_text(df: DataFrame, stop_words, lemmas: DataFrame | None = None, by_lang: bool = False) -> DataFrame:
    """Add ``article_title_preprocessed``: lower-cased words without stop words and non-letters, as lemmas.

    Equal rows stay apart.
    """
    lang = F.col("lang") if by_lang else None
    words = alpha_tokens(remove_stopwords(word_tokens(F.lower("article_title")), stop_words, lang))
    prepared = df.withColumn("article_title_preprocessed", words)
    if lemmas is None:
        return prepared
    return lemmatize(prepared, df.columns, "article_title_preprocessed", lemmas, "article_title_preprocessed")


def split_run(df: DataFrame, run: Run, key: str = "article_url", seed: int = V.SEED) -> DataFrame:
    """Add ``split`` for one run."""
    if not run.held_out:
        return train_val_test(select_langs(df, run.langs), key, seed=seed)
    parts = holdout_langs(df, run.langs)
    pool = stratified_split(parts.filter(F.col("part") == "pool"), key, seed=seed, names=("val", "train"))
    unseen = parts.filter(F.col("part") == "test").withColumn("split", F.lit("test"))
    return pool.unionByName(unseen).drop("part")


@dataclass
class TrainedRun:
    """Models of a run, its records (one row per evaluated part), and counts by part, language, label and prediction."""

    run: Run
    text_model: PipelineModel
    model: svm.SvmModel
    records: DataFrame
    pairs: DataFrame


def train_run(
    df: DataFrame,
    run: Run,
    text: str = "article_title",
    key: str = "article_url",
    fit_on: str = "train",
    trials: Sequence[svm.Trial] | None = None,
    threads: int = 2,
    n_landmarks: int = 200,
    seed: int = V.SEED,
    max_features: int | None = None,
    zero_division: float = V.SVM_ZERO_DIVISION,
) -> TrainedRun:
    """Split, fit TF-IDF, search, refit and evaluate one run.

    ``fit_on`` "train" takes vocabulary and idf from the training part only,
    "all" from every row of the run. Whatever the run is called, its record has
    the family of the model that was fitted.
    """
    parts = split_run(df, run, key, seed).select(key, text, "is_sarcastic", "lang", "split").persist()
    try:
        sizes = {r["split"]: r["n"] for r in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        fitted = parts if fit_on == "all" else parts.filter(F.col("split") == "train")
        text_model = features.fit_tfidf_vectors(fitted, max_features or features.max_features_for(run.langs), text)
        vectors = text_model.transform(parts)
        train, val = (vectors.filter(F.col("split") == part) for part in ("train", "val"))
        model, _ = svm.search(train, val, key, trials, threads, n_landmarks, seed=seed)
        evaluated = vectors.filter(F.col("split") != "train").select("features", "is_sarcastic", "lang", "split")
        by = ("split", "lang")
        counts = metrics.pair_counts(model.transform(evaluated), "is_sarcastic", "prediction", by).collect()
    finally:
        parts.unpersist()
    spark = df.sparkSession
    pairs = spark.createDataFrame(
        [(run.name, {"val": "eval"}.get(r["split"], r["split"]), r["lang"], r["y"], int(r["p"]), r["n"]) for r in counts],
        "run string, split string, lang string, y int, p int, n long",
    )
    return TrainedRun(run, text_model, model, _records(pairs, run, sizes, model, zero_division), pairs)


def _records(pairs: DataFrame, run: Run, sizes: dict, model: svm.SvmModel, zero_division: float) -> DataFrame:
    scores = metrics.macro_from_pairs(pairs, zero_division, ["split"])

    def cell(y: int, p: int):
        return F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("n"))), F.lit(0))

    cells = pairs.groupBy("split").agg(
        cell(0, 0).alias("true_negative"),
        cell(0, 1).alias("false_positive"),
        cell(1, 0).alias("false_negative"),
        cell(1, 1).alias("true_positive"),
    )
    fixed = {
        "family": F.lit("svm"),
        "run": F.lit(run.name),
        "training_data_size": F.lit(sizes.get("train", 0)).cast("long"),
        "evaluation_data_size": F.lit(sizes.get("val", 0)).cast("long"),
        "test_data_size": F.lit(sizes.get("test", 0)).cast("long"),
        "parameters": F.create_map(*[F.lit(x) for pair in svm.parameters(model).items() for x in pair]),
    }
    return scores.join(cells, "split").withColumns(fixed).select(*schemas.RUN_RECORD.names)


def train_runs(df: DataFrame, runs: Sequence[Run], **options) -> tuple[DataFrame, DataFrame]:
    """Train several runs. Returns all run records, and the test scores by run and language."""
    trained = [train_run(df, run, **options) for run in runs]
    pairs = union_sources([t.pairs for t in trained]).filter(F.col("split") == "test")
    return union_sources([t.records for t in trained]), metrics.macro_from_pairs(pairs, options.get("zero_division", V.SVM_ZERO_DIVISION), ["run", "lang"])
