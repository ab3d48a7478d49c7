"""Vocabulary and TF-IDF features, as rows (doc, term, weight) or as ML vectors."""

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.functions.text import terms


def term_counts(df: DataFrame, text: str = "article_title", by: Sequence[str] = ()) -> DataFrame:
    """Occurrences (``n``) and documents (``docs``) of each term (for each value of ``by``).

    Both come from one pass: a document sends each occurrence once and each
    distinct term once. Hot terms are summed per task before the shuffle.
    """
    found = F.col("_terms")
    events = F.concat(
        F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("docs"))),
        F.transform(
            F.array_distinct(found), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("docs"))
        ),
    )
    rows = df.select(*by, terms(F.col(text)).alias("_terms")).select(*by, F.inline(events))
    return rows.groupBy(*by, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(df: DataFrame, max_features: int, text: str = "article_title") -> DataFrame:
    """The ``max_features`` most frequent terms; equal counts go by term.

    How many terms have each count shows which counts can still reach the
    vocabulary. Rarer terms go before the sort, as most terms are rare. Both
    uses of the counts read the same columns, so the shuffle behind them runs once.
    """
    counts = term_counts(df, text).filter((F.col("docs") > 0) & (F.col("n") > 0))
    most_frequent = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    least = (
        counts.groupBy("n")
        .agg(F.count(F.lit(1)).alias("n_terms"))
        .withColumn("ahead", F.coalesce(F.sum("n_terms").over(most_frequent), F.lit(0)))
        .filter(F.col("ahead") < max_features)
        .agg(F.min("n"))
    )
    return counts.filter(F.col("n") >= least.scalar()).orderBy(F.desc("n"), "term").limit(max_features)


def with_idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    """Add ln((1 + N) / (1 + docs)) + 1."""
    return vocab.withColumn("idf", F.log((F.lit(n_docs) + 1.0) / (F.col("docs") + 1.0)) + 1.0)


def tfidf(
    df: DataFrame,
    keys: str | Sequence[str],
    max_features: int,
    text: str = "article_title",
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """(keys, term, tfidf): term count times idf, scaled to length 1 per row.

    ``fit_on`` gives the rows the vocabulary and idf come from, ``df`` by default.
    Weights are computed inside each row, so the rows are not shuffled.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    model = fit_tfidf_vectors(df if fit_on is None else fit_on, max_features, text, "_vector")
    names = df.sparkSession.createDataFrame(list(enumerate(vocabulary_terms(model))), "_place int, term string")
    vectors = model.transform(df.select(*{c: None for c in [*keys, text]}))
    parts = vectors.select(*keys, sparse_parts("_vector").alias("_parts"))
    weights = parts.select(
        *keys, F.inline(F.arrays_zip("_parts.indices", "_parts.values")).alias("_place", "tfidf")
    )
    return weights.join(F.broadcast(names), "_place").select(*keys, "term", "tfidf")


def sparse_parts(vector: str) -> Column:
    """Indices and values of a sparse ML vector, as a struct that has both."""
    return F.unwrap_udt(vector)


def vocabulary_terms(model: PipelineModel) -> list[str]:
    """Terms of a fitted pipeline, by vector index."""
    return next(stage.vocabulary for stage in model.stages if isinstance(stage, CountVectorizerModel))


def fit_tfidf_vectors(df: DataFrame, max_features: int, text: str = "article_title", out: str = "features") -> PipelineModel:
    """A savable pipeline that turns a text column into TF-IDF vectors, row by row without a shuffle.

    The vocabulary (at most ``max_features`` terms) is model state and goes
    through the driver.
    """
    n_docs = df.count()
    vocab = with_idf(vocabulary(df, max_features, text), n_docs).select("term", "idf").collect()
    if not vocab:
        raise ValueError("no terms to fit on")
    split = SQLTransformer(
        statement=f"SELECT *, regexp_extract_all(lower(coalesce(`{text}`, '')), r'{V.TERM_PATTERN}', 0) AS _terms FROM __THIS__"
    )
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in vocab], inputCol="_terms", outputCol="_counts")
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in vocab]), inputCol="_counts", outputCol="_weighted"
    )
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=out)
    tidy = SQLTransformer(statement="SELECT * EXCEPT (_terms, _counts, _weighted) FROM __THIS__")
    return PipelineModel([split, counts, weigh, unit, tidy])


def max_features_for(langs: Sequence[str]) -> int:
    """Vocabulary size of a run over these languages."""
    return V.MAX_FEATURES_ONE_LANGUAGE if len(langs) == 1 else V.MAX_FEATURES_MANY_LANGUAGES
