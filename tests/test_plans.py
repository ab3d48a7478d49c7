"""Physical plans: no Python on the hot path, one shuffle where one is enough, small sides broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from newsfold import schemas
from newsfold.functions import text
from newsfold.operators import crawl, features, reports, rows, split, svm


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "h")
    data = [(f"u{i}", f"title {i}", i % 2, 50 + i % 9, ("en", "it")[i % 2]) for i in range(200)]
    spark.createDataFrame(data, schemas.HEADLINE).write.partitionBy("lang").parquet(path)
    return spark.read.schema(schemas.HEADLINE).parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def python_free(p):
    return not any(word in p for word in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"))


def test_split_moves_no_rows(table):
    p = plan(split.train_val_test(table, "article_url"))
    assert "Exchange hashpartitioning" not in p and "Window" not in p and "BroadcastHashJoin" in p


def test_sample_moves_no_rows(table):
    p = plan(rows.sample_n(table, 20, "article_url"))
    assert "hashpartitioning" not in p and "TakeOrdered" not in p and "Join" not in p and "CartesianProduct" not in p


def test_tfidf_moves_no_rows(table):
    p = plan(features.tfidf(table, "article_url", 50))
    assert "hashpartitioning" not in p and python_free(p)


def test_reports_aggregate_before_grouping_sets(table):
    p = plan(reports.length_histogram(table))
    assert p.index("Expand") < p.index("partial_count(1)")
    assert "article_title" not in p and python_free(p)


def test_dedup_combines_before_its_one_shuffle(table):
    p = plan(rows.dedup_by(table.select("article_url", "article_title"), "article_url", []))
    assert p.count("Exchange") == 1 and "partial_min" in p
    assert "is_sarcastic" not in p


def test_crawl_rows_are_narrow(spark):
    fetched = spark.createDataFrame([], schemas.FETCHED_DOCUMENT)
    p = plan(crawl.article_rows(fetched))
    assert "Exchange" not in p and python_free(p)


def test_language_filter_reaches_the_folders(table):
    df = rows.select_langs(table, ["it"])
    details = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*lang", details)


def test_text_functions_stay_in_the_jvm(table):
    tokens = text.remove_stopwords(text.alpha_tokens(text.word_tokens(F.lower("article_title"))), ["a", "the"])
    p = plan(table.select(text.render_tokens(tokens)))
    assert python_free(p) and "Exchange" not in p


def test_scoring_stays_in_the_jvm(spark, table):
    model = features.fit_tfidf_vectors(table, 50)
    vectors = model.transform(table)
    fitted = svm.linear_svm(vectors.coalesce(1), 1.0, 200)
    p = plan(svm.score(vectors, fitted))
    assert python_free(p) and "Exchange" not in p
