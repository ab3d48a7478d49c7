import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsfold import schemas
from newsfold.operators.metrics import leaderboard
from newsfold.sources import readers, writers


def test_article_csv_round_trip(spark, tmp_path):
    rows = [
        ("https://x/a", 'He said "hi", twice', "two\nlines", datetime(2020, 1, 2, 3, 4, 5), "url", "date"),
        ("https://x/b", None, None, None, None, None),
        ("https://x/c", " blank at both ends ", "x", None, None, None),
    ]
    df = spark.createDataFrame(rows, schemas.RAW_ARTICLE)
    out = str(tmp_path / "articles")
    writers.write_dataset_csv(df, out)
    (tmp_path / "articles" / "notes.txt").write_text("not a csv")
    assert any("2020-01-02 03:04:05" in p.read_text() for p in (tmp_path / "articles").glob("*.csv"))
    back = readers.read_article_csv(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_pandas_style_csv(spark, tmp_path):
    (tmp_path / "one.csv").write_text('url,title\nhttps://x/1,"a ""b"", c"\n')
    (tmp_path / "two.csv").write_text("url,title\nhttps://x/2,é\n", encoding="utf-8")
    df = readers.read_renamed_csv(spark, str(tmp_path))
    assert df.columns == ["article_url", "article_title"]
    assert sorted(map(tuple, df.collect())) == [("https://x/1", 'a "b", c'), ("https://x/2", "é")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"article_link": "u", "headline": "h", "is_sarcastic": 1}\n')
    (tmp_path / "b.json").write_text('{"is_sarcastic": 0, "headline": "g", "article_link": "v"}\n')
    df = readers.read_json_lines(spark, str(tmp_path))
    assert {(r["article_url"], r["article_title"], r["is_sarcastic"]) for r in df.collect()} == {("u", "h", 1), ("v", "g", 0)}


def headlines(spark):
    rows = [("u1", "a", 1, 1, "nl"), ("u2", "b", 0, 1, "it"), ("u3", "c", 0, 1, "en")]
    return spark.createDataFrame(rows, schemas.HEADLINE)


def test_dataset_is_partitioned_by_language(spark, tmp_path):
    path = str(tmp_path / "table")
    writers.write_dataset(headlines(spark), path)
    assert sorted(p.name for p in (tmp_path / "table").glob("lang=*")) == ["lang=en", "lang=it", "lang=nl"]
    df = readers.read_dataset(spark, path, ["nl", "it"])
    assert {r["article_url"] for r in df.collect()} == {"u1", "u2"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [lang" in plan


def test_prepared_csv_holds_python_lists(spark, tmp_path):
    df = headlines(spark).withColumn("tokens", F.array("article_title", F.lit("x")))
    writers.write_dataset_csv(df, str(tmp_path / "out"))
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).collect()
    assert {r["tokens"] for r in rows} == {"['a', 'x']", "['b', 'x']", "['c', 'x']"}
    writers.write_dataset_csv(headlines(spark), str(tmp_path / "plain"))
    assert sorted(map(tuple, readers.read_dataset_csv(spark, str(tmp_path / "plain")).collect())) == sorted(map(tuple, headlines(spark).collect()))


def test_prepared_csv_can_be_read_back(spark, tmp_path):
    words = [["it's", 'say "no"', "back\\slash", "'\"both\"'"], [], ["é", "a, b", "", "]['"]]
    rows = [(f"u{i}", f"title, {i}", i % 2, 7, "en", w) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, schemas.PREPARED)
    writers.write_dataset_csv(df, str(tmp_path / "out"))
    for multi_line in (True, False):
        back = readers.read_dataset_csv(spark, str(tmp_path / "out"), schemas.PREPARED, multi_line=multi_line)
        assert back.schema == schemas.PREPARED
        assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_article_csv_without_line_breaks_is_split(spark, tmp_path):
    df = spark.range(20000).select(*[F.col("id").cast("string").alias(c) if c.startswith("article") else F.lit(None).cast(schemas.RAW_ARTICLE[c].dataType).alias(c) for c in schemas.RAW_ARTICLE.names])
    writers.write_dataset_csv(df.coalesce(1), str(tmp_path / "out"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        whole, parts = (readers.read_article_csv(spark, str(tmp_path / "out"), multi_line=m) for m in (True, False))
        assert parts.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
        assert parts.count() == whole.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_crawl_batches_append(spark, tmp_path):
    df = spark.createDataFrame([("s", "u", "t")], "source string, article_url string, article_title string")
    for day in ("2024-01-09", "2024-01-10", "2024-01-10"):
        writers.write_crawl_batch(df, str(tmp_path / "raw"), F.lit(day).cast("timestamp"))
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert back.count() == 3
    assert {p.name for p in (tmp_path / "raw" / "source=s").iterdir() if p.is_dir()} == {"crawl_date=20240109", "crawl_date=20240110"}


def test_run_records(spark, tmp_path):
    record = {"family": "svm", "run": "en-svm", "split": "test", "f1": 0.5, "training_data_size": 3, "parameters": {"kernel": "rbf"}}
    row = [record.get(name) for name in schemas.RUN_RECORD.names]
    for _ in range(2):
        writers.write_run_record(spark.createDataFrame([row], schemas.RUN_RECORD), str(tmp_path / "runs"))
    back = readers.read_run_records(spark, str(tmp_path / "runs")).collect()
    assert len(back) == 2 and back[0]["family"] == "svm" and back[0]["parameters"] == {"kernel": "rbf"}


def test_result_tree(spark, tmp_path):
    files = {
        "bert/en-bert/scores_test.json": {"precision": 0.9, "recall": 0.8, "f1": 0.85, "accuracy": 0.86},
        "bert/en-bert/scores_eval.json": {"precision": 0.1, "recall": 0.1, "f1": 0.1, "accuracy": 0.1},
        "bert/en-bert/confusion_matrix_test.json": {"true_negative": 1, "false_positive": 2, "false_negative": 3, "true_positive": 4},
        "svm/en-svm/scores.json": {"precision": 0.7, "recall": 0.7, "f1": 0.9, "accuracy": 0.7},
        "svm/en-svm/hyperparameters.json": {"kernel": "rbf", "svm-regularization": 8.4, "degree": 4.0},
        "svm/en-svm/training_test_data_size.json": {"training_data_size": 10, "evaluation_data_size": 2, "test_data_size": 3},
    }
    for name, content in files.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(content))
    df = readers.read_result_files(spark, str(tmp_path / "tree"))
    found = {(r["family"], r["run"], r["kind"], r["split"]): r for r in df.collect()}
    assert len(found) == 6
    assert found["bert", "en-bert", "confusion_matrix", "test"]["true_positive"] == 4
    assert found["svm", "en-svm", "hyperparameters", None]["svm-regularization"] == 8.4
    assert found["svm", "en-svm", "training_test_data_size", None]["test_data_size"] == 3
    assert [(r["run"], r["f1"]) for r in leaderboard(df).collect()] == [("en-svm", 0.9), ("en-bert", 0.85)]


def test_sitemap_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<urlset>\n<url><loc>u</loc></url>\n</urlset>")
    rows = readers.read_sitemaps(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["url"].endswith("a.xml") and "<loc>u</loc>" in rows[0]["body"]
