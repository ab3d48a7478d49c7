import pytest
from pyspark.sql import functions as F

from newsfold.operators import split
from newsfold.plans import experiments
from tests.golden import CLASS_TOTALS, SPLITS, SVM_SIZES


def pool(langs):
    return {label: sum(CLASS_TOTALS[lang][label] for lang in langs) for label in (0, 1)}


@pytest.mark.parametrize("run", [r for r in experiments.standard_runs()], ids=lambda r: r.name)
def test_quotas_give_the_published_sizes(run):
    counts = pool(run.langs)
    if run.held_out:
        val = split.class_quotas(counts, 0.10)
        test = {c: n - counts[c] for c, n in pool(CLASS_TOTALS).items()}
    else:
        both = split.train_val_test_quotas(counts)
        test, val = ({c: q[i] for c, q in both.items()} for i in (0, 1))
    train = {c: counts[c] - val[c] - (0 if run.held_out else test[c]) for c in counts}
    parts = tuple(tuple(p[c] for c in (0, 1)) for p in (train, val, test))
    if run.family == "svm":
        assert tuple(map(sum, parts)) == SVM_SIZES[run.name]
    else:
        assert parts == SPLITS[run.name]


@pytest.fixture(scope="module")
def full_size(spark):
    """A headline table with the published class totals."""
    rows = [(lang, label, n) for lang, totals in CLASS_TOTALS.items() for label, n in enumerate(totals)]
    counts = spark.createDataFrame(rows, "lang string, is_sarcastic int, n int")
    each = counts.select("lang", "is_sarcastic", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return each.withColumn("article_url", F.concat_ws("/", "lang", F.col("is_sarcastic").cast("string"), F.col("i").cast("string"))).cache()


def test_grid_gives_all_published_splits(spark, full_size):
    grid = experiments.experiment_grid(full_size, experiments.standard_runs())
    found = {}
    for r in grid.groupBy("run", "split", "is_sarcastic").count().collect():
        found.setdefault(r["run"], {}).setdefault(r["split"], {})[r["is_sarcastic"]] = r["count"]
    parts = {run: tuple(tuple(s[p][c] for c in (0, 1)) for p in ("train", "val", "test")) for run, s in found.items()}
    for run, sizes in SVM_SIZES.items():
        assert tuple(map(sum, parts.pop(run))) == sizes
    assert parts == SPLITS


def test_split_equals_the_grid(spark, full_size):
    from newsfold.plans.training import split_run

    runs = [r for r in experiments.standard_runs() if r.name in ("nl-bert", "m-bert-it")]
    grid = experiments.experiment_grid(full_size, runs)
    for run in runs:
        one = split_run(full_size, run).select("article_url", "split")
        same = grid.filter(F.col("run") == run.name).select("article_url", "split")
        assert one.count() == same.count() and one.exceptAll(same).isEmpty()


def test_parts_are_disjoint_and_cover(spark, full_size):
    parts = split.train_val_test(full_size, "article_url")
    assert parts.count() == full_size.count() == parts.select("article_url").distinct().count()
    assert parts.filter(F.col("split").isNull()).isEmpty()


def test_same_split_for_any_layout(spark, full_size):
    one = split.stratified_split(full_size, "article_url", fraction=0.25)
    two = split.stratified_split(full_size.repartition(5), "article_url", fraction=0.25)
    pairs = one.select("article_url", "split"), two.select("article_url", "split")
    assert pairs[0].exceptAll(pairs[1]).isEmpty()


def test_split_with_hot_copies(spark):
    """A third of all rows are full copies of one row; sizes stay exact and no row is lost."""
    hot = spark.range(4000).select(F.lit("hot").alias("article_url"), F.lit(1).alias("is_sarcastic"))
    rest = spark.range(8000).select(F.col("id").cast("string").alias("article_url"), (F.col("id") % 3 == 0).cast("int").alias("is_sarcastic"))
    df = hot.unionByName(rest).repartition(7)
    counts = {r[0]: r[1] for r in df.groupBy("is_sarcastic").count().collect()}
    for fraction in (0.1, 0.5, 0.9):
        quotas = split.train_val_test_quotas(counts, fraction)
        found = {(r[0], r[1]): r[2] for r in split.train_val_test(df, "article_url", fraction=fraction).groupBy("is_sarcastic", "split").count().collect()}
        for label, (test, val) in quotas.items():
            assert found[label, "test"] == test and found[label, "val"] == val
            assert found.get((label, "train"), 0) == counts[label] - test - val


def test_null_labels_are_a_class(spark):
    df = spark.createDataFrame([(str(i), [0, 1, None][i % 3]) for i in range(90)], "article_url string, is_sarcastic int")
    found = {(r[0], r[1]): r[2] for r in split.stratified_split(df, "article_url").groupBy("is_sarcastic", "split").count().collect()}
    assert found == {(c, s): n for c in (0, 1, None) for s, n in (("test", 3), ("train", 27))}


def test_holdout_langs_drops_null_languages(spark):
    df = spark.createDataFrame([("en",), ("it",), (None,)], "lang string")
    assert {tuple(r) for r in split.holdout_langs(df, ["en"]).collect()} == {("en", "pool"), ("it", "test")}


def test_resolve_run():
    assert experiments.resolve_run(["English", "Klingon"], "svm").langs == ("en",)
    assert experiments.resolve_run(["English"], "bert", multilingual=True, held_out=True).name == "m-bert-en"
    with pytest.raises(ValueError):
        experiments.resolve_run([], "svm")
    names = [(r.family, r.name) for r in experiments.standard_runs()]
    assert len(names) == len(set(names)) == 14
