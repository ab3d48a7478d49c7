from pyspark.sql import functions as F

from newsfold.operators import rows
from newsfold.plans import dataset


def test_length_band_bounds(spark):
    titles = [("x" * n,) for n in (45, 46, 184, 185)] + [(None,), ("𝒳" * 46,)]
    df = rows.with_title_length(spark.createDataFrame(titles, "article_title string"))
    assert sorted(r["title_length"] for r in rows.length_band(df).collect()) == [46, 46, 184]


def test_project_ignores_absent_names(spark):
    assert rows.project(spark.range(1).withColumn("a", F.lit(1)), ["a", "nope", "id"]).columns == ["a", "id"]


def test_dedup(spark):
    df = spark.createDataFrame(
        [("u", "b", 2), ("u", "a", 1), ("v", "c", 1), (None, "d", 9), (None, "e", 8), ("u", "0", 1)],
        "article_url string, article_title string, seen int",
    )
    once = rows.dedup_by(df, "article_url", ["seen"])
    assert {tuple(r) for r in once.collect()} == {("u", "0", 1), ("v", "c", 1), (None, "e", 8)}
    assert once.columns == df.columns
    assert rows.dedup_by(once, "article_url", ["seen"]).count() == 3


def test_dedup_prefers_titles_whatever_the_order(spark):
    df = spark.createDataFrame([("u", None, 1), ("u", "good", 2), ("v", None, 5), ("v", None, 4)], "article_url string, article_title string, seen int")
    assert {tuple(r) for r in rows.dedup_by(df, "article_url", ["seen"]).collect()} == {("u", "good", 2), ("v", None, 4)}
    by_title = rows.dedup_by(df, "article_title", ["seen"])
    assert {tuple(r) for r in by_title.collect()} == {("u", None, 1), ("u", "good", 2)}


def test_drop_image_urls(spark):
    urls = ["a.png", "a.jpeg", "a.jpg", "a.png?x", "axpng", None]
    df = spark.createDataFrame([(u,) for u in urls], "article_url string")
    assert [r[0] for r in rows.drop_image_urls(df).collect()] == ["a.jpg", "a.png?x", "axpng"]


def test_sample_is_exact_and_independent_of_layout(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("article_url"))
    samples = [{r[0] for r in rows.sample_n(df.repartition(n), 137, "article_url").collect()} for n in (1, 3, 16)]
    assert len(samples[0]) == 137 and samples[0] == samples[1] == samples[2]
    assert samples[0] != {r[0] for r in rows.sample_n(df, 137, "article_url", seed=1).collect()}
    assert rows.sample_n(df, 5000, "article_url").count() == 1000
    assert rows.sample_n(df, 0, "article_url").count() == 0


def test_sample_with_hot_keys(spark):
    """A third of the rows share one URL; some of them are full copies."""
    hot = spark.range(300).select(F.lit(None).cast("string").alias("article_url"), F.lit("same").alias("t"))
    mixed = spark.range(300).select(F.lit("hot").alias("article_url"), F.col("id").cast("string").alias("t"))
    rest = spark.range(300).select(F.concat(F.lit("u"), "id").alias("article_url"), F.lit("x").alias("t"))
    df = hot.unionByName(mixed).unionByName(rest)
    for n in (1, 250, 449, 450, 451, 620, 899, 900):
        found = [r for r in rows.sample_n(df, n, "article_url").collect()]
        assert len(found) == n
        again = [r for r in rows.sample_n(df.repartition(5), n, "article_url").collect()]
        assert sorted(map(str, found)) == sorted(map(str, again))


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    assert {tuple(r) for r in rows.union_sources([a, b]).collect()} == {(1, "x"), (2, "y")}


def title(text):
    return text + "x" * (60 - len(text))


def test_build_dataset_with_the_five_sources(spark):
    three = "article_url string, article_title string"
    frames = {
        "de_speld": spark.createDataFrame([("a", title("De Aap")), ("a", title("Zz")), ("b", "short"), ("c", None)], three),
        "nos": spark.createDataFrame([(f"n{i}", title(f"Nos {i} ")) for i in range(9)], "url string, title string"),
        "lercio": spark.createDataFrame([("l", title("Ciao Lercio ") + " | Lercio"), ("l.png", title("Foto"))], three),
        "il_giornale": spark.createDataFrame([(f"g{i}", title(f"G{i} ")) for i in range(4)] + [("g.jpeg", title("F"))], three),
        "english": spark.createDataFrame(
            [("e", title("The Onion"), 1), ("h", title("Huff"), 0)], "article_link string, headline string, is_sarcastic int"
        ),
    }
    built = {r["article_url"]: r for r in dataset.build_dataset(frames).collect()}
    assert len(built) == 1 + 9 + 1 + 4 + 2
    assert built["a"]["article_title"] == title("de aap") and built["a"]["lang"] == "nl" and built["a"]["is_sarcastic"] == 1
    assert built["n3"]["is_sarcastic"] == 0
    assert built["l"]["article_title"] == (title("Ciao Lercio ") + " | Lercio").replace(" Lercio", "").replace("|", "").lower()
    assert built["l"]["title_length"] == len(built["l"]["article_title"])
    assert built["e"]["article_title"] == title("The Onion") and built["e"]["is_sarcastic"] == 1
    assert built["h"]["lang"] == "en"


def test_sample_before_or_after_image_filter(spark):
    df = spark.createDataFrame([(f"u{i}" + (".png" if i < 10 else ""), title(str(i))) for i in range(20)], "article_url string, article_title string")
    after = dataset.SourceConfig("it", 0, sample=10, drop_images=True)
    first = dataset.SourceConfig("it", 0, sample=10, drop_images=True, sample_first=True)
    assert dataset.build_source(df, after).count() == 10
    assert dataset.build_source(df, first).count() < 10
