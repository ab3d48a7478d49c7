"""One Spark query per operator, over whole test tables."""

import uuid

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.views import (
    dated_pages,
    headlines,
    predictions,
    site_indexes,
    table,
    visits,
)
from newsfold.functions import html, labels, text
from newsfold.operators import abbreviations, crawl, domains, features, kernels, metrics, reports, rows, split, svm, tokens
from newsfold.plans import dataset, experiments, headline_table, run_masks
from newsfold.session import checkpoint_folder, reliable_checkpoint

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Parameters that the test languages (en, fr, de, es) need.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "be", "as", "by"),
    "fr": ("de", "la", "le", "les", "des", "et", "un", "une", "en", "du", "que", "qui", "au", "pour", "sur", "est"),
    "de": ("der", "die", "das", "und", "den", "von", "zu", "in", "es", "sich", "nicht", "auch", "als", "an", "er"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "un", "por", "con", "no", "una", "para", "se", "del", "las"),
}
ALL_STOP_WORDS = sorted({w for words in STOP_WORDS.values() for w in words})
LEMMAS = (
    ("en", "is", "n", "be"), ("en", "was", "n", "be"), ("en", "are", "n", "be"), ("en", "are", "v", "are-verb"),
    ("en", "this", "n", "this-one"), ("fr", "les", "n", "le"), ("fr", "des", "n", "un"), ("de", "den", "n", "der"),
    ("de", "die", "n", "der"), ("es", "los", "n", "el"), ("es", "las", "n", "el"),
)
SECTIONS = ("In in oredble ea.", "Nicht aulich für sch erüver enau sch der.")
SUFFIXES = ("com", "net", "org", "example.com", "example.net", "example.org")
DOMAINS = ("tionsh.example.net", "ththan.example.net", "tiontion.example.com", "ththhe.example.com", "ththly.example.org")
LANG_NAMES = {"English": "en", "French": "fr", "German": "de"}
MAX_FEATURES = features.max_features_for(tuple(STOP_WORDS))
RUNS = (
    experiments.Run("en-svm", "svm", ("en",)),
    experiments.Run("fr-svm", "svm", ("fr",)),
    experiments.Run("m-svm-all", "svm", ("en", "fr", "de", "es")),
    experiments.Run("m-bert-en", "bert", ("en",), True),
    experiments.Run("m-bert-de-es", "bert", ("de", "es"), True),
)
INDEX_RULES = {"F": crawl.MONTHLY_SITEMAPS, "O": crawl.POST_SITEMAPS, "P": crawl.LinkRule()}
ARTICLE_RULES = {
    "view": crawl.DATED_ARTICLES, "click": crawl.NEWS_ARTICLES, "signup": crawl.NO_IMAGES,
    "error": crawl.NO_IMAGES, "purchase": crawl.LinkRule(),
}
SOURCES = {
    "fr_de": dataset.SourceConfig("xx", 1, site_name="the", lower_title=True, order=("first_url",)),
    "es": dataset.SourceConfig("es", 0, sample=200, drop_images=True, lower_title=True),
    "en": dataset.SourceConfig("en", None, renames={"link": "article_url", "headline": "article_title"}),
}


def _joined(column):
    return F.array_join(column, "|")


# Crawl data

@query
def sitemap_index_links(spark, sf_dir):
    return crawl.sitemap_index_links(site_indexes(spark, sf_dir), INDEX_RULES)


@query
def sitemap_article_links(spark, sf_dir):
    return crawl.sitemap_article_links(visits(spark, sf_dir), ARTICLE_RULES)


@query
def ok_responses(spark, sf_dir):
    return crawl.ok_responses(visits(spark, sf_dir)).select("event_id", "status")


@query
def extract_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.extract_title(F.col("html")).alias("article_title"))


@query
def extract_body(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.extract_body(F.col("html")).alias("article_text"))


@query
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.clean_html(F.col("html")).alias("clean"))


@query
def drop_section_pages(spark, sf_dir):
    return crawl.drop_section_pages(extract_title(spark, sf_dir), SECTIONS)


@query
def trim_media_credit(spark, sf_dir):
    credited = F.when(F.col("lang") != "en", F.concat(F.lit("VIDEO "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", html.trim_media_credit(credited).alias("article_text"))


@query
def guess_publish_date(spark, sf_dir):
    guess = html.guess_publish_date(F.col("url"), F.col("html"))
    return dated_pages(spark, sf_dir).select("o_orderkey", guess.alias("g")).select("o_orderkey", "g.*")


@query
def crawl_stamp(spark, sf_dir):
    return crawl.with_crawl_date(table(spark, sf_dir, "events"), F.col("ts")).select("event_id", "crawl_date")


@query
def article_rows(spark, sf_dir):
    fetched = table(spark, sf_dir, "pages").select(
        F.substring_index("url", ":", 1).alias("source"), "url", F.lit(200).alias("status"), F.col("html").alias("body")
    )
    return crawl.article_rows(fetched, SECTIONS)


# Rows of the dataset build

@query
def title_length(spark, sf_dir):
    h = headlines(spark, sf_dir).drop("title_length")
    return rows.project(rows.with_title_length(h), ["article_url", "title_length", "no_such_column"])


@query
def length_band(spark, sf_dir):
    return rows.length_band(headlines(spark, sf_dir)).select("article_url", "title_length")


@query
def dedup_by_url(spark, sf_dir):
    h = headlines(spark, sf_dir).select("article_title", "article_url", "lang")
    return rows.dedup_by(h, "article_title", ["article_url"])


@query
def incremental_dedup(spark, sf_dir):
    """Three batches, one of them twice, merged into a table of their own; what is kept is that of one dedup of all."""
    h = headlines(spark, sf_dir).select("article_title", "article_url", "lang")
    path = f"{checkpoint_folder(spark)}/headlines-{uuid.uuid4().hex}"
    headline_table.create(spark, path, h.schema, "article_title", ["article_url"])
    for langs in (["fr", "es"], ["en"], ["fr", "es"], ["de"]):
        headline_table.merge(h.filter(F.col("lang").isin(langs)), path)
    headline_table.merge(h.filter(~F.col("lang").isin("en", "fr", "de", "es") | F.col("lang").isNull()), path)
    return headline_table.read(spark, path)


@query
def sample_n(spark, sf_dir):
    return rows.sample_n(headlines(spark, sf_dir), 50, "article_url").select("article_url", "is_sarcastic")


@query
def union_sources(spark, sf_dir):
    h = headlines(spark, sf_dir)
    english = rows.label_slice(h, langs=["en"]).select("article_url", "lang", "is_sarcastic")
    others = h.filter(F.col("lang") != "en").select("is_sarcastic", "article_url", "lang")
    return rows.union_sources([english, others])


@query
def strip_site_suffix(spark, sf_dir):
    titled = F.concat("article_title", F.lit(" | Lercio"))
    return headlines(spark, sf_dir).select("article_url", text.strip_site_suffix(titled, "Lercio").alias("article_title"))


@query
def drop_image_urls(spark, sf_dir):
    return rows.drop_image_urls(visits(spark, sf_dir)).select("event_id", "article_url")


@query
def build_dataset(spark, sf_dir):
    h = headlines(spark, sf_dir).select("article_url", "article_title", "is_sarcastic", "lang")
    copies = h.filter(F.col("lang").isin("fr", "de")).withColumn("first_url", F.col("article_url"))
    frames = {
        "fr_de": copies.withColumn("article_url", F.col("article_title")),
        "es": h.filter(F.col("lang") == "es"),
        "en": h.filter(F.col("lang") == "en").withColumnsRenamed({"article_url": "link", "article_title": "headline"}),
    }
    return dataset.build_dataset(frames, SOURCES)


# Text

@query
def normalize_headline(spark, sf_dir):
    return headlines(spark, sf_dir).select("article_url", text.normalize_headline(F.col("article_title")).alias("clean"))


def _tokens(spark, sf_dir):
    h = headlines(spark, sf_dir)
    return h.select("article_url", "lang", text.word_tokens(F.lower("article_title")).alias("tokens"))


@query
def word_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("article_url", _joined("tokens").alias("tokens"))


@query
def abbreviation_scores(spark, sf_dir):
    return abbreviations.abbreviation_scores(headlines(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query
def learned_word_tokens(spark, sf_dir):
    h = headlines(spark, sf_dir).select("article_url", "lang", "article_title")
    named = abbreviations.with_abbreviations(h, abbreviations.learned_abbreviations(h))
    found = text.word_tokens(F.lower("article_title"), F.col("abbreviations"))
    return named.select("article_url", _joined(found).alias("tokens"))


@query
def remove_stopwords(spark, sf_dir):
    kept = text.remove_stopwords(F.col("tokens"), ALL_STOP_WORDS)
    by_lang = text.remove_stopwords(F.col("tokens"), STOP_WORDS, F.col("lang"))
    return _tokens(spark, sf_dir).select("article_url", _joined(kept).alias("kept"), _joined(by_lang).alias("kept_by_lang"))


@query
def alpha_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("article_url", _joined(text.alpha_tokens(F.col("tokens"))).alias("tokens"))


@query
def lemmatize(spark, sf_dir):
    lemmas = spark.createDataFrame(LEMMAS, "lang string, word string, pos string, lemma string")
    found = tokens.lemmatize(_tokens(spark, sf_dir), ["article_url", "lang"], "tokens", lemmas)
    return found.select("article_url", _joined("lemmas").alias("lemmas"))


@query
def render_tokens(spark, sf_dir):
    alpha = text.alpha_tokens(F.col("tokens"))
    return _tokens(spark, sf_dir).select("article_url", text.render_tokens(alpha).alias("rendered"))


@query
def lang_labels(spark, sf_dir):
    name = labels.lang_name(F.col("lang"), LANG_NAMES)
    return headlines(spark, sf_dir).select(
        "article_url",
        name.alias("lang_name"),
        labels.lang_code(name, LANG_NAMES).alias("lang_code"),
        labels.article_type(F.col("is_sarcastic")).alias("article_type"),
        labels.article_type(F.col("is_sarcastic"), for_file=True).alias("file_type"),
    )


def _domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        labels.registered_domain(F.col("url"), SUFFIXES).alias("any_domain"),
        labels.registered_domain(F.col("url"), SUFFIXES, DOMAINS).alias("domain"),
        F.when(F.startswith("url", F.lit("https:")), 1).otherwise(0).alias("is_sarcastic"),
    )


#: Rules of a suffix table, with a wildcard and an exception to it.
SUFFIX_RULES = ("org", "com", "*.net", "!ththan.example.net", "example.com", "*.example.net")


@query
def registered_domain_table(spark, sf_dir):
    rules = spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return domains.with_registered_domain(pages, "url", rules).drop("url")


@query
def registered_domain(spark, sf_dir):
    return _domains(spark, sf_dir).select("page_id", "any_domain", "domain")


# Reports

@query
def label_counts(spark, sf_dir):
    return reports.label_counts(headlines(spark, sf_dir))


@query
def length_stats(spark, sf_dir):
    return reports.length_stats(rows.length_band(headlines(spark, sf_dir)))


@query
def length_stats_all(spark, sf_dir):
    return reports.length_stats_all(headlines(spark, sf_dir))


@query
def length_stats_sets(spark, sf_dir):
    return reports.length_stats_sets(headlines(spark, sf_dir)).drop("level")


@query
def source_medians(spark, sf_dir):
    return reports.source_medians(headlines(spark, sf_dir))


@query
def lang_label_pivot(spark, sf_dir):
    return reports.label_pivot(headlines(spark, sf_dir), "lang")


@query
def domain_label_pivot(spark, sf_dir):
    return reports.label_pivot(_domains(spark, sf_dir), "domain")


@query
def length_histogram(spark, sf_dir):
    return reports.length_histogram(headlines(spark, sf_dir))


@query
def histogram_summary(spark, sf_dir):
    return reports.histogram_summary(headlines(spark, sf_dir))


# Splits

@query
def select_langs(spark, sf_dir):
    return rows.select_langs(headlines(spark, sf_dir), ["fr", "es"]).select("article_url", "lang")


@query
def holdout_langs(spark, sf_dir):
    return split.holdout_langs(headlines(spark, sf_dir), ["en", "fr"]).select("article_url", "part")


@query
def stratified_split(spark, sf_dir):
    return split.stratified_split(headlines(spark, sf_dir), "article_url").select("article_url", "split")


@query
def train_val_test(spark, sf_dir):
    return split.train_val_test(headlines(spark, sf_dir), "article_url").select("article_url", "is_sarcastic", "split")


@query
def split_sizes(spark, sf_dir):
    return split.split_sizes(split.train_val_test(headlines(spark, sf_dir), "article_url"))


@query
def experiment_grid(spark, sf_dir):
    h = headlines(spark, sf_dir).select("article_url", "is_sarcastic", "lang")
    return experiments.experiment_grid(h, RUNS).select("run", "article_url", "split")


def _masked(spark, sf_dir):
    h = headlines(spark, sf_dir).select("article_url", "article_title", "is_sarcastic", "lang")
    return run_masks.split_masks(h, RUNS)


@query
def split_masks(spark, sf_dir):
    return _masked(spark, sf_dir).select("article_url", run_masks.TRAIN, run_masks.VAL, run_masks.TEST)


@query
def run_label_counts(spark, sf_dir):
    return run_masks.label_counts_by_run(_masked(spark, sf_dir), RUNS)


@query
def run_vocabularies(spark, sf_dir):
    return run_masks.vocabularies(_masked(spark, sf_dir), RUNS)


@query
def run_transfer(spark, sf_dir):
    """Given predictions: runs with an even number flag titles of odd length, the others those of even length."""
    given = [F.shiftleft(((F.length("article_title") + i) % 2).cast("long"), i) for i in range(len(RUNS))]
    masked = _masked(spark, sf_dir).withColumn("predicted_of", sum(given[1:], given[0]))
    return _rounded(run_masks.transfer_of_runs(masked, RUNS, 1.0), ["run", "lang"])


# Features, models, scoring

@query
def term_counts(spark, sf_dir):
    return features.term_counts(headlines(spark, sf_dir))


@query
def vocabulary(spark, sf_dir):
    return features.vocabulary(headlines(spark, sf_dir), MAX_FEATURES).select("term", "n")


@query
def tfidf(spark, sf_dir):
    weights = features.tfidf(headlines(spark, sf_dir), "article_url", MAX_FEATURES)
    return weights.select("article_url", "term", F.round("tfidf", 6).alias("tfidf"))


def _vectors(spark, sf_dir):
    narrow = headlines(spark, sf_dir).select("article_url", "article_title", "is_sarcastic")
    h = reliable_checkpoint(split.train_val_test(narrow, "article_url"))  # read by the count, the vocabulary, fit and score
    train = h.filter((F.col("split") == "train") & F.col("is_sarcastic").isNotNull())
    model = features.fit_tfidf_vectors(train, MAX_FEATURES)
    # Read by the solver's summary, its blocks and the score, or by gamma, the landmarks and the map.
    vectors = reliable_checkpoint(model.transform(h).select("article_url", "is_sarcastic", "split", "features"))
    return vectors, vectors.filter((F.col("split") == "train") & F.col("is_sarcastic").isNotNull())


@query
def svm_predictions(spark, sf_dir):
    vectors, train = _vectors(spark, sf_dir)
    model = svm.linear_svm(train, 1.0)
    return svm.score(vectors, model).select("article_url", "split", "is_sarcastic", "prediction", "confidence")


@query
def scale_gamma(spark, sf_dir):
    h = headlines(spark, sf_dir).select("article_title")
    gamma = kernels.scale_gamma(features.fit_tfidf_vectors(h, MAX_FEATURES).transform(h))
    return spark.createDataFrame([(gamma,)], "gamma double").select(F.round("gamma", 6).alias("gamma"))


@query
def kernel_features(spark, sf_dir):
    vectors, train = _vectors(spark, sf_dir)
    kernel = kernels.Kernel("rbf", kernels.scale_gamma(train))
    mapped = kernels.kernel_features(vectors, kernels.pick_landmarks(train, 200, "article_url"), kernel)
    return mapped.select("article_url", vector_to_array("kernel_features").alias("kernel_features"))


@query
def score_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scored = svm.score_softmax(e, F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double"))
    return scored.select("vec_id", "is_sarcastic", F.round("confidence", 6).alias("confidence"))


@query
def score_external(spark, sf_dir):
    h = headlines(spark, sf_dir).select("article_url", text.normalize_headline(F.col("article_title")).alias("clean"))

    def load():
        def predict(texts):
            words = np.array([len(t.split()) for t in texts], dtype=float)
            return np.stack([words, 12.0 - words], axis=1)

        return predict

    scores = svm.score_external(h, "clean", load)
    return svm.score_softmax(scores, F.get("scores", F.lit(0)), F.get("scores", F.lit(1))).select(
        "article_url", "is_sarcastic", F.round("confidence", 6).alias("confidence")
    )


# Evaluation

@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(predictions(spark, sf_dir))


@query
def accuracy(spark, sf_dir):
    return metrics.accuracy(predictions(spark, sf_dir), by=["lang"])


def _rounded(df, keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query
def macro_prf(spark, sf_dir):
    return _rounded(metrics.macro_prf(predictions(spark, sf_dir), 0.0), [])


@query
def transfer_matrix(spark, sf_dir):
    m = predictions(spark, sf_dir).withColumn("run", F.when(F.col("y_pred") == 1, "flagged").otherwise("plain"))
    return _rounded(experiments.transfer_matrix(m, 1.0), ["run", "lang"])


@query
def leaderboard(spark, sf_dir):
    scored = metrics.macro_prf(predictions(spark, sf_dir), 0.0, by=["lang"])
    records = scored.select(F.lit("svm").alias("family"), F.col("lang").alias("run"), F.lit("test").alias("split"), "*")
    return _rounded(metrics.leaderboard(records), ["family", "run"])


@query
def transfer_gap(spark, sf_dir):
    gaps = metrics.transfer_gap(experiments.trained_and_unseen(predictions(spark, sf_dir), RUNS))
    return gaps.select("run", *[F.round(c, 6).alias(c) for c in ("f1_trained", "f1_unseen", "gap")])
