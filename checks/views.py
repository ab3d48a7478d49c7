"""Views over the test tables that stand in for the headline data, in Spark and as SQL text.

Every view covers all rows and whole texts of its tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: every line of every document is a headline; documents without a label have a null one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    lines = docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "quality", F.posexplode(F.split("text", "\n")).alias("line_no", "article_title")
    )
    return lines.select(
        F.concat(
            F.lit("http://"), "source", F.lit(".example/"), "lang", F.lit("/"), F.col("doc_id").cast("string"),
            F.lit("/"), F.col("line_no").cast("string"),
        ).alias("article_url"),
        "article_title",
        (1 - F.col("quality")).cast("int").alias("is_sarcastic"),
        "lang",
        "source",
        F.length("article_title").alias("title_length"),
    )


H_SQL = """
H0 AS (
  SELECT d.doc_id, d.lang, d.source, CAST(1 - l.quality AS INTEGER) AS is_sarcastic,
         unnest(string_split(d.text, chr(10))) AS article_title,
         unnest(range(len(string_split(d.text, chr(10))))) AS line_no
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
H AS (
  SELECT 'http://' || source || '.example/' || lang || '/' || CAST(doc_id AS VARCHAR) || '/' || CAST(line_no AS VARCHAR)
           AS article_url,
         article_title, is_sarcastic, lang, source, CAST(length(article_title) AS INTEGER) AS title_length
  FROM H0
)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M: the toxic flag taken as a prediction of the label, by language of the document."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return labels.join(docs, "doc_id").select(
        "doc_id",
        "lang",
        (1 - F.col("quality")).cast("int").alias("y_true"),
        F.col("toxic").cast("int").alias("y_pred"),
    )


M_SQL = """
M AS (
  SELECT l.doc_id, d.lang, CAST(1 - l.quality AS INTEGER) AS y_true, CAST(l.toxic AS INTEGER) AS y_pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: every event as a fetched address with a status and a site map that lists it."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    ending = F.when(kind == "click", ".png").when(kind == "view", ".jpeg").when(kind == "signup", ".jpg").otherwise("")
    article = F.concat(F.lit("https://e.example/news/"), F.date_format("ts", "yyyy/MM/dd/"), user)
    picture = F.concat(F.lit("https://e.example/pic?a=1&u="), user, ending)
    escaped = F.replace(picture, F.lit("&"), F.lit("&amp;"))
    return events.select(
        "event_id",
        "ts",
        kind.alias("source"),
        F.when(kind == "error", 500).when(kind == "signup", 201).otherwise(200).alias("status"),
        picture.alias("article_url"),
        F.concat(
            F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), article,
            F.lit("</loc><lastmod>2024</lastmod></url>\n<url><loc>"), escaped, F.lit("</loc></url></urlset>"),
        ).alias("body"),
    )


E_SQL = """
E AS (
  SELECT event_id, ts, event_type AS source,
         CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END AS status,
         'https://e.example/news/' || strftime(ts, '%Y/%m/%d/') || CAST(user_id AS VARCHAR) AS article,
         'https://e.example/pic?a=1&u=' || CAST(user_id AS VARCHAR) ||
           CASE event_type WHEN 'click' THEN '.png' WHEN 'view' THEN '.jpeg' WHEN 'signup' THEN '.jpg' ELSE '' END
           AS article_url
  FROM events
)"""


def site_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: every order as a site-map index with a monthly and a numbered site map."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate")
    return orders.select(
        F.col("o_orderstatus").alias("source"),
        F.concat(
            F.lit("<sitemapindex><sitemap><loc>https://s.example/sitemap/"), F.date_format("o_orderdate", "yyyy/MM"),
            F.lit(".xml</loc></sitemap><sitemap><loc>https://s.example/post-sitemap"), F.col("o_custkey").cast("string"),
            F.lit(".xml</loc></sitemap><url><loc>https://s.example/post-sitemap/none</loc></url></sitemapindex>"),
        ).alias("body"),
    )


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: every order as a page with a full date, a month, or only a page tag, by order status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    day = F.col("o_orderdate")
    part = F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy/MM/dd/"))
    part = part.when(F.col("o_orderstatus") == "O", F.date_format(day, "yyyy/MM/")).otherwise("")
    tag = F.concat(
        F.lit('<head><meta property="article:published_time" content="'), F.date_format(day, "yyyy-MM-dd"),
        F.lit('T06:07:08+02:00"></head>'),
    )
    return orders.select(
        "o_orderkey",
        F.concat(F.lit("https://d.example/"), part, F.col("o_orderkey").cast("string")).alias("url"),
        F.when(F.col("o_orderstatus") == "P", tag).otherwise("<head></head>").alias("html"),
    )
