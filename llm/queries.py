"""The queries of the operators in this subpackage, and SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import byte_bpe, collocations, decontamination, divergence, language_id, lm_scoring, near_dedup, packing, pii, sharding, topk, url_filter, warc
from llm.digests import sha256, span_text
from llm.frames import shared_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm_scoring.train(docs.filter(~lm_scoring.held_out()))
    return lm_scoring.score(docs.select("doc_id", "text", lm_scoring.held_out().alias("held_out")), model, carry=["doc_id", "held_out"])


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards and tells what lies in them, read back."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_folder(spark)
    sharding.write_shards(sharding.shard(docs), path)
    return sharding.read_shards(spark, path, docs.schema).drop("text")


#: Host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled if its url names a labelled document: the first number that fills a segment of its path."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    named = pages.select("page_id", F.expr("try_cast(regexp_extract(url, '/([0-9]+)(?:[./?#]|$)', 1) AS bigint)").alias("doc_id"))
    toxic = _read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("bad"))
    return url_filter.judge(pages, named.join(toxic, "doc_id").select("page_id", "bad"), RULES)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(~language_id.held_out()))
    texts = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.identify(texts, model, carry=["doc_id", "held_out"])


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.look_up(pages.select("page_id", "url"), warc.write(pages))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        sha256(F.concat_ws(",", "hit_items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["strict"])
    counts = [F.size(F.array_remove(F.transform(base, lambda s: s["kind"] == F.lit(kind)), False)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, sha256(span_text(base)).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"], decoded=True)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        sha256(F.concat_ws(",", F.col("token_ids").cast("array<string>"))).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents").select("text", "lang"))


def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_extendible_sharding": op2_extendible_sharding,
    "op3_url_templates": op3_url_templates,
    "op4_exact_topk": op4_exact_topk,
    "op5_language_id": op5_language_id,
    "op6_warc_index": op6_warc_index,
    "op7_decontamination": op7_decontamination,
    "op8_weak_pii": op8_weak_pii,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_collocations": op11_collocations,
    "op12_cost_packing": op12_cost_packing,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE = {
    "op2_extendible_sharding": """
WITH d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
    array_to_string(list_transform(string_split(substr(md5(coalesce('k' || CAST(doc_id AS VARCHAR), 'null')), 1, 16), ''),
      lambda h: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * instr('0123456789abcdef', h) - 3 AS BIGINT), 4)), '') AS bits
  FROM documents
), nodes AS (
  SELECT d.doc_id, d.n_bytes, CAST(depth AS INTEGER) AS depth, substr(bits, 1, depth) AS node FROM d, range(0, 33) t(depth)
), sizes AS (
  SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY depth, node) AS BIGINT) AS shard_bytes FROM nodes
)
SELECT doc_id, node AS shard, depth, n_bytes, shard_bytes FROM sizes WHERE shard_bytes <= 1048576
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
""",
    "op4_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op6_warc_index": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS original, 
    array_to_string(list_transform(string_split(sha1(payload), ''),
      lambda h: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * instr('0123456789abcdef', h) - 3 AS BIGINT), 4)), '') AS bits
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32),
         lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER)
           + 4 * CAST(bits[5 * i + 3] AS INTEGER) + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM d
""",
}
