"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import ann, bpe, language, minhash, mixing, secret_scan, topk
from basalt.llm.passages import repeated_passages
from basalt.llm.resample import resample
from basalt.llm.token_counts import token_counts

QUERIES = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded_col="decoded")
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


@query
def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good = F.col("quality") == 1
    share = labels.agg(F.avg(good.cast("int"))).first()[0]
    return resample(table(spark, sf_dir, "documents"), labels.where(good).select("doc_id"), 1.0 if share is None else share)


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


@query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


SQL["op5_source_mixing"] = mixing.SQL


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def secret_digests(found: DataFrame) -> DataFrame:
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), of("novel").alias("n_novel"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    found = language.identify(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_langs")


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op10_minhash_near_dedup"] = minhash.SQL.replace("{percent}", "85")


_pairs = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{nonzero}),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, {score} AS score
  FROM (SELECT DISTINCT * FROM rows WHERE vec_id % {every} = 0) q JOIN rows c ON q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= {k}
"""
SQL["op1_nearest_neighbours"] = _pairs.format(nonzero=" AND len(list_filter(embedding, lambda x: x <> 0)) > 0", score="list_dot_product(q.v, c.v)", every=20, k=20)
SQL["op3_exact_top_k"] = _pairs.format(nonzero="", score="list_dot_product(list_transform(q.v, lambda x: floor(256 * x)), list_transform(c.v, lambda x: floor(256 * x)))::BIGINT", every=50, k=5)
