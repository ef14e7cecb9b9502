"""The registered query of each operator: production parameters, whole tables, digests of the operator's real output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bpe_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.training_order import materialise

    index, _ = materialise(table(spark, sf_dir, "documents"), bpe_path(), common.fresh_path(spark, "training-order"), key=20_240_601)
    return index


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import secrets

    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.decontam import find_overlaps

    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import chat

    said = "</s>[INST] ok [/INST]"
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], own.schema)
    return chat.digests(common.keep(chat.format_chats(own.unionByName(more)), "chats"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), bpe_path(), capacity=1024, end_id=2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, budget=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"), licenses.train(spark))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, take the toxic ones back, count those of low quality anew with an end id each, and send both batches again."""
    from corpusloom.llm.rollups import Ledger, count_tokens

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = Ledger(spark, common.fresh_path(spark, "rollups"))
    ledger.apply("load", inserts=count_tokens(docs, bpe_path()).withColumn("tokenizer", F.lit("byte_bpe_50k")))
    toxic, low = (labels.filter(F.col(c) == v).select("doc_id").distinct() for c, v in (("toxic", 1), ("quality", 0)))
    for _ in range(2):
        ledger.apply("toxic", deletes=toxic)
        counted = ledger.current().filter("tokenizer = 'byte_bpe_50k'").join(low, "doc_id", "left_semi")
        ledger.apply("end-ids", revised=counted.select("doc_id", "source", "lang", F.lit("byte_bpe_50k+end").alias("tokenizer"), (F.col("n_tokens") + F.col("n_docs")).alias("n_tokens")))
    return ledger.totals()


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written, then read back for sizes and checksums."""
    from corpusloom.llm import sharding

    return sharding.digests(sharding.shuffle(table(spark, sf_dir, "documents"), common.fresh_path(spark, "shards"), shards=16, seed=20_240_611))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import spelling

    return spelling.variants(spelling.dictionary(table(spark, sf_dir, "documents")), ratio=5)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_top_k, op2_training_order, op3_secret_scan, op4_decontamination, op5_chat_format, op6_best_fit_packing, op7_language_id, op8_simhash_near_dedup, op9_license_scan, op10_token_rollups, op11_external_shuffle, op12_spelling_variants, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    from corpusloom.llm import filter_audit, secrets

    return {"op1_exact_top_k": OP1_SQL, "op3_secret_scan": secrets.oracle(), "op13_filter_audit": filter_audit.SQL}
