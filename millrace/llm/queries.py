"""The registered queries of the operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, fingerprint, language_id, mixing, neardup, pii, ppm, quality, secrets, warc
from millrace.llm.common import fold, new_folder, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold(5) != 0)
    scored = quality.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    folder = new_folder(spark, "warc")
    warc.plan_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").option("payload", "false").option("verify", "true").load(folder)
    number = lambda c: F.nullif(F.substring_index(F.col(c), ":", -1), F.lit("")).cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a key of the user's own belongs here; the query's is fixed so that reruns agree
    replaced = pii.surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), secret="millrace")
    return replaced.select("doc_id", F.col("surrogate_text").alias("text"), "n_entities")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(fold(4) != 2))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ppm.fit(docs.filter(fold(7) != 2))
    scored = ppm.predict(docs, model, base_over=model.add_one())
    return scored.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), secrets.fit())
    return scanned.select("doc_id", F.inline("findings")).withColumn("is_secret", F.col("score") >= secrets.ACCEPT)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.found_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_order_minhash": op4_order_minhash,
    "op5_near_dedup": op5_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_ppm": op8_ppm,
    "op9_secrets": op9_secrets,
    "op10_decontamination": op10_decontamination,
}

NEAR_DEDUP_SQL = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), shingles as materialized (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from words
  )
), sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as materialized (
  select u, v from pairs join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)
), edges as materialized (select u, v from links union select v, u from links),
reach as (
  select doc_id as id, doc_id as r from documents union select reach.id, edges.v from reach join edges on edges.u = reach.r
), least_ids as (select id, min(r) as component_id from reach group by id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join least_ids on id = d.doc_id left join sizes on sizes.doc_id = d.doc_id
"""

WARC_SQL = """
with body as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as h from pages),
letters as (
  select page_id, octet_length(b) as payload_bytes, min(page_id) over (partition by h) as first,
    array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (1 + 5 * g)::int, 5))::int >> s) & 31) + 1)::int, 1)), '')), '') as payload_digest
  from body
)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from letters
"""

ORACLE_SQL: dict[str, str] = {"op2_warc": WARC_SQL, "op5_near_dedup": NEAR_DEDUP_SQL}
