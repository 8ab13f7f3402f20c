"""Registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, audit, chat, decontaminate, jaccard, minhash, mixing, secrets, sharding, spelling, suffix, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    cleaned = suffix.dedup(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.is_held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")


def op3_sharding(spark, sf_dir):
    return sharding.place(_read(spark, sf_dir, "documents").select("doc_id"), slot_col="slot")


def op4_warc(spark, sf_dir):
    return warc.derive(_read(spark, sf_dir, "pages"))


def op5_secrets(spark, sf_dir):
    found = secrets.find_secrets(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "named")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(show(base), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"), count("named").alias("n_named"))


def op6_chat_format(spark, sf_dir):
    return chat.read_back(chat.format_turns(chat.with_probe(_read(spark, sf_dir, "conversations"))))


def op7_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "n_copies")


def op8_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.component_ids(jaccard.link(_read(spark, sf_dir, "documents")))


def op10_ann(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_minhash(spark, sf_dir):
    return minhash.link(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.word_counts(_read(spark, sf_dir, "documents")))


def op13_filter_audit(spark, sf_dir):
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_secrets": op5_secrets,
    "op6_chat_format": op6_chat_format,
    "op7_mixing": op7_mixing,
    "op8_decontaminate": op8_decontaminate,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_ann": op10_ann,
    "op11_minhash": op11_minhash,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op1_suffix_dedup": suffix.ORACLE_SQL,
    "op3_sharding": sharding.oracle_sql(),
    "op4_warc": warc.oracle_sql(),
    "op6_chat_format": chat.ORACLE_SQL,
    "op9_ngram_jaccard": jaccard.ORACLE_SQL,
    "op11_minhash": minhash.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
    "op13_filter_audit": audit.ORACLE_SQL,
}
