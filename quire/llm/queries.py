"""The operators' queries over their whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, exact_dedup, merkle, mixing, ngram_join, packing, quality, secrets, spelling, token_count, topk, toxicity, url_filter
from quire.llm.common import delete, read, shared_dir

#: The rules of the url query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Fixed value: a conversation whose texts consist of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


#: The ledger of a session's last run of the query; the next run removes it.
_LEDGERS: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, app = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", spark.sparkContext.applicationId
    if app in _LEDGERS:
        delete(spark, _LEDGERS[app])  # what the last run returned lies in checkpoints
    _LEDGERS[app] = folder
    found = secrets.scan(read(spark, sf_dir, "documents"), secrets.Ledger(spark, folder))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{CONTROL_TEXT}'), (-1L, 1L, 'assistant', '{CONTROL_TEXT}') as t(conv_id, turn, role, text)")
    done = chat.format_chats(chat.with_parts(rows.unionByName(extra)))
    done = done.withColumn("turns", chat.read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.under_mask(F.col("formatted"), F.col("loss_spans"))
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    words = spelling.runs(read(spark, sf_dir, "documents")).select(spelling.misspelt(F.col("run"), key, 31).alias("word"))
    return spelling.variants(spelling.counted(words))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", spelling.UPPER, spelling.LOWER)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return merkle.manifest(read(spark, sf_dir, "documents"), merkle.leaf(text=F.when(tampered, lowered).otherwise(F.col("text"))))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_jaccard_join, op2_source_mix, op3_url_filter, op4_token_count, op5_exact_dedup, op6_quality_classifier, op7_secret_scan, op8_exact_topk, op9_packing, op10_chat_format, op11_spelling_variants, op12_merkle_manifest, op13_toxicity)
    return {f.__name__: f for f in own}
