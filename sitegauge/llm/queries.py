"""The registered queries of these operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm import (
    align,
    chat,
    decontaminate,
    langid,
    mixing,
    parity,
    pii,
    quality,
    secrets,
    simhash,
    tokencount,
    toxicity,
    whitening,
)
from sitegauge.llm.common import crc_remainder, table
from sitegauge.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def registered(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = registered
    return registered


@_query
def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", held_out, "lang_pred", "score")


@_query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = secrets.scan(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *(count(secrets.KINDS.index(kind)).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


@_query
def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@_query
def op5_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@_query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    held_out = (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokencount.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@_query
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii.detect(docs)
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@_query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, folder, "labels")))


@_query
def op10_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows.unionByName(more))
    read = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("segments")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@_query
def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    aligned = align.align_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.withColumn("doc_id", F.col("doc_id").cast("long"))


@_query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.usable(table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding")
    model = whitening.fit(rows, "embedding")
    found = whitening.apply(rows, "embedding", model)
    shares = F.array(*map(F.lit, model.explained.tolist())).cast("array<double>")
    return found.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("place")].alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


@_query
def op13_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return parity.near_duplicates(table(spark, folder, "documents"))


ORACLES["op1_benchmark_decontamination"] = decontaminate.ORACLE
ORACLES["op5_mixing_sources"] = mixing.ORACLE
ORACLES["op10_chat_formatting"] = chat.ORACLE
