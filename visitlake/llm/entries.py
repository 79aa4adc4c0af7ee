"""Queries of this subpackage over the given tables, with the SQL they equal."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake.llm import (
    byte_bpe,
    conversation_repair,
    decontamination,
    embedding_dedup,
    language_id,
    lexical_search,
    maxent_lm,
    mixing,
    ngram_jaccard,
    oracles,
    quality,
    secret_scan,
    substring_dedup,
    toxicity,
)
from visitlake.llm.tables import bounded_batches, fold_of, stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Shares of all tokens that mixing aims at.
TARGET_SHARES = {"toxic": 0.02, "low": 0.08, "clean": 0.90}


def _query(sql: str | None = None):
    def keep(function):
        @functools.wraps(function)
        def bounded(spark, sf):
            bounded_batches(spark)
            return function(spark, sf)

        QUERIES[function.__name__] = bounded
        if sql is not None:
            ORACLES[function.__name__] = sql
        return bounded

    return keep


@_query(oracles.OP1)
def op1_ngram_jaccard_join(spark, sf):
    found = ngram_jaccard.near_duplicates(
        table(spark, sf, "documents"), stage(spark, "op1"), n=4, threshold=(85, 100)
    )
    return found.select("doc_id", "n_shingles", "component_id")


@_query(oracles.OP2)
def op2_substring_dedup(spark, sf):
    kept = substring_dedup.remove_repeats(
        table(spark, sf, "documents"), stage(spark, "op2"), k=35, with_text=False
    )
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query()
def op8_secret_scans(spark, sf):
    found = secret_scan.find_secrets(table(spark, sf, "documents").select("doc_id", "text"))

    def count(kind: str):
        spans = F.filter("base_spans", lambda s: s["kind"] == kind)
        return F.size(spans).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.span_list(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("secret_spans")).alias("spans"),
    )


def _held_out(folds: int, rest: int):
    return (fold_of("doc_id", folds) == rest).alias("held_out")


@_query()
def op3_toxicity(spark, sf):
    fold = fold_of("doc_id", 5)
    scored = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"), fold != 0)
    return scored.select(
        "doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_query()
def op4_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = language_id.references(docs, fold_of("doc_id", 3) != 1)
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", _held_out(3, 1), "lang_pred", "score"
    )


@_query()
def op5_lm_scoring(spark, sf):
    docs = table(spark, sf, "documents")
    scored, counts = maxent_lm.language_model(docs, fold_of("doc_id", 5) != 1, stage(spark, "op5"))
    return scored.select(
        "doc_id", _held_out(5, 1), "n_tokens", "n_known",
        F.lit(counts.total).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


@_query()
def op6_quality_classifier(spark, sf):
    fold = fold_of("doc_id", 5)
    scored = quality.quality(
        table(spark, sf, "documents"), table(spark, sf, "labels"), fold != 0, stage(spark, "op6"), threshold=0.3
    )
    return scored.select(
        "doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@_query()
def op7_benchmark_decontamination(spark, sf):
    return decontamination.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@_query(oracles.OP10)
def op10_embedding_near_dedup(spark, sf):
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings"), stage(spark, "op10"), least=0.93)


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled table: toxic, else low for poor quality, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.when(F.col("quality") == 1, "clean").alias("domain"))


@_query()
def op9_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    mixed = mixing.mix(
        docs, labelled_domains(table(spark, sf, "labels")), TARGET_SHARES, stage(spark, "op9"),
        lexical=("toxic",), keep=["doc_id"],
    )
    at = {name: i for i, name in enumerate(TARGET_SHARES)}
    return mixed.select(
        "doc_id", "n_tokens", *(F.col("memberships")[i].alias(f"p_{name}") for name, i in at.items()),
        "rate", "n_copies",
    )


@_query()
def op11_conversation_repair(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    fixed = conversation_repair.repair(conversation_repair.damaged(turns), stage(spark, "op11"))
    everyone = turns.select(F.col("conv_id").alias("id")).distinct()
    zero, text = F.lit(0).cast("bigint"), {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    figures = [F.coalesce(c, text.get(c, zero)).alias(c) for c in fixed.columns if c != "conv_id"]
    found = everyone.join(fixed, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return found.select(F.col("id").alias("conv_id"), *figures)


@_query()
def op12_byte_bpe(spark, sf):
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, stage(spark, "op12"))
    ids = F.col("token_ids")
    return coded.select(
        "doc_id",
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decoded(ids, ranks), 256).alias("decoded_sha256"),
    )


@_query(oracles.OP13)
def op13_lexical_search(spark, sf):
    return lexical_search.search(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"), stage(spark, "op13"), k=50
    )


@_query()
def pipeline(spark, sf):
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf)
