"""Documents to training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; what it
returns is written as Parquet and read again as the next one's input. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake.llm import decontamination, language_id, mixing, ngram_jaccard, secret_scan
from visitlake.llm.entries import TARGET_SHARES, labelled_domains
from visitlake.llm.tables import bounded_batches, small, stage, table


def _boxed(docs: DataFrame) -> DataFrame:
    """The text, and the whole row in one column, so that no name of it can clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that fit no learned language. A text that
    fits several equally well stays. Learns from all documents that have a lang."""
    bounded_batches(spark)
    model = language_id.references(docs, F.lit(True))
    if not model.texts:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language_id.predict(_boxed(docs), model).filter("fits").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates.

    Rows that share an id and a text are one document. Rows without an id, which
    belong to no class, stay, as do texts without words.
    """
    bounded_batches(spark)
    staging = stage(spark, "near-duplicates")
    classes = ngram_jaccard.near_duplicates(docs, staging)
    gone = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = classes.filter("doc_id = component_id").groupBy("doc_id").count()
    # An id goes if none of its rows leads a class.
    gone = staging.write(gone.join(kept, "doc_id", "left_anti"), "gone")
    again = staging.write(kept.filter("count > 1").select("doc_id"), "again")
    n_gone, n_again = gone.count(), again.count()
    rest = docs.join(small(gone, n_gone), "doc_id", "left_anti")
    if not n_again:
        return rest.select(*docs.columns)
    again = small(again, n_again)
    once = rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    bounded_batches(spark)
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with a mask in place of each secret, and n_chars to match."""
    found = secret_scan.find_secrets(_boxed(docs))
    hidden = F.size("secret_spans") > 0
    clean = {
        "text": secret_scan.redacted(F.col("text"), F.col("secret_spans")),
        "n_chars": F.when(hidden, F.length("clean").cast("bigint")).otherwise(F.col("row.n_chars")),
    }
    found = found.withColumn("clean", clean.pop("text"))
    kept = [F.col("clean").alias(c) if c == "text" else clean.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    return found.select(*kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, memberships, rate and n_copies, and drops what the solution
    excludes (rate 0). A reader repeats a row n_copies times or weighs it by rate."""
    bounded_batches(spark)
    mixed = mixing.mix(
        docs, labelled_domains(table(spark, sf_dir, "labels")), TARGET_SHARES, stage(spark, "mixing"),
        lexical=("toxic",),
    )
    return mixed.filter("rate > 0")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

# Trained models and alignments are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    staging = stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = staging.write(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
