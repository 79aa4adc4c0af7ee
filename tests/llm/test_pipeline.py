"""Stages of the pipeline on the smallest tables, each against its own input."""

import pytest
from llm_helpers import AWKWARD, prose, words_of
from test_decontamination import slow_align  # noqa: F401  (the brute-force version is tested there)
from test_ngram_jaccard import brute
from test_secret_scan import base, entropy

import corpus_pipeline as P
from pyspark.sql import functions as F
from visitlake.llm import language_id, tables

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    staging = tables.stage(spark, "steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90_000 + i, t, None, "odd", None) for i, t in enumerate(AWKWARD)]
    extra += [(91_000, "same words here again " * 9, "en", "odd", 1)] * 2
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs.collect()]
    for name, step in P.STAGES:
        docs = staging.write(step(spark, docs, SF), name)
        out.append(docs.collect())
    return out


def test_columns_and_order(steps):
    assert [name for name, _ in P.STAGES] == [
        "language_id", "near_duplicates", "decontamination", "secrets", "mixing",
    ]
    for rows in steps[:-1]:
        assert rows[0].__fields__ == COLUMNS
    assert steps[-1][0].__fields__[:5] == COLUMNS


def test_letterless_texts_go_and_clean_ones_stay(steps):
    before, after = steps[0], {r.doc_id for r in steps[1]}
    for r in before:
        if not any(c.isalpha() for c in r.text or ""):
            assert r.doc_id not in after
    lettered = {r.doc_id for r in before if r.doc_id < 90_000 and any(c.isalpha() for c in r.text or "")}
    assert len(after & lettered) >= 0.995 * len(lettered)


def test_columns_with_the_names_of_results_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    names = ["lang_pred", "score", "fits", "base_spans", "secret_spans", "row", "clean", "vertex"]
    more = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    for step in (P.identify_language, P.drop_near_duplicates, P.drop_benchmark_leaks, P.redact_secrets):
        kept = step(spark, more, SF)
        assert kept.columns == more.columns
        assert all(row[n] == f"own {n}" for row in kept.collect() for n in names), step


def test_every_word_of_the_labelled_texts_fits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL").limit(60)
    words = docs.select("lang", F.explode(F.split(F.col("text"), r"\s+")).alias("text")).filter(F.col("text").rlike(r"\p{L}"))
    words = words.distinct().withColumn("doc_id", F.monotonically_increasing_id())
    model = language_id.references(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), F.lit(True))
    found = language_id.predict(words, model)
    assert found.filter("NOT fits").count() <= 0.01 * found.count()


def test_one_document_of_each_class_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1]]
    want = sorted({c for _, c in brute(rows, 5, 80, 100).values()})
    assert sorted(r.doc_id for r in steps[2]) == want


def test_benchmark_passages_go(spark, steps):
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {
        r.doc_id for r in steps[2] if any(b" ".join(i) in b" ".join(words_of(r.text)) for i in items if i)
    }
    left = {r.doc_id for r in steps[3]}
    assert not holds & left
    assert len(left) >= len(steps[2]) - len(holds) - 2


def test_secrets_are_masked(steps):
    before = {r.doc_id: r for r in steps[3]}
    assert sorted(before) == sorted(r.doc_id for r in steps[4])
    changed = 0
    for r in steps[4]:
        old = before[r.doc_id]
        if base(old.text) or entropy(old.text):
            changed += 1
            assert "[REDACTED]" in r.text and r.n_chars == len(r.text)
        else:
            assert r == old
    assert changed


def test_mixing_gives_rates(steps):
    assert steps[5] and all(r.rate > 0 and r.n_copies >= 0 for r in steps[5])
    assert {r.doc_id for r in steps[5]} <= {r.doc_id for r in steps[4]}


def test_run_applies_all_stages(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = P.run(spark, SF)
    assert 0 < got.count() <= docs.count()


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    staging = tables.stage(spark, "empty")
    for name, step in P.STAGES:
        docs = staging.write(step(spark, docs, SF), name)
        assert docs.count() == 0
    assert prose
