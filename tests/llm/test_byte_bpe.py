import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from llm_helpers import AWKWARD, table
from pyspark.sql import functions as F

from visitlake.llm import byte_bpe as B
from visitlake.llm import entries, tables
from visitlake.sources.staging import folder_exists

RANKS = B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABETS = [
    "abcdefghij ", "etaoin shrdlu", "АБвгд  ежз", "0123456789", "'srtvemldSTM ", "\t\n\r \x0b\x0c\x85\xa0 　x",
    "=-_*#~.", "日本語テキスト中文", "😀👍🏽é́ß", "ŀĀāÿþ\x7f\x00\x01", "½²٣४",
]


def texts():
    rng = random.Random(12)
    out = [t for t in AWKWARD if t] + ["<|endoftext|>", "don't DON'T we'll", " leading", "trailing  \n", "a" * 5_000]
    out += ["=" * 4_097, "-_" * 900, " " * 3_000 + "x", "\n" * 500, "".join(rng.choices("abcxyz", k=6_000)), "é" * 1_001]
    for _ in range(400):
        out.append("".join("".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))))
    return out


def run(spark, rows):
    docs = table(spark, rows).withColumn("token_ids", F.lit("replaced"))
    return B.encode(docs, RANKS, public_tokenizers.PATTERN, tables.stage(spark, "t"))


@pytest.mark.parametrize("frequent", [0, 50, B.FREQUENT])
def test_ids_equal_the_library(spark, monkeypatch, frequent):
    monkeypatch.setattr(B, "FREQUENT", frequent)
    rows = list(enumerate(texts())) + [(-1, None), (-2, ""), (None, "twice"), (None, "twice")]
    got = run(spark, rows)
    assert got.columns == [*table(spark, []).columns, "token_ids"]
    found = got.select("doc_id", "text", "token_ids", B.decoded(F.col("token_ids"), RANKS).alias("back")).collect()
    assert len(found) == len(rows)
    for row in found:
        text = row.text or ""
        assert row.token_ids == REFERENCE.encode_ordinary(text), text[:80]
        assert bytes(row.back) == text.encode()


def test_heap_equals_fold_and_library():
    rng = random.Random(5)
    for n in [1, 2, 3, 10, 65, 300, 2_000]:
        for letters in ("ab", "=", "etaoinshrdlu"):
            word = "".join(rng.choices(letters, k=n))
            assert B.merge_long(word.encode(), RANKS) == REFERENCE.encode_single_piece(word) if hasattr(REFERENCE, "encode_single_piece") else REFERENCE.encode_ordinary(word)


def test_a_long_word_takes_linear_time():
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=300_000)).encode()
    assert b"".join(REFERENCE.decode_single_token_bytes(i) for i in B.merge_long(word, RANKS)) == word


def test_the_rank_map_is_a_literal(spark):
    frame = spark.range(1).select(B.word_ids(F.array(F.col("id").cast("string")), RANKS).alias("x"))
    optimized = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in optimized and "crc32" in optimized


def test_the_driver_holds_few_objects_and_no_staged_words(spark):
    literal = spark.range(1).select(B.rank_map(RANKS).alias("x"))
    assert literal.schema["x"].dataType.elementType.typeName() == "string"  # a map is four objects and one per key
    staging = tables.stage(spark, "t")
    docs = table(spark, [(1, "one word and one more"), (2, None)])
    coded = B.encode(docs, RANKS, public_tokenizers.PATTERN, staging)
    assert not any(folder_exists(spark, f"{staging.folder}/{name}") for name in ("words", "frequent"))
    assert {r.doc_id: r.token_ids for r in coded.collect()} == {1: REFERENCE.encode_ordinary("one word and one more"), 2: []}


def test_a_rank_file_without_all_bytes_is_refused(tmp_path):
    (tmp_path / "r").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        B.read_ranks(str(tmp_path / "r"))


def test_empty_table(spark):
    assert run(spark, []).collect() == []


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = entries.QUERIES["op12_byte_bpe"](spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for row in found:
        ids = REFERENCE.encode_ordinary(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()
