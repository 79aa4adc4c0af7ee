import random

from llm_helpers import AWKWARD, table
from pyspark.sql import functions as F

from visitlake.llm import language_id as L

SYLLABLES = {"aa": ["ba", "do", "ki", "lu"], "bb": ["sch", "ung", "eit", "er"], "cc": ["ção", "ões", "nh", "lh"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_phrases_are_greedy_longest_matches():
    rng = random.Random(1)
    for _ in range(5):
        known = "".join(rng.choices("abc ", k=200))
        automaton = L.SuffixAutomaton(known)
        for _ in range(300):
            word = "".join(rng.choices("abcd ", k=rng.randint(1, 15)))
            at = count = 0
            while at < len(word):
                size = 1
                while at + size < len(word) and word[at : at + size + 1] in known:
                    size += 1
                at, count = at + size, count + 1
            assert automaton.phrases(word) == count


def test_held_out_languages_and_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(100 + i, t, None) for i, t in enumerate(AWKWARD)] + [(None, "42 !? 7", "aa"), (200, "x" * 50_000, None)]
    docs = table(spark, rows)
    model = L.references(docs, F.col("doc_id") % 3 != 4)
    found = L.predict(docs, model)
    assert set(docs.columns) - {"score"} < set(found.columns)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang in rows[:60])
    assert all(0 <= r.score <= 1 for r in got.values())
    letterless = [i for i, t, _ in rows if not any(c.isalpha() for c in t or "")]
    assert {i for i, r in got.items() if r.lang_pred == "und"} == set(letterless)


def test_nothing_to_learn_from(spark):
    docs = table(spark, [(1, "some text", None), (2, None, "aa")])
    assert [r.lang_pred for r in L.identify(docs, F.lit(True)).collect()] == ["und", "und"]
    assert L.identify(table(spark, []), F.lit(True)).count() == 0


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(L, "KEPT_WORDS", 3)
    model = L.Model({"aa": " abc abd ", "bb": " xyz "})
    model.prepare()
    first = [model.predict(t) for t in ("abc abd", "xyz q", "abd r s t u v w", "abc abd")]
    assert first[0] == first[3] and first[0][0] == "aa" and first[1][0] == "bb"


def test_language_of_long_texts_alone_is_learned(spark):
    rows = [(i, "the house and the garden " * 20, "en") for i in range(5)]
    rows += [(10 + i, "das haus und der garten " * 900, "de") for i in range(3)]
    rows += [(20, "123 " * 4000 + "das haus und der garten", "de"), (30, "das haus und der garten", None)]
    found = {r.doc_id: r.lang_pred for r in L.identify(table(spark, rows), F.lit(True)).collect()}
    assert found[30] == "de" and found[0] == "en"


def test_other_numbers_are_no_letters(spark):
    rows = [(1, "the house and the garden", "en"), (2, "½ ²", None), (3, "Ⅷ ⑤ ٣", None), (4, "x²", None), (5, "ªº", None)]
    found = {r.doc_id: r.lang_pred for r in L.identify(table(spark, rows), F.lit(True)).collect()}
    assert found == {1: "en", 2: "und", 3: "und", 4: "en", 5: "en"}


def test_only_texts_that_fit_no_language_are_unfit(spark):
    words = {"en": "the house and a garden", "de": "das haus und der garten", "fr": "la maison et le jardin", "es": "la casa y el huerto"}
    rows = [(i, t + " ", lang) for i, (lang, t) in enumerate(words.items())]
    # Each learned word alone, one that fits all alike, and scripts that none has.
    alone = [w for t in words.values() for w in t.split()] + ["A.", "e", "De.", "La"]
    rows += [(100 + i, w, None) for i, w in enumerate(alone)]
    rows += [(200, "Съешь же ещё этих мягких", None), (201, "ж", None), (202, "日本語の文章", None), (203, "42", None)]
    found = {r.doc_id: r.fits for r in L.identify(table(spark, rows), F.lit(True)).collect()}
    assert {i for i, fits in found.items() if not fits} == {200, 201, 202, 203}
