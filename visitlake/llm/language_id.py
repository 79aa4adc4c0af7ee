"""Language of texts by cross-parsing entropy.

For each language a suffix automaton of labelled text gives the longest match
from any point. A text is cut greedily into phrases, each the longest that occurs
in the language's text; phrases end where words end. Their number, normalised by
the logarithm of the reference text's length over the length of the text,
estimates the cross-entropy (Ziv and Merhav, 1993), and the language that needs
the fewest wins.

As phrases end with words, the phrases of a word are counted once and kept in a
table of the Python worker, so the cost follows the number of different words.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
# Reference text per language: so many characters, of longer texts a slice.
REFERENCE_CHARS = 60_000
REFERENCE_TEXTS = 400
LONGEST_REFERENCE = 8_000
# Words kept per worker, and the longest word that is kept.
KEPT_WORDS, LONGEST_KEPT = 600_000, 48
_SHORTEST = 0.75  # phrases per character of a text that fits no language
_SHIFT = 21  # bits of a code point


_WORDS = re.compile(r"[^\W\d_]+")


@functools.cache
def _numbers() -> tuple[frozenset[str], re.Pattern]:
    """Fractions, superscripts and the like, which ``re`` counts as parts of words, and
    words without them. That pattern is slow, so few texts are searched by it."""
    found = [c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()]
    return frozenset(found), re.compile(rf"[^\W\d_{re.escape(''.join(found))}]+")


def letter_runs(text: str) -> list[str]:
    if not text.isascii():
        numbers, pattern = _numbers()
        if not numbers.isdisjoint(text):
            return pattern.findall(text)
    return _WORDS.findall(text)


class SuffixAutomaton:
    """All substrings of a text; ``phrases`` parses a word against them."""

    def __init__(self, text: str):
        edges: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in map(ord, text):
            current = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = current
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[current] = q
                else:
                    clone = len(edges)
                    edges.append(dict(edges[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = clone
                        p = link[p]
                    link[q] = link[current] = clone
            last = current
        # One table of all edges is much smaller than one per state.
        self.edges = {s << _SHIFT | c: t << _SHIFT for s, out in enumerate(edges) for c, t in out.items()}

    def phrases(self, word: str) -> int:
        """Greedy longest matches that cover the word; an unseen character is one."""
        edges = self.edges
        state, count = 0, 1
        for c in map(ord, word):
            following = edges.get(state | c)
            if following is None:
                # The phrase ends before c, unless it would be empty.
                if state:
                    count += 1
                    following = edges.get(c)
                if following is None:
                    count += 1
                    following = 0
            state = following
        return count - (state == 0)


@dataclass
class Model:
    """Reference text by language, in order of the languages' names."""

    texts: dict[str, str]
    automata: list[SuffixAutomaton] = field(default_factory=list)
    rates: np.ndarray | None = None
    known: dict[str, int] = field(default_factory=dict)
    counts: np.ndarray | None = None

    def __getstate__(self):
        return {"texts": self.texts, "automata": [], "rates": None, "known": {}, "counts": None}

    def prepare(self) -> None:
        """Build the automata; done once per worker."""
        if self.rates is None:
            self.automata = [SuffixAutomaton(t) for t in self.texts.values()]
            self.rates = np.array([math.log2(max(len(t), 2)) for t in self.texts.values()])
            self.counts = np.zeros((1024, len(self.texts)), np.int32)

    def word(self, word: str) -> int:
        """Row of the word in ``counts``."""
        at = self.known.get(word)
        if at is None:
            at = len(self.known)
            if at == len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            padded = f"{word} "
            self.counts[at] = [a.phrases(padded) for a in self.automata]
            self.known[word] = at
        return at

    def phrases(self, found: list[str]) -> np.ndarray:
        """Phrases of all words together, by language."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        total = np.zeros(len(self.texts), np.int64)
        rows = []
        for w in found:
            at = known.get(w)
            if at is None:
                if len(w) > LONGEST_KEPT:
                    total += [a.phrases(f"{w} ") for a in self.automata]
                    continue
                at = self.word(w)
            rows.append(at)
        return total + self.counts[rows].sum(0) if rows else total

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text fits it at all."""
        found = letter_runs(text.lower()) if text else []
        if not found or not self.texts:
            return UNKNOWN, 0.0, False
        # Bits that the phrases of each language cost; the score is the winner's
        # share when languages are weighed by them, tempered as phrases depend.
        phrases = self.phrases(found)
        bits = phrases * self.rates
        best = int(np.argmin(bits))
        share = 1.0 / np.exp2(np.maximum((bits[best] - bits) / 16, -60)).sum()
        fits = phrases[best] <= _SHORTEST * (sum(map(len, found)) + len(found))
        return list(self.texts)[best], float(share), bool(fits)


def references(docs: DataFrame, usable) -> Model:
    """Reference text from labelled rows, a bounded number of characters per language.

    The texts are taken in the order of a hash, so the choice is spread over all
    rows and the same for any partitioning.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    turn = F.xxhash64("doc_id", "text")
    start = F.pmod(turn, F.greatest(F.length("text") - LONGEST_REFERENCE + 1, F.lit(1))) + 1
    piece = F.substring(F.col("text"), start.cast("int"), F.lit(LONGEST_REFERENCE))
    # A slice that has no letter gives way to the one at the first letter.
    lettered = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, LONGEST_REFERENCE)
    piece = F.when(F.length("text") <= LONGEST_REFERENCE, F.col("text")).otherwise(
        F.when(piece.rlike(r"\p{L}"), piece).otherwise(lettered)
    )
    rows = rows.select("doc_id", "lang", piece.alias("text"))
    # Some times the rows that are needed of each language; the rest never reaches
    # the window, however large a language is. One count per language is broadcast.
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang"))
    part = F.least(F.lit(1.0), F.lit(4.0 * REFERENCE_TEXTS) / F.col("n_lang"))
    near = rows.join(F.broadcast(counts), "lang").filter(F.pmod(turn, F.lit(1_000_000)) < part * 1_000_000)
    order = Window.partitionBy("lang").orderBy(turn, "text")
    ranked = near.select("lang", "text", F.row_number().over(order).alias("at"))
    chosen = ranked.filter(F.col("at") <= REFERENCE_TEXTS).orderBy("lang", "at").collect()
    texts: dict[str, list[str]] = {}
    used: dict[str, int] = {}
    for row in chosen:
        if used.get(row["lang"], 0) < REFERENCE_CHARS:
            text = " " + " ".join(letter_runs(row["text"].lower())) + " "
            texts.setdefault(row["lang"], []).append(text)
            used[row["lang"]] = used.get(row["lang"], 0) + len(text)
    return Model({lang: "".join(parts)[:REFERENCE_CHARS] for lang, parts in sorted(texts.items())})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and fits; columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text when nothing could be learned. ``fits`` is false for these and for a text
    whose phrases are hardly longer than a character in every language, as in a
    script that none has. Of languages that need equally many bits the first by name
    wins. Rows are judged one by one; a very long text takes time in proportion.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "fits")]
    rows = docs.select(*kept)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, lang_pred string, score double, fits boolean"

    def run(batches):
        model = shared.value
        model.prepare()
        for batch in batches:
            found = [model.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                [*kept, "lang_pred", "score", "fits"],
            )

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, usable) -> DataFrame:
    """Learn from the rows of ``docs`` that meet ``usable`` and have a lang; predict all."""
    return predict(docs, references(docs, usable))
