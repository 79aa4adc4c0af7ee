"""Secrets in texts: fixed patterns, and sliding-window entropy of candidate strings.

DataFrame functions only. Spark has no function for the positions of all matches
of a pattern, so each match is set between marks, the text is split at the marks
(every second piece is then a match), and positions are running sums of lengths.

*Entropy.* Candidates are long runs of token characters with a letter and a
digit. Some shapes are on an allow-list and suppressed whole; fragments such as
a run of one character are cut out of a candidate, and what is left of it is
scanned. A window of fixed width slides over each part. Its Shannon entropy is
updated by the counts, within the window, of the character that enters and the
one that leaves. The span from the first to the last window whose entropy
reaches the threshold of the candidate's character class is reported.

All steps stay within a row: nothing is shuffled, and no value of any column can
make a task large but a long text. Time grows in proportion to a text's length,
whatever is in it: arrays that a step looks into are made once per row, and no
pattern repeats a group, for which Java's matcher would take a stack frame each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.llm.tables import let

# Patterns by kind, in the order in which kinds are listed, and the
# least length of the part that counts.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]{16,}"}
RANKS = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Bits per character that a window has to reach, by character class.
THRESHOLDS = (("^[0-9a-f]+$|^[0-9A-F]+$", 3.0), ("^[A-Z0-9=]+$", 3.6), ("^[A-Za-z0-9]+$", 3.7), ("", 3.8))
# Candidates that only look random: UUIDs, and by what lies between separators words
# with a number at the end, or words and numbers with no separator before them.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SEPARATORS = "[+/_=-]+"
WORD, WORD_OR_NUMBER, NUMBERED = "^[A-Za-z]+$", "^([A-Za-z]+|[0-9]{1,8})$", "^[A-Za-z]*[0-9]{1,8}$"
# Parts of a candidate that are no secret.
FRAGMENT = r"(?i)example|placeholder|x{6,}|(.)\1{7,}"

# A private-use character that no pattern matches marks the edges of matches;
# where a text holds it, another of the same kind takes its place.
_MARK, _PLAIN = "", ""
_BLOCK = 256


def _pieces(text: Column, pattern: str) -> Column:
    marked = F.regexp_replace(F.translate(text, _MARK, _PLAIN), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}"))
    return F.split(marked, _MARK)


_INTS = "cast(array() as array<int>)"


def _running(numbers: Column, op) -> Column:
    """Running values of an associative ``op`` over an array of int, by blocks and then
    blocks of blocks, so that long arrays take linear time."""

    def within(block: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            return F.concat(acc, F.array(F.when(last.isNull(), x).otherwise(op(last, x))))

        return F.aggregate(block, F.expr(_INTS), add)

    def joined(blocks: Column) -> Column:
        lasts = F.transform(blocks, lambda block: F.element_at(block, -1))

        def shifted(before: Column) -> Column:
            return F.flatten(
                F.transform(
                    blocks,
                    lambda block, i: F.when(i == 0, block).otherwise(
                        F.transform(block, lambda x: op(F.get(before, i - 1), x))
                    ),
                )
            )

        return let(within(lasts), shifted)

    def blocked(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil(F.size(values) / _BLOCK).cast("int") - 1)
        blocks = F.transform(starts, lambda b: within(F.slice(values, b * _BLOCK + 1, _BLOCK)))
        return F.when(F.size(values) > 0, let(blocks, joined)).otherwise(F.expr(_INTS))

    return let(numbers, blocked)


_NO_MATCHES = "cast(array() as array<struct<start:int,match:string>>)"


def _alternate(pieces: Column, first: int) -> Column:
    """array<struct<start, match>> of every second piece: from the first match on with
    ``first`` 2, from what lies before it with 1."""

    def located(parts: Column) -> Column:
        def placed(ends: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(first), F.size(parts), F.lit(2)),
                lambda i: F.struct(
                    F.coalesce(F.get(ends, i - 2), F.lit(0)).alias("start"), F.element_at(parts, i).alias("match")
                ),
            )

        ends = _running(F.transform(parts, F.length), lambda a, b: a + b)
        return F.when(F.size(parts) >= first, let(ends, placed)).otherwise(F.expr(_NO_MATCHES))

    return let(pieces, located)


def _matches(pieces: Column) -> Column:
    """Matches with their places, from alternating pieces, the first outside a match."""
    return _alternate(pieces, 2)


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(RANKS[kind]).alias("rank"), F.lit(kind).alias("kind"),
        end.cast("int").alias("end"),
    )


def _spans(kind: str, matches: Column) -> Column:
    return F.transform(matches, lambda m: _span(kind, m["start"], m["start"] + F.length(m["match"])))


def _plogp(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(0.0)


def _threshold(match: Column) -> Column:
    return F.coalesce(*(F.when(match.rlike(p), F.lit(t)) for p, t in THRESHOLDS))


def _hot_windows(part: Column, threshold: Column) -> Column:
    """struct<first, last>: starts of the first and last window at or over the threshold; null if none."""
    start = F.struct(
        F.lit(0.0).alias("total"),  # sum of count * log2(count)
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def scanned(chars: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            """``i``: place of the character that enters, from 1."""
            leaves = F.get(chars, i - WINDOW - 1)
            # The window before, less the one that leaves.
            kept = F.slice(chars, F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i - 1, F.lit(WINDOW - 1)))

            def count(x: Column) -> Column:
                return F.size(F.filter(kept, lambda y: y == x))

            def changed(c_in: Column) -> Column:
                return _plogp(c_in + 1) - _plogp(c_in)

            lost = F.when(leaves.isNotNull(), let(count(leaves), changed)).otherwise(0.0)
            total = state["total"] + let(count(F.element_at(chars, i)), changed) - lost
            return let(total, lambda t: after(state, i, t))

        def after(state: Column, i: Column, total: Column) -> Column:
            # Rounding keeps the order of additions from deciding at the threshold.
            entropy = F.round(F.lit(math.log2(WINDOW)) - total / WINDOW, 6)
            hot = (i >= WINDOW) & (entropy >= threshold)
            return F.struct(
                total.alias("total"),
                F.coalesce(state["first"], F.when(hot, i - WINDOW)).alias("first"),
                F.coalesce(F.when(hot, i - WINDOW), state["last"]).alias("last"),
            )

        return F.aggregate(
            F.sequence(F.lit(1), F.size(chars)),
            start,
            step,
            lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"].alias("first"), s["last"].alias("last"))),
        )

    return let(F.split(part, ""), scanned)


def _allowed(match: Column) -> Column:
    """Whether a candidate has a shape of the allow-list."""

    def shaped(parts: Column) -> Column:
        words = F.forall(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.rlike(WORD))
        numbered = words & F.element_at(parts, -1).rlike(NUMBERED)
        plain = F.forall(parts, lambda p: p.rlike(WORD_OR_NUMBER)) & ~match.rlike("^" + SEPARATORS)
        return (F.size(parts) > 0) & (numbered | plain)

    return match.rlike(UUID) | let(F.filter(F.split(match, SEPARATORS), lambda p: p != ""), shaped)


def _entropy_spans(text: Column) -> Column:
    candidates = F.filter(
        _matches(_pieces(text, CANDIDATE)),
        lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]") & ~_allowed(m["match"]),
    )

    def spans(m: Column) -> Column:
        parts = F.filter(_alternate(_pieces(m["match"], FRAGMENT), 1), lambda p: F.length(p["match"]) >= WINDOW)

        def scanned(threshold: Column) -> Column:
            hot = F.transform(
                parts,
                lambda p: F.struct(
                    (m["start"] + p["start"]).alias("start"), _hot_windows(p["match"], threshold).alias("hot")
                ),
            )
            return F.transform(
                F.filter(hot, lambda p: p["hot"].isNotNull()),
                lambda p: _span("entropy", p["start"] + p["hot"]["first"], p["start"] + p["hot"]["last"] + WINDOW),
            )

        return let(_threshold(m["match"]), scanned)

    return F.flatten(F.transform(candidates, spans))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with three columns more.

    ``base_spans`` has the spans of the fixed patterns, ``secret_spans`` those and
    the entropy spans, both array<struct<start, rank, kind, end>> in code points,
    sorted by start, then kind; columns of these names are replaced. Spans of
    different kinds may overlap. A null or empty text has none. Rows are taken
    one by one: repeats and ties have no influence. A text, a token or a number of
    matches of any size takes time in proportion.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(
        _matches(_pieces(whole, PATTERNS["assign"])),
        lambda m: F.length(F.regexp_extract(m["match"], PATTERNS["assign"], 2)) >= ASSIGN_VALUE,
    )
    access = F.filter(
        _matches(_pieces(whole, PATTERNS["access"])), lambda m: F.length(m["match"]) >= ACCESS_LENGTH
    )
    base = F.array_sort(
        F.concat(
            _spans("assign", assign), _spans("access", access),
            _spans("hex", _matches(_pieces(whole, PATTERNS["hex"]))),
        )
    )
    found = docs.withColumn("base_spans", base)
    return found.withColumn("secret_spans", F.array_sort(F.concat("base_spans", _entropy_spans(whole))))


def redacted(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with every span, overlapping and touching ones as one, replaced by a mask."""

    def cut(chars: Column) -> Column:
        def parted(ends: Column) -> Column:
            # What lies before each span that starts after all earlier ones have ended.
            before = F.transform(
                spans, lambda s, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("low"), s["start"].alias("high"), i.alias("i"))
            )
            gaps = F.filter(before, lambda g: (g["i"] == 0) | (g["high"] > g["low"]))
            tail = F.struct(F.element_at(ends, -1).alias("low"), F.size(chars).alias("high"), F.lit(0).alias("i"))
            parts = F.transform(
                F.concat(gaps, F.array(tail)),
                lambda g: F.array_join(F.slice(chars, g["low"] + 1, F.greatest(g["high"] - g["low"], F.lit(0))), ""),
            )
            return F.array_join(parts, mask)

        return let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), parted)

    return F.when(F.size(spans) > 0, let(F.split(text, ""), cut)).otherwise(text)
