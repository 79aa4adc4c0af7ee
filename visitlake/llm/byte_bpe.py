"""Byte-level BPE by the rank file of a public tokenizer: texts to ids and back.

Text is cut by the tokenizer's pattern; each word is a byte array, held as a string with
a character for each token, at first each byte. A fold of Spark's higher-order functions
merges it: the neighbours whose joined bytes have the lowest rank become one, the first of
equal ones, until no joined pair has a rank. Ranks come from a literal map in the
expression, dealt into small ones by a hash of the key. Each is a string of entries, as a
map of Spark's is searched from its start through an object per key. Decoding puts the
byte strings of the ids, a literal array, one after the other.

*Distinct words.* Words are counted over all texts with a map-side combine. Those that
occur most, at most ``FREQUENT`` of them with at most ``LONG`` bytes each, are folded
once and go to the tasks as a broadcast of bounded size; the others are folded once in
each document that has them. No text is shuffled. A word of more than ``LONG`` bytes,
such as a rule of dashes or a blob, would take quadratic time in a fold; it is merged
with a heap in the task, to the same ids.

A null text is an empty one and has no ids; rows are taken one by one, so repeats and
ties have no influence, and other columns may have any names. Classes of characters are
those of the Java runtime: letters that Unicode has added since count as symbols.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlake.llm.tables import let
from visitlake.sources.staging import Staging

FREQUENT = 400_000
LONG = 64  # bytes
WORDS_AT_ONCE = 1 << 17  # whose runs are made together
_SLOTS = 1 << 16
# Symbols are characters beyond the basic plane, which no surrogate can be.
_FIRST, _NONE = 0x10000, "\U0010ffff"
_BEGIN, _END = "\x01", "\x02"  # of a key in a slot
_LATIN = "ISO-8859-1"


def read_ranks(path: str) -> dict[bytes, int]:
    """A tokenizer's rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level tokenizer needs a rank for each byte")
    return ranks


def java_pattern(pattern: str) -> str:
    r"""The pattern for Java, whose ``\s`` and ``\S`` are ASCII only."""
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def _symbol(token: int) -> str:
    """A token within a word under work: a character, so that a merge is one change of a string."""
    return chr(_FIRST + token)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: strings of entries by the key's hash. Keys are two symbols
    whose joined bytes have a rank, and the symbols of the bytes of a longer token; values
    are the symbol of the token."""
    if max(ranks.values()) >= ord(_NONE) - _FIRST:
        raise ValueError("too many ranks")
    byte = [_symbol(ranks[bytes([b])]) for b in range(256)]
    slots = [[_NONE] for _ in range(_SLOTS)]
    for token, rank in ranks.items():
        keys = {"".join(byte[b] for b in token)} if len(token) > 2 else set()
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.add(_symbol(left) + _symbol(right))
        for key in keys:
            entry = _BEGIN + key + _END
            slots[zlib.crc32(entry.encode()) % _SLOTS].append(entry + _symbol(rank))
    return F.from_json(F.lit(json.dumps(["".join(slot) for slot in slots], ensure_ascii=False)), "array<string>")


def _rank(table: Column, *key: Column) -> Column:
    """The symbol that a key stands for, or _NONE."""

    def of(entry: Column) -> Column:
        slot = F.get(table, (F.crc32(entry.cast("binary")) % _SLOTS).cast("int"))
        # What follows the entry, or all of the slot, which starts with _NONE.
        return F.substring(F.call_function("substring_index", slot, entry, F.lit(-1)), 1, 1)

    return let(F.concat(F.lit(_BEGIN), *key, F.lit(_END)), of)


def _merged(table: Column, state: Column) -> Column:
    """The state after the merge with the lowest rank, the first of equal ones; the same
    if there is none. ``pairs`` has the symbol that each neighbours' pair would become."""
    word, pairs = state["word"], state["pairs"]

    def merge(least: Column) -> Column:
        def at(p: Column) -> Column:
            # The pair before now ends with the new symbol, the one after starts with it.
            before = F.when(p > 1, _rank(table, F.substring(word, p - 1, F.lit(1)), least)).otherwise("")
            after = F.when(p < F.length(pairs), _rank(table, least, F.substring(word, p + 2, F.lit(1)))).otherwise("")
            low = F.greatest(p - 1, F.lit(1))
            return F.struct(
                F.overlay(word, least, p, F.lit(2)).alias("word"),
                F.overlay(pairs, F.concat(before, after), low, p + 2 - low).alias("pairs"),
            )

        ended = F.struct(word.alias("word"), F.lit("").alias("pairs"))
        return F.when(least == _NONE, ended).otherwise(let(F.instr(pairs, least), at))

    return F.when(pairs == "", state).otherwise(let(F.array_min(F.split(pairs, "")), merge))


def _fold(table: Column, symbols: Column) -> Column:
    """Symbols of the tokens of a word; a word that is a token is taken as it is."""

    def merged(word: Column) -> Column:
        n = F.length(word)
        starts = F.slice(F.sequence(F.lit(1), n), F.lit(1), n - 1)
        pairs = F.array_join(F.transform(starts, lambda i: _rank(table, F.substring(word, i, F.lit(2)))), "")
        folded = F.aggregate(
            F.array_repeat(F.lit(0), n - 1),
            F.struct(word.alias("word"), pairs.alias("pairs")),
            lambda state, _: _merged(table, state),
            lambda state: state["word"],
        )
        return let(_rank(table, word), lambda whole: F.when(whole == _NONE, folded).otherwise(whole))

    return let(symbols, merged)


def word_ids(words: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of each word of an array of short words."""
    byte = "".join(_symbol(ranks[bytes([b])]) for b in range(256))
    latin = bytes(range(256)).decode(_LATIN)

    def ids(table: Column, word: Column) -> Column:
        symbols = F.translate(F.decode(F.encode(word, "UTF-8"), _LATIN), latin, byte)
        return F.transform(F.split(_fold(table, symbols), ""), lambda x: F.ascii(x) - _FIRST)

    return let(rank_map(ranks), lambda table: F.transform(words, lambda word: ids(table, word)))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that an array of ids stands for; an unknown id has none."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.decode(_LATIN)
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))
    return F.encode(joined, _LATIN)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for long words."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends = list(range(1, n + 1))  # end of the piece that starts here, 0 where none does
    before = list(range(-1, n))
    heap = []

    def consider(low: int) -> None:
        if low >= 0 and ends[low] < n:
            rank = ranks.get(word[low : ends[ends[low]]])
            if rank is not None:
                heap.append((rank, low, ends[low], ends[ends[low]]))

    for low in range(n):
        consider(low)
    heapq.heapify(heap)
    while heap:
        _, low, middle, high = heapq.heappop(heap)
        if ends[low] != middle or ends[middle] != high:
            continue  # one of the two has been merged
        ends[low], ends[middle] = high, 0
        before[high] = low
        for start in (before[low], low):
            held = len(heap)
            consider(start)
            if len(heap) > held:
                heapq.heappush(heap, heap.pop())
    out, low = [], 0
    while low < n:
        out.append(ranks[word[low : ends[low]]])
        low = ends[low]
    return out


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


class Frequent:
    """The frequent words with their ids, and ranks for long words."""

    def __init__(self, found: pa.Table, ranks: dict[bytes, int]):
        self.words = found.column("word").combine_chunks()
        ids = found.column("ids").combine_chunks()
        self.lengths = pc.list_value_length(ids).to_numpy().astype(np.int64)
        self.ids = ids.flatten().to_numpy()
        self.ranks = ranks

    def _ids_of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: whether they are rare, the number of their ids, where these
        start, and what they start in."""
        # Arrow's own hash table, made for each batch, takes less memory than a dict that stays.
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        lengths, own = [self.lengths], [self.ids]
        sizes = pc.binary_length(words).to_numpy()
        long = np.flatnonzero((place < 0) & (sizes > LONG))
        for i, at in enumerate(long):
            merged = merge_long(words[int(at)].as_py().encode(), self.ranks)
            place[at] = len(self.lengths) + i
            lengths.append(np.array([len(merged)]))
            own.append(np.array(merged, np.int32))
        # The last entry, without ids, is for rare words.
        every = np.concatenate([*lengths, np.zeros(1, np.int64)])
        starts = np.cumsum(every) - every
        return place < 0, every[place], starts[place], np.concatenate(own)

    def look_up(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Ids of the words of each row, in runs that end before a rare word; the row's
        distinct rare words, and which of them follows each run (-1: the last run).
        The words of a batch are looked up at once, the runs made for some rows at a time."""
        words = batch.column(1).flatten().dictionary_encode()
        code = words.indices.to_numpy()
        counts = pc.list_value_length(batch.column(1)).to_numpy()
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        found = self._ids_of(words.dictionary)
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(first, first[low] + WORDS_AT_ONCE, side="right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            own = code[first[low] : first[high]]
            yield self._runs(batch.column(0).slice(low, high - low), words.dictionary, own, first[low : high + 1] - first[low], *found)
            low = high

    @staticmethod
    def _runs(rows, dictionary, code, first, is_rare, lengths, starts, table) -> pa.RecordBatch:
        n_rows = len(rows)
        lengths, starts = lengths[code], starts[code]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        flat = table[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)]

        rare = np.flatnonzero(is_rare[code])
        row_of = np.searchsorted(first, rare, side="right") - 1
        distinct, which = np.unique(row_of * max(len(dictionary), 1) + code[rare], return_inverse=True)
        owner, distinct = np.divmod(distinct, max(len(dictionary), 1))
        own = np.bincount(owner, minlength=n_rows)
        before = np.bincount(row_of, minlength=n_rows)
        # A run starts with each row and with each rare word.
        run = np.arange(len(rare)) + row_of
        bounds = np.empty(n_rows + len(rare) + 1, np.int64)
        bounds[np.arange(n_rows) + np.cumsum(before) - before] = offsets[first[:-1]]
        bounds[run + 1] = offsets[rare]
        bounds[-1] = offsets[-1]
        follows = np.full(n_rows + len(rare), -1, np.int32)
        follows[run] = which - (np.cumsum(own) - own)[row_of]
        return pa.RecordBatch.from_arrays(
            [
                rows,
                _lists(before + 1, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))),
                _lists(own, dictionary.take(pa.array(distinct))),
                _lists(before + 1, pa.array(follows)),
            ],
            names=["row", "runs", "rare", "follows"],
        )


def frequent_words(words: DataFrame, ranks: dict[bytes, int], staging: Staging) -> pa.Table:
    """word, ids of the words that occur most, at most ``FREQUENT``."""
    short = words.filter(F.octet_length("word") <= LONG)
    counts = staging.write(short.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    # Counts by an eighth of an octave: the least one from which few enough words remain.
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step).count().collect()), reverse=True)
    least, held = None, 0
    for at, n in sizes:
        held += n
        if held > FREQUENT:
            break
        least = at
    kept = counts.filter(step >= least if least is not None else F.lit(False))
    ids = F.get(word_ids(F.array("word"), ranks), F.lit(0))
    found = staging.write(kept.select("word", ids.alias("ids")), "frequent").toArrow()
    staging.discard("words", "frequent")
    return found


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, staging: Staging, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``token_ids``, an array of int; a column of that name
    is replaced. ``pattern`` is the tokenizer's own."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != "token_ids"]
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    rows = docs.select(F.struct(*columns).alias("row"), found.alias("words"))
    table = frequent_words(rows.select(F.explode("words").alias("word")), ranks, staging)
    sent = spark.sparkContext.broadcast((table, ranks))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Frequent(*sent.value)
        for batch in batches:
            yield from known.look_up(batch)

    layout = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("runs", T.ArrayType(T.ArrayType(T.IntegerType()))),
            T.StructField("rare", T.ArrayType(T.StringType())),
            T.StructField("follows", T.ArrayType(T.IntegerType())),
        ]
    )
    coded = rows.mapInArrow(look_up, layout)

    def joined(rare: Column) -> Column:
        def run(ids: Column, i: Column) -> Column:
            after = F.get("follows", i)
            return F.when(after >= 0, F.concat(ids, F.get(rare, after))).otherwise(ids)

        return F.flatten(F.transform("runs", run))

    ids = F.when(F.size("rare") > 0, let(word_ids(F.col("rare"), ranks), joined)).otherwise(F.flatten("runs"))
    return coded.select("row.*", ids.alias("token_ids"))
