"""Cheapest repair of conversations whose turns are lost, empty, repeated, cut or misattributed.

A repaired conversation has the role initials ``(s?(ua)+)?``. Each turn is kept (0),
given the role user or assistant (3) or deleted (4, the only way for blank and repeated
turns); an empty turn of user or assistant may be inserted anywhere (3), and a truncated
turn that stays costs 3 more. Of the cheapest repairs the one with the ASCII-least audit,
the initials of its edits in order, is taken.

*Weights.* Cost and audit are one integer. Its high digits are the cost. Below are three
digits for each turn: the letters of the edits up to and with that turn (at most two
inserts can be of use, and the turn's own letter comes last), padded with zeros at the
end. No turn's letters start another's, so integers are in the order of the audits, and
a shortest path over (turn, last role) in plain integers settles everything.

*Size.* Turns are put in order by ranges of (conversation, turn), so a conversation with
a third of all rows lies in many tasks. They are cut into blocks of at most ``BLOCK``
turns, whose integers have bounded width. A block is solved from each of the four states
to each, which gives 16 costs and the ranks of their audits; these figures compose, so a
conversation is decided from them alone, going over its blocks in order. A second
stream applies the edits. It holds the audit of one conversation, a letter for a turn,
which is a cell of the result; texts pass one by one into the hash. Equal rows are
counted before anything else and travel as one.

Any column may be null: role and text count as one space, turns without a number come
first, rows without a conversation are one conversation. Rows of one turn are ordered by
role, then text. Empty tables give empty tables.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.sources.staging import Staging

BLOCK = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Digits by ASCII order of the letters; 0 pads.
LETTERS = "\0DIKR"
_BASE, _WIDTH, _MOST_INSERTS = len(LETTERS), 3, 2
WHITESPACE = " \t\n\x0b\x0c\r"

# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEEPS = {("s", START): SYSTEM, ("a", USER): ASSISTANT} | {("u", g): USER for g in (START, SYSTEM, ASSISTANT)}
# Inserts that end a repair in each state, as a state to end in.
_TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_LEGAL = {"su", "ua", "au"}


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after a fixed damage by crc32 of ``conv_id:turn``:
    remainder by 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it,
    3 repeats the row, 4 makes it a user's."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    harm = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = turns.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        F.when(harm == 3, 2).otherwise(1).alias("times"),
    ).filter(harm != 0)
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def _edges(symbol: str) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, code of the letters) for one turn."""
    out = []
    for state in _STATES:
        here = state
        for inserts in range(_MOST_INSERTS + 1):
            ways = [("D", here, DELETE)]
            if symbol != "d":
                cost = TRUNCATED if symbol.isupper() else 0
                ways.append(("R", _NEXT[here], REROLE + cost))
                if (symbol.lower(), here) in _KEEPS:
                    ways.append(("K", _KEEPS[symbol.lower(), here], cost))
            for letter, to, price in ways:
                digits = ("I" * inserts + letter).ljust(_WIDTH, "\0")
                code = functools.reduce(lambda n, c: n * _BASE + LETTERS.index(c), digits, 0)
                out.append((state, to, price + INSERT * inserts, code))
            here = _NEXT[here]
    return out


# Turns as the shortest path sees them: the role's initial (x: no legal one), in upper
# case if truncated, and d for those that have to go.
SYMBOLS = "suaxSUAXd"
_EDGES = {symbol: _edges(symbol) for symbol in SYMBOLS}


@functools.lru_cache(maxsize=20_000)
def solve(symbols: str) -> tuple[tuple[int | None, ...], ...]:
    """Least weights of a block of turns by state before and state after."""
    n = len(symbols)
    unit = _BASE ** (_WIDTH * n)
    out = []
    for enter in _STATES:
        least: list[int | None] = [None] * 4
        least[enter] = 0
        place = unit
        for symbol in symbols:
            place //= _BASE**_WIDTH
            after: list[int | None] = [None] * 4
            for source, to, cost, code in _EDGES[symbol]:
                weight = least[source]
                if weight is not None:
                    weight += cost * unit + code * place
                    if after[to] is None or weight < after[to]:
                        after[to] = weight
            least = after
        out.append(tuple(least))
    return tuple(out)


def letters(symbols: str, enter: int, leave: int) -> str:
    """Audit of the best way through a block."""
    rest = solve(symbols)[enter][leave] % _BASE ** (_WIDTH * len(symbols))
    digits = []
    for _ in range(_WIDTH * len(symbols)):
        rest, digit = divmod(rest, _BASE)
        digits.append(LETTERS[digit])
    return "".join(reversed(digits)).replace("\0", "")


@functools.lru_cache(maxsize=20_000)
def figures(symbols: str) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """By state before: (state after, cost, rank of the audit) of the best ways."""
    unit = _BASE ** (_WIDTH * len(symbols))
    out = []
    for row in solve(symbols):
        order = sorted(w % unit for w in row if w is not None)
        out.append(tuple((x, w // unit, order.index(w % unit)) for x, w in enumerate(row) if w is not None))
    return tuple(out)


def _decide(blocks: list[str]) -> tuple[list[tuple[int, int]], str, int]:
    """States around each block of a conversation, the inserts at its end, and the cost."""
    # The same weights, with one digit for the rank of all letters so far.
    at = {START: (0, 0)}
    back: list[dict[int, int]] = []
    for symbols in blocks:
        ways: dict[int, tuple[int, int, int]] = {}
        for enter, (cost, rank) in at.items():
            for leave, price, place in figures(symbols)[enter]:
                way = (cost + price, rank * 4 + place, enter)
                if leave not in ways or way < ways[leave]:
                    ways[leave] = way
        order = sorted(way[1] for way in ways.values())
        at = {leave: (cost, order.index(rank)) for leave, (cost, rank, _) in ways.items()}
        back.append({leave: way[2] for leave, way in ways.items()})
    cost, _, state = min((c + INSERT * len(_TAIL[x]), rank, x) for x, (c, rank) in at.items())
    tail, around = _TAIL[state], []
    for before in reversed(back):
        around.append((before[state], state))
        state = before[state]
    return around[::-1], tail, cost


def _pairs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds block and place to turns that come in order. No block has two conversations."""
    part = TaskContext.get().partitionId()
    block, place, held, last = part << 40, 0, 0, object()
    for batch in batches:
        blocks, places = [], []
        for conv, symbols in _pairs([batch], "conv", "symbols"):
            if held + len(symbols) > BLOCK or conv != last:
                block, held, last = block + 1, 0, conv
            held += len(symbols)
            place += 1
            blocks.append(block)
            places.append(place)
        columns = [*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "block", "place"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, block, symbols in order to each block's letters. Holds one conversation's
    symbols, a byte for a turn."""
    last, blocks, numbers = object(), [], []

    def decided() -> pa.RecordBatch:
        around, tail, cost = _decide(blocks)
        ends = len(blocks) - 1
        return pa.RecordBatch.from_pydict(
            {
                "conv": pa.array([last] * len(blocks), kind),
                "block": pa.array(numbers, pa.int64()),
                "enter": pa.array([enter for enter, _ in around], pa.int32()),
                "letters": [letters(s, *states) for s, states in zip(blocks, around)],
                "tail": [tail if i == ends else "" for i in range(len(blocks))],
                "cost": pa.array([cost if i == ends else 0 for i in range(len(blocks))], pa.int64()),
            }
        )

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, block, symbols in _pairs([batch], "conv", "block", "symbols"):
            if blocks and conv != last:
                yield decided()
                blocks, numbers = [], []
            last = conv
            blocks.append(symbols)
            numbers.append(block)
    if blocks:
        yield decided()


class _Conversation:
    """Figures of one conversation, turn by turn."""

    def __init__(self, conv):
        self.conv = conv
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.low = self.high = self.turn = self.initial = None
        self.n_turns = self.n_lines = 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.letters, self.state = iter(""), START

    def line(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update(("\n" * (self.n_lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.n_lines += 1
        return self.n_lines, role, text

    def inserted(self) -> tuple[int, str, str]:
        self.audit.append("I")
        self.state = _NEXT[self.state]
        return self.line(ROLE[self.state], "")

    def add(self, turn, role: str, text: str, symbols: str, copies: int) -> Iterator[tuple[int, str, str]]:
        """Takes a turn with its copies and gives the repaired lines."""
        if turn is not None:
            self.n_turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        initial = role[:1]
        self.illegal += copies - 1 + (self.initial is not None and self.initial + initial not in _LEGAL)
        self.initial = initial
        gone = copies - (symbols != "d" and symbols[0] != "d")
        if text.strip(WHITESPACE):
            self.duplicate += gone
        else:
            self.blank += gone
        self.truncated += symbols[0].isupper()
        # The path has counted one of the rows that have to go.
        self.cost += DELETE * max(gone - 1, 0)
        for symbol in symbols:
            while (letter := next(self.letters)) == "I":
                yield self.inserted()
            if symbol == "d":
                self.audit.append("D" * gone)
                continue
            self.audit.append(letter)
            if letter == "K":
                self.state = _KEEPS[symbol.lower(), self.state]
                yield self.line(role, text)
            elif letter == "R":
                self.state = _NEXT[self.state]
                yield self.line(ROLE[self.state], text)

    def figures(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return (
            self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
            "".join(self.audit), self.hash.hexdigest(),
        )


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
LINES = "position bigint, role string, text string"
_LINES_AT_ONCE = 4096


def _apply(batches: Iterator[pa.RecordBatch], summary: bool) -> Iterator[pa.RecordBatch]:
    """Goes over blocks of edits, each followed by its turns, conversation by conversation."""
    names = ("conv", "position", "role", "text")
    if summary:
        names = ("conv", *(field.split()[0] for field in SUMMARY.split(", ")))
    out: list[tuple] = []
    now, tail = None, ""
    kind = pa.null()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        arrays = [pa.array(next(columns), kind), *(pa.array(c) for c in columns)]
        return pa.RecordBatch.from_arrays(arrays, names=list(names))

    def ended(conversation: _Conversation) -> list[tuple]:
        lines = [conversation.inserted() for _ in tail]
        return [conversation.figures()] if summary else [(conversation.conv, *line) for line in lines]

    for batch in batches:
        kind = batch.schema.field("conv").type
        columns = ("conv", "place", "enter", "letters", "tail", "cost", "turn", "role", "text", "symbols", "copies")
        for conv, place, enter, edits, end, cost, turn, role, text, symbols, copies in _pairs([batch], *columns):
            if now is None or conv != now.conv:
                if now is not None:
                    out += ended(now)
                now = _Conversation(conv)
            if place == 0:
                now.letters, now.state, tail = iter(edits), enter, end
                now.cost += cost
                continue
            for line in now.add(turn, role, text, symbols, copies):
                if not summary:
                    out.append((conv, *line))
            if len(out) >= _LINES_AT_ONCE:
                yield batch_of(out)
                out = []
    if now is not None:
        out += ended(now)
    if out:
        yield batch_of(out)


def _symbols(first: Column, copies: Column) -> Column:
    """The turn's symbol, if its first copy may stay, and d for the other copies."""
    initial = F.substring("role", 1, 1)
    solid = F.rtrim(F.col("text"), F.lit(WHITESPACE))
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.substring(solid, -1, 1).isin(".", "!", "?"), symbol).otherwise(F.upper(symbol))
    return F.when((solid == "") | ~first, "d").when(copies > 1, F.concat(symbol, F.lit("d"))).otherwise(symbol)


def _edited_turns(turns: DataFrame, staging: Staging, conversation: str) -> DataFrame:
    """Blocks of edits and turns in one frame, for ``_apply``."""
    space = F.lit(" ")
    rows = turns.select(
        F.col(conversation).alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    # to_json leaves a null out, which no value can look like.
    rows = staging.write(rows.withColumn("key", F.sha2(F.to_json(F.struct("conv", "role", "text")), 256)), "turns")
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = rows.groupBy("key").agg(F.min(when).alias("first"))
    rows = rows.join(firsts, "key").withColumn("symbols", _symbols(when == F.col("first"), F.col("copies")))
    rows = staging.write(rows.drop("key", "first"), "marked")
    order = ["conv", "turn", "role", "text"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = staging.write(ordered.mapInArrow(_number, f"{layout}, block bigint, place bigint"), "ordered")

    held = F.sort_array(F.collect_list(F.struct("place", "symbols")))  # a block's, at most BLOCK
    blocks = rows.groupBy("conv", "block").agg(F.array_join(F.transform(held, lambda x: x["symbols"]), "").alias("symbols"))
    blocks = blocks.repartition("conv").sortWithinPartitions("conv", "block")
    conv = f"conv {rows.schema['conv'].dataType.simpleString()}"
    edits = blocks.mapInArrow(_edits, f"{conv}, block bigint, enter int, letters string, tail string, cost bigint")
    both = rows.unionByName(edits.withColumn("place", F.lit(0).cast("bigint")), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "block", "place")


def repair(turns: DataFrame, staging: Staging, conversation: str = "conv_id") -> DataFrame:
    """One row per conversation: gaps in its numbering, faults (blank, duplicate,
    truncated turns; illegal neighbours), cost and audit of the repair, and the SHA-256
    of the repaired ``role:text`` lines."""
    return _applied(turns, staging, conversation, True)


def repaired_turns(turns: DataFrame, staging: Staging, conversation: str = "conv_id") -> DataFrame:
    """The repaired turns: conversation, position (from 1), role, text."""
    return _applied(turns, staging, conversation, False)


def _applied(turns: DataFrame, staging: Staging, conversation: str, summary: bool) -> DataFrame:
    both = _edited_turns(turns, staging, conversation)
    conv = f"conv {both.schema['conv'].dataType.simpleString()}"
    out = both.mapInArrow(lambda batches: _apply(batches, summary), f"{conv}, {SUMMARY if summary else LINES}")
    return out.withColumnRenamed("conv", conversation)
