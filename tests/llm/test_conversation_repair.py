import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from visitlake.llm import conversation_repair as C
from visitlake.llm import entries, tables

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("conv", T.StringType()), T.StructField("block", T.StringType()),
    ]
)
WHITE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def harmed(rows):
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        harm = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        solid = text.rstrip(WHITE)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        yield fault


def tried(rows):
    """(cost, audit, lines) of the best of all repairs, by trying them."""
    choices = []
    for (_, _, role, text), fault in zip(rows, faults(rows)):
        ways = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            ways += [(more, "K", [(role, text)])] + [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append(ways)
    new = [(0, "", [])] + [(3, "I", [(r, "")]) for r in ("user", "assistant")]
    new += [(6, "II", [(r, ""), (s, "")]) for r, s in (("user", "assistant"), ("assistant", "user"))]
    slots = [new]
    for ways in choices:
        slots += [ways, new]
    best = None
    for path in itertools.product(*slots):
        lines = [line for way in path for line in way[2]]
        if LEGAL.match("".join(role[:1] or "?" for role, _ in lines)):
            found = (sum(way[0] for way in path), "".join(way[1] for way in path), lines)
            best = min(best or found, found, key=lambda f: f[:2])
    return best


def walked(rows):
    """The same by a plain shortest path over whole audits, for longer conversations."""
    at = {"": (0, "", [])}

    def follows(state, initial):
        return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    def keep(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserts(states):
        out = dict(states)
        for _ in range(2):
            for state, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    if follows(state, role[0]):
                        keep(out, role[0], (cost + 3, audit + "I", [*lines, (role, "")]))
        return out

    for (_, _, role, text), fault in zip(rows, faults(rows)):
        after = {}
        more = 3 * (fault == "truncated")
        # Inserts are tried apart from each state, as ways that lead to one state differ later.
        for state in at:
            for here, (cost, audit, lines) in inserts({state: at[state]}).items():
                keep(after, here, (cost + 4, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                if role[:1] in ("s", "u", "a") and follows(here, role[:1]):
                    keep(after, role[0], (cost + more, audit + "K", [*lines, (role, text)]))
                for new in ("user", "assistant"):
                    if follows(here, new[0]):
                        keep(after, new[0], (cost + 3 + more, audit + "R", [*lines, (new, text)]))
        at = after
    ends = {k: v for k, v in inserts(at).items() if k in ("", "a")}
    return min(ends.values(), key=lambda f: f[:2])


def expected(rows, solve):
    rows = ordered(rows)
    kinds = list(faults(rows))
    turns = {r[1] for r in rows if r[1] is not None}
    cost, audit, lines = solve(rows)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    )


def grouped(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


def some_rows(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User"]
    texts = ["One.", "Two!", "Three?", "cut", "", " \t", "cut.\n", "é。", "Four. "]
    return [
        (conv, rng.choice([None, rng.randrange(9), i]) if rng.random() < 0.3 else i, rng.choice(roles), rng.choice(texts))
        for i in range(n)
    ]


def as_given(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


def run(spark, rows):
    found = C.repair(table(spark, rows), tables.stage(spark, "t")).collect()
    out = {r[0]: tuple(r)[1:] for r in found}
    assert len(out) == len(found)
    return out


def test_small_conversations_against_all_repairs(spark):
    rng = random.Random(7)
    rows = [r for c in range(40) for r in some_rows(rng, c, rng.randrange(1, 5))]
    rows += [(None, 0, "user", None), (None, None, None, "x."), (99, None, None, None)]
    found = run(spark, rows)
    want = {c: expected(g, tried) for c, g in grouped(as_given(rows)).items()}
    assert found == want
    for group in grouped(as_given(rows)).values():
        assert walked(ordered(group))[:2] == tried(ordered(group))[:2]


@pytest.mark.parametrize("block", [2, 5, C.BLOCK])
def test_blocks_and_long_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    rows = [r for c in range(20) for r in some_rows(rng, c, rng.randrange(5, 30))]
    alternating = ["user", "assistant"]
    rows += [(77, i, alternating[i % 2] if rng.random() < 0.9 else "system", f"t{i}{rng.choice(['.', ''])}") for i in range(900)]
    rows += [(78, 5, "user", "same.")] * 3000 + [(78, 4, "user", "")] * 500
    rng.shuffle(rows)
    found = run(spark, rows)
    for conv, group in grouped(rows).items():
        assert found[conv] == expected(group, walked), conv


def test_repaired_turns_are_those_hashed(spark):
    rng = random.Random(3)
    rows = [r for c in range(30) for r in some_rows(rng, c, rng.randrange(1, 9))]
    lines = C.repaired_turns(table(spark, rows), tables.stage(spark, "t")).collect()
    for conv, group in grouped(rows).items():
        own = sorted((r.position, r.role, r.text) for r in lines if r.conv_id == conv)
        assert [r[1:] for r in own] == walked(ordered(group))[2]
        assert [r[0] for r in own] == list(range(1, len(own) + 1))


def test_empty_table_and_other_ids(spark):
    assert run(spark, []) == {}
    frame = spark.createDataFrame([("a", 1, "user", "Hi."), (" ", 1, "user", "Hi."), (None, 2, "assistant", "Yo.")], "conv_id string, turn int, role string, text string")
    found = {r.conv_id: r.audit for r in C.repair(frame, tables.stage(spark, "t")).collect()}
    # Deleting costs 4, inserting the other side 3.
    assert found == {"a": "KI", " ": "KI", None: "IK"}


def test_query_equals_brute_force(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    # Turn numbers whose row the damage drops make a conversation without rows.
    lost = next(i for i in range(9_000, 9_999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    given += [(lost, 0, "user", "Hi."), (None, None, None, None), (lost + 1_000, None, "user", "A?")]
    table(spark, given).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r[0]: r for r in entries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    after = grouped(harmed(given))
    assert set(found) == {r[0] for r in given}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for conv, row in found.items():
        want = expected(after[conv], walked) if conv in after else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
        assert tuple(row[n] for n in names) == want, conv
