import math
import random
import re
import time

from llm_helpers import AWKWARD, table
from pyspark.sql import functions as F

from visitlake.llm import secret_scan as S

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def allowed(c):
    shapes = (
        S.UUID, r"^[+/_=-]*([A-Za-z]+[+/_=-]+)*[A-Za-z]*[0-9]{1,8}[+/_=-]*$",
        r"^([A-Za-z]+|[0-9]{1,8})([+/_=-]+([A-Za-z]+|[0-9]{1,8}))*[+/_=-]*$",
    )
    return any(re.search(p, c) for p in shapes)


def entropy(text):
    out = []
    for m in re.finditer(S.CANDIDATE, text):
        c = m[0]
        if not re.search("[0-9]", c) or not re.search("[A-Za-z]", c) or allowed(c):
            continue
        least = next(t for p, t in S.THRESHOLDS if re.search(p, c))
        cuts = [0] + [x for f in re.finditer(S.FRAGMENT, c) for x in f.span()] + [len(c)]
        for low, high in zip(cuts[::2], cuts[1::2]):
            hot = []
            for i in range(low, high - S.WINDOW + 1):
                w = c[i : i + S.WINDOW]
                bits = -sum(w.count(x) / len(w) * math.log2(w.count(x) / len(w)) for x in set(w))
                if round(bits, 6) >= least:
                    hot.append(i)
            if hot:
                out.append((m.start() + hot[0], 3, "entropy", m.start() + hot[-1] + S.WINDOW))
    return out


def texts():
    rng = random.Random(4)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", S.ALPHABET, "ab1", "0123456789ABCDEF"]
    keys = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "ſecret", "toKen"]
    out = list(AWKWARD) + ["password=token: abcdefghijklmnop", "token=" * 6, "AKIA" * 9, "f" * 16 + "AKIA" + "F" * 14]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            value = "".join(rng.choices(rng.choice(alphabets), k=rng.choice([5, 11, 12, 15, 16, 20, 40, 90])))
            kind = rng.randrange(5)
            quote = rng.choice(["", '"', "'"])
            parts.append(
                [
                    f"{rng.choice(keys)}{quote}{' ' * rng.randrange(3)}{rng.choice(':=')} {quote}{value}{quote}",
                    "AKIA" + value.upper(), value, "ünïcode 😀 wörd", "prose-with-2024-01-02 and-hyphens-here-12",
                ][kind]
            )
        out.append(rng.choice([" ", "\n", ""]).join(parts))
    # A key with a run of one character, cut-out words, and shapes on the edge of the list.
    blob = "".join(rng.choices(S.ALPHABET, k=900))
    out += [blob[:300] + "A" * 9 + blob[300:], blob[:40] + "EXAMPLE" + blob[40:60], blob[:25] + "xxxXXXx" + blob[50:65] + "Placeholder1"]
    out += ["ab-12-" * 40 + "!", "ab-12-" * 40, "-ab-12-" * 9, "one-two-three-four-123456789", "a/b/c/d/e/f/g/h/i/j/k/12", "12-ab-34-cd-56-ef-78-gh", "".join(rng.choices("ab1-_", k=5_000))]
    return out + ["AKIA" + "Z" * 14 + " " + "0123456789abcdef " * 700]


def test_equals_brute_force(spark):
    all_texts = texts()
    docs = table(spark, [(i, t) for i, t in enumerate(all_texts)])
    found = {r.doc_id: r for r in S.find_secrets(docs).collect()}
    assert len(found) == len(all_texts)
    some = 0
    for i, t in enumerate(all_texts):
        row = lambda s: (s.start, s.rank, s.kind, s.end)
        assert [row(s) for s in found[i].base_spans] == base(t or ""), t
        assert [row(s) for s in found[i].secret_spans] == sorted(base(t or "") + entropy(t or "")), t
        some += len(entropy(t or ""))
    assert some > 50


def test_redaction_replaces_merged_spans(spark):
    all_texts = texts()
    docs = S.find_secrets(table(spark, [(i, t) for i, t in enumerate(all_texts)]))
    got = docs.select("doc_id", S.redacted(F.col("text"), F.col("secret_spans"), "<>").alias("clean")).collect()
    for row in got:
        t = all_texts[row.doc_id]
        if t is None:
            assert row.clean is None
            continue
        want, done = "", 0
        merged: list[list[int]] = []
        for a, _, _, b in sorted(base(t) + entropy(t)):
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            want, done = want + t[done:a] + "<>", b
        assert row.clean == want + t[done:]


def test_empty_table(spark):
    assert S.find_secrets(table(spark, [])).count() == 0


def test_a_megabyte_of_anything_takes_seconds(spark):
    rng = random.Random(8)
    n = 1 << 20
    long = {
        "token": "".join(rng.choices(S.ALPHABET, k=n)),
        "shape": "ab-12-" * (n // 6) + "!",
        "shape and end": "ab-12-" * (n // 6) + "c",
        "hex words": " ".join("%016x" % rng.getrandbits(64) for _ in range(n // 17)),
        "one letter": "x" * n,
        "assignments": "token=abcdefgh1234 " * (n // 19),
        "keywords": "token  " * (n // 7),
        "uuids": "01234567-89ab-cdef-0123-456789abcdef " * (n // 37),
        "fragments": "q1example" * (n // 9),
    }
    for name, text in long.items():
        docs = S.find_secrets(table(spark, [(1, text)]))
        started = time.time()
        row = docs.select("secret_spans", S.redacted(F.col("text"), F.col("secret_spans"), "").alias("clean")).first()
        assert time.time() - started < 60, name
        assert len(row.clean) <= n
        assert len(row.secret_spans) >= {"token": 1, "hex words": n // 17, "assignments": n // 19}.get(name, 0), name
