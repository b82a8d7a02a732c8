"""Conversation repair against a plain search over all edits, whole and in stretches."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from keepwise.llm import conversation_edits as E
from keepwise.llm import conversation_repair as C
from keepwise.llm import queries
from tests.conftest import SF_MID, SF_SMALL

SPACE = " \t\n\x0b\f\r"
CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def plain_cheapest(initials, faults, limit=2):
    """(cost, audit) by trying everything from the end: at most two turns inserted in a row are ever of use."""
    memo = {}

    def best(pos, state, inserted):
        key = (pos, state, inserted)
        if key not in memo:
            ways = []
            if pos == len(initials) and state in "0a":
                ways.append((0, ""))
            if inserted < limit:
                c, a = best(pos, "a" if state == "u" else "u", inserted + 1)
                ways.append((c + 2, "I" + a))
            if pos < len(initials):
                c, a = best(pos + 1, state, 0)
                ways.append((c + 3, "D" + a))
                if faults[pos] != 1:
                    extra = int(faults[pos] == 2)
                    if initials[pos] and initials[pos] in {"0": "su", "s": "u", "u": "a", "a": "u"}[state]:
                        c, a = best(pos + 1, initials[pos], 0)
                        ways.append((c + extra, "K" + a))
                    c, a = best(pos + 1, "a" if state == "u" else "u", 0)
                    ways.append((c + 2 + extra, "R" + a))
            memo[key] = min(ways) if ways else (10**9, "")
        return memo[key]

    for pos in range(len(initials), -1, -1):     # fill from the end: no deep recursion
        for inserted in range(limit, -1, -1):
            for state in "0sua":
                best(pos, state, inserted)
    return best(0, "0", 0)


def plain_repair(rows):
    """{conv_id: result} of (conv_id, turn, role, text) rows."""
    text = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, body in rows:
        kept = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, body = text(role), text(body)
        if kind == 0:
            continue
        if kind == 1:
            body = ""
        if kind == 2:
            body = "".join(c for c in body if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, body)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, body in kept:
            end = body.rstrip(SPACE)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, body) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, body))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_cheapest(initials, [1 if f in ("blank", "duplicate") else 2 if f else 0 for f in faults])
        lines, state, at = [], "0", 0
        for edit in audit:
            role, body = (None, "") if edit == "I" else kept[at][1:]
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            lines.append(f"{role}:{body}")
            state = role[0]
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_search_against_plain(seed=5):
    rng = random.Random(seed)
    for _ in range(1500):
        n = rng.randrange(9)
        initials = [rng.choice(["u", "a", "s", "", "x"] if rng.random() < 0.3 else ["u", "a"]) for _ in range(n)]
        faults = [rng.choice([0, 0, 1, 2]) for _ in range(n)]
        assert E.Stretch(initials, faults).cheapest() == plain_cheapest(initials, faults), (initials, faults)


@pytest.mark.parametrize("initials", [["u"] * 600, ["s"] * 300, ["u", "a"] * 300, ["a", "u", "u"] * 150, ["s", "a", "x"] * 100])
def test_long_sequences(initials):
    for step in (10**9, 7, 2):
        faults = [2 if i % step == 1 else 1 if i % step == 3 else 0 for i in range(len(initials))]
        assert E.Stretch(initials, faults).cheapest() == plain_cheapest(initials, faults)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_against_plain(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(queries.QUERIES["op13_deepening_repair"](spark, sf)) == plain_repair(rows)


def odd_rows(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", None, "", "tool", "umpire", "User"]
    texts = ["Fine.", "Fine.", "cut short", "", None, " \t\n", "Really? ", "é…", "x" * 50_000 + "!", "a.b!c?", "end. "]
    rows = [(conv, rng.choice([None, *range(n)]), rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice(texts))
            for conv in range(40) for n in [rng.randrange(1, 30)] for _ in range(n)]
    rows += [(None, t, "user", "Same words.") for t in range(40)] + [(None, None, "assistant", "Same words.")] * 5
    rows += [(77, 5, "user", "Hi.")] * 9 + [(78, -2**62, "user", "Far."), (78, 2**62 - 1, "assistant", "away.")]
    dropped = [(c, t) for c in range(1000, 1400) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:4]
    return rows + [(c, t, "user", "Gone.") for c, t in dropped]


def test_odd_rows_whole_and_in_stretches(spark):
    rows = odd_rows(1)
    want = plain_repair(rows)
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "role AS gone", "text AS chunk", "turn AS at", "conv_id AS _conv")
    assert results(C.repair_conversations(df)) == want
    for long, chunk in ((0, 3), (6, 4), (12, 1)):
        assert results(C.repair_conversations(df, long=long, chunk=chunk)) == want, (long, chunk)
    assert C.repair_conversations(spark.createDataFrame([], CONV)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert any(v == (0, 0, 0, 0, 0, 0, "", empty) for v in want.values())


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["One.", "Two!", f"Line {t}.", f"open {t}"])) for t in range(3000)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"Say {c} {t}.") for c in range(2, 400) for t in range(4)]
    df = spark.createDataFrame(rows, CONV)
    assert results(C.repair_conversations(df, long=500, chunk=128)) == plain_repair(rows)
