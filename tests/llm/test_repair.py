import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from tallyglass.llm import repair as r

EXTRA = ("g", "pos", 1)
SCHEMA = "conv_id long, turn long, role string, text string, g string, block string, kind int"
SPACE = "\x20\t\n\x0b\x0c\r"


def _brute(rows):
    """(cost, letters) of the cheapest edits, first in ASCII order: rows from the last, inserts relaxed until nothing improves."""
    n = len(rows)
    best = {(n, s): ((0, "") if s in (r.NOTHING, r.A) else (10 ** 6, "")) for s in range(4)}
    for i in range(n, -1, -1):
        for s in range(4):
            if i < n:
                initial, fault = rows[i]
                ways = [(3 + best[i + 1, s][0], "D" + best[i + 1, s][1])]
                if fault in (0, 3):
                    ways.append((2 + (fault == 3) + best[i + 1, r.PUT[s]][0], "R" + best[i + 1, r.PUT[s]][1]))
                    if initial in r.NEXT[s]:
                        to = r.NEXT[s][initial]
                        ways.append(((fault == 3) + best[i + 1, to][0], "K" + best[i + 1, to][1]))
                best[i, s] = min(ways)
        for _, s in itertools.product(range(4), range(4)):
            best[i, s] = min(best[i, s], (2 + best[i, r.PUT[s]][0], "I" + best[i, r.PUT[s]][1]))
    return best[0, r.NOTHING]


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([0, 0, 1, 2, 3])), max_size=14)


@settings(max_examples=300, deadline=None)
@given(ROWS)
def test_prices_and_letters_against_all_ways(rows):
    lattice = r.Lattice([i for i, _ in rows], [f for _, f in rows], None)
    pieces, _ = lattice.trace(r.NOTHING)
    assert (lattice.price[0], "".join(pieces)) == _brute(rows)
    assert len(pieces) == len(rows) + 1


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(1, 4))
def test_blocks_join_to_the_whole(rows, size):
    parts = [rows[i:i + size] for i in range(0, len(rows), size)] or [[]]
    ahead, behind = None, []
    for k, part in reversed(list(enumerate(parts))):
        behind.append(ahead)
        ways = r._reach([i for i, _ in part], [f for _, f in part], k == len(parts) - 1)
        ahead = ways if len(ways) == 4 else [min(ways[4 * a + b] + ahead[b] for b in range(4)) for a in range(4)]
    state, letters = r.NOTHING, ""
    for part, a in zip(parts, reversed(behind)):
        pieces, state = r.Lattice([i for i, _ in part], [f for _, f in part], a).trace(state)
        letters += "".join(pieces)
    assert (ahead[0], letters) == _brute(rows)


def _expected(turns):
    """Every conversation after damage, in plain Python."""
    out = {}
    for conv, *_ in turns:
        out.setdefault(conv, [])
    for conv, turn, role, text in turns:
        role, text = (" " if v is None else v for v in (role, text))
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if part == 0:
            continue
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        out[conv] += [(turn, "user" if part == 4 else role, text)] * (2 if part == 3 else 1)
    result = []
    for conv, rows in out.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(SPACE)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        known = [t for t, _, _ in rows if t is not None]
        cost, audit = _brute([(role[:1], f) for (_, role, _), f in zip(rows, faults)])
        lines, left, system, n = [], list(rows), 0, 0
        for letter in audit:
            if letter != "I":
                _, role, text = left.pop(0)
            if letter == "D":
                continue
            n += 1
            if letter == "K":
                system |= n == 1 and role[:1] == "s"
                lines.append(f"{role}:{text}")
            else:
                lines.append(("user:" if (n - system) % 2 else "assistant:") + (text if letter == "R" else ""))
        initials = [role[:1] for _, role, _ in rows]
        result.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(k) for k in (1, 2, 3)),
                       sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=str)


def _turns(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 40])
        for turn in range(size):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]) + (100 if turn > 20 else 0), "system" if turn == 0 and rng.random() < 0.4 else role, rng.choice(["Yes.", "no", "Why? \n", f"text {rng.random()}.", f"cut {turn}", "é\n!", " \t"])))
    kept = {(c, t): (c, t, *x) for c, t, *x in rows}
    return list(kept.values()) + [(9001, 0, None, None), (9001, None, "user", "first."), (9002, None, "tool", "Hi."), (None, 1, "user", "A."), (None, 2, "assistant", None), (9003, 5, "", "x"), (9004, -3, "user", "long " * 100_000)]


@pytest.mark.parametrize("block", [1024, 3])
def test_conversations_against_python(spark, block):
    turns = _turns(120, 3)
    df = spark.createDataFrame([(*t, *EXTRA) for t in turns], SCHEMA).repartition(4)
    got = r.repair(r.damage(df), conversations=df, block=block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == _expected(turns)


def test_repaired_rows_follow_the_pattern_and_hash_alike(spark):
    df = r.damage(spark.createDataFrame(_turns(60, 4), "conv_id long, turn long, role string, text string"))
    lines = {}
    for x in sorted(r.repaired(df, block=5).collect(), key=lambda x: (str(x["conv_id"]), x["position"])):
        lines.setdefault(x["conv_id"], []).append((x["role"], x["text"], x["position"]))
    for x in r.repair(df).collect():
        own = lines.get(x["conv_id"], [])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _, _ in own)) and [p for *_, p in own] == list(range(len(own)))
        assert x["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in own).encode()).hexdigest()


def test_nothing_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert r.repair(r.damage(empty), conversations=empty).count() == 0 and r.repaired(empty).count() == 0
    same = spark.createDataFrame([(1, 1, "user", "Hello.")] * 5 + [(1, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    x = r.repair(same).first()
    assert (x["duplicate"], x["illegal"], x["cost"], x["audit"]) == (4, 4, 12, "KDDDDK")
    lost = spark.createDataFrame([(1, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    gone = r.repair(lost.limit(0), conversations=lost).first()
    assert tuple(gone) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
