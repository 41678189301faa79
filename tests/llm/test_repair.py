import hashlib
import random
import zlib
from functools import cache
from itertools import groupby

import pytest

from chartweave.llm import repair as r


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        elif code == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def cheapest(rows, faults):
    """Least (cost, letters) by plain recursion over rows and what has been written so far."""
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserts=0):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        put = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[put]
        if inserts < 3:
            c, a, t = best(i, put, inserts + 1)
            found.append((c + 5, "I" + a, ((name, ""), *t)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, a, t = best(i + 1, state)
            found.append((c + 2, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if role[:1] and role[:1] in nexts[state]:
                    c, a, t = best(i + 1, role[:1])
                    found.append((c + more, "K" + a, ((role, text), *t)))
                c, a, t = best(i + 1, put)
                found.append((c + 1 + more, "R" + a, ((name, text), *t)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    return best(0, "")


def brute(rows, damage=True):
    own = damaged(rows) if damage else [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]
    order = lambda x: (x[1] is not None, x[1] or 0, x[2], x[3])
    out = []
    for conv in {x[0] for x in rows}:
        mine = sorted((x for x in own if x[0] == conv), key=order)
        seen, faults = set(), []
        for _, _, role, text in mine:
            left = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        ts = [x[1] for x in mine if x[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, turns = cheapest(mine, faults)
        text = "\n".join(f"{a}:{b}" for a, b in turns)
        out.append((conv, max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, turns):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        rows += [(conv, t, rng.choice(["system", "user", "assistant", "assistant", "user", "tool", ""]), rng.choice(["a.", "b!", "c", " ", "d?", "é", "x y. ", f"own {t}."]))
                 for t in range(rng.randint(1, turns)) if rng.random() < 0.9]
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(*x, "z", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, idx int")
    return sorted((tuple(x) for x in r.repair(df, **more).verdicts().collect()), key=str)


@pytest.mark.parametrize("damage", [True, False])
def test_equals_brute_force(spark, damage):
    rows = made(1, 60, 9)
    assert run(spark, rows, damaged=damage) == brute(rows, damage)


@pytest.mark.parametrize(("most_rows", "most_chars"), [(1, 1 << 20), (2, 1 << 20), (3, 8), (40, 1 << 20)])
def test_chunks_change_nothing(spark, most_rows, most_chars):
    """Conversations of many chunks, also those whose vectors never meet: rows of one role, or deleted rows only."""
    rows = made(2, 5, 30) + [(100, t, "system", f"s {t}.") for t in range(24)] + [(101, t, "user", "same.") for t in range(20)]
    rows += [(102, t, "user", " ") for t in range(15)] + [(103, t, "tool", f"t {t}") for t in range(13)]
    assert run(spark, rows, most_rows=most_rows, most_chars=most_chars) == brute(rows, False)


def test_vectors_converge_to_constants():
    flags, copies = bytes([2, 3] * 30), [1] * 60
    true, supposed = (r.costs(flags, copies, v)[0] for v in (r.END, r.SUPPOSED))
    assert r.normal(true) == r.normal(supposed)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (None, 1, "user", "hi."), (None, 2, "assistant", "ho."), (2, None, "user", "q."), (2, None, "user", "q."), (2, 5, "assistant", "x" * 300_000 + "."),
            (3, 2, "user", ""), (4, 7, "system", "s."), *[(5, 1, "user", "again.")] * 30, (6, 1, "User", "u."), (6, 2, "", ".")]
    for damage in (True, False):
        assert run(spark, rows, damaged=damage) == brute(rows, damage)
    assert run(spark, []) == []


def test_turns_spell_the_digest(spark):
    rows = made(3, 8, 12)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = r.repair(df, most_rows=4)
    want = {x.conv_id: x.repaired_sha256 for x in done.verdicts().collect()}
    turns = sorted(map(tuple, done.turns().collect()))
    for conv, own in groupby(turns, lambda t: t[0]):
        text = "\n".join(f"{t[3]}:{t[4]}" for t in own)
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv]
