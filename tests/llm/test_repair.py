"""Repairs against all ways to edit, on made conversations with every fault."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        left = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all edits with up to two insertions in each place."""
    marks, best = faults(rows), None
    choices = [("D",) if m in ("blank", "duplicate") else ("D", "K", "Ru", "Ra") for m in marks]
    gaps = ["", "u", "ua", "a", "au"]
    for edits in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, extra in enumerate(inserted):
                for e in extra:
                    cost, audit, out = cost + 5, audit + "I", [*out, ({"u": "user", "a": "assistant"}[e], "")]
                if i < len(rows):
                    e, (_, _, role, text) = edits[i], rows[i]
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if marks[i] == "truncated" and e != "D" else 0)
                    audit += e[0]
                    if e != "D":
                        out.append(({"K": role, "Ru": "user", "Ra": "assistant"}[e], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def made(rng, n):
    texts = ["Hello.", "What now?", "Yes!", "no end", "", " \t", "Fine. ", "è…", "a ", "Hello."]
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u"]), rng.choice(texts)) for _ in range(n)]


def sha(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def test_signatures_are_solved_like_by_trying_all_edits():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(0, i, *x) for i, x in enumerate(made(rng, rng.randrange(0, 3)))]
        letters = "".join(repair.LETTERS[{"s": 0, "u": 1, "a": 2}.get(r[2][0], 3) * 4 + ["", "blank", "duplicate", "truncated"].index(f)] for r, f in zip(rows, faults(rows), strict=True))
        solved = repair.Solved(letters, None)
        assert (solved.best(0, 0)[0], solved.path(0)[0]) == cheapest(rows)[:2]


def expected(rows, cost_of):
    """By conversation, from a recursion over states written for the test."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = damaged(sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0)))
        marks = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][0] for r in mine]
        cost, audit, kept = cost_of(mine, marks)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, sha(kept))
    return out


def forward(mine, marks):
    """Cheapest edits by going forward with the best string for each state."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}

    def widen(states):
        for _ in range(3):
            for s, (cost, audit, out) in list(states.items()):
                new = (cost + 5, audit + "I", (*out, (name[follow[s]], "")))
                if follow[s] not in states or new[:2] < states[follow[s]][:2]:
                    states[follow[s]] = new
        return states

    for (_, _, role, text), mark in zip(mine, marks, strict=True):
        after: dict = {}
        for s, (cost, audit, out) in widen(states).items():
            options = [(s, cost + 2, "D", ())]
            if mark not in ("blank", "duplicate"):
                more = 5 * (mark == "truncated")
                options.append((follow[s], cost + 1 + more, "R", ((name[follow[s]], text),)))
                if role[0] == follow[s] or (role[0] == "s" and s == ""):
                    options.append((role[0], cost + more, "K", ((role, text),)))
            for to, c, e, more_out in options:
                if to not in after or (c, audit + e) < after[to][:2]:
                    after[to] = (c, audit + e, (*out, *more_out))
        states = after
    states = widen(states)
    return min((states[s] for s in ("", "a") if s in states), key=lambda x: x[:2])


@pytest.mark.parametrize("segment", [512, 3, 1])
def test_report(spark, segment):
    rng = random.Random(segment)
    rows = [(c, t, *x) for c in range(60) for t, x in enumerate(made(rng, rng.randrange(1, 12)))]
    rows += [(100, t, *x) for t, x in enumerate(made(rng, 200))]  # a long one
    rows += [(101, t, "user", "The same.") for t in range(150)]
    rows += [(102, None, "user", None), (103, 5, None, "What."), (103, 90, "user", "Who?"), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (104, 0, "user", ""), (105, 7, "assistant", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", c string, kind int").repartition(6)
    got = {r["conv_id"]: r for r in repair.report(repair.damage(df), df, segment).collect()}
    want = expected(rows, forward)
    assert set(got) == set(want)
    for c, w in want.items():
        assert tuple(got[c])[1:] == w, c


def test_damage_and_no_rows(spark):
    rows = [(c, t, "assistant", f"Is it {c}? It is.") for c in range(40) for t in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, repair.damage(df).collect())) == sorted(damaged(rows))
    none = df.limit(0)
    assert repair.report(repair.damage(none), none).count() == 0 and repair.repaired(none).count() == 0
    lost = repair.report(repair.damage(df).filter("conv_id <> 3"), df).filter("conv_id = 3").first()
    assert tuple(lost) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_alternate(spark):
    rng = random.Random(8)
    rows = [(c, t, *x) for c in range(30) for t, x in enumerate(made(rng, rng.randrange(1, 9)))]
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"conv_id": "c", "text": "kind"})
    out = repair.repaired(df, "c", "turn", "role", "kind", 4)
    assert out.columns == ["c", "place", "role", "kind"]
    for r in out.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "role"))), lambda s: F.substring(s["role"], 1, 1)), "").alias("said")).collect():
        assert re.fullmatch("s?(ua)+", r["said"])
