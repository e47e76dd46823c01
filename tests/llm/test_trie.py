"""The tree of conversations against a plain one, with buckets and blocks so small that all paths are taken."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())):
        out[c].append((role or "", text or ""))
    return out


def rebuilt(held):
    out = {}
    for c, turns in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = held.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(held):
    members = defaultdict(list)
    for c, turns in held.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for key, cs in members.items():
        subtree = [k for k in members if k[: len(key)] == key]
        children = lambda k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k]
        ends = sorted(c for c in cs if len(held[c]) == len(key))
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in subtree if k)
        out[min(cs), len(key)] = (min(members[key[:-1]]) if key else None, len(cs), len(children(key)), sum(not children(k) for k in subtree), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def nodes(df):
    out = {}
    for r in df.collect():
        assert (r["conv_id"], r["depth"]) not in out
        out[r["conv_id"], r["depth"]] = (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
    return out


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 5, 8])
        rows += [(c, t, rng.choice(["user", "assistant"]) if t > 1 else "user", rng.choice(["Hello.", "Grüße", "same", ""])) for t in range(n)]
    long = [("user", f"turn {t}é") for t in range(23)]
    for c in range(100, 112):  # a long beginning that many share, parting late
        rows += [(c, t, *x) for t, x in enumerate(long[: rng.choice([9, 17, 23])])] + [(c, 30, "assistant", rng.choice(["a", "b", "c"]))]
    rows += [(c, t, "user", "copy") for c in range(200, 215) for t in range(3)]
    rows += [(300, None, None, None), (300, 5, "user", "x"), (None, 1, "user", "lost"), (303, 0, "user", "y"), (303, 0, "user", "x"), (-7, 1, "user", "Hello.")]
    return rows


@pytest.mark.parametrize(("local", "block"), [(2048, 128), (4, 128), (1, 3), (40, 2)])
def test_trees(spark, monkeypatch, local, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = made(local)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", size int, c string").repartition(5)
    held = ordered(rows)
    turns = trie.encoded(df)
    assert nodes(trie.trie(turns.select("c").distinct(), turns, local)) == plain(held)


def test_rebuilt_conversations(spark):
    rows = made(0)
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes(trie.trie(*trie.rebuilt(trie.encoded(df)), 16)) == plain(rebuilt(ordered(rows)))
    assert trie.prefix_trie(df.limit(0)).count() == 0
    one = spark.createDataFrame([(5, 1, "user", "Hi")], SCHEMA)
    assert nodes(trie.prefix_trie(one)) == plain(ordered([(5, 1, "user", "Hi")]))
