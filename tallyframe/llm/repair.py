"""Conversations whose turns don't alternate as they should: faults counted, the cheapest edits, the repaired turns.

A conversation's turns become a string of one letter a turn, for its role and its fault. Such a signature says all that
the edits depend on, so each distinct one is solved once, by recursion over (turn, state) that remembers its answers, and
the edits go back to the conversations that share it. Long conversations are cut into segments: what a segment costs from
each state to each other is solved by signature too, and these small tables are put together by conversation.

Texts are moved once, for the replay: the edits travel ahead of the turns of their conversation and are carried out as the
turns stream by, in memory of one batch.

Null conversations are one conversation; null roles and texts are read as one space, an empty role too; null turns come
first. Turns that tie are ordered by role, then by the text's digest. Tables without rows give none. Other columns, of
whatever name, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_batches, written
from tallyframe.operators.scan import placed

#: White space that doesn't count as text.
BLANKS = " \t\n\x0b\x0c\r"

#: Turns in a segment, that is in a signature.
SEGMENT = 512

#: What edits cost; leaving a truncated turn in costs TRUNCATED besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States between turns: nothing yet, after a system turn, after a user turn, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)

#: Which state follows a turn of the role that is due: a user's, or an assistant's after a user's.
DUE = (USER, USER, ASSISTANT, USER)
ENOUGH = 1 << 30

#: Letters of a signature: four for each role (system, user, assistant, other), by fault.
LETTERS = "abcdefghijklmnop"
SOUND, BLANK, DUPLICATE, CUT = range(4)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) damaged by a checksum of conv_id and turn: of 20 kinds, 0 drops the row, 1 empties
    its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls: one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def edits(letter: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a turn in a state: (letter of the edit, its cost, state after it)."""
    role, fault = divmod(letter, 4)
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        if (role == 0 and state == START) or (role == 1 and state != USER) or (role == 2 and state == USER):
            out.append(("K", more, role + 1))
        out.append(("R", REROLE + more, DUE[state]))
    return out


class Solved:
    """The cheapest edits of a signature, from any state. `after` has what lies behind each state at the end; None: the
    conversation ends, with an assistant's turn or without any."""

    def __init__(self, signature: str, after: list[int] | None):
        self.letters, self.after, self.known = [LETTERS.index(c) for c in signature], after, {}

    def end(self, state: int) -> tuple[int, str, int]:
        if self.after is not None:
            return self.after[state], "", state
        missing = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
        return INSERT * missing, "I" * missing, ASSISTANT if missing else state

    def best(self, i: int, state: int) -> tuple[int, str, int]:
        """(cost of all from turn i on, edits of turn i with insertions before it, state after it); of equal ones the least
        in ASCII. No two choices begin alike and differ later, so the least choice of each turn makes the least string."""
        if i == len(self.letters):
            return self.end(state)
        if (i, state) not in self.known:
            found, at = [], state
            for inserted in range(3):  # a third insertion would lead where the first did
                for name, cost, then in edits(self.letters[i], at):
                    found.append((INSERT * inserted + cost + self.best(i + 1, then)[0], "I" * inserted + name, then))
                at = DUE[at]
            self.known[i, state] = min(found)
        return self.known[i, state]

    def path(self, state: int) -> tuple[str, int]:
        """All edits from a state, and the state at the end."""
        out = []
        for i in range(len(self.letters) + 1):
            _, said, state = self.best(i, state)
            out.append(said)
        return "".join(out), state


def transfers(signature: str) -> list[int]:
    """What it costs to get from each state to each other through a signature, row by row."""
    columns = [Solved(signature, [0 if to == t else ENOUGH for to in range(4)]) for t in range(4)]
    return [min(columns[t].best(0, s)[0], ENOUGH) for s in range(4) for t in range(4)]


def illegal(letters: str) -> int:
    """Adjacent roles that are not system-user, user-assistant, assistant-user."""
    roles = [LETTERS.index(c) // 4 for c in letters]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(roles, roles[1:], strict=False))


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, after) -> costs, edits and last states by first state, and counts."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("signature", "after", "costs", "paths", "ends", "counts")}
        for signature, after in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = Solved(signature, after)
            paths = [found.path(s) for s in range(4)]
            faults = [LETTERS.index(c) % 4 for c in signature]
            row = (signature, after, [found.best(0, s)[0] for s in range(4)], [p for p, _ in paths], [e for _, e in paths], [*(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal(signature)])
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        ints = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(out[n], type=t) for n, t in zip(out, (pa.string(), ints, ints, pa.list_(pa.string()), ints, ints), strict=True)], names=list(out))


SOLVED = "signature string, after array<long>, costs array<long>, paths array<string>, ends array<long>, counts array<long>"


def letters_of(rows: DataFrame) -> DataFrame:
    """(c, place, letter) of (c, turn, role, digest, text's end): the letter of each turn, in order."""
    ordered = written(placed(rows, ["c"], ["turn", "role", "digest"]), "turns")
    # Few turns are repeated; only their first places are joined back.
    again = ordered.filter("fault <> 1").groupBy("c", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = written(again.select(F.col("c").alias("c_"), F.col("role").alias("role_"), F.col("digest").alias("digest_"), "first"), "repeated")
    same = F.col("c").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_")) & (F.col("fault") != BLANK)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("place") > F.col("first"), DUPLICATE).otherwise(F.col("fault"))
    return ordered.join(again, same, "left").select("c", "place", F.substring(F.lit(LETTERS), (role * 4 + fault + 1).cast("int"), F.lit(1)).alias("letter"))


def chained(segments: DataFrame) -> DataFrame:
    """(c, segment, signature, after, cost) of conversations of several segments: what lies behind each state at the end of
    each segment, from the tables of the segments after it; the cost of all stands with the first."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([transfers(s) for s in batch.column(0).to_pylist()], type=pa.list_(pa.int64()))], names=["s", "costs"])

    def back(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("segment", ascending=False)
        after, afters, cost = [0, 2 * INSERT, INSERT, 0], [], 0
        for n, costs in enumerate(group["costs"]):
            afters.append(None if n == 0 else [a - min(after) if a < ENOUGH else ENOUGH for a in after])
            cost += 0 if n == 0 else min(after)
            after = [min(min(costs[4 * s + t] + (after if n == 0 else afters[-1])[t] for t in range(4)), ENOUGH) for s in range(4)]
        return pd.DataFrame({"c": group["c"], "segment": group["segment"], "signature": group["signature"], "after": afters, "cost": [after[START] + cost] * len(group)})

    distinct = segments.select("signature").distinct().mapInArrow(tables, "s string, costs array<long>")
    with_costs = segments.join(distinct, F.col("signature") == F.col("s")).drop("s")
    return with_costs.groupBy("c").applyInPandas(back, f"c {segments.schema['c'].dataType.simpleString()}, segment long, signature string, after array<long>, cost long")


def chosen(segments: DataFrame, solved: DataFrame) -> DataFrame:
    """(c, segment, counts, path) of segments with `after`: which of the solved paths it is, going through the conversation."""

    def on(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("segment").reset_index(drop=True)
        state, paths, counts = START, [], []
        for n, row in enumerate(group.itertuples()):
            paths.append(row.paths[state])
            state = int(row.ends[state])
            across = illegal(group["signature"][n - 1][-1] + row.signature[0]) if n else 0
            counts.append([*list(row.counts)[:3], int(row.counts[3]) + across])
        return pd.DataFrame({"c": group["c"], "segment": group["segment"], "counts": counts, "path": paths, "cost": group["cost"]})

    joined = segments.join(solved.withColumnsRenamed({"signature": "s", "after": "a"}), (F.col("signature") == F.col("s")) & F.col("after").eqNullSafe(F.col("a"))).drop("s", "a", "costs")
    return joined.groupBy("c").applyInPandas(on, f"c {segments.schema['c'].dataType.simpleString()}, segment long, counts array<long>, path string, cost long")


def named(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, role, digest, text), roles and texts without nulls."""
    said = lambda n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(" "))
    plain = rows.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("turn"), F.when(said(role) == "", " ").otherwise(said(role)).alias("role"), said(text).alias("text"))
    return plain.select("c", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")


def audited(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(c, segment, counts, path, cost): the edits of each segment of each conversation, one letter an edit."""
    plain = named(rows, conv, turn, role, text)
    kept = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(kept == "", BLANK).when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    letters = letters_of(plain.select("c", "turn", "role", "digest", fault.alias("fault")))
    no = F.floor((F.col("place") - 1) / segment).alias("segment")
    gathered = letters.groupBy("c", no).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "letter"))), lambda s: s["letter"]), "").alias("signature"))
    segments = written(gathered, "segments")
    several = written(segments.filter("segment > 0").select(F.col("c").alias("c_")).distinct(), "several")
    is_one_of = F.col("c").eqNullSafe(F.col("c_"))
    after, parts = F.lit(None).cast("array<long>"), []
    whole = segments.join(several, is_one_of, "left_anti")
    solved = written(whole.groupBy("signature").agg(after.alias("after")).mapInArrow(solve, SOLVED), "solved")
    parts.append(whole.join(solved.withColumnRenamed("signature", "s"), F.col("signature") == F.col("s")).select("c", "segment", "counts", F.col("paths")[START].alias("path"), F.col("costs")[START].alias("cost")))
    if not several.isEmpty():
        linked = written(chained(segments.join(several, is_one_of, "left_semi")), "chained")
        parts.append(chosen(linked, linked.groupBy("signature", "after").agg(F.lit(1)).select("signature", "after").mapInArrow(solve, SOLVED)))
    return written(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "audits")


def stream(rows: DataFrame, audits: DataFrame, *names: str) -> DataFrame:
    """The edits of each conversation, then its turns in order, in one partition."""
    bounded_batches(rows.sparkSession)
    plain = named(rows, *names)
    turns = plain.select("c", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("segment"), "turn", "role", "digest", "text")
    ahead = audits.select("c", F.lit(0).alias("kind"), "segment", F.lit(None).cast(plain.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("path").alias("text"))
    return ahead.unionByName(turns).repartition("c").sortWithinPartitions("c", "kind", "segment", "turn", "role", "digest").select("c", "kind", "role", "text")


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, kind, role, text) of `stream` -> (c, place, role, text), repaired."""
    nothing = object()
    current, plan, at, state, place = nothing, [], 0, START, 0
    c, places, roles, texts = [], [], [], []

    def put(role: str, text: str) -> None:
        nonlocal place
        place += 1
        c.append(current), places.append(place), roles.append(role), texts.append(text)

    def due() -> str:
        nonlocal state
        state = DUE[state]
        return "user" if state == USER else "assistant"

    def insertions() -> None:
        nonlocal at
        while at < len(plan) and plan[at] == "I":
            put(due(), "")
            at += 1

    kind_of = None
    for batch in batches:
        kind_of = batch.schema.field(0).type
        for conv, kind, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if current is nothing or conv != current:
                if current is not nothing:
                    insertions()
                current, plan, at, state, place = conv, "", 0, START, 0
            if kind == 0:
                plan += text
                continue
            insertions()
            edit = plan[at]
            at += 1
            if edit == "K":
                state = {"s": SYSTEM, "u": USER}.get(role[0], ASSISTANT)
                put(role, text)
            elif edit == "R":
                put(due(), text)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=kind_of), pa.array(places, type=pa.int64()), pa.array(roles, type=pa.string()), pa.array(texts, type=pa.string())], names=["c", "place", "role", "text"])
        c, places, roles, texts = [], [], [], []
    if current is not nothing:
        insertions()
        yield pa.RecordBatch.from_arrays([pa.array(c, type=kind_of), pa.array(places, type=pa.int64()), pa.array(roles, type=pa.string()), pa.array(texts, type=pa.string())], names=["c", "place", "role", "text"])


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `replay` -> (c, sha256 of `role:text` lines). A digest is taken in order, by one task for a conversation."""
    nothing = object()
    current, running, kind_of = nothing, None, None
    for batch in batches:
        kind_of, done = batch.schema.field(0).type, []
        for conv, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if current is nothing or conv != current:
                if current is not nothing:
                    done.append((current, running.hexdigest()))
                current, running = conv, hashlib.sha256()
            running.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=kind_of), pa.array([d[1] for d in done], type=pa.string())], names=["c", "sha"])
    if current is not nothing:
        yield pa.RecordBatch.from_arrays([pa.array([current], type=kind_of), pa.array([running.hexdigest()], type=pa.string())], names=["c", "sha"])


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(conversation, place, role, text): the turns after the cheapest edits, under the given names and `place`."""
    found = audited(rows, conv, turn, role, text, segment)
    kind = rows.schema[conv].dataType.simpleString()
    out = stream(rows, found, conv, turn, role, text).mapInArrow(replay, f"c {kind}, place long, role string, text string")
    return out.select(F.col("c").alias(conv), "place", F.col("role").alias(role), F.col("text").alias(text))


def report(rows: DataFrame, conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conv_id of `conversations`: what is wrong with its `rows` (conv_id, turn, role, text), the cost and
    the letters of the cheapest edits, and a digest of the repaired turns. Without rows: zeros, no edits, nothing's digest."""
    found = audited(rows, segment=segment)
    count = lambda i: F.sum(F.col("counts")[i])
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "path"))), lambda s: s["path"]), "")
    whole = found.groupBy("c").agg(*[count(i).alias(n) for i, n in enumerate(("blank", "duplicate", "truncated", "illegal"))], F.max("cost").alias("cost"), path.alias("audit"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    shas = stream(rows, found, "conv_id", "turn", "role", "text").mapInArrow(lambda batches: digest(replay(batches)), f"c {kind}, sha string")
    turns = rows.groupBy(F.col("conv_id").alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    out = conversations.select("conv_id").distinct()
    for table in (turns, whole, shas):
        out = out.join(table, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero: dict[str, Column] = {n: F.coalesce(F.col(n), F.lit(0)).cast("long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select("conv_id", *[v.alias(n) for n, v in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
