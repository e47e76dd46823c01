"""SimHash near-duplicates: fingerprints of word shingles, linked by segments with one bit left out.

Cut into as many segments as bits may differ, or fewer, a fingerprint has one that differs by at most one bit, and agrees once
that bit is left out. So every fingerprint is indexed by segments with each bit left out in turn, an equality join on those
variants finds all candidates, and the whole fingerprints are compared. A variant of one segment alone (31 bits) would be
shared by ever more fingerprints as they grow in number; so a segment more is cut than may differ, and each variant is
joined to the segments that, for some choice, don't differ at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import common, components

#: Members of a run up to which they are compared each with each; their names are then passed on in a matrix.
EACH = 2_048


def fingerprints(texts: list[bytes], words: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is 1 if it is set in over half the shingles' XXH64 (seed 42).

    A-Z are lower-cased. Shingles of `words` words count as often as they occur; a text with fewer words is one
    shingle; a text without words has fingerprint zero.
    """
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        w = text.lower().split()
        if not w:
            continue
        runs = list(zip(*(w[k:] for k in range(words)))) if len(w) >= words else [w]
        ones = np.zeros(64, dtype=np.int64)
        for a in range(0, len(runs), 1 << 16):
            h = np.fromiter((digest(b" ".join(r), 42) for r in runs[a : a + (1 << 16)]), dtype=np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(runs), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, keep: list[str] | None = None, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each whole text as a signed 64-bit number; null texts count as empty ones."""

    def make():
        return lambda texts: {name: fingerprints(texts, words).view(np.int64)}

    return common.map_texts(docs, text_col, make, [T.StructField(name, T.LongType())], keep)


#: Segments that a fingerprint is cut into, by the number of bits that may differ. In one segment more than bits the
#: keys of a single segment would be short where there are very many fingerprints; three bits need five to come near 40.
CUTS = {0: 1, 1: 2, 2: 3, 3: 5}


def segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    n = CUTS[bits]
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def signatures(bits: int) -> list[tuple[int, int]]:
    """(bits that are kept, bit left out or -1) of each key: together they find every pair within `bits` bits.

    For each choice of `bits` segments that may differ, all others are equal, and of those chosen one is indexed with
    each of its bits left out in turn. The one is so chosen that, wherever bits differ, some key has them all outside of what it
    keeps: two bits in one segment are found where another is indexed.
    """
    cut, every = segments(bits), (1 << 64) - 1
    mask = [((1 << width) - 1) << low for low, width in cut]
    if not bits:
        return [(every, -1)]
    out = []
    for chosen in combinations(range(len(cut)), bits):
        one = chosen[sum(chosen) % bits]
        kept = every
        for s in chosen:
            kept &= ~mask[s]
        low, width = cut[one]
        out += [(kept | (mask[one] & ~(1 << (low + j))), low + j) for j in range(width)]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def nearest(values: np.ndarray, bits: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted fingerprints that differ in `free` bits only -> (a, b): verified links that span the components of
    all pairs within `bits` bits, one for each fingerprint that isn't the least of its component.

    Each takes the least name that it meets among its neighbours until none changes. Up to `EACH` of them find their
    neighbours by comparing all; more look each choice of up to `bits` of the free bits up, turned, so the work
    grows with their number.
    """
    n = len(values)
    name, link = np.arange(n), np.arange(n)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits if n <= EACH else None
    turned = [] if n <= EACH else [np.uint64(sum(1 << int(f) for f in some)) for k in range(1, bits + 1) for some in combinations(free.tolist(), k)]
    moved = True
    while moved:
        moved = False
        for t in [None] if n <= EACH else turned:
            if t is None:
                at = np.where(near, name[None, :], n).argmin(axis=1)
                better = name[at] < name
            else:
                at = np.minimum(np.searchsorted(values, values ^ t), n - 1)
                better = (values[at] == values ^ t) & (name[at] < name)
            link[better], name[better], moved = at[better], name[at[better]], moved or bool(better.any())
    own = np.flatnonzero(link != np.arange(n))
    return values[own], values[link[own]]


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Distinct `fp` -> (a, b): links whose components are those of all pairs that differ in at most `bits` bits.

    Each fingerprint is indexed by its keys (see `signatures`): 64 of some 42 bits for two bits, 128 of some 37 for
    three. Who shares a key meets in one run of a sorted partition and is verified. A run can't be long: its members differ only in
    the bits that the key leaves out, and members of long runs look each other up instead of being paired.
    """
    if bits not in CUTS:
        raise ValueError("0 to 3 differing bits")
    keys = signatures(bits)
    common.bounded_batches(prints.sparkSession)
    shown = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(kept)))) for k, (kept, _) in enumerate(keys)]
    rows = prints.select("fp", F.explode(F.array(*shown)).alias("key")).repartition("key").sortWithinPartitions("key", "fp")
    masks = np.array([k for k, _ in keys], dtype=np.uint64)

    def joined(fp: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links among sorted rows of whole runs; the key is a hash, so what is met is verified as a whole."""
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([edge, [len(key)]]))
        two = edge[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
        a, b = [fp[near]], [fp[near + 1]]
        for s, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = np.unique(fp[s : s + n])
            varied = np.bitwise_or.reduce(own ^ own[0])
            # Two keys whose hashes meet are one run: each fingerprint's own key tells them apart if the run is long.
            free = np.flatnonzero(np.unpackbits(np.array([varied]).view(np.uint8), bitorder="little"))
            x, y = nearest(own, bits, free)
            a.append(x)
            b.append(y)
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, key = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, key = np.concatenate([fp, batch.column(0).to_numpy().view(np.uint64)]), np.concatenate([key, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if whole:
                yield as_links(*joined(fp[:whole], key[:whole]))
                fp, key = fp[whole:], key[whole:]
        if len(fp):
            yield as_links(*joined(fp, key))

    return rows.mapInArrow(run, "a long, b long")


def as_links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def classes(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(fp, id) -> (fp, id of the smallest of its component): one row for each distinct fingerprint.

    Fingerprints go into the components behind the least id of each, so a component's root brings the smallest id with it, and
    nothing is gathered by component, which may hold a third of all fingerprints.
    """
    per = common.written(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    named = per.select("fp", F.struct(F.col("least").isNull().alias("none"), "least", "fp").alias("node"))
    near = links(per.select("fp"), bits)
    nodes = near.join(named.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    found = components.components(nodes.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node.fp").alias("fp"), "root")
    rooted = per.join(found, "fp", "left")
    return rooted.select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("root.least")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of each row: fingerprint as 16 hex digits, the smallest id of its component.

    Exact copies meet in one fingerprint before anything is linked. Null and empty texts have fingerprint zero and are
    linked like any other; rows with the same id are listed each; a null id is never the smallest unless its component
    has no other. No rows give no rows; other columns play no part.
    """
    prints = with_fingerprint(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), words=words, keep=["id"], name="fp")
    prints = common.written(prints, "fingerprints")
    # The class of a very common fingerprint goes to many rows. The classes are written, so Spark knows their size: a table
    # under its bound for broadcasts goes to the rows, and else it splits such partitions of the join.
    out = prints.join(common.written(classes(prints, bits), "component"), "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """One document of each component, the one with the smallest id (of rows with the same id, the same text or not,
    one), with its own columns only. Rows without an id are kept only where their component has no id at all."""
    safe, at = common.by_place(docs)
    marked = with_fingerprint(safe, at[text_col], words, name="fp")
    marked = common.written(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    id_ = F.col(at[id_col])
    prints = marked.select("fp", F.struct(id_.isNull().alias("none"), id_.alias("id"), "row").alias("id"))
    # The survivor's row number goes with its component; whole texts are not shuffled.
    kept = classes(prints, bits).select(F.col("component_id.row").alias("row")).distinct()
    return marked.join(kept, "row", "left_semi").select(*[F.col(n).alias(c) for c, n in at.items()])
