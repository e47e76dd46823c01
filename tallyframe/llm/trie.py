"""The tree of shared beginnings of conversations.

Turns are numbered by a dictionary, and a conversation is the sequence of its turns' numbers, held in blocks, so that a
long one is many rows. Equal sequences become one. The rest is radix sorting from the first number on: all begin in one
bucket; a bucket skips what its sequences all share (the least and the greatest of them share it), emits the nodes along
the way, and is parted by the number that follows. Buckets with few turns left are finished locally, by quicksort on one
number at a time, whose recursion emits nodes; a bucket of one sequence is a chain of nodes and needs no sorting. So rounds
grow with the branchings that large buckets have, not with turns. Sums over subtrees go up along the names of buckets,
which say how they came about.

No text is moved: turns travel as digests and lengths. Null conversations are left out; null roles and texts count as
empty; null turns come first; turns that tie are ordered by role, then by the text's digest. No rows give no nodes.
Other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import written
from tallyframe.operators.scan import placed
from tallyframe.operators.sequence import numbered

#: Turns in a block of a sequence.
BLOCK = 128

#: Turns that the sequences of a bucket may have left for it to be finished locally.
LOCAL = 2048

#: Turns that rebuilt conversations take over from another, at most.
SHARED = 8

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
CHAIN, FEW, MANY = range(3)


def encoded(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, place, digest, size) of each turn: its place from 1, a digest of role and text, the bytes of its text."""
    said = lambda n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(""))
    turns = conversations.select(F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text")).filter("c IS NOT NULL")
    digest = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    text_digest = F.md5(F.col("text").cast("binary"))
    slim = turns.select("c", "turn", "role", text_digest.alias("by"), digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))
    return placed(slim, ["c"], ["turn", "role", "by"]).select("c", "place", "digest", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (c) and turns (c, place, digest, size) in which each conversation c begins with the first h turns of
    conversation c - c % 5 instead of its own first h; h is the checksum of c modulo 9."""
    turns = written(turns, "turns")
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % (SHARED + 1)
    heads = turns.filter(F.col("place") <= SHARED).select(F.col("c").alias("from"), "place", "digest", "size")
    convs = written(turns.select("c").distinct().select("c", (F.col("c") - F.col("c") % 5).alias("from"), h("c").alias("h")), "conversations")
    taken = convs.join(heads, "from").filter("place <= h").select("c", "place", "digest", "size")
    lengths = heads.groupBy("from").agg(F.max("place").alias("n"))
    short = convs.join(lengths, "from", "left").select("c", (F.col("h") - F.least("h", F.coalesce("n", F.lit(0)))).alias("less")).filter("less > 0")
    own = turns.filter(F.col("place") > h("c")).join(written(short, "short"), "c", "left")
    return convs.select("c"), taken.unionByName(own.select("c", (F.col("place") - F.coalesce("less", F.lit(0))).alias("place"), "digest", "size"))


def blocks_of(turns: DataFrame) -> DataFrame:
    """(c, block, ids, sizes): each sequence in blocks, turns numbered by the dictionary."""
    turns = written(turns, "turns")
    dictionary = written(numbered(turns.select("digest").distinct(), "digest").select(F.col("digest").alias("digest_"), F.col("number").alias("id")), "dictionary")
    coded = turns.join(dictionary, F.col("digest") == F.col("digest_"))
    block = F.floor((F.col("place") - 1) / BLOCK).cast("long").alias("block")
    ordered = F.sort_array(F.collect_list(F.struct("place", "id", "size")))
    return coded.groupBy("c", block).agg(ordered.alias("o")).select("c", "block", F.col("o.id").alias("ids"), F.col("o.size").alias("sizes"))


def joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, first, said), sorted -> (seq, sha256 of what was said, joined by commas)."""
    current, running = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for seq, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if seq != current:
                if current is not None:
                    done.append((current, running.hexdigest()))
                current, running = seq, hashlib.sha256(said.encode())
            else:
                running.update(b"," + said.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], type=pa.string()) for k in (0, 1)], names=["seq_", "ends"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([running.hexdigest()])], names=["seq_", "ends"])


def sequences(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(s, n, len, ends): distinct sequences: the least conversation of each, how many have it, its turns, and the digest of
    their ids in order, which is put together from runs of ids, so that a sequence of very many has few rows."""
    part = F.struct("block", F.md5(F.array_join("ids", ",").cast("binary")).alias("md5"))
    whole = blocks.groupBy("c").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["md5"]), "").cast("binary")).alias("seq"), F.sum(F.size("ids")).cast("long").alias("len"))
    named = written(convs.join(whole.withColumnRenamed("c", "c_"), F.col("c") == F.col("c_"), "left").select("c", F.coalesce("seq", F.lit("")).alias("seq"), F.coalesce("len", F.lit(0)).cast("long").alias("len")), "named")
    n = max(1, int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = named.select("seq", "c").repartitionByRange(n, "seq", "c").groupBy("seq", F.spark_partition_id().alias("run")).agg(F.sort_array(F.collect_list("c")).alias("cs"))
    said = runs.select("seq", F.col("cs")[0].alias("first"), F.array_join(F.transform("cs", lambda c: c.cast("string")), ",").alias("said"))
    ends = said.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(joined_digests, "seq_ string, ends string")
    found = named.groupBy("seq").agg(F.min("c").alias("s"), F.count("*").alias("n"), F.max("len").alias("len"))
    return found.join(ends, F.col("seq") == F.col("seq_")).select("s", "n", "len", "ends")


def grown(strings: list[tuple[int, int, list[int], list[int], str]], depth: int, parent: int | None) -> list[list]:
    """Nodes of sequences (s, n, ids from place depth + 1 on, sizes from place depth on, ends) that share `depth` turns, the
    one at that depth first: quicksort by one number at a time, without recursion of the interpreter."""
    nodes: list[list] = []
    todo: list[tuple[bool, list, int, int]] = [(True, strings, 0, -1)]
    while todo:
        is_node, group, k, above = todo.pop()
        if is_node:
            size = group[0][3][k] if depth else group[0][3][k - 1] if k else 0
            n, least = sum(g[1] for g in group), min(g[0] for g in group)
            ended = [g[4] for g in group if len(g[2]) == k]
            nodes.append([least, depth + k, nodes[above][0] if above >= 0 else parent, n, 0, 0, (n - 1) * size, ended[0] if ended else None, above])
            if above >= 0:
                nodes[above][4] += 1
            above, group = len(nodes) - 1, [g for g in group if len(g[2]) > k]
            if group:
                todo.append((False, group, k, above))
            continue
        pivot = group[len(group) // 2][2][k]
        less, more = [g for g in group if g[2][k] < pivot], [g for g in group if g[2][k] > pivot]
        todo += [(False, part, k, above) for part in (less, more) if part]
        todo.append((True, [g for g in group if g[2][k] == pivot], k + 1, above))
    for node in reversed(nodes):  # children come after their parents
        node[5] = node[5] or 1
        if node[8] >= 0:
            nodes[node[8]][5] += node[5]
            nodes[node[8]][6] += node[6]
    return nodes


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, depth, parent, s, n, ends, block, ids, sizes), sorted by bucket, s, block -> nodes of each bucket."""
    fields = [pa.string(), *[pa.int64()] * 7, pa.string()]
    names = ["bucket", *[f.split()[0] for f in NODE.split(", ")]]
    held: list = [None, 0, None, {}]
    out: list[list] = []

    def close() -> None:
        bucket, depth, parent, strings = held
        if bucket is not None:
            out.extend([bucket, *node[:8]] for node in grown([(s, n, ids, sizes, ends) for s, (n, ends, ids, sizes) in strings.items()], depth, parent))

    def flush() -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in out], type=t) for i, t in enumerate(fields)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        for bucket, depth, parent, s, n, ends, block, ids, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != held[0]:
                close()
                held = [bucket, depth, parent, {}]
            string = held[3].setdefault(s, (n, ends, [], []))
            begins = (block or 0) * BLOCK
            string[2].extend((ids or [])[max(0, depth - begins) :])
            string[3].extend((sizes or [])[max(0, (depth - 1 if depth else 0) - begins) :])
        yield flush()
    close()
    yield flush()


def trie(convs: DataFrame, turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """Nodes of conversations (c) with turns (c, place, digest, size): conv_id (the least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (bytes that the subtree's turns have more than once), ends_sha256."""
    every = written(blocks_of(turns), "blocks")
    strings = written(sequences(convs, every), "sequences")
    blocks = every.join(strings.select(F.col("s").alias("c")), "c", "left_semi")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    later = F.coalesce(F.sum(total).over(Window.partitionBy("c").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each BLOCK turns
    blocks = written(blocks.select(F.col("c").alias("c_"), "block", "ids", "sizes", later.alias("later")), "blocks")
    todo = strings.select("s", "n", "len", "ends", F.lit("").alias("bucket"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("parent"))
    of_string = F.col("s") == F.col("c_")
    nodes, tops, splits, buckets = [], [], [], []
    while True:
        left = F.sum(F.col("len") - F.col("depth"))
        kind = F.when(F.count("*") == 1, CHAIN).when(left <= local, FEW).otherwise(MANY)
        summed = written(todo.groupBy(F.col("bucket").alias("b")).agg(kind.alias("kind"), F.min("s").alias("least"), F.sum("n").alias("members")), "buckets")
        buckets.append(summed.select("b"))
        marked = written(todo.join(summed, F.col("bucket") == F.col("b")).drop("b"), "marked")

        # Chains: all turns from the bucket's depth on.
        from_here = marked.filter(F.col("kind") == CHAIN).join(blocks, of_string & (F.col("block") >= F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / BLOCK)), "left")
        rest = F.transform("sizes", lambda x, i: F.col("later") + F.aggregate(F.slice("sizes", i + 1, BLOCK), F.lit(0).cast("long"), lambda a, y: a + y))
        at = from_here.select("*", F.posexplode_outer(F.coalesce(rest, F.array().cast("array<long>"))).alias("i", "rest")).withColumn("d", F.col("block") * BLOCK + F.col("i") + 1)
        root = marked.filter((F.col("kind") == CHAIN) & (F.col("depth") == 0)).join(blocks.filter("block = 0"), of_string, "left").withColumn("d", F.lit(0).cast("long")).withColumn("rest", F.coalesce(F.col("later") + total, F.lit(0)))
        columns = ["bucket", "s", "parent", "n", "len", "ends", "depth", "d", "rest"]
        chain = at.filter("d >= depth AND d > 0").select(*columns).unionByName(root.select(*columns))
        chain = chain.select("bucket", F.col("s").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("depth"), F.col("parent")).otherwise(F.col("s")).alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"), F.when(F.col("d") == F.col("len"), F.col("ends")).alias("ends"), (F.col("d") == F.col("depth")).alias("top"))

        # Small buckets.
        few = marked.filter(F.col("kind") == FEW).join(blocks, of_string & (F.col("block") >= F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / BLOCK)), "left")
        few = few.select("bucket", "depth", "parent", "s", "n", "ends", "block", "ids", "sizes").repartition("bucket").sortWithinPartitions("bucket", "s", "block")
        small = few.mapInArrow(finish, f"bucket string, {NODE}")
        begun = summed.filter(F.col("kind") == FEW).select("b", "least")
        finished = written(chain.unionByName(small.withColumn("top", F.lit(False))), "nodes")
        nodes.append(finished)
        least_depth = todo.groupBy(F.col("bucket").alias("b")).agg(F.min("depth").alias("from"))
        tops.append(finished.filter("top").select("bucket", "n_leaves", "saved_tokens"))
        tops.append(finished.join(begun.join(least_depth, "b"), (F.col("bucket") == F.col("b")) & (F.col("depth") == F.col("from"))).select("bucket", "n_leaves", "saved_tokens"))

        # Large buckets: what all share, then a bucket for each number that follows.
        large = marked.filter(F.col("kind") == MANY)
        if large.isEmpty():
            break
        offset = (F.col("depth") % BLOCK + 1).cast("int")
        cut = lambda c: F.coalesce(F.slice(c, offset, BLOCK), F.array().cast("array<long>")).alias(c)
        heads = written(large.join(blocks, of_string & (F.col("block") == F.floor(F.col("depth") / BLOCK)), "left").select(*marked.columns, cut("ids"), cut("sizes")), "heads")
        ranged = heads.groupBy(F.col("bucket").alias("b")).agg(F.min(F.struct("ids", "sizes")).alias("lo"), F.max("ids").alias("hi"), *[F.first(c).alias(f"b_{c}") for c in ("depth", "size", "parent", "least", "members")])
        differs = F.array_position(F.zip_with("lo.ids", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False))
        shared = ranged.withColumn("k", F.when(differs > 0, differs - 1).otherwise(F.size("hi")).cast("int")).withColumn("full", differs == 0)
        # Where a block ends before the sequences part, the next one is another bucket, of all of them.
        stays = F.when(F.col("full"), F.col("k") - 1).otherwise(F.col("k"))
        path = F.concat(F.array("b_size"), F.slice("lo.sizes", F.lit(1), stays))
        shared = written(shared.select("b", "k", "full", *[f"b_{c}" for c in ("depth", "parent", "least", "members")], path.alias("path"), F.col("b_depth").alias("from")), "splits")
        parted = heads.join(shared.select("b", "k", "full", "b_least"), F.col("bucket") == F.col("b")).drop("b")
        ended = parted.filter(~F.col("full") & (F.col("len") == F.col("depth") + F.col("k"))).select(F.col("bucket").alias("e"), F.col("ends").alias("ended"))
        splits.append(shared.join(ended, F.col("b") == F.col("e"), "left").drop("e"))
        goes = parted.filter(F.col("full") | (F.col("len") > F.col("depth") + F.col("k")))
        digit = F.when(F.col("full"), F.lit("on")).otherwise(F.element_at("ids", F.when(F.col("full"), 1).otherwise(F.col("k") + 1)).cast("string"))
        step = F.when(F.col("full"), F.col("k")).otherwise(F.col("k") + 1)
        todo = written(goes.select("s", "n", "len", "ends", F.concat_ws(".", "bucket", digit).alias("bucket"), (F.col("depth") + step).alias("depth"), F.element_at("sizes", step).alias("size"), F.col("b_least").alias("parent")), "strings")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    plain = union(nodes).select(*[f.split()[0] for f in NODE.split(", ")])
    if splits:
        split = union(splits)
        own = split.select(F.col("b").alias("bucket"), F.lit(0).cast("long").alias("n_leaves"), ((F.col("b_members") - 1) * F.aggregate("path", F.lit(0).cast("long"), lambda a, x: a + x)).alias("saved_tokens"))
        steps = F.split("bucket", r"\.")
        above = F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ".")))
        below = union([*tops, own]).select(F.explode(above).alias("a"), "n_leaves", "saved_tokens").groupBy("a").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        children = union(buckets).select(F.regexp_replace("b", r"\.[^.]*$", "").alias("p"), "b").filter("b <> ''").groupBy("p").agg(F.count("*").alias("children"))
        whole = split.join(below, F.col("b") == F.col("a")).join(children, F.col("b") == F.col("p"))
        rest = F.transform("path", lambda x, i: F.aggregate(F.slice("path", i + 1, BLOCK + 1), F.lit(0).cast("long"), lambda a, y: a + y))
        spread = whole.select("*", F.posexplode(rest).alias("i", "rest"))
        last = F.col("i") == F.size("path") - 1
        plain = plain.unionByName(spread.select(F.col("b_least").alias("conv_id"), (F.col("b_depth") + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("b_parent")).otherwise(F.col("b_least")).alias("parent_conv_id"), F.col("b_members").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("b_members") - 1) * F.col("rest")).alias("saved_tokens"), F.when(last, F.col("ended")).alias("ends")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return plain.select(*[c for c in plain.columns if c != "ends"], F.coalesce("ends", nothing).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The tree of conversations as they are."""
    turns = written(encoded(conversations, conv, turn, role, text), "turns")
    return trie(turns.select("c").distinct(), turns)
