"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a node number of its own (1, then twice the node plus the bit); each node
has a context tree over the bytes before. A tree's context has two counts and the Krichevsky-Trofimov estimate
of them. Weighting mixes, at every context, the estimate with the product of the contexts one byte longer, half and
half, which comes to a mixture over all depths: with the mixture's logarithms summed from the longest contexts up,
the share that a context's own estimate has in the prediction follows, and predictions are put together from the
empty context down.

Trees are built by grouping and joining level by level, as tables of (context, node). Texts are scored in blocks of a
bounded size: a block asks once for each run of bytes (and each word) that it has, the answers come by a join, and
meet the block's texts again. So neither the model nor the vocabulary is ever in one place.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import common

#: Bytes of context, and bytes of text in a block.
DEPTH, BLOCK_BYTES = 5, 24 << 20

#: Bytes of text that a step turns into runs of bytes at a time.
STEP = 1 << 19

#: What a block gets: the words and grams that it asked for, and to each its count or logarithm, all in one order.
ANSWERS = ("words", "word_c", "grams", "logp")

#: Fixed value: marks both the bytes before a text and its end; no UTF-8 has this byte.
EDGE = 0xFF


#: The modulus (a prime) and factor of a step that stirs grams before they are dealt.
PRIME, FACTOR = (1 << 31) - 1, 48_271


def bucket_of(gram, buckets: int, pmod=lambda x, n: x % n):
    """The bucket of a gram, as a number or a column: all of its bytes count, as its last letter alone would fill few."""
    x = gram
    for _ in range(2):
        x = pmod(pmod(x, PRIME) * FACTOR, PRIME)
    return pmod(x, buckets)


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x of 0.5 or more: Stirling's series after eight steps up."""
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def estimate(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov estimate of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def nodes(grams: DataFrame) -> DataFrame:
    """(gram, c) -> (gram, c, key, bit) for each of its eight decisions; key is the context and the node's number."""
    byte, context = F.col("gram").bitwiseAND(F.lit(255)), F.shiftright("gram", 8)
    steps = [F.struct((F.shiftleft(context, 8) + (1 << k) + F.shiftright(byte, 8 - k)).alias("key"), F.shiftright(byte, 7 - k).bitwiseAND(F.lit(1)).alias("bit")) for k in range(8)]
    return grams.select("gram", "c", F.explode(F.array(*steps)).alias("s")).select("gram", "c", "s.key", "s.bit")


def shorter(key: Column, depth: int) -> Column:
    """The key of the same node in the context one byte shorter."""
    return key.bitwiseAND(F.lit((1 << (8 * depth)) - 1))


def model(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, c) -> (gram, logp): log10 of the probability of a gram's last byte after its first `depth` ones.

    c counts training texts only; grams of texts that are to be scored have rows too, with c = 0 if need be.
    """
    n0, n1 = F.sum(F.when(F.col("bit") == 0, F.col("c")).otherwise(0)), F.sum(F.when(F.col("bit") == 1, F.col("c")).otherwise(0))
    level = nodes(grams).groupBy("key").agg(n0.cast("double").alias("n0"), n1.cast("double").alias("n1"))
    level = level.withColumn("weighted", estimate(F.col("n0"), F.col("n1"))).withColumn("own", F.lit(1.0))
    levels = [common.written(level, f"level{depth}")]
    for d in range(depth, 0, -1):
        up = levels[0].groupBy(shorter(F.col("key"), d).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        up = up.withColumn("estimate", estimate(F.col("n0"), F.col("n1")))
        high, gap = F.greatest("estimate", "below"), F.abs(F.col("estimate") - F.col("below"))
        up = up.select("key", "n0", "n1", (high + F.log1p(F.exp(-gap)) - math.log(2)).alias("weighted"), (1 / (1 + F.exp(F.least(F.lit(700.0), F.col("below") - F.col("estimate"))))).alias("own"))
        levels.insert(0, common.written(up, f"level{d - 1}"))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    down = levels[0].select("key", (F.col("own") * one).alias("one"), (1 - F.col("own")).alias("rest"))
    for d in range(1, depth + 1):
        above = down.select(F.col("key").alias("up"), F.col("one").alias("one_up"), F.col("rest").alias("rest_up"))
        own = levels[d].withColumn("up", shorter(F.col("key"), d)).join(above, "up")
        down = own.select("key", (F.col("one_up") + F.col("rest_up") * F.col("own") * one).alias("one"), (F.col("rest_up") * (1 - F.col("own"))).alias("rest"))
    # A context has 255 nodes at most: they travel as one map to its grams.
    maps = down.groupBy(F.shiftright("key", 8).alias("context")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(255)).cast("int"), "one"))).alias("ones"))
    byte, logp = F.col("gram").bitwiseAND(F.lit(255)).cast("int"), F.lit(0.0)
    for k in range(8):
        p = F.element_at("ones", F.lit(1 << k) + F.shiftright(byte, 8 - k))
        logp = logp + F.log10(F.when(F.shiftright(byte, 7 - k).bitwiseAND(F.lit(1)) == 1, p).otherwise(1 - p))
    return grams.withColumn("context", F.shiftright("gram", 8)).join(maps, "context").select("gram", logp.alias("logp"))


def gram_codes(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The runs of depth + 1 bytes that end in each byte of each text and in its end, as numbers; text numbers."""
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join(edge * depth + t + edge for t in texts), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    code = np.zeros(max(0, len(data) - depth), dtype=np.int64)
    for k in range(depth + 1):
        code = (code << 8) | data[k : k + len(code)]
    starts = np.concatenate([[0], np.cumsum(lengths + depth)])[:-1]
    doc = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(doc)) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
    return code[at], doc


class Lookup:
    """Numbers to values by open addressing, for many numbers at once; the numbers are distinct."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        size = 1 << self.bits
        self.key, self.value = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.float64)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.key[at] == -1
            self.key[at[free]] = keys[left[free]]  # of several the last stays
            won = self.key[at] == keys[left]
            self.value[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        left = np.flatnonzero(self.key[at] != keys)
        while len(left):
            at[left] = (at[left] + 1) & (len(self.key) - 1)
            left = left[self.key[at[left]] != keys[left]]
        return self.value[at]


class Asked:
    """What a block asks for: its distinct words and grams, each with its count in training texts."""

    def __init__(self, depth: int):
        self.depth, self.train, self.rest, self.grams, self.counts, self.held = depth, Counter(), Counter(), [], [], 0

    def add(self, texts: list[bytes], train: np.ndarray) -> None:
        for t, own in zip(texts, train.tolist(), strict=True):
            (self.train if own else self.rest).update(t.split())
        code, doc = gram_codes(texts, self.depth)
        own = train[doc]
        for codes, weight in ((code[own], 1), (code[~own], 0)):
            key, n = np.unique(codes, return_counts=True)
            self.grams.append(key)
            self.counts.append(n * weight)
            self.held += len(key)
        if self.held > 1 << 20:
            self.merge()

    def merge(self) -> None:
        key, n = summed(self.grams, self.counts)
        # What is left after a merge counts from nothing, so that merging stays rare however many distinct grams there are.
        self.grams, self.counts, self.held = [key], [n], 0

    def batches(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """A row for each bucket that gets something: its words and grams as one value each, and their counts in the
        same order. So a block has no more rows than words and grams, however many buckets there are."""
        self.merge()
        self.rest.update(dict.fromkeys(self.train, 0))
        words = list(self.rest)
        of_word, of_gram = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets, bucket_of(self.grams[0], buckets)
        by_word, by_gram = np.argsort(of_word, kind="stable"), np.argsort(of_gram, kind="stable")
        grams, counts = self.grams[0][by_gram], self.counts[0][by_gram]
        some = np.union1d(of_word, of_gram)
        w0, w1 = (np.searchsorted(of_word[by_word], some, side=x).tolist() for x in ("left", "right"))
        g0, g1 = (np.searchsorted(of_gram[by_gram], some, side=x).tolist() for x in ("left", "right"))
        each = max(1, len(some) * 50_000 // max(1, len(words) + len(grams)))
        for i in range(0, len(some), each):
            own = [[words[j] for j in by_word[w0[k] : w1[k]].tolist()] for k in range(i, min(i + each, len(some)))]
            here = [slice(g0[k], g1[k]) for k in range(i, min(i + each, len(some)))]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block] * len(own), pa.int64()), "bucket": pa.array(some[i : i + each]), "words": pa.array([b"\n".join(w) for w in own], pa.binary()),
                    "word_c": pa.array([np.fromiter(map(self.train.__getitem__, w), dtype=np.int64, count=len(w)).tobytes() for w in own], pa.binary()),
                    "grams": pa.array([grams[g].tobytes() for g in here], pa.binary()), "gram_c": pa.array([counts[g].tobytes() for g in here], pa.binary()),
                }
            )


ASKED = "block long, bucket long, words binary, word_c binary, grams binary, gram_c binary"


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key, back = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
    return key, np.bincount(back, weights=np.concatenate([*counts, np.zeros(0)]), minlength=len(key)).astype(np.int64)


def numbers(value: bytes | None, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(value or b"", dtype=kind)


def split(words: bytes) -> list[bytes]:
    return words.split(b"\n") if words else []


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of asked things, sorted by bucket -> for each bucket its grams with their counts in all blocks, the sum and
    number of its words' counts, and to each block the counts of the words that it asked for."""
    names = ["block", "bucket", "word_c", "gram", "c", "n", "v"]
    bucket, rows = None, []

    def told() -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for r in rows:
            for w, c in zip(split(r["words"]), numbers(r["word_c"]).tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        for r in rows:
            c = np.fromiter(map(total.__getitem__, split(r["words"])), dtype=np.int64)
            yield batch_of(names, 1, block=[r["block"]], bucket=[bucket], word_c=[c.tobytes()])
        yield batch_of(names, 1, n=[sum(total.values())], v=[sum(c > 0 for c in total.values())])
        key, n = summed([numbers(r["grams"]) for r in rows], [numbers(r["gram_c"]) for r in rows])
        for i in range(0, len(key), 100_000):
            yield batch_of(names, len(key[i : i + 100_000]), gram=key[i : i + 100_000], c=n[i : i + 100_000])

    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["bucket"] != bucket:
                yield from told()
                rows = []
            bucket = row["bucket"]
            rows.append(row)
    if rows:
        yield from told()


def batch_of(names: list[str], rows: int, /, **values: object) -> pa.RecordBatch:
    kinds = {"word_c": pa.binary(), "logp": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(values[c], kinds.get(c, pa.int64())) if c in values else pa.nulls(rows, kinds.get(c, pa.int64())) for c in names], names=names)


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by bucket, first grams with their logarithms, then what blocks asked for -> the logarithms to each block,
    in the order in which it asked."""
    bucket, key, value, sorted_ = None, [], [], False
    for batch in batches:
        for (at, kind), part in common.alike(batch, "bucket", "kind"):
            if at != bucket:
                bucket, key, value, sorted_ = at, [], [], False
            if kind == 0:
                key.append(part.column("gram").to_numpy())
                value.append(part.column("logp").to_numpy())
                continue
            if len(key) > 1:
                whole, said = np.concatenate(key), np.concatenate(value)
                order = np.argsort(whole)
                key, value, sorted_ = [whole[order]], [said[order]], True
            elif key and not sorted_:
                order = np.argsort(key[0])
                key, value, sorted_ = [key[0][order]], [value[0][order]], True
            for row in part.select(["block", "grams"]).to_pylist():
                own = value[0][np.searchsorted(key[0], numbers(row["grams"]))] if row["grams"] else np.zeros(0)
                yield batch_of(["block", "bucket", "logp"], 1, block=[row["block"]], bucket=[at], logp=[own.tobytes()])


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, train, n_bytes, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text.

    score: log10 of the probability that the model gives the text's bytes (A-Z lower-cased) and its end; code length
    in bits a byte is -score / (n_bytes * log10(2)). base_score: the sum over tokens (words, then an end) of
    log10((c + 0.5) / (N + 0.5 * (V + 1))), c the token's count in training texts, N all their tokens, V the
    distinct ones. `train` is a condition on the row that must not be null. Null and empty texts are an end only;
    repeated rows are scored each and count each in training; without training rows every bit is even. No rows give no
    rows; other columns play no part.
    """
    if not 1 <= depth <= 6:
        raise ValueError("1 to 6 bytes of context")
    spark = docs.sparkSession
    common.bounded_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), train.alias("train"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    # Blocks follow from the row itself, so a lost task puts the same rows into the same block again. The text counts
    # too: rows of one id are not one block; rows that are alike in both are, and ask no more than one of them does.
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("long")
    dealt = rows.withColumn("block", block)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, Asked(depth)
        for batch in batches:
            for (at,), part in common.alike(batch, "block"):
                if block is not None and at != block:
                    yield from held.batches(block, blocks)
                    held = Asked(depth)
                block, train_, texts = at, part.column("train").to_numpy(zero_copy_only=False).astype(bool), common.as_bytes(part.column("text"))
                for a, b in common.pieces(texts, STEP):
                    held.add([t.lower() for t in texts[a:b]], train_[a:b])
        if block is not None:
            yield from held.batches(block, blocks)

    # All rows of a block are in one partition, one after the other, so a task holds one block's lists at a time. What is
    # asked is dealt into as many buckets as there are blocks; a bucket is about as large as a block's lists.
    sorted_ = dealt.select("block", "train", "text").repartition("block").sortWithinPartitions("block")
    wanted = common.written(sorted_.mapInArrow(ask, ASKED), "asked")
    totals = common.written(wanted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, "block long, bucket long, word_c binary, gram long, c long, n long, v long"), "totals")
    seen = totals.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    ends = rows.filter("train").count()
    n, v = (seen["n"] or 0) + ends, (seen["v"] or 0) + (ends > 0)
    logs = common.written(model(totals.filter("gram IS NOT NULL").select("gram", "c"), depth), "model")
    known = logs.select(bucket_of(F.col("gram"), blocks, lambda x, n: F.pmod(x, F.lit(n))).alias("bucket"), F.lit(0).alias("kind"), "gram", "logp", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("grams"))
    open_ = wanted.select("bucket", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("logp"), "block", "grams")
    said = common.written(known.unionAll(open_).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, "block long, bucket long, logp binary"), "said")
    blank = {"bucket": "long", "words": "binary", "word_c": "binary", "grams": "binary", "logp": "binary", "id": rows.schema["id"].dataType.simpleString(), "train": "boolean", "text": "string"}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        """The columns of answers and texts together, answers first in each block."""
        return df.select("block", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, end, none = math.log10(n + 0.5 * (v + 1)), math.log10(ends + 0.5), math.log10(0.5)
        block, held, log, look = None, {}, {}, None
        for batch in batches:
            for (at, kind), part in common.alike(batch, "block", "kind"):
                if at != block:
                    block, held, log, look = at, {}, {}, None
                if kind == 0:
                    for row in part.select(["bucket", *ANSWERS]).to_pylist():
                        held.setdefault(row["bucket"], {}).update((c, row[c]) for c in ANSWERS if row[c] is not None)
                    continue
                if look is None:
                    for row in held.values():
                        log.update(zip(split(row["words"]), np.log10(numbers(row["word_c"]) + 0.5).tolist(), strict=True))
                    look = Lookup(np.concatenate([numbers(r["grams"]) for r in held.values()]), np.concatenate([numbers(r["logp"], np.float64) for r in held.values()]))
                    held = {}
                texts = common.as_bytes(part.column("text"))
                for a, b in common.pieces(texts, STEP):
                    n_bytes, n_tokens, n_known, base = [], [], [], []
                    low = [t.lower() for t in texts[a:b]]
                    for t in low:
                        own = list(map(log.__getitem__, t.split()))
                        n_bytes.append(len(t))
                        n_tokens.append(len(own) + 1)
                        n_known.append(len(own) - own.count(none) + (ends > 0))
                        base.append(math.fsum(own) + end - (len(own) + 1) * total)
                    code, doc = gram_codes(low, depth)
                    score_ = np.bincount(doc, weights=look.get(code), minlength=b - a)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").slice(a, b - a), part.column("train").slice(a, b - a), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([n] * (b - a), pa.int64()), pa.array(base, pa.float64()), pa.array(score_)],
                        names=["id", "train", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    answers = shaped(wanted.select("block", "bucket", "words", "grams"), 0).unionAll(shaped(totals.filter("word_c IS NOT NULL").select("block", "bucket", "word_c"), 0)).unionAll(shaped(said, 0))
    together = answers.unionAll(shaped(dealt, 1)).repartition("block").sortWithinPartitions("block", "kind")
    schema = f"id {blank['id']}, train boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.mapInArrow(put_together, schema).withColumnRenamed("id", id_col)
