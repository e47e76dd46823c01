"""Numbers of tokens of whole texts, as a tokenizers library counts them.

No word of the tokenizer's pattern has white space in it, nor does anything compose across it, so a text has as many tokens
as what lies between its white space has, and what has been counted once is remembered, in a table of bounded size. That
serves texts of usual length, whole. A long one is cut into chunks that overlap, so that no task gets all of it,
and the chunks are encoded wherever there is room. Where two neighbours meet, both have seen the overlap; they are spliced
at a place where both begin a word, and which no letter before it can move:

* the left chunk has read on for MARGIN bytes behind that place, more than any of the pattern's choices or special
  tokens looks ahead, so the whole text's words begin there too;
* the right chunk's words begin there too, so both read on in the same state (the pattern doesn't look back);
* the letter there is none that could be composed with those before it.

By induction from a text's beginning every splice is a boundary of the whole text's words, and counts add up to the whole
text's. Where neighbours share no such place, as inside a word that is longer than the overlap, the text is cut anew with
overlaps and chunks four times as wide, until all meet or one chunk is the text.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import common
from tallyframe.llm.common import written

#: Bytes of a chunk without overlap, of an overlap, and how far a left chunk must have read on behind a splice.
CHUNK, OVERLAP, MARGIN = 1 << 16, 1 << 10, 64

#: How much wider chunks and overlaps get where neighbours don't meet.
WIDER = 4

#: Stretches without white space whose counts a task remembers, and the longest that it does, in bytes.
REMEMBERED, LONGEST = 1 << 19, 64


def seconds() -> frozenset[str]:
    """Letters that can be composed with one before them: the second ones of canonical pairs, and Hangul vowels and tails."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")) | frozenset(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))


def library(path: str):
    """The library's tokenizer, on one thread, as Spark runs a task for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Words:
    """Counts tokens of texts by what lies between their white space."""

    def __init__(self, path: str):
        self.tokenizer, self.known = library(path), {}

    def counts(self, texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]  # at the six kinds of ASCII white space
        new = list(set().union(*words).difference(self.known))
        self.known.update(zip(new, (len(e) for e in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)), strict=True))
        out = [sum(map(self.known.__getitem__, found)) for found in words]
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return out


class Chunks:
    """Counts tokens of chunks, and before each place where a chunk may be spliced."""

    def __init__(self, path: str):
        self.tokenizer, self.composing = library(path), seconds()

    def steady(self, letter: str) -> bool:
        return letter not in self.composing and not unicodedata.combining(letter) and unicodedata.category(letter) != "Cn"

    def count(self, raw: bytes, start: int, after: int, overlap: int, size: int) -> tuple[int, list[int], list[int], list[int], list[int]]:
        """Of a chunk's bytes, which begin at `start` of a text of `size` bytes: tokens; places shared with the chunk
        before and tokens before each; places shared with the chunk that begins at `after`, and tokens before each."""
        skipped = next((i for i, b in enumerate(raw[:4]) if b & 0xC0 != 0x80), len(raw)) if start else 0
        end = len(raw)
        while start + end < size and end and (raw[end - 1] & 0xC0) == 0x80:
            end -= 1
        if start + end < size and end and raw[end - 1] >= 0xC0:
            end -= 1  # a letter that the cut has gone through is left to the next chunk
        whole = raw[skipped:end] if start + end < size else raw[skipped:]
        text = whole.decode()
        coded = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.flatnonzero((np.frombuffer(whole, dtype=np.uint8) & 0xC0) != 0x80) + start + skipped
        offsets, words = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2), coded.word_ids
        found: dict[str, tuple[list[int], list[int]]] = {"before": ([], []), "behind": ([], [])}
        last = start + skipped + len(whole) - MARGIN
        for i in range(1, len(words)):
            a = int(offsets[i, 0])
            if words[i] == words[i - 1] or offsets[i - 1, 1] > a:
                continue
            place = int(at[a])
            side = "before" if start < place <= start + overlap else "behind" if after <= place <= last else None
            if start == 0 and side == "before":
                continue
            if side and self.steady(text[a]):
                found[side][0].append(place)
                found[side][1].append(i)
        if after >= size:
            found["behind"] = ([], [])
        return len(words), *found["before"], *found["behind"]


def encoded(chunks: DataFrame, vocabulary: Callable[[], str] | str) -> DataFrame:
    """(row, start, after, overlap, size, raw) -> (row, start, after, size, n, and two arrays for each side)."""
    names = ["n", "places_before", "tokens_before", "places_behind", "tokens_behind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Chunks(vocabulary if isinstance(vocabulary, str) else vocabulary())
            numbers = [batch.column(i).to_pylist() for i in range(1, 5)]
            got = [coder.count(batch.column(5)[i].as_py(), start, after, overlap, size) for i, (start, after, overlap, size) in enumerate(zip(*numbers, strict=True))]
            arrays = [pa.array([g[k] for g in got], type=pa.int64() if k == 0 else pa.list_(pa.int64())) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), *arrays], names=["row", "start", "after", "size", *names])

    schema = "row long, start long, after long, size long, n long, " + ", ".join(f"{n} array<long>" for n in names[1:])
    return chunks.mapInArrow(run, schema)


def cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, raw, size) -> one row for each chunk."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))
    piece = lambda s: F.struct(s.alias("start"), F.least(s + chunk, F.col("size")).alias("after"), F.substring(F.col("raw"), (s + 1).cast("int"), F.lit(chunk + overlap)).alias("raw"))
    parts = texts.select("row", "size", F.explode(F.transform(starts, piece)).alias("p"))
    return parts.select("row", "p.start", "p.after", F.lit(overlap).cast("long").alias("overlap"), "size", "p.raw").repartition("row", "start")


def long_counts(texts: DataFrame, vocabulary: Callable[[], str] | str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, n_tokens) of a written table (row, raw, size) of long texts."""
    done, todo = [], texts
    while True:
        coded = written(encoded(cut(todo, chunk, overlap), vocabulary), "chunks")
        right = coded.select(F.col("row").alias("row_"), F.col("start").alias("start_"), "places_before", "tokens_before")
        left = coded.filter("after < size").select("row", "after", "places_behind", "tokens_behind")
        met = left.join(right, (F.col("row") == F.col("row_")) & (F.col("after") == F.col("start_")))
        place = F.array_min(F.array_intersect("places_behind", "places_before"))
        tokens = lambda side: F.element_at(f"tokens_{side}", F.array_position(f"places_{side}", F.col("place")).cast("int"))
        met = met.withColumn("place", place).select("row", F.when(F.col("place").isNotNull(), tokens("behind") - tokens("before")).alias("n"))
        ends = coded.filter("after >= size").select("row", "n")
        totals = written(met.unionByName(ends).groupBy("row").agg(F.sum("n").alias("n_tokens"), F.count_if(F.col("n").isNull()).alias("apart")), "totals")
        done.append(totals.filter("apart = 0").select("row", "n_tokens"))
        apart = totals.filter("apart > 0").select("row")
        if apart.isEmpty():
            break
        todo, chunk, overlap = texts.join(apart, "row", "left_semi"), chunk * WIDER, overlap * WIDER
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def token_counts(docs: DataFrame, vocabulary: Callable[[], str] | str, limit: int, text_col: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Add `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens) for each whole text.

    vocabulary: path of a tokenizers JSON file on every machine, or a function that a task asks for it; the file's pattern
    must not look back, nor ahead by over MARGIN bytes, nor keep white space. Special tokens in a text count as the library has it by default.
    A null text counts as the empty text: no bytes, no tokens. Equal rows get equal counts, each its own; no rows give none.
    Columns called like a result are replaced, others pass. Texts of up to `chunk` bytes are never cut.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]
    kept = common.without(docs, names).columns if keep is None else keep
    text = F.col(f"`{text_col}`").cast("string")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    own = [f"k{i}" for i in range(len(kept))]

    def make() -> Callable[[list[bytes]], dict[str, object]]:
        words = Words(vocabulary if isinstance(vocabulary, str) else vocabulary())
        return lambda texts: {"n": words.counts(texts)}

    short = common.map_texts(plain.filter(F.col("size") <= chunk), "text", make, [T.StructField("n", T.LongType())], keep=[*own, "size"])
    texts = written(plain.filter(F.col("size") > chunk).select(*own, "size", F.col("text").cast("binary").alias("raw"), F.monotonically_increasing_id().alias("row")), "long_texts")
    counted = long_counts(texts.select("row", "raw", "size"), vocabulary, chunk, overlap)
    long = texts.select(*own, "size", "row").join(counted.withColumnsRenamed({"row": "row_", "n_tokens": "n"}), F.col("row") == F.col("row_")).select(*own, "size", "n")
    both = short.select(*own, "size", "n").unionByName(long)
    return both.select(*[F.col(k).alias(c) for k, c in zip(own, kept, strict=True)], F.col("size").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
