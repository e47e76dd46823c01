"""Hashed features of texts and linear models over them, shared by the classifiers of this package.

Words and character n-grams are hashed in numpy, a piece of many texts at a time. A model keeps the buckets that tell
the classes apart best (chi-square over a bounded sample of labelled rows) and one weight for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import common

U = np.uint64


def white() -> np.ndarray:
    """True for the six ASCII white-space bytes."""
    out = np.zeros(256, dtype=bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


def lower() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def stir(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit number over all its bits."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(32))


@dataclass
class Words:
    """The words of a piece of texts: where each starts and ends, and its text's number."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def eight(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Up to eight bytes from `at` before `end`, as a number."""
        got = self.data[at[:, None] + np.arange(8)].view("<u8").ravel().astype(U)
        short = np.maximum(0, 8 - (end - at)).astype(U) * U(8)
        return np.where(short >= 64, U(0), got & (U(0xFFFFFFFFFFFFFFFF) >> np.minimum(short, U(63))))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each whole word."""
        h = stir(self.eight(self.start, self.end) ^ ((self.end - self.start).astype(U) << U(1)))
        more = np.flatnonzero(self.end - self.start > 8)
        at = self.start[more] + 8
        while len(more):
            h[more] = stir(h[more] * U(0x9E3779B97F4A7C15) ^ self.eight(at, self.end[more]))
            at += 8
            still = at < self.end[more]
            more, at = more[still], at[still]
        return h


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> Words:
    """Words of texts joined by at least eight zero bytes; `blank` marks white space and the bytes between texts."""
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return Words(data, start, end, np.searchsorted(starts, start, side="right") - 1)


def blanks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """White space, and the bytes between texts."""
    blank = white()[data]
    for shift in range(8):
        blank[ends + shift] = True
    return blank


@dataclass(frozen=True)
class Spec:
    """Which features: whole words, beginnings of words (bytes), runs of words, runs of bytes, whether a run of so
    many words came before in the text; lower-cased or not; the number of buckets; values by presence, or by the root of the share of all features of the kind."""

    words: bool = True
    prefixes: tuple[int, ...] = ()
    runs: tuple[int, ...] = ()
    grams: tuple[int, ...] = ()
    again: int = 0
    lowered: bool = True
    bits: int = 18
    shares: bool = False

    def each(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text number, bucket) of every occurrence, one kind after the other."""
        data, starts, ends = common.joined(texts)
        if self.lowered:
            data = lower()[data]
        blank = blanks(data, starts, ends)
        top = U(64 - self.bits)
        if self.words or self.prefixes or self.runs or self.again:
            w = words_of(data, starts, ends, blank)
            h = w.hashes()
            if self.words:
                yield w.doc, (stir(h) >> top).astype(np.int64)
            for n in self.prefixes:
                long = w.end - w.start >= n
                first = w.eight(w.start[long], np.minimum(w.start[long] + n, w.end[long]))
                yield w.doc[long], (stir(first * U(2 * n + 1) + U(n)) >> top).astype(np.int64)
            for n in self.runs:
                if len(h) >= n:
                    run, last = h[: len(h) - n + 1].copy(), w.doc[n - 1 :]
                    for k in range(1, n):
                        run = stir(run * U(3) + h[k : len(h) - n + 1 + k])
                    same = w.doc[: len(last)] == last
                    yield last[same], (run[same] >> top).astype(np.int64)
            if self.again and len(h) >= self.again:
                run, last = stir(w.doc[: len(h) - self.again + 1].astype(U)), w.doc[self.again - 1 :]
                for k in range(self.again):
                    run = stir(run * U(3) + h[k : len(h) - self.again + 1 + k])
                same = np.flatnonzero(w.doc[: len(last)] == last)
                repeat = np.ones(len(same), dtype=np.int64)
                repeat[np.unique(run[same], return_index=True)[1]] = 0
                yield last[same], repeat  # buckets 0 and 1
        for n in self.grams:
            if len(data) < n:
                continue
            code = np.zeros(len(data) - n + 1, dtype=U)
            for k in range(n):
                code = (code << U(8)) | data[k : len(code) + k]
            at = np.arange(len(code))
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + n <= ends[doc]
            yield doc[inside], (stir(code[inside] * U(2 * n + 1) + U(n)) >> top).astype(np.int64)

    def chosen(self, texts: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, feature, value) of the features that `place` (bucket -> feature or -1) knows, by text."""
        n, width = len(texts), int(place.max(initial=0)) + 1
        keys, values = [], []
        for doc, bucket in self.each(texts):
            feature = place[bucket]
            hit = feature >= 0
            key, count = np.unique(doc[hit] * width + feature[hit], return_counts=True)
            keys.append(key)
            values.append(count / np.maximum(1, np.bincount(doc, minlength=n))[key // width])
        key, value = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0)])
        key, back = np.unique(key, return_inverse=True)
        value = np.sqrt(np.bincount(back, weights=value, minlength=len(key))) if self.shares else np.ones(len(key))
        return key // width, key % width, value


@dataclass
class Linear:
    """Weights of chosen buckets, a constant, and a line from margin to calibrated margin."""

    spec: Spec
    buckets: np.ndarray
    weights: np.ndarray
    constant: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def place(self) -> np.ndarray:
        out = np.full(1 << self.spec.bits, -1, dtype=np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        """Margins of texts; equal texts have equal ones, whatever stands beside them."""
        place = self.place()

        def margins(texts: list[bytes]) -> np.ndarray:
            doc, feature, value = self.spec.chosen(texts, place)
            return self.constant + np.bincount(doc, weights=value * self.weights[feature], minlength=len(texts))

        return margins


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Sample:
    """Labelled rows as sparse rows: `doc` and `feature` of each value, and the labels."""

    doc: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    label: np.ndarray
    twin: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=self.value * w[self.feature], minlength=len(self.label))

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.feature, weights=self.value * r[self.doc], minlength=width)

    def curvature(self, width: int) -> float:
        """The largest eigenvalue of X'X / n, by power iteration."""
        v = np.ones(width) / max(1, width) ** 0.5
        size = 1.0
        for _ in range(20):
            v = self.back(self.times(v), width) / max(1, len(self.label))
            size = float(np.linalg.norm(v)) or 1.0
            v = v / size
        return size


def labelled(docs: DataFrame, labels: DataFrame, label: Column, most: int, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """(text, label) of at most `most` labelled rows: those with the least hash of their id.

    Rows without an id or a label are left out; an id that is labelled twice counts once, with its highest label.
    The chosen ids have a bound, so they are broadcast; of rows of `docs` with the same id the least text counts, so the
    sample has the same bound.
    """
    ids = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), label.cast("int").alias("label"))
    if where is not None:
        ids = labels.filter(F.col(id_col).isNotNull() & where).select(F.col(id_col).alias("id"), label.cast("int").alias("label"))
    ids = ids.filter("label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(most)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def choose(sample: DataFrame, spec: Spec, classes: int, features: int, least: float) -> np.ndarray:
    """The buckets, `features` at most, whose presence tells the classes apart best (chi-square of `least` or more).

    Each task counts its own texts in arrays of a fixed length and gives a row for each bucket seen, so the shuffle
    is bounded by buckets times tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((classes, 1 << spec.bits), dtype=np.int64)
        for batch in batches:
            texts, label = common.as_bytes(batch.column(0)), batch.column(1).to_numpy()
            for a, b in common.pieces(texts):
                for doc, bucket in spec.each(texts[a:b]):
                    key = np.unique((doc << spec.bits) + bucket)
                    for c in range(classes):
                        own = key[label[a:b][key >> spec.bits] == c]
                        seen[c] += np.bincount(own & ((1 << spec.bits) - 1), minlength=1 << spec.bits)
        found = np.flatnonzero(seen.sum(axis=0))
        for i in range(0, len(found), 50_000):
            part = found[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(seen[c][part]) for c in range(classes))], names=["bucket", *(f"c{c}" for c in range(classes))])

    names = [f"c{c}" for c in range(classes)]
    counts = sample.select("text", "label").mapInArrow(count, "bucket long, " + ", ".join(f"{n} long" for n in names))
    counts = counts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    totals = sample.groupBy("label").count()
    of = {r["label"]: r["count"] for r in totals.collect()}
    n = sum(of.values())
    share = sum((F.col(c) for c in names), F.lit(0)) / F.lit(max(1, n))
    chi = F.lit(0.0)
    for c, name in enumerate(names):
        want = share * of.get(c, 0)
        chi = chi + F.when(want > 0, (F.col(name) - want) ** 2 / (want * (1 - share) + 1e-9)).otherwise(0.0)
    best = counts.select("bucket", chi.alias("chi")).filter(F.col("chi") >= least).orderBy(F.desc("chi"), "bucket").limit(features)
    return np.sort(np.array([r["bucket"] for r in best.collect()], dtype=np.int64))


def gathered(sample: DataFrame, spec: Spec, buckets: np.ndarray, twins: Callable[[bytes], list[bytes]] | None = None) -> Sample:
    """The sample's chosen features, on the driver: bounded by its rows and the number of features.

    twins: gives other wordings of a text that must score like it; they follow it as rows with `twin` its row.
    """
    place = Linear(spec, buckets, np.zeros(len(buckets))).place()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts, row, twin = [], [], []
            for i, t in enumerate(common.as_bytes(batch.column(1))):
                for k, x in enumerate([t, *(twins(t) if twins else [])]):
                    texts.append(x)
                    row.append(i)
                    twin.append(k)
            for a, b in common.pieces(texts):
                doc, feature, value = spec.chosen(texts[a:b], place)
                cut = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[r] for r in row[a:b]], pa.string()), pa.array([labels[r] for r in row[a:b]], pa.int32()), pa.array(twin[a:b], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int16))), pa.ListArray.from_arrays(pa.array(cut), pa.array(value.astype(np.float32))),
                    ],
                    names=["id", "label", "twin", "feature", "value"],
                )

    got = sample.select(F.col("id").cast("string").alias("id"), "text", "label").mapInArrow(run, "id string, label int, twin int, feature array<smallint>, value array<float>")
    table = got.toArrow().combine_chunks()
    order = np.lexsort((table["twin"].to_numpy(), np.array(table["id"].to_pylist(), dtype=object).astype(str))) if len(table) else np.zeros(0, np.int64)
    table = table.take(pa.array(order)).combine_chunks()
    if not len(table):
        return Sample(*[np.zeros(0, np.int64)] * 2, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lists = table["feature"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    values = table["value"].combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    twin, ids = table["twin"].to_numpy(), table["id"].to_pylist()
    first = np.maximum.accumulate(np.where(twin == 0, np.arange(len(twin)), 0))
    return Sample(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.float64), table["label"].to_numpy().astype(np.int64), np.where(twin == 0, -1, first))


def logistic_gradient(x: Sample, v: np.ndarray, weight: np.ndarray, l2: float, alike: float) -> np.ndarray:
    """The gradient, in the weights and the constant, of the weighted log loss, l2 * w^2 and the twins' penalty."""
    width, twins = len(v) - 1, np.flatnonzero(x.twin >= 0)
    margin = x.times(v[:width]) + v[width]
    r = weight * (sigmoid(margin) - x.label)
    total = r.sum()
    if alike and len(twins):
        gap = 2 * alike * (margin[twins] - margin[x.twin[twins]]) / len(twins)
        np.add.at(r, twins, gap)
        np.add.at(r, x.twin[twins], -gap)
    g = np.append(x.back(r, width), total)
    g[:width] += 2 * l2 * v[:width]
    return g


def fit_logistic(x: Sample, width: int, l1: float = 0.0, l2: float = 1e-6, alike: float = 0.0, rounds: int = 300, part: np.ndarray | None = None, yes: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise mean log loss, l1 * |w| + l2 * w^2, and `alike` times the mean square of
    the differences in margin between rows and their twins (accelerated proximal gradient, a fixed number of rounds).
    Rows of class 1 count `yes` times; only rows of `part` count, if given."""
    real = (x.twin < 0) if part is None else (x.twin < 0) & part
    n, twins = max(1, int(real.sum())), np.flatnonzero(x.twin >= 0)
    weight = np.where(real, np.where(x.label > 0, yes, 1.0), 0.0) / n
    step = 1 / (0.25 * max(1.0, yes) * (x.curvature(width) * len(x.label) / n + 1) + 2 * l2 + 4 * alike * bool(len(twins)) * x.curvature(width) * len(x.label) / max(1, len(twins)))
    w, v, momentum = np.zeros(width + 1), np.zeros(width + 1), 1.0
    for _ in range(rounds):
        new = v - step * logistic_gradient(x, v, weight, l2, alike)
        new[:width] = np.sign(new[:width]) * np.maximum(0, np.abs(new[:width]) - step * l1)
        faster = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v = new + (momentum - 1) / faster * (new - w)
        w, momentum = new, faster
    return w[:width], float(w[width])


def fit_line(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to labels (Platt's targets), by Newton's method."""
    yes, no = label.sum(), (1 - label).sum()
    if not yes or not no:
        return 1.0, 0.0
    target = np.where(label > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(ab[0] * margin + ab[1])
        q = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        ab = ab - move * min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])
