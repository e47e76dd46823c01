"""Byte-level BPE: segment trees over the ranks of adjacent pairs.

A pre-token is a row of byte symbols. The leaves of its tree hold `rank of (symbol, next symbol) * width + place`,
so the root is the lowest rank and, among equals, the leftmost place. Merging there changes three leaves (the merged
pair, the pair it swallows, the pair before), each repaired up the tree in logarithmic time, until the root says
that no pair can be merged. Trees of the same width are stacked in one array, and a step merges once in each, so the
work stays inside numpy. Results of pre-tokens are kept for the task in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyframe.llm import common

#: Fixed value: the pattern that byte-level BPE vocabularies of this kind cut texts with.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens that a task remembers, and the longest one (in characters) it does.
REMEMBERED, LONGEST = 250_000, 40

#: Width from which a pre-token is merged by itself, in plain lists: steps of few trees are no work for numpy.
WIDE = 1024

NEVER = np.int64(1) << 62


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabulary files: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of bytes, ranks and results of pairs, and the bytes of each id, from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without a normalizer or a prefix space is needed")
        ids, letters = model["vocab"], byte_letters()
        value = {c: b for b, c in letters.items()}
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.n = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        code = np.array([ids[a] * self.n + ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.made = code[order], order.astype(np.int64), made[order]
        self.known_pairs: dict[int, tuple[int, int]] | None = None
        self.bytes_of: list[bytes] = [b""] * self.n
        for piece, i in ids.items():
            self.bytes_of[i] = bytes(value[c] for c in piece)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()

    def table(self) -> dict[int, tuple[int, int]]:
        """Rank and merged id by the code of a pair."""
        if self.known_pairs is None:
            self.known_pairs = dict(zip(self.code.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        return self.known_pairs

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if they don't merge) and merged id of each pair; -1 stands for no symbol."""
        want = left * self.n + right
        at = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
        good = (self.code[at] == want) & (left >= 0) & (right >= 0)
        return np.where(good, self.rank[at], NEVER), np.where(good, self.made[at], -1)


def merge_stack(vocabulary: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Merge each row of `symbols` (-1 after its end; a power of two wide) to the end; merged-away places are -1."""
    rows, width = symbols.shape
    sym, n = symbols.copy(), np.arange(rows)
    # Neighbours; `width` and -1 stand for none. Places from the end of a row on link nowhere.
    lengths = (symbols >= 0).sum(axis=1)
    following = np.broadcast_to(np.arange(1, width + 1), (rows, width)).copy()
    following[n[lengths > 0], lengths[lengths > 0] - 1] = width
    before = np.broadcast_to(np.arange(-1, width - 1), (rows, width)).copy()
    right = np.concatenate([sym[:, 1:], np.full((rows, 1), -1)], axis=1)
    rank, made = vocabulary.pairs(sym.ravel(), right.ravel())
    rank, made = rank.reshape(rows, width), made.reshape(rows, width)
    tree = np.full((rows, 2 * width), NEVER, dtype=np.int64)
    tree[:, width:] = np.where(rank < NEVER, rank * width + np.arange(width), NEVER)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def put(rows_: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
        node = place + width
        tree[rows_, node] = key
        while node[0] > 1:  # all leaves are equally deep
            node = node >> 1
            tree[rows_, node] = np.minimum(tree[rows_, 2 * node], tree[rows_, 2 * node + 1])

    def pair_at(rows_: np.ndarray, place: np.ndarray) -> None:
        follow = following[rows_, place]
        other = np.where(follow < width, sym[rows_, np.minimum(follow, width - 1)], -1)
        r, m = vocabulary.pairs(sym[rows_, place], other)
        made[rows_, place] = m
        put(rows_, place, np.where(r < NEVER, r * width + place, NEVER))

    live = n[tree[:, 1] < NEVER]
    while len(live):
        place = tree[live, 1] % width
        gone = following[live, place]
        sym[live, place] = made[live, place]
        after = following[live, gone]
        following[live, place] = after
        sym[live, gone] = -1
        put(live, gone, np.full(len(live), NEVER))
        linked = after < width
        before[live[linked], after[linked]] = place[linked]
        pair_at(live, place)
        ahead = before[live, place]
        some = ahead >= 0
        if some.any():
            pair_at(live[some], ahead[some])
        live = live[tree[live, 1] < NEVER]
    return sym


def merge_one(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """The same for one long row; what is left of it."""
    never, n, width = int(NEVER), len(symbols), 1 << max(1, (len(symbols) - 1).bit_length())
    pairs, base = vocabulary.table(), vocabulary.n
    sym, following, before = symbols + [-1], [*range(1, n), n], [*range(-1, n - 1)]
    made, tree = [-1] * n, [never] * (2 * width)
    for i in range(n - 1):
        rank, made[i] = pairs.get(sym[i] * base + sym[i + 1], (never, -1))
        tree[width + i] = rank * width + i if rank < never else never
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(place: int, key: int) -> None:
        node = place + width
        tree[node] = key
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return  # nothing changes further up
            tree[node] = least
            node >>= 1

    def pair_at(place: int) -> None:
        rank, made[place] = pairs.get(sym[place] * base + sym[following[place]], (never, -1)) if following[place] < n else (never, -1)
        put(place, rank * width + place if rank < never else never)

    while tree[1] < never:
        place = tree[1] % width
        gone = following[place]
        sym[place] = made[place]
        following[place] = after = following[gone]
        sym[gone] = -1
        put(gone, never)
        if after < n:
            before[after] = place
        pair_at(place)
        if before[place] >= 0:
            pair_at(before[place])
    return [x for x in sym[:n] if x >= 0]


class Encoder:
    """Encodes and decodes as the file's own library does; special tokens in a text become their ids."""

    def __init__(self, path: str):
        self.vocabulary, self.cut, self.known = Vocabulary(path), regex.compile(CUT), {}
        special = sorted(map(regex.escape, self.vocabulary.special), key=len, reverse=True)
        self.special_cut = regex.compile(f"({'|'.join(special)})") if special else None

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit integers."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: list[bytes] = [b""] * len(raw)
        widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for width in np.unique(widths):
            all_of = np.flatnonzero(widths == width)
            if width >= WIDE:
                for k in all_of.tolist():
                    out[k] = np.array(merge_one(self.vocabulary, self.vocabulary.byte_ids[list(raw[k])].tolist()), dtype="<u4").tobytes()
                continue
            step = max(1, (1 << 18) // int(width))
            for i in range(0, len(all_of), step):
                own = all_of[i : i + step]
                flat = np.frombuffer(b"".join([raw[k].ljust(int(width), b"\0") for k in own]), dtype=np.uint8).reshape(len(own), int(width))
                symbols = np.where(np.arange(width) < lengths[own][:, None], self.vocabulary.byte_ids[flat], -1)
                done = merge_stack(self.vocabulary, symbols)
                left = done >= 0
                ids, ends = done[left].astype("<u4").tobytes(), 4 * np.cumsum(left.sum(axis=1))
                start = 0
                for k, end in zip(own.tolist(), ends.tolist(), strict=True):
                    out[k] = ids[start:end]
                    start = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        known, cuts = self.known, []
        for text in texts:
            found: list[str | int] = []  # pre-tokens, and ids of special tokens
            for k, part in enumerate(self.special_cut.split(text) if self.special_cut else [text]):
                if k % 2:
                    found.append(self.vocabulary.special[part])
                else:
                    found += self.cut.findall(part)
            cuts.append(found)
        new = [w for w in set().union(*cuts) if w not in known]
        words = [w for w in new if isinstance(w, str)]
        known.update(zip(words, self.merged(words), strict=True))
        known.update((i, np.array([i], dtype="<u4").tobytes()) for i in new if isinstance(i, int))
        out = [b"".join(map(known.__getitem__, found)) for found in cuts]
        for w in words:
            if len(w) > LONGEST:
                del known[w]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; bytes that are not UTF-8 become U+FFFD."""
        raw = b"".join(map(self.vocabulary.bytes_of.__getitem__, ids.tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


def encode_texts(docs: DataFrame, vocabulary: str | Callable[[], str], text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Encode and decode each whole text; adds `n_tokens`, `ids` (if wanted), `ids_sha256`, `decoded_sha256`.

    vocabulary: path of a tokenizers JSON file, there on every machine, or a function that a task asks for it. A null text counts as the empty text, which
    has no ids. Equal texts get equal ids, each row its own; no rows give no rows. Columns called like a result are
    replaced, others pass. A very long text is worked on by itself, whole.
    """
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make():
        coder = Encoder(vocabulary if isinstance(vocabulary, str) else vocabulary())

        def run(texts: list[bytes]) -> dict[str, object]:
            coded = coder.encode([t.decode() for t in texts])
            ids = [np.frombuffer(c, dtype="<u4") for c in coded]
            out: dict[str, object] = {"n_tokens": [len(i) for i in ids], "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded]}
            out["decoded_sha256"] = [hashlib.sha256(coder.decode(i)).hexdigest() for i in ids]
            if with_ids:
                out["ids"] = [i.astype(np.int32) for i in ids]
            return out

        return run

    return common.map_texts(docs, text_col, make, fields, keep)
