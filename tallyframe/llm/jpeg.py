"""Media columns: bytes as baseline JPEG, one 8x8 block for each byte, and DC-only luminance thumbnails read back.

A block of one grey value has nothing but a DC coefficient, which a quantiser of 8 makes `value - 128`. So the
thumbnail that the DC coefficients of a picture give (one sample for each block) holds the bytes without loss, and any
JPEG reader shows the picture. The reader below takes any baseline picture: it parses the markers, Huffman-decodes the
scan and keeps DC luminance. Restart intervals of one row of blocks can be decoded side by side: a step decodes one
block in all intervals of many pictures at once, in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import common

#: Payloads are filled up to a multiple of this, one row of blocks; the most rows in one picture (65,535 lines).
ROW, MOST_ROWS = 64, 8191

#: Bytes that a step works on; a byte takes up some hundred while its code is put together or taken apart.
STEP = 1 << 19

#: The number of Huffman codes of each length, 1 to 16 bits, for the DC categories 0 to 11 in order (the
#: luminance table of the JPEG standard, annex K), and a table with one code, the end of a block.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
EOB_LENGTHS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)


def codes(lengths: tuple[int, ...], symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out.append((symbols[at], code, bits))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    """Everything before the scan's data of a picture of `rows` rows of 64 blocks."""
    frame = b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big") + b"\x01\x01\x11\x00"
    tables = b"\x00" + bytes(DC_LENGTHS) + bytes(range(12)) + b"\x10" + bytes(EOB_LENGTHS) + b"\x00"
    return b"\xff\xd8" + segment(0xDB, b"\x00" + b"\x08" * 64) + segment(0xC0, frame) + segment(0xC4, tables) + segment(0xDD, ROW.to_bytes(2, "big")) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits of a block, and how many, by the difference of its DC from the one before, plus 255."""
    dc = {s: (c, n) for s, c, n in codes(DC_LENGTHS, bytes(range(12)))}
    bits, count = np.zeros(511, dtype=np.int64), np.zeros(511, dtype=np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], count[d + 255] = ((code << size) | extra) << 1, n + size + 1  # and the end of the block, 0
    return bits, count


class Writer:
    """Texts to pictures; a payload of over MOST_ROWS rows becomes several pictures, one after the other."""

    def __init__(self):
        self.bits, self.count = block_codes()

    def scans(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stuffed bytes of each row of 64 samples, all in one array, and how many bytes each row has."""
        value = samples.astype(np.int64) - 128
        value[:, 1:] -= value[:, :-1].copy()
        value += 255
        bits, count = self.bits[value], self.count[value]
        total = count.sum(axis=1)
        size = (total + 7) // 8
        first = np.concatenate([[0], np.cumsum(size)])
        at = 8 * first[:-1, None] + np.cumsum(count, axis=1) - count
        # Each code lies in two 32-bit words at most; the bits of one word never overlap, so sums put them together.
        word, shift = at >> 5, 64 - (at & 31) - count
        long = bits << shift
        n = int(first[-1]) // 4 + 3
        words = sum(np.bincount((word + k).ravel(), weights=part.ravel().astype(np.float64), minlength=n) for k, part in ((0, long >> 32), (1, long & 0xFFFFFFFF)))
        raw = words.astype(np.int64).astype(">u4").view(np.uint8)[: first[-1]].copy()
        last = first[1:] - 1
        raw[last] |= ((1 << (8 * size - total)) - 1).astype(np.uint8)  # a row is filled up with ones
        full = raw == 0xFF
        spread = np.ones(len(raw), dtype=np.int64) + full
        to = np.cumsum(spread) - spread
        out = np.zeros(int(spread.sum()), dtype=np.uint8)
        out[to] = raw
        return out, np.add.reduceat(spread, first[:-1])

    def rows(self, samples: np.ndarray, place: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Rows of samples as they stand in a file, each with a restart marker behind it, and how long each is."""
        data, sizes = self.scans(samples)
        ends = np.cumsum(sizes + 2)
        out = np.empty(int(ends[-1]), dtype=np.uint8)
        out[np.arange(len(data)) + np.repeat(2 * np.arange(len(sizes)), sizes)] = data
        out[ends - 2], out[ends - 1] = 0xFF, 0xD0 + (place % 8)
        return out.tobytes(), sizes + 2

    def write(self, texts: list[bytes]) -> list[bytes]:
        counts = [max(1, -(-len(t) // ROW)) for t in texts]
        samples = np.frombuffer(b"".join(t.ljust(ROW * n, b"\0") for t, n in zip(texts, counts, strict=True)), dtype=np.uint8).reshape(-1, ROW)
        place = np.concatenate([np.arange(n) for n in counts]) % MOST_ROWS
        done = [self.rows(samples[a : a + STEP // ROW], place[a : a + STEP // ROW]) for a in range(0, len(samples), STEP // ROW)]
        flat, starts = b"".join(d for d, _ in done), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in done]))]).tolist()
        media, row = [], 0
        for n in counts:
            parts = []
            for a in range(0, n, MOST_ROWS):
                b = min(n, a + MOST_ROWS)
                parts += [header(b - a), flat[starts[row + a] : starts[row + b] - 2], b"\xff\xd9"]  # the last row has no marker
            media.append(b"".join(parts))
            row += n
        return media


@dataclass
class Picture:
    """What the markers of one picture say, and its scan's bytes as they stand in the file."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quant: dict[int, tuple[int, ...]] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[tuple[int, ...], bytes]] = field(default_factory=dict)
    restart: int = 0
    scan: tuple[tuple[int, int, int], ...] = ()
    data: bytes = b""


def parse(media: bytes) -> list[Picture]:
    """The pictures of a file, one after the other. Raises ValueError for what isn't baseline JPEG."""
    out: list[Picture] = []
    at, p = 0, None
    while at < len(media):
        if media[at] != 0xFF or at + 1 >= len(media):
            raise ValueError(f"no marker at byte {at}")
        marker = media[at + 1]
        at += 2
        if marker == 0xD8:
            p = Picture()
        elif marker == 0xD9:
            if p is None:
                raise ValueError("an end without a start")
            out.append(p)
            p = None
        elif marker == 0xFF or 0xD0 <= marker <= 0xD7:
            at -= marker == 0xFF
        else:
            size = int.from_bytes(media[at : at + 2], "big")
            body, at = media[at + 2 : at + size], at + size
            if p is None or size < 2:
                raise ValueError("a segment outside a picture")
            if marker == 0xDB:
                while body:
                    n = 64 << (body[0] >> 4)
                    p.quant[body[0] & 15] = tuple(body[1 : n + 1]) if n == 64 else tuple(int.from_bytes(body[1 + 2 * k : 3 + 2 * k], "big") for k in range(64))
                    body = body[n + 1 :]
            elif marker == 0xC0:
                p.height, p.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                p.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not a baseline picture")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    p.tables[body[0] >> 4, body[0] & 15] = (tuple(body[1:17]), body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                p.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                p.scan = tuple((body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0]))
                end = at
                while True:  # to the next marker that neither stuffs nor restarts
                    end = media.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(media):
                        raise ValueError("the scan has no end")
                    if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                p.data, at = media[at:end], end
    if p is not None:
        raise ValueError("a picture without an end")
    return out


def lookup(table: tuple[tuple[int, ...], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol, and bits of its code, for every 16 bits that a code may begin (0 bits: none)."""
    symbol, length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for s, code, bits in codes(*table):
        symbol[code << (16 - bits) : (code + 1) << (16 - bits)] = s
        length[code << (16 - bits) : (code + 1) << (16 - bits)] = bits
    return symbol, length


class Reader:
    """Thumbnails of pictures; those with the same tables are decoded together."""

    def __init__(self):
        self.looked: dict = {}

    def table(self, key: tuple[tuple[int, ...], bytes]) -> tuple[np.ndarray, np.ndarray]:
        if key not in self.looked:
            if len(self.looked) > 64:
                self.looked.clear()
            self.looked[key] = lookup(key)
        return self.looked[key]

    def thumbnails(self, pictures: list[Picture]) -> list[np.ndarray]:
        """One sample for each luminance block of each picture: its mean, 0 to 255."""
        out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(pictures)
        groups: dict[tuple, list[int]] = {}
        for i, p in enumerate(pictures):
            frames = {c[0]: c for c in p.components}
            luma = p.components[0][0]
            layout = tuple((c == luma, *(frames[c][1:3] if len(p.scan) > 1 else (1, 1)), p.tables[0, d], p.tables[1, a]) for c, d, a in p.scan)
            groups.setdefault((layout, p.restart), []).append(i)
        for (layout, restart), members in groups.items():
            for a, b in common.pieces([pictures[i].data for i in members], STEP):
                for i, got in zip(members[a:b], self.decode([pictures[i] for i in members[a:b]], layout, restart), strict=True):
                    p = pictures[i]
                    step = p.quant[p.components[0][3]][0]
                    out[i] = np.clip(np.round(got * step / 8.0) + 128, 0, 255).astype(np.uint8)
        return out

    def decode(self, pictures: list[Picture], layout: tuple, restart: int) -> list[np.ndarray]:
        """The luminance DC coefficients of each picture, as rows of blocks."""
        raw, firsts, sizes = [], [], []
        base = 0
        shapes = []
        h0, v0 = next((h, v) for luma, h, v, *_ in layout if luma)
        most_h, most_v = max(x[1] for x in layout), max(x[2] for x in layout)
        for p in pictures:
            across, down = -(-p.width // (8 * most_h)), -(-p.height // (8 * most_v))
            shapes.append((down, across))
            left = across * down
            data = np.frombuffer(p.data, dtype=np.uint8)
            mark = np.flatnonzero(data[:-1] == 0xFF) if len(data) else np.zeros(0, np.int64)
            follow = data[mark + 1]
            stuffed, resets = mark[follow == 0] + 1, mark[(follow & 0xF8) == 0xD0]
            drop = np.zeros(len(data), dtype=bool)
            drop[stuffed] = True
            drop[resets] = drop[resets + 1] = True
            kept = np.cumsum(~drop)
            begin = np.concatenate([[0], kept[resets] if len(resets) else np.zeros(0, np.int64)])
            per = restart or left
            n = -(-left // per)
            if len(begin) < n:
                raise ValueError("a restart interval is missing")
            raw += [data[~drop], np.zeros(8, np.uint8)]
            firsts.append(base + begin[:n])
            sizes.append(np.minimum(per, left - per * np.arange(n)))
            base += len(raw[-2]) + 8
        data, units = np.concatenate(raw), np.concatenate(sizes)
        view = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        at = np.concatenate(firsts).astype(np.int64) * 8
        limit = 8 * (len(data) - 8) + 64
        luma_blocks = h0 * v0
        dc = np.zeros((len(units), int(units.max(initial=0)) * luma_blocks), dtype=np.int32)
        before = np.zeros((len(layout), len(units)), dtype=np.int64)

        def bits16(pos: np.ndarray) -> np.ndarray:
            byte = pos >> 3
            return (((view[byte] << 16) | (view[byte + 1] << 8) | view[byte + 2]) >> (8 - (pos & 7))) & 0xFFFF

        order = np.argsort(-units, kind="stable")  # intervals that end early leave from the back
        at, units, before = at[order], units[order], before
        live = len(units)
        for unit in range(int(units.max(initial=0))):
            while live and units[live - 1] <= unit:
                live -= 1
            pos = at[:live]
            k = 0
            for c, (luma, h, v, dc_table, ac_table) in enumerate(layout):
                symbol, length = self.table(dc_table)
                ac_symbol, ac_length = self.table(ac_table)
                for _ in range(h * v):
                    code = bits16(pos)
                    size, used = symbol[code], length[code]
                    if not used.all() or pos.max(initial=0) > limit:
                        raise ValueError("a code that the table doesn't have")
                    pos = pos + used
                    extra = bits16(pos) >> (16 - size)
                    before[c, :live] += np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
                    pos = pos + size
                    if luma:
                        dc[order[:live], unit * luma_blocks + k] = before[c, :live]
                        k += 1
                    # The AC coefficients are passed over: most blocks end at once, the others step on by themselves.
                    code = bits16(pos)
                    step, used = ac_symbol[code], ac_length[code]
                    if not used.all():
                        raise ValueError("a code that the table doesn't have")
                    pos = pos + used + (step & 15)
                    rest = np.flatnonzero(step)
                    seen = (step[rest] >> 4) + 1
                    while len(rest := rest[seen < 63] if len(rest) else rest):
                        seen = seen[seen < 63]
                        code = bits16(pos[rest])
                        step, used = ac_symbol[code], ac_length[code]
                        if not used.all() or pos.max(initial=0) > limit:
                            raise ValueError("a code that the table doesn't have")
                        pos[rest] += used + (step & 15)
                        seen = np.where(step == 0, 63, seen + (step >> 4) + 1)
            at[:live] = pos
        out, row = [], 0
        per_picture = [len(f) for f in firsts]
        for (down, across), n in zip(shapes, per_picture, strict=True):
            per = restart or down * across
            flat = dc[row : row + n, : per * luma_blocks].reshape(-1)[: down * across * luma_blocks]
            row += n
            out.append(flat.reshape(down, across, v0, h0).transpose(0, 2, 1, 3).reshape(down * v0, across * h0))
        return out


def looks(thumb: np.ndarray) -> str:
    """64 bits of a thumbnail: whether each of 8x8 cells (means of equal parts) is brighter than the mean of cells."""
    if not thumb.size:
        return "0" * 16
    h, w = thumb.shape
    sums = np.zeros((h + 1, w + 1), dtype=np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    y0, x0 = np.arange(8) * h // 8, np.arange(8) * w // 8
    y1, x1 = np.maximum(y0 + 1, np.arange(1, 9) * h // 8), np.maximum(x0 + 1, np.arange(1, 9) * w // 8)
    cell = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    cell = cell / np.outer(y1 - y0, x1 - x0)
    return np.packbits(cell.ravel() > cell.mean()).tobytes().hex()


def store(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `n_bytes` and `media`, the whole text as baseline JPEG (null: the empty text), filled up with zero bytes to
    a positive multiple of 64. A text of over 524,224 bytes becomes several pictures in one file. Equal texts, equal
    media; no rows give no rows; columns called like a result are replaced, others pass (or only those in `keep`)."""

    def make():
        writer = Writer()
        return lambda texts: {"n_bytes": [len(t) for t in texts], "media": writer.write(texts)}

    return common.map_texts(docs, text_col, make, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], keep, piece=STEP)


def read(stored: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Add what the media say: `width`, `height` (of all pictures together, one below the other), `thumbnail` (its
    samples row by row), `thumbnail_hash`. Media that are null or not baseline JPEG have null in all four."""
    fields = [T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("thumbnail", T.BinaryType()), T.StructField("thumbnail_hash", T.StringType())]

    def make():
        reader = Reader()

        def one(media: list[bytes]) -> list[tuple | None]:
            found: list[list[Picture] | None] = []
            for m in media:
                try:
                    found.append(parse(m) or None)
                except (ValueError, IndexError):
                    found.append(None)
            flat = [p for ps in found if ps for p in ps]
            thumbs = iter(reader.thumbnails(flat))
            out: list[tuple | None] = []
            for ps in found:
                if not ps:
                    out.append(None)
                    continue
                own = [next(thumbs) for _ in ps]
                whole = own[0] if len(own) == 1 else np.vstack([np.pad(t, ((0, 0), (0, max(x.shape[1] for x in own) - t.shape[1]))) for t in own])
                out.append((max(p.width for p in ps), sum(p.height for p in ps), whole))
            return out

        def run(media: list[bytes]) -> dict[str, object]:
            try:
                got = one(media)
            except (ValueError, IndexError, KeyError, StopIteration):  # one bad picture spoils a step: each by itself, then
                got = []
                for m in media:
                    try:
                        got += one([m])
                    except (ValueError, IndexError, KeyError, StopIteration):
                        got.append(None)
            return {
                "width": [g and g[0] for g in got], "height": [g and g[1] for g in got],
                "thumbnail": [g and g[2].tobytes() for g in got], "thumbnail_hash": [g and looks(g[2]) for g in got],
            }

        return run

    return common.map_texts(stored, media_col, make, fields, keep, binary=True, piece=STEP)


def digests(stored: DataFrame, keep: list[str]) -> DataFrame:
    """The digest columns of stored media: of the bytes read back, of their last 64, and of the stored form."""
    seen = read(stored, keep=[*keep, "n_bytes", "media"])
    return seen.select(
        *[F.col(f"`{c}`") for c in keep],
        "n_bytes",
        F.octet_length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.substring("thumbnail", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash").alias("feature"),
    )
