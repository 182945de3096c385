"""GIF media: frames of 8-bit samples, written and read with numpy and the LZW code streams of GIF89a.

The reader takes any GIF: global and local palettes, interlacing, code sizes of 2 to 8 bits, deferred clear codes,
timed frames, transparency, and the disposal rules (keep, background, previous). It yields each frame's samples and the
canvas as shown. Code widths depend on a code's place after the last clear code only, so codes are cut out all at once.

Payloads of documents are stored as grey samples 64 wide, up to 1024 rows a frame, each frame shown for 0.1 s and then
restored to the background. Features are colour histograms of the canvas: 16 ranges of red, of green and of blue.

Defined results: null text is stored as empty, 64 zero bytes; bytes that aren't UTF-8 are stored as U+FFFD; equal texts
give equal values; repeated rows are stored
each; other columns are ignored. Damaged input is a ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agendum.llm.common import by_bytes, text_of, utf8

WIDTH, ROWS, DELAY = 64, 1024, 10
BINS = 16
_SINGLE = [bytes([i]) for i in range(256)]


#: Codes whose places are worked out at a time; more than fill a table.
_MANY = 4400


@lru_cache(maxsize=8)
def _places(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the first codes after a clear code, and where each begins: the decoder's table grows by one a code
    from the second on."""
    size = (1 << bits) + 2 + np.maximum(np.arange(_MANY) - 1, 0)
    widths = np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, bits + 1, 12)
    return widths, np.cumsum(widths) - widths


def lzw_codes(samples: bytes) -> list[np.ndarray]:
    """8-bit samples as codes, in runs that each start after a clear code; the table is cleared when it's full."""
    runs, out, table = [], [], {}
    get, put = table.get, out.append
    new, prefix = 258 << 8, samples[0] << 8  # codes are kept eight bits up, so that a sample can be joined to them
    for sample in samples[1:]:
        if (code := get(prefix | sample)) is not None:
            prefix = code
            continue
        put(prefix)
        if new < 4096 << 8:
            table[prefix | sample] = new
            new += 256
        else:
            runs.append(np.array(out, np.uint64) >> np.uint64(8))
            out, table, new = [], {}, 258 << 8
            get, put = table.get, out.append
        prefix = sample << 8
    put(prefix)
    return [*runs, np.array(out, np.uint64) >> np.uint64(8)]


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples, without its sub-blocks."""
    clear, end = np.array([256], np.uint64), np.array([257], np.uint64)
    codes, widths = [clear], [np.array([9])]
    runs = lzw_codes(samples)
    for i, run in enumerate(runs, 1):
        codes += [run, end if i == len(runs) else clear]
        widths.append(_places(8)[0][: len(run) + 1])
    code, width = np.concatenate(codes), np.concatenate(widths)
    at = np.cumsum(width) - width
    value = code << (at & 7).astype(np.uint64)
    out, size = 0.0, int(at[-1] + width[-1] + 7) // 8 + 3
    for k in range(3):  # bits of codes never overlap, so sums join them
        out = out + np.bincount((at >> 3) + k, (value >> np.uint64(8 * k)) & np.uint64(255), size)
    return out.astype(np.uint8)[:-3].tobytes()


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """The samples of a code stream; ends at its end code, its end, or `most` samples."""
    clear, stop = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    total, at, got, out = 8 * len(data), 0, 0, []
    widths, starts = _places(bits)
    while at + bits < total and got < most:
        parts, size, later = [], 0, at
        while True:  # until the next clear or end code
            if not size:
                place, width = at + starts, widths
            else:  # the table is full, and 12 bits go on until it's cleared
                place, width = later + 12 * np.arange(_MANY), np.full(_MANY, 12)
            fits = int(np.searchsorted(place + width, total, "right"))
            place, width = place[:fits], width[:fits]
            part = window[place >> 3] >> (place & 7).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)
            ends = np.flatnonzero((part == clear) | (part == stop))
            n = int(ends[0]) if len(ends) else len(part)
            parts.append(part[:n])
            size += n
            later = int(place[n] + width[n]) if n < len(part) else int(place[-1] + width[-1]) if len(part) else total
            if len(ends) or len(part) < _MANY:
                break
        at = later
        ended = not len(ends) or part[n] == stop
        codes = np.concatenate(parts)
        if len(codes):
            if codes[0] >= clear or (codes[1:] > clear + 2 + np.minimum(np.arange(len(codes) - 1), 4093 - clear)).any():
                raise ValueError("a code is out of range")
            got += _expand(codes.tolist(), clear, out)
        if ended:
            break
    return b"".join(out)[:most]


def _expand(codes: list[int], clear: int, out: list[bytes]) -> int:
    """Adds what the codes after a clear code stand for, and returns how much that is."""
    table = [*_SINGLE[:clear], b"", b""]
    add, before = table.append, len(out)
    put = out.append
    last = table[codes[0]]
    put(last)
    grown = 1 + 4096 - len(table)
    for code in codes[1:grown]:
        try:
            now = table[code]
        except IndexError:  # the entry that this very code completes
            now = last + last[:1]
        add(last + now[:1])
        put(now)
        last = now
    out += [table[code] for code in codes[grown:]]
    return sum(map(len, out[before:]))


def blocks(data: bytes) -> bytes:
    """Data in sub-blocks of at most 255 bytes, with the empty one that ends them."""
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_grey(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as a GIF of grey frames."""
    rows = len(payload) // WIDTH
    grey = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), grey]
    for i in range(0, rows, ROWS):
        part = payload[i * WIDTH : (i + ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2, DELAY, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """samples: palette indices of the frame's own area; canvas: RGBA of the whole screen as shown."""

    samples: np.ndarray
    canvas: np.ndarray
    delay_ms: int
    left: int
    top: int


def read(media: bytes) -> Iterator[Frame]:
    """The timed frames of a GIF."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        """256 packed RGBA colours; what the file doesn't name is black."""
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        at += 3 * n
        out = np.zeros((256, 4), np.uint8)
        out[:, 3] = 255
        out[:n, :3] = np.frombuffer(media, np.uint8, 3 * n, at - 3 * n).reshape(n, 3)
        return out.view(np.uint32)[:, 0]

    def joined() -> bytes:
        nonlocal at
        out = []
        while n := media[at]:
            out.append(media[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(out)

    common = palette(flags)
    canvas = np.zeros((height, width), np.uint32)
    disposal, delay, clear = 0, 0, None
    while at < len(media) and media[at] != 0x3B:
        kind = media[at]
        at += 1
        if kind == 0x21:
            label = media[at]
            at += 1
            body = joined()
            if label == 0xF9 and len(body) >= 4:
                own, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = own >> 2 & 7, index if own & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, own = struct.unpack_from("<HHHHB", media, at)
        at += 9
        local = palette(own)
        colours = local if local is not None else common
        bits = media[at]
        at += 1
        flat = lzw_decode(joined(), bits, w * h)
        samples = np.zeros(w * h, np.uint8)
        samples[: len(flat)] = np.frombuffer(flat, np.uint8)
        samples = samples.reshape(h, w)
        if own & 0x40:
            order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
            samples = samples[np.argsort(order)]
        if colours is None:
            raise ValueError("no palette")
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        shown = samples[: area.shape[0], : area.shape[1]]
        np.copyto(area, colours[shown], where=True if clear is None else shown != clear)
        yield Frame(samples, canvas.copy().view(np.uint8).reshape(height, width, 4), 10 * delay, left, top)
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear = 0, 0, None


CHANNELS = ("red", "green", "blue")


def histograms(canvas: np.ndarray) -> dict[str, list[int]]:
    """Counts of the shown pixels by red, by green and by blue, in BINS ranges each."""
    colours, counts = np.unique(canvas.reshape(-1, 4).view(np.uint32)[:, 0], return_counts=True)
    *colour, opaque = colours.view(np.uint8).reshape(-1, 4).T.astype(np.int64)
    return {c: np.bincount(x * BINS // 256, counts * (opaque > 0), BINS).astype(np.int64).tolist() for c, x in zip(CHANNELS, colour, strict=True)}


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 if text else 64)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(1))]
            for i, j in by_bytes(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array([write_grey(padded(t)) for t in texts[i:j]], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAMES = "frames array<struct<at_ms: long, delay_ms: int, left: int, top: int, width: int, height: int, red: array<long>, green: array<long>, blue: array<long>>>"


def load(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, frames): the samples of all frames in order, and what each frame shows."""
    kind = pa.list_(pa.struct([("at_ms", pa.int64()), *((x, pa.int32()) for x in ("delay_ms", "left", "top", "width", "height")), *((x, pa.list_(pa.int64())) for x in CHANNELS)]))

    def one(media: bytes | None) -> tuple[bytes, list[dict]]:
        samples, frames, now = [], [], 0
        for f in read(media) if media is not None else ():
            samples.append(f.samples.tobytes())
            h, w = f.samples.shape
            frames.append({"at_ms": now, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": w, "height": h, **histograms(f.canvas)})
            now += f.delay_ms
        return b"".join(samples), frames

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            for i, j in by_bytes(media):
                found = [one(x) for x in media[i:j]]
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns] + [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], kind)], ["doc_id", "n_bytes", "media", "payload", "frames"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, media binary, payload binary, {FRAMES}")
