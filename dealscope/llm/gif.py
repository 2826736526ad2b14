"""GIF: writing samples losslessly, and reading files back as timed frames.

The writer stores 8-bit samples as palette indices, compressed by LZW with growing
codes and a clear when the table is full.  How wide a code is follows from its place
after the last clear alone, so codes are packed and unpacked by numpy, and only the
string table is kept code by code.  Frames are composed on the canvas with palettes,
transparency and disposal, one at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscope.llm.shared import given_id, held_id

WIDTH = 64
#: Fixed values of the format: entries of a full string table, and bits of its codes.
FULL, WIDEST = 4096, 12
#: Pixels of a canvas or a picture block that are decoded unless a caller says otherwise; four bytes each.
MOST_PIXELS = 1 << 25


class TooLarge(ValueError):
    """A file claims more pixels than are to be decoded; ``canvas`` is its width and height."""

    def __init__(self, width: int, height: int):
        super().__init__(f"a canvas of {width} x {height}")
        self.canvas = (width, height)


@dataclass
class Frame:
    """A picture block: where it lies, its samples, and how it is shown."""

    left: int
    top: int
    samples: np.ndarray  # (height, width) palette indices
    palette: np.ndarray  # (n, 3)
    delay: int = 0  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


def grey() -> np.ndarray:
    return np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def _regions(least: int) -> Iterator[tuple[int, int]]:
    """(width, number) of the codes after a clear, in turn; the last width goes on for ever."""
    yield least + 1, (1 << least) - 1
    for width in range(least + 2, WIDEST):
        yield width, 1 << (width - 1)
    while True:
        yield WIDEST, FULL


def _widths(n: int, least: int) -> np.ndarray:
    found, left = [], n
    for width, number in _regions(least):
        found.append(np.full(min(number, left), width, np.int64))
        left -= len(found[-1])
        if not left:
            return np.concatenate(found)
    raise AssertionError


def compressed(samples: bytes) -> bytes:
    """The LZW stream of 8-bit samples."""
    clear, stop, first = 256, 257, 258
    codes, begins = [clear], [1]
    add, n, table = codes.append, first, {}
    get = table.get
    rest = iter(samples)
    run = next(rest, None)
    for s in rest:
        longer = run << 8 | s
        code = get(longer)
        if code is not None:
            run = code
            continue
        add(run)
        table[longer] = n
        n += 1
        run = s
        if n == FULL:
            add(clear)
            begins.append(len(codes))
            table.clear()
            n = first
    if run is not None:
        add(run)
    add(stop)
    held = np.array(codes, np.int64)
    widths = np.concatenate([[9], *(_widths(b - a, 8) for a, b in zip(begins, [*begins[1:], len(codes)], strict=True))])
    at = np.cumsum(widths) - widths
    bits = np.zeros(int(widths.sum()), np.uint8)
    for k in range(WIDEST):
        wide = widths > k
        bits[at[wide] + k] = held[wide] >> k & 1
    return np.packbits(bits, bitorder="little").tobytes()


def write(frames: list[Frame], width: int, height: int) -> bytes:
    """A GIF89a file; the first frame's palette is the global one, others are local."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), frames[0].palette.tobytes()]
    for f in frames:
        flags = (f.disposal << 2) | (f.transparent is not None)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, f.delay, f.transparent or 0, 0))
        h, w = f.samples.shape
        own = not np.array_equal(f.palette, frames[0].palette)
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, w, h, 0x87 if own else 0))
        if own:
            out.append(f.palette.tobytes())
        data = compressed(f.samples.tobytes())
        out.append(b"\x08")
        out += [bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def unpacked(data: bytes, least: int, n: int) -> np.ndarray:
    """``n`` samples of an LZW stream, 0 where it gives fewer; ``least`` is its smallest code size in bits."""
    clear, stop = 1 << least, (1 << least) + 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    parts: list[bytes] = []
    done, at, total = 0, 0, len(bits)
    single = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, size, before, ended = single.copy(), clear + 2, b"", False
    while not ended:
        # from a clear to the next one, region by region
        for width, number in _regions(least):
            span = min(number, (total - at) // width)
            codes = bits[at : at + span * width].reshape(span, width) @ (1 << np.arange(width))
            marks = np.flatnonzero((codes == clear) | (codes == stop))
            k = int(marks[0]) if len(marks) else span
            for code in codes[:k].tolist():
                if code < size:
                    entry = table[code]
                elif before and code == size:
                    entry = before + before[:1]
                else:
                    ended = True
                    break
                parts.append(entry)
                done += len(entry)
                if done >= n:
                    ended = True
                    break
                if before and size < FULL:
                    table.append(before + entry[:1])
                    size += 1
                before = entry
            at += (k + bool(len(marks))) * width
            if ended or len(marks) or span < number:
                ended = ended or not len(marks) or codes[k] == stop
                break
        table, size, before = single.copy(), clear + 2, b""
    out = np.zeros(n, np.uint8)
    found = np.frombuffer(b"".join(parts), np.uint8)[:n]
    out[: len(found)] = found
    return out


class _CutOff(Exception):
    """The file ends, or goes wrong, here."""


@dataclass
class _Bytes:
    data: bytes
    at: int = 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _CutOff
        self.at += n
        return self.data[self.at - n : self.at]

    def fields(self, form: str) -> tuple[int, ...]:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def palette(self, flags: int) -> np.ndarray:
        return np.frombuffer(self.take(6 << (flags & 7)), np.uint8).reshape(-1, 3)

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)


def opened(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[int, int, Iterator[Frame]]:
    """Width and height of the canvas of a GIF file, and its picture blocks, read as they are asked for.

    A file that breaks off or goes wrong gives the frames before that; one that is cut off
    before its canvas is known has size 0 and no frames.  A canvas or picture of more than
    ``most_pixels`` raises :class:`TooLarge`, when it is come to.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    b = _Bytes(data, 6)
    try:
        width, height, flags, _, _ = b.fields("<HHBBB")
        common = b.palette(flags) if flags & 0x80 else grey()
    except _CutOff:
        return 0, 0, iter(())
    if width * height > most_pixels:
        raise TooLarge(width, height)
    return width, height, _frames(b, common, most_pixels, (width, height))


def _frames(b: _Bytes, common: np.ndarray, most_pixels: int, canvas: tuple[int, int]) -> Iterator[Frame]:
    delay, disposal, transparent = 0, 0, None
    try:
        while (kind := b.take(1)[0]) in (0x21, 0x2C):
            if kind == 0x21:
                label, body = b.take(1)[0], b.blocks()
                if label == 0xF9 and len(body) >= 4:
                    control, delay, index = struct.unpack_from("<BHB", body)
                    disposal, transparent = control >> 2 & 7, index if control & 1 else None
                continue
            left, top, w, h, flags = b.fields("<HHHHB")
            palette = b.palette(flags) if flags & 0x80 else common
            least, stream = b.take(1)[0], b.blocks()
            if not 1 <= least <= 8:
                return
            if w * h > most_pixels:
                raise TooLarge(*canvas)
            samples = unpacked(stream, least, w * h).reshape(h, w)
            if flags & 0x40:
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                samples = samples[np.argsort(order)]
            yield Frame(left, top, samples, palette, delay, disposal, transparent)
            delay, disposal, transparent = 0, 0, None
    except _CutOff:
        return


def read(data: bytes, most_pixels: int = MOST_PIXELS) -> Gif:
    """All picture blocks of a GIF file, as :func:`opened` gives them, up to one that is too large."""
    found: list[Frame] = []
    try:
        width, height, frames = opened(data, most_pixels)
        found.extend(frames)
    except TooLarge as e:
        width, height = e.canvas
    return Gif(width, height, found)


def shown(width: int, height: int, frames: Iterable[Frame]) -> Iterator[tuple[Frame, int, np.ndarray]]:
    """(frame, start, RGBA canvas) of every frame in turn; start is in hundredths of a second."""
    canvas = np.zeros((height, width, 4), np.uint8)
    clock = 0
    for f in frames:
        h, w = f.samples.shape
        area = (slice(f.top, max(f.top, min(f.top + h, height))), slice(f.left, max(f.left, min(f.left + w, width))))
        samples = f.samples[: area[0].stop - f.top, : area[1].stop - f.left]
        before = canvas[area].copy()
        samples = samples[: before.shape[0], : before.shape[1]]
        colour = np.full((*samples.shape, 4), 255, np.uint8)
        colour[..., :3] = f.palette[np.minimum(samples, len(f.palette) - 1)]
        seen = np.ones(samples.shape, bool) if f.transparent is None else samples != f.transparent
        canvas[area] = np.where(seen[..., None], colour, before)
        yield f, clock, canvas.copy()
        clock += f.delay
        if f.disposal == 2:
            canvas[area] = 0
        elif f.disposal == 3:
            canvas[area] = before


def histogram(canvas: np.ndarray, levels: int = 4) -> np.ndarray:
    """Visible pixels by red, green and blue level: levels ** 3 counts."""
    rgb = canvas[canvas[..., 3] > 0][:, :3].astype(np.int64) * levels // 256
    return np.bincount((rgb[:, 0] * levels + rgb[:, 1]) * levels + rgb[:, 2], minlength=levels**3)


def payload_to_gif(payload: bytes, rows: int = 1024, delay: int = 4) -> bytes:
    """Samples (a multiple of WIDTH) as grey frames of up to ``rows`` rows, one after the other."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [Frame(0, 0, samples[k : k + rows], grey(), delay) for k in range(0, len(samples), rows)]
    return write(frames, WIDTH, min(rows, len(samples)))


def gif_to_payload(data: bytes) -> tuple[bytes, int, np.ndarray, bool]:
    """The samples of all frames as they are shown, the number of frames, their summed colour histogram, and whether a frame too large ended it."""
    parts, counts = [], np.zeros(64, np.int64)
    try:
        for f, _, canvas in shown(*opened(data)):
            h, w = f.samples.shape
            seen = canvas[f.top : f.top + h, f.left : f.left + w]
            parts.append(seen[..., 0].tobytes())
            counts += histogram(seen)
    except TooLarge:
        return b"".join(parts), len(parts), counts, True
    return b"".join(parts), len(parts), counts, False


def decode_frames(media: DataFrame, id_col: str, bytes_col: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row a frame: id, frame, start, delay, width, height, rgba, histogram, left_out.

    ``start`` and ``delay`` are hundredths of a second; ``rgba`` is the composed canvas
    and ``histogram`` its 64 colour counts.  Null and empty bytes, and bytes that
    are no GIF, have no frames; a file that is cut off or goes wrong has the frames before
    that.  Where a canvas or picture has more than ``most_pixels``, a row with ``left_out`` true and without rgba and histogram says
    from which frame on the file was not decoded.  Repeated rows give repeated frames; other columns
    are ignored; an empty table gives no rows.
    """
    source = media.select(held_id(media, id_col).alias("id"), F.col(bytes_col).alias("data"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, data in zip(pdf["id"], pdf["data"], strict=True):
                if not data or bytes(data[:6]) not in (b"GIF87a", b"GIF89a"):
                    continue
                columns = ["id", "frame", "start", "delay", "width", "height", "rgba", "histogram", "left_out"]
                seen, clock = 0, 0
                try:
                    width, height, frames = opened(bytes(data), most_pixels)
                    for f, start, canvas in shown(width, height, frames):
                        yield pd.DataFrame([(i, seen, start, f.delay, width, height, canvas.tobytes(), histogram(canvas), False)], columns=columns)
                        seen, clock = seen + 1, start + f.delay
                except TooLarge as e:
                    yield pd.DataFrame([(i, seen, clock, 0, *e.canvas, None, None, True)], columns=columns)

    out = source.mapInPandas(run, f"id {kind}, frame int, start int, delay int, width int, height int, rgba binary, histogram array<long>, left_out boolean")
    return out.withColumn("id", given_id(out)).withColumnRenamed("id", id_col)


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text stored as the samples of a GIF.

    Null texts are empty; the bytes are filled up with 0 to a positive multiple of
    WIDTH.  Repeated rows give repeated results; other columns are ignored.
    """
    source = docs.select(held_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            media = [payload_to_gif(r + b"\0" * (-len(r) % WIDTH or (0 if r else WIDTH))) for r in raws]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [len(r) for r in raws], "media": media})

    out = source.mapInPandas(run, f"id {kind}, n_bytes long, media binary")
    return out.withColumn("id", given_id(out)).withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a stored text, from its bytes: sizes, digests and the feature string.

    The samples are read back through the decoder and the shown frames; the feature is the number
    of decoded frames and the number of samples in each of the colour histogram's used
    cells, which on grey levels are four.  Bytes that are no GIF, and null, hold no
    samples; null has no media_bytes and no media_sha256, and a null n_bytes is 0.  Repeated rows
    give repeated results; other columns are ignored; an empty table gives no rows.
    """
    kind = media.schema[id_col].dataType.simpleString()
    source = media.select(held_id(media, id_col).alias("id"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), "media")
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, n, data in zip(pdf["id"], pdf["n_bytes"], pdf["media"], strict=True):
                data = None if data is None else bytes(data)
                is_gif = data is not None and data[:6] in (b"GIF87a", b"GIF89a")
                payload, frames, counts, left_out = gif_to_payload(data) if is_gif else (b"", 0, np.zeros(64, np.int64), False)
                cells = ",".join(f"{k}:{c}" for k, c in enumerate(counts.tolist()) if c)
                own = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), *own, f"frames={frames};hist={cells}{';left_out' if left_out else ''}"))
            yield pd.DataFrame(rows, columns=names).astype({"media_bytes": "Int64"})

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = source.mapInPandas(run, schema)
    return out.withColumn("id", given_id(out)).withColumnRenamed("id", id_col)
