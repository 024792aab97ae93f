"""Media columns: bytes stored as animated GIF, decoded to timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import stored, table

WIDTH = 192
MAX_ROWS = 256
DELAY_CS = 10
#: The palette of stored payloads: grey level i for index i.
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def lzw_pack(data: bytes, bits: int = 8) -> bytes:
    """The code stream of a GIF image: variable-width LZW codes, least significant bit first."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, starts = [clear], []  # starts: places of the codes after which the table is empty
    put, rest = codes.append, iter(data)
    prefix = next(rest, -1)
    while prefix >= 0:
        known: dict[int, int] = {}
        free = end + 1
        for byte in rest:
            key = prefix << 8 | byte
            if key in known:
                prefix = known[key]
                continue
            put(prefix)
            prefix = byte
            if free == 4096:
                put(clear)
                starts.append(len(codes) - 1)
                break
            known[key] = free
            free += 1
        else:
            put(prefix)
            break
    put(end)
    values = np.array(codes, dtype=np.uint16)
    # the decoder's table has one entry less than the codes since the clear code, and widths follow it
    widths = [WIDTHS[bits][:1]]
    for at, upto in zip([0, *starts], [*starts, len(values) - 1], strict=True):
        widths.append(WIDTHS[bits][: upto - at])
    return pack_bits(values, np.concatenate(widths))


def code_widths(bits: int, n: int = 4200) -> np.ndarray:
    """Widths of the first n codes after a clear code."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)  # table size when the code is read
    sizes = np.array([1 << w for w in range(bits + 1, 12)])
    return np.minimum(bits + 1 + np.searchsorted(sizes, entries, side="right"), 12)


WIDTHS = {bits: code_widths(bits) for bits in range(2, 9)}
OFFSETS = {bits: np.concatenate([[0], np.cumsum(w)[:-1]]) for bits, w in WIDTHS.items()}


def pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    places = np.arange(12)
    bits = (values[:, None] >> places.astype(np.uint16)) & 1
    return np.packbits(bits[places < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_unpack(stream: bytes, bits: int, limit: int) -> bytes:
    """Bytes of a code stream; ends at the end code, the end of the stream or limit bytes. Bad codes raise ValueError."""
    if bits not in OFFSETS:
        raise ValueError("a code size that no palette has")
    clear, end = 1 << bits, (1 << bits) + 1
    flat = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    windows = flat[:-2] | flat[1:-1] << np.uint32(8) | flat[2:] << np.uint32(16)
    total, bit = len(stream) * 8, 0
    parts: list[np.ndarray] = []
    stretch: list[np.ndarray] = []
    got, ended = 0, False
    while bit < total and got < limit and not ended:
        # codes until the next clear code have known widths, so whole stretches are cut out at once
        n = (total - bit) // (bits + 1) + 1
        begin = bit + (np.arange(min(n, 4200)) * 12 if stretch else OFFSETS[bits][:n])
        wide = np.full(len(begin), 12) if stretch else WIDTHS[bits][:n]
        fits = int(np.searchsorted(begin + wide, total, side="right"))
        if not fits:
            break
        begin, wide = begin[:fits], wide[:fits]
        codes = (windows[begin >> 3] >> (begin & 7).astype(np.uint32)).astype(np.int64) & ((1 << wide) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else fits
        stretch.append(codes[:stop])
        last = min(stop, fits - 1)
        bit = int(begin[last] + wide[last])
        if stop < fits:
            parts.append(unfold(np.concatenate(stretch), clear))
            got += len(parts[-1])
            stretch, ended = [], codes[stop] == end
    if stretch:
        parts.append(unfold(np.concatenate(stretch), clear))
    return b"".join(x.tobytes() for x in parts)[:limit]


def unfold(codes: np.ndarray, clear: int) -> np.ndarray:
    """Bytes of the codes between two clear codes.

    Code clear + 2 + t repeats what step t wrote and one byte more, so every written byte is a literal or points to
    an earlier one; following pointers in doubling steps resolves all of them at once.
    """
    if not len(codes):
        return np.zeros(0, np.uint8)
    steps = np.arange(len(codes))
    origin = np.where(codes < clear, steps, codes - clear - 2)
    if ((origin >= steps) & (codes >= clear)).any():
        raise ValueError("a code lies beyond the table")
    length, jump = np.where(codes < clear, 0, 1), origin
    while length[jump].any():
        length, jump = length + length[jump], jump[jump]
    length += 1
    ends = np.cumsum(length)
    begins = ends - length
    places = np.arange(int(ends[-1]))
    source = places + np.repeat(begins[origin] - begins, length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    literal = np.zeros(len(places), np.uint8)
    plain = codes < clear
    literal[begins[plain]] = codes[plain]
    return literal[source]


def sub_blocks(data: bytes) -> bytes:
    parts = [bytes([len(x)]) + x for i in range(0, len(data), 255) if (x := data[i : i + 255])]
    return b"".join(parts) + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, max_rows: int = MAX_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A grey GIF whose frames hold payload row by row; len(payload) is a positive multiple of width."""
    rows = len(payload) // width
    head = b"GIF89a" + struct.pack("<HHBBB", width, min(rows, max_rows), 0xF7, 0, 0) + GREY
    parts = [head]
    for top in range(0, rows, max_rows):
        high = min(max_rows, rows - top)
        pixels = payload[top * width : (top + high) * width]
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay_cs, 0, 0))
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, high, 0) + b"\x08" + sub_blocks(lzw_pack(pixels)))
    return b"".join(parts) + b"\x3b"


def read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := data[at]) != 0:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> list[dict]:
    """Frames of a GIF: left, top, width, height, start_ms, delay_ms, indices (of the frame itself) and canvas, the
    RGB picture shown after palette, transparency and the earlier frames' disposal. Bad files, cut ones included, raise
    ValueError. All frames of a file are held at once."""
    try:
        return _frames(data)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF that ends too early or points beyond its end") from e


def _frames(data: bytes) -> list[dict]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    wide, high, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    shared = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    ground = shared[back] if shared is not None and back < len(shared) else np.zeros(3, np.uint8)
    canvas = np.broadcast_to(ground, (high, wide, 3)).copy()
    frames, clock = [], 0
    delay, disposal, clear_index = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            body, after = read_blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                control, delay, clear = struct.unpack_from("<BHB", body)
                disposal, clear_index = control >> 2 & 7, clear if control & 1 else -1
            at = after
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if colours is None:
            raise ValueError("no palette")
        bits = data[at]
        stream, at = read_blocks(data, at + 1)
        indices = np.frombuffer(lzw_unpack(stream, bits, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:  # rows of an interlaced image come in four passes
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        shown = indices[: part.shape[0], : part.shape[1]]
        seen = colours[np.minimum(shown, len(colours) - 1)]
        part[...] = np.where((shown == clear_index)[..., None], part, seen)
        frames.append({"left": left, "top": top, "width": w, "height": h, "start_ms": clock, "delay_ms": delay * 10, "indices": indices, "canvas": canvas.copy()})
        clock += delay * 10
        if disposal == 2:
            part[...] = ground
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, -1
    return frames


def colour_histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of the 64 colours that two bits of each channel tell apart."""
    two = rgb.reshape(-1, 3) >> 6
    return np.bincount((two[:, 0].astype(np.int64) << 4) | (two[:, 1] << 2) | two[:, 2], minlength=64)


def padded(raw: bytes, unit: int = WIDTH) -> bytes:
    return raw + b" " * (-len(raw) % unit if raw else unit)


def gif_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): texts as UTF-8, padded with spaces to whole rows of 192 samples, stored as GIF.

    Null and empty texts become one row of spaces; texts over 256 rows become several frames; repeated rows stay;
    equal texts give equal media; other columns are left behind, so names cannot clash.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                some = batch.iloc[lo : lo + 500]
                raws = [b"" if t is None else t.encode() for t in some["_text"]]
                yield pd.DataFrame({"_id": some["_id"], "n_bytes": [len(x) for x in raws], "media": [encode_gif(padded(x)) for x in raws]})

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInPandas(encode, f"_id {kind}, n_bytes long, media binary").withColumnRenamed("_id", id_col)


def gif_frames(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame of each GIF: id, frame, start_ms, delay_ms, left, top, width, height, rgb (the whole
    picture shown), histogram (64 colours). Null media give no rows; damaged files raise."""
    kind = df.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, media in zip(batch["_id"], batch["_media"], strict=True):
                if media is None:
                    continue
                frames = decode_gif(bytes(media))
                yield pd.DataFrame(
                    [
                        {"_id": doc, "frame": k, **{c: f[c] for c in ("start_ms", "delay_ms", "left", "top", "width", "height")}, "rgb": f["canvas"].tobytes(), "histogram": colour_histogram(f["canvas"]).tolist()}
                        for k, f in enumerate(frames)
                    ]
                )

    rows = df.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_media"))
    schema = f"_id {kind}, frame int, start_ms long, delay_ms long, left int, top int, width int, height int, rgb binary, histogram array<long>"
    return rows.mapInPandas(decode, schema).withColumnRenamed("_id", id_col)


def media_digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of gif_column's rows, from the decoded bytes of each stored file. Rows without media have NULL
    digests."""
    kind = df.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, n, media in zip(batch["_id"], batch["n_bytes"], batch["media"], strict=True):
                if media is None:
                    rows.append((doc, None if pd.isna(n) else int(n), *[None] * 8))
                    continue
                media = bytes(media)
                frames = decode_gif(media)
                counts = np.zeros(64, np.int64)
                for f in frames:
                    counts += colour_histogram(f["canvas"][f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"]])
                payload = b"".join(f["canvas"][f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"], 0].tobytes() for f in frames)
                grey = counts[[0, 21, 42, 63]]
                feature = f"frames={len(frames)};ms={frames[-1]['start_ms'] + frames[-1]['delay_ms']};hist={','.join(map(str, grey))}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), grey.tolist()))
            yield pd.DataFrame(rows, columns=["_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "grey_histogram"])

    schema = f"_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, grey_histogram array<long>"
    return df.withColumnRenamed(id_col, "_id").select("_id", "n_bytes", "media").mapInPandas(digest, schema).withColumnRenamed("_id", id_col)


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(gif_column(table(spark, sf_dir, "documents")), "gif-media")
    return media_digest(media)
