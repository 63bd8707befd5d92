"""Media columns: motion-JPEG in AVI.

``encode`` stores bytes as grey frames: each byte is an 8x8 block of one shade, so its sample is the
quantised mean (DC) of the block, which baseline JPEG keeps exactly; any player shows the frames.
``clips`` reads AVI values: it parses the RIFF lists and the index, decodes the intra frames, compares
the histograms of neighbouring frames, and cuts a shot where the difference is far above its recent
mean, which adapts to the material. The result is a row for each clip with its times.

The decoder handles baseline grey JPEG: Huffman tables, quantisation and restart markers as the file
gives them, and any coefficients; the frames of a batch are decoded side by side, one symbol of each
at a time. Other media (colour, progressive, not AVI) give the status ``unsupported``.

Defined cases: a null text is empty, and makes one frame of spaces; a very long text makes as many frames as it takes,
whole; equal bytes, ties and repeated rows give equal media; media without frames give no clip; a null medium has nulls
and no clip; an empty table gives an empty result; further columns are kept, but for those of the names that are added.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices, utf8

#: Blocks of a frame, across and down, and frames a second.
ACROSS, DOWN, RATE = 16, 12, 25
FRAME = ACROSS * DOWN
#: A cut needs this many mean differences, and at least the floor (a part of the samples), over so many frames before.
TIMES, FLOOR, RECENT = 2.0, 0.25, 8

# Code lengths of the DC table for text: differences of 0 to 8 bits. The AC table has the end of block alone.
_DC_LENGTHS = (4, 4, 4, 3, 2, 2, 4, 4, 5)


def canonical(counts: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    """Huffman codes of JPEG: value -> (code, length)."""
    code, at, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for value in values[at : at + n]:
            out[value] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


_VALUES = sorted(range(9), key=lambda v: (_DC_LENGTHS[v], v))
_COUNTS = [_DC_LENGTHS.count(k) for k in range(1, 17)]
_CODES = canonical(_COUNTS, _VALUES)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, bytes([0x00, *_COUNTS, *_VALUES]))
    + _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)

# For a difference of -255..255: its code with its bits and the end of block, and the length of that.
_BITS, _LENGTHS = np.zeros(511, np.uint32), np.zeros(511, np.int64)
for _d in range(-255, 256):
    _n = abs(_d).bit_length()
    _code, _len = _CODES[_n]
    _extra = _d if _d >= 0 else _d + (1 << _n) - 1
    _BITS[_d + 255] = ((_code << _n) | _extra) << 1
    _LENGTHS[_d + 255] = _len + _n + 1


def scans(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded data of frames, a row of samples each."""
    n = len(samples)
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)).ravel() + 255
    bits, lengths = _BITS[diff], _LENGTHS[diff]
    # Each frame starts at a byte; its end is filled with ones.
    per = lengths.reshape(n, -1)
    total = per.sum(1)
    size = (total + 7) // 8
    begin = np.cumsum(size) - size
    at = (begin * 8)[:, None] + np.cumsum(per, axis=1) - per
    at = at.ravel()
    out = np.zeros(int(size.sum()) + 8, np.uint32)
    # A code of up to 14 bits touches three bytes at most.
    word = bits.astype(np.uint64) << (24 - lengths - (at & 7)).astype(np.uint64)
    for k in range(3):
        out[: len(out)] += np.bincount(at // 8 + k, ((word >> np.uint64(16 - 8 * k)) & np.uint64(255)).astype(np.float64), len(out)).astype(np.uint32)
    out = out.astype(np.uint8)
    fill = (begin + size - 1, (1 << (size * 8 - total)) - 1)
    out[fill[0]] |= fill[1].astype(np.uint8)
    stuffed = np.flatnonzero(out == 0xFF)
    ends = begin + size
    shift = np.searchsorted(stuffed, np.concatenate((begin, ends[-1:])))
    raw = np.insert(out, stuffed + 1, 0).tobytes() if len(stuffed) else out.tobytes()
    begin = begin + shift[:-1]
    stop = np.append(begin[1:], ends[-1] + shift[-1])
    return [raw[a:b] for a, b in zip(begin.tolist(), stop.tolist())]


def avi(frames: list[bytes]) -> bytes:
    """An AVI 1.0 file with one video stream and an index."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    group = lambda name, kind, body: name + struct.pack("<I", len(body) + 4) + kind + body
    most = max(map(len, frames))
    wide, high = ACROSS * 8, DOWN * 8
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, wide, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    header = group(b"LIST", b"hdrl", chunk(b"avih", avih) + group(b"LIST", b"strl", chunk(b"strh", strh) + chunk(b"strf", strf)))
    index, at, body = [], 4, []
    for f in frames:
        body.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return group(b"RIFF", b"AVI ", header + group(b"LIST", b"movi", b"".join(body)) + chunk(b"idx1", b"".join(index)))


def padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with spaces up to a positive multiple of a frame's samples, as rows of frames, and the frames of each."""
    sizes = ends - starts
    frames = np.maximum(-(-sizes // FRAME), 1)
    out = np.full(int(frames.sum()) * FRAME, 32, np.uint8)
    begin = (np.cumsum(frames) - frames) * FRAME
    out[ranges(begin, sizes)] = data[ranges(starts, sizes)]
    return out.reshape(-1, FRAME), frames


def encode(docs: DataFrame, column: str = "text", into: str = "media") -> DataFrame:
    """Adds ``into``, the AVI that stores the text's UTF-8 bytes."""
    kept = [c for c in docs.columns if c != into]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{into}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 1 << 20):
            rows, frames = padded(*utf8(batch.column(column)))
            coded = [_HEAD + s + b"\xff\xd9" for s in scans(rows)]
            ends = np.cumsum(frames).tolist()
            media = [avi(coded[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(media, pa.binary())], names=[*kept, into])

    return docs.mapInArrow(run, schema)


# -- reading


class Unsupported(ValueError):
    """Not baseline grey motion-JPEG in AVI."""


def parse(file: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Seconds a frame, and where the frames of the first video stream are, by the index or else by the lists."""
    if len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise Unsupported("no AVI")
    rate, movi, stream, index, plain = 0.0, -1, None, None, []
    open_, number = [(12, min(len(file), 8 + struct.unpack_from("<I", file, 4)[0]))], 0
    while open_:
        at, end = open_.pop()
        while at + 8 <= end:
            name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
            body = at + 8
            if body + size > end:
                raise Unsupported("cut off")
            if name == b"LIST":
                kind = file[body : body + 4]
                if kind == b"movi":
                    movi = body
                open_.append((body + size + (size & 1), end))
                at, end = body + 4, body + size
                continue
            if name == b"strh":
                if stream is None and file[body : body + 4] == b"vids":
                    stream = number
                    scale, per = struct.unpack_from("<II", file, body + 20)
                    rate = scale / per if per else 0.0
                number += 1
            elif name == b"idx1":
                index = (body, size // 16)
            elif name[2:] in (b"dc", b"db"):
                plain.append((name, body, size))
            at = body + size + (size & 1)
    if stream is None:
        raise Unsupported("no video")
    names = (b"%02ddc" % stream, b"%02ddb" % stream)
    if index is None:
        return rate, [(a, n) for name, a, n in plain if name in names]
    entries = [struct.unpack_from("<4sIII", file, index[0] + 16 * i) for i in range(index[1])]
    entries = [e for e in entries if e[0] in names]
    # Offsets count from the list's name, or from the file's start.
    base = movi if entries and file[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0
    return rate, [(base + e[2] + 8, e[3]) for e in entries]


def jpeg_head(frame: bytes) -> tuple[tuple, int]:
    """Tables of a grey baseline JPEG, and where its scan starts."""
    if frame[:2] != b"\xff\xd8":
        raise Unsupported("no JPEG")
    at, quant, huff, shape, restart = 2, {}, {}, None, 0
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = tuple(struct.unpack(">64H", body[1:129]) if wide else body[1:65])
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            if body[0] != 8 or body[5] != 1:
                raise Unsupported("not grey")
            shape = (struct.unpack_from(">HH", body, 1), body[8])
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if shape is None or shape[1] not in quant:
                raise Unsupported("no frame")
            tables = (huff.get(body[2] >> 4), huff.get(0x10 | body[2] & 15))
            if None in tables:
                raise Unsupported("no table")
            return (shape[0], quant[shape[1]], *tables, restart), at + 2 + size
        elif 0xC0 < marker <= 0xCF:
            raise Unsupported("not baseline")
        at += 2 + size
    raise Unsupported("no scan")


def lookup(table: tuple) -> np.ndarray:
    """By the next 16 bits: value * 32 + length of the code; 0 if there is none."""
    out = np.zeros(1 << 16, np.int32)
    for value, (code, length) in canonical(*map(list, table)).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = value * 32 + length
    return out


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) & 1 else i % 8)))
_BASIS = np.array([[(0.5**0.5 if u == 0 else 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def decode(files: list[bytes], places: list[tuple[int, int, int]], head: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Frames that share their tables, side by side. ``places``: file, start of the scan, its end.

    Returns a row of block means for each frame, as 8-bit samples, and whether the frame was sound.
    """
    (high, wide), quant, dc_table, ac_table, restart = head
    blocks = -(-high // 8) * -(-wide // 8)
    each = restart or blocks
    segments: list[bytes] = []
    lanes_of = -(-blocks // each)
    sound = np.ones(len(places), bool)
    for k, (f, a, b) in enumerate(places):
        raw = files[f][a:b]
        end = raw.rfind(b"\xff\xd9")
        raw = raw[:end] if end >= 0 else raw
        parts = [raw]
        if restart:
            for m in range(8):
                raw = raw.replace(bytes([0xFF, 0xD0 + m]), b"\xff\xd0")
            parts = raw.split(b"\xff\xd0")
        if len(parts) != lanes_of:
            sound[k] = False
            parts = [b""] * lanes_of
        segments += [p.replace(b"\xff\x00", b"\xff") for p in parts]
    sizes = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(segments) + b"\xff" * 8, np.uint8)
    # The next 32 bits from every byte.
    words = np.ndarray(len(data) - 3, dtype=">u4", buffer=data, strides=(1,)).astype(np.uint64)
    n = len(segments)
    at = (np.cumsum(sizes) - sizes) * 8
    stop = at + sizes * 8
    dc, ac = lookup(dc_table), lookup(ac_table)
    means = np.zeros((n, each), np.int32)
    level = np.zeros(n, np.int64)
    many = np.minimum(each, blocks - np.arange(n) % lanes_of * each)
    rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # block, place and value of what is more than a mean
    ok = np.ones(n, bool)

    def symbol(lanes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The value, then as many more bits as its low half says, for each lane."""
        spot = np.minimum(at[lanes], len(words) * 8 - 1)
        window = words[spot >> 3] << (spot & 7).astype(np.uint64)
        hit = table[((window >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        length, value = hit & 31, hit >> 5
        ok[lanes] &= length > 0
        extra = value & 15
        spot = np.minimum(at[lanes] + length, len(words) * 8 - 1)
        window = words[spot >> 3] << (spot & 7).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        bits = (window >> (32 - extra).astype(np.uint64)).astype(np.int64)
        at[lanes] += length + extra
        signed = np.where(bits < (1 << np.maximum(extra - 1, 0)), bits - (1 << extra) + 1, bits)
        return value >> 4, extra, np.where(extra > 0, signed, 0)

    for block in range(each):
        lanes = np.flatnonzero(ok & (many > block))
        if not len(lanes):
            break
        _, _, diff = symbol(lanes, dc)
        level[lanes] += diff
        means[lanes, block] = level[lanes]
        place = np.ones(len(lanes), np.int64)
        while len(lanes):
            run, extra, value = symbol(lanes, ac)
            on = (extra > 0) | (run == 15)
            place = place + np.where(on, run, 0)
            some = (extra > 0) & (place < 64)
            if some.any():
                rest.append((lanes[some] * each + block, place[some], value[some]))
            place = place + 1
            go = on & (place < 64) & ok[lanes]
            lanes, place = lanes[go], place[go]
    ok &= at <= stop + 7
    sound &= ok.reshape(-1, lanes_of).all(1)
    samples = means.astype(np.float64) * quant[0] / 8 + 128
    if rest:
        # A block's sample is the mean of its pixels after clipping.
        block, place, value = (np.concatenate(x) for x in zip(*rest))
        own, nth = np.unique(block, return_inverse=True)
        coefficients = np.zeros((len(own), 64))
        coefficients[nth, np.array(_ZIGZAG)[place]] = value * np.array(quant)[place]
        coefficients[:, 0] = means.ravel()[own] * quant[0]
        pixels = _BASIS.T @ coefficients.reshape(-1, 8, 8) @ _BASIS + 128
        samples.ravel()[own] = np.clip(np.rint(pixels), 0, 255).mean((1, 2))
    samples = np.clip(np.rint(samples), 0, 255).astype(np.uint8)
    return samples.reshape(len(places), -1)[:, :blocks], sound


def read(files: list[bytes]) -> list[tuple[str, float, np.ndarray]]:
    """For each AVI: status, seconds a frame, and its frames as rows of samples."""
    by: dict[tuple, list[tuple[int, int, int, int]]] = {}
    rates, counts, status, heads = [], [], [], {}
    for f, file in enumerate(files):
        try:
            rate, frames = parse(file)
            for nth, (a, n) in enumerate(frames):
                if (start := file.find(b"\xff\xda", a, a + n)) < 0:
                    raise Unsupported("no scan")
                start += 2 + struct.unpack_from(">H", file, start + 2)[0]
                key = file[a:start]
                if key not in heads:
                    heads[key] = jpeg_head(key)
                head, size = heads[key]
                by.setdefault(head, []).append((f, nth, a + size, a + n))
            status.append("ok")
        except (Unsupported, struct.error, IndexError):
            rate, frames = 0.0, []
            status.append("unsupported")
        rates.append(rate)
        counts.append(len(frames))
    out = [(status[f], rates[f], [None] * counts[f]) for f in range(len(files))]
    for head, places in by.items():
        rows, sound = decode(files, [(f, a, b) for f, _, a, b in places], head)
        for (f, nth, _, _), row, good in zip(places, rows, sound.tolist()):
            if status[f] == "ok":
                out[f][2][nth] = row if good else None
    return [
        (s, r, np.stack(rows) if rows and len({len(x) for x in rows}) == 1 else np.zeros((0, 0), np.uint8)) if all(x is not None for x in rows) else ("unsupported", r, np.zeros((0, 0), np.uint8))
        for s, r, rows in out
    ]


def shots(frames: np.ndarray) -> list[int]:
    """Frames where shots start: the histogram differs from the frame before by much more than lately."""
    if not len(frames):
        return []
    n = len(frames)
    bins = frames.astype(np.int64) >> 4
    hist = np.bincount((bins + 16 * np.arange(n)[:, None]).ravel(), minlength=16 * n).reshape(n, 16)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * frames.shape[1])
    total = np.concatenate(([0.0], np.cumsum(diff)))
    k = np.arange(len(diff))
    low = np.maximum(k - RECENT, 0)
    mean = (total[k] - total[low]) / np.maximum(k - low, 1)  # nothing lately before the second frame: 0
    return [0, *((np.flatnonzero((diff > FLOOR) & (diff > TIMES * mean)) + 1).tolist())]


READ = "status string, samples binary, clips array<struct<clip: int, first_frame: int, n_frames: int, start_s: double, end_s: double>>"


def described(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds status, samples (all frames, decoded) and clips (the shots with their times); a null medium has nulls."""
    added = ("status", "samples", "clips")
    kept = [c for c in media.columns if c not in added]
    schema = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept), READ])
    clip = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 2 << 20):
            files = [bytes(x) if x is not None else None for x in batch.column(column).to_pylist()]
            found = iter(read([f for f in files if f is not None]))
            status, samples, cuts = [], [], []
            for f in files:
                state, rate, frames = next(found) if f is not None else (None, 0.0, None)
                good = state == "ok"
                begins = shots(frames) if good else []
                status.append(state)
                samples.append(frames.tobytes() if good else None)
                bounds = zip(begins, [*begins[1:], len(frames) if good else 0])
                cuts.append([{"clip": i, "first_frame": a, "n_frames": b - a, "start_s": a * rate, "end_s": b * rate} for i, (a, b) in enumerate(bounds)] if good else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(status, pa.string()), pa.array(samples, pa.binary()), pa.array(cuts, pa.list_(clip))], names=[*kept, *added]
            )

    return media.select(*kept).mapInArrow(run, schema)


def clips(media: DataFrame, column: str = "media") -> DataFrame:
    """Timed clip rows: the other columns, clip, first_frame, n_frames, start_s, end_s and samples of the clip."""
    out = described(media, column)
    added = ["clip", "first_frame", "n_frames", "start_s", "end_s"]
    others = [c for c in media.columns if c not in (column, "status", "samples", "clips", *added)]
    size = F.octet_length("samples") / F.greatest(F.element_at("clips", -1)["first_frame"] + F.element_at("clips", -1)["n_frames"], F.lit(1))
    cut = F.transform("clips", lambda c: F.struct(*(c[f].alias(f) for f in added), F.substring("samples", c["first_frame"] * size.cast("int") + 1, c["n_frames"] * size.cast("int")).alias("samples")))
    return out.select(*others, F.inline(cut))


def feature(cuts: Column) -> Column:
    """The shots as text: first frame + number of frames, joined by commas."""
    return F.array_join(F.transform(cuts, lambda c: F.concat(c["first_frame"].cast("string"), F.lit("+"), c["n_frames"].cast("string"))), ",")
