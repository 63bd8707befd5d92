"""Motion-JPEG in AVI: round trips, a decoder of its own for comparison, shots and odd media."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import media


def payload(text):
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))


TEXTS = ["", None, "x", "plain words " * 40, "é" * 96, "ÿ\x00\x7f" * 100, "\U0010ffff" * 500, "y" * 192, "long \n" * 60_000]


def test_round_trip(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, status string, media int")
    out = {r["doc_id"]: r for r in media.described(media.encode(docs)).collect()}
    assert len(out) == len(rows)
    for i, t, _, _ in rows:
        assert out[i]["status"] == "ok" and bytes(out[i]["samples"]) == payload(t)
        assert bytes(out[i]["media"]) == bytes(out[i % len(TEXTS)]["media"])
        assert sum(c["n_frames"] for c in out[i]["clips"]) * 192 == len(payload(t)) and out[i]["clips"][0]["start_s"] == 0
    rows = media.clips(media.encode(docs)).where("doc_id = 8").orderBy("clip").collect()
    assert b"".join(bytes(r["samples"]) for r in rows) == payload(TEXTS[8])
    assert all(a["end_s"] == b["start_s"] for a, b in zip(rows, rows[1:]))
    assert media.described(media.encode(docs.limit(0))).collect() == []


def slow_frame(jpeg):
    """A plain bit-by-bit decoder of one grey frame: pixels."""
    (high, wide), quant, dc, ac, restart = (head := media.jpeg_head(jpeg))[0]
    data = jpeg[head[1] : -2]
    codes = [{(length, code): v for v, (code, length) in media.canonical(*map(list, t)).items()} for t in (dc, ac)]
    parts, out = [data], []
    if restart:
        for m in range(8):
            data = data.replace(bytes([255, 0xD0 + m]), b"\xff\xd0")
        parts = data.split(b"\xff\xd0")
    for part in parts:
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff"))
        at = level = 0

        def take(table):
            nonlocal at
            n = 1
            while (n, int(bits[at : at + n], 2)) not in table:
                n += 1
            v = table[n, int(bits[at : at + n], 2)]
            at += n
            s = v & 15
            x = int(bits[at : at + s], 2) if s else 0
            at += s
            return v >> 4, s, x - (1 << s) + 1 if s and x < 1 << (s - 1) else x

        for _ in range(min(restart or 10**9, -(-high // 8) * -(-wide // 8) - len(out))):
            c = np.zeros(64)
            level += take(codes[0])[2]
            c[0] = level * quant[0]
            k = 1
            while k < 64:
                run, s, v = take(codes[1])
                if not s and run != 15:
                    break
                k += run
                if s:
                    c[media._ZIGZAG[k]] = v * quant[k]
                k += 1
            out.append(media._BASIS.T @ c.reshape(8, 8) @ media._BASIS + 128)
    return out


def own_frame(restart, rnd):
    """A 24 x 16 frame with coefficients beyond the mean, by another encoder."""
    dc = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
    ac = ([0, 2, 1, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0x00, 0x01, 0x12, 0xF0, 0x03])
    codes = [media.canonical(*t) for t in (dc, ac)]
    put = lambda table, v, x: f"{codes[table][v][0]:0{codes[table][v][1]}b}" + (f"{x if x > 0 else x + (1 << (v & 15)) - 1:0{v & 15}b}" if v & 15 else "")
    scans, bits, level, blocks = [], "", 0, []
    for b in range(6):
        d = int(rnd.integers(-40, 41))
        bits += put(0, abs(d).bit_length(), d)
        level += d
        k = 1
        while k < 64 and rnd.random() < 0.7:
            v = [0x01, 0x12, 0xF0, 0x03][rnd.integers(0, 4)]
            if k + (v >> 4) >= 63:
                break
            s = v & 15
            x = int(rnd.integers(1 << (s - 1), 1 << s)) * int(rnd.choice([-1, 1])) if s else 0
            bits += put(1, v, x)
            k += (v >> 4) + 1
        bits += put(1, 0, 0)
        if restart and (b + 1) % restart == 0 or b == 5:
            bits += "1" * (-len(bits) % 8)
            scans.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
            bits, level = "", 0
        blocks.append(level)
    seg = media._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, *range(3, 67)])) + seg(0xC0, struct.pack(">BHHB", 8, 16, 24, 1) + bytes([1, 0x11, 0]))
    head += seg(0xC4, bytes([0x00, *dc[0], *dc[1]]) + bytes([0x10, *ac[0], *ac[1]])) + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return head + b"".join(s + (bytes([255, 0xD0 + i % 8]) if i + 1 < len(scans) else b"") for i, s in enumerate(scans)) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2, 4])
def test_decoder_equals_a_plain_one(restart):
    rnd = np.random.default_rng(restart)
    frames = [own_frame(restart, rnd) for _ in range(20)]
    [(status, _, rows)] = media.read([media.avi(frames)])
    assert status == "ok" and rows.shape == (20, 6)
    for f, row in zip(frames, rows):
        want = [np.rint(np.clip(np.rint(p), 0, 255).mean()) for p in slow_frame(f)]
        assert np.abs(row - want).max() <= 1  # a mean may lie on a half


def test_stored_frames_decode_by_the_plain_one():
    rows, _ = media.padded(np.frombuffer(bytes(range(256)), np.uint8), np.array([0]), np.array([256]))
    for row, scan in zip(rows, media.scans(rows)):
        want = np.array([np.rint(p).mean() for p in slow_frame(media._HEAD + scan + b"\xff\xd9")])
        assert (want == row).all()


def test_shots():
    rnd = np.random.default_rng(0)
    scene = lambda low: rnd.integers(low, low + 30, (10, 192)).astype(np.uint8)
    assert media.shots(np.concatenate([scene(0), scene(100), scene(200)])) == [0, 10, 20]
    assert media.shots(np.zeros((0, 192), np.uint8)) == [] and media.shots(scene(0)[:1]) == [0]
    black, white = np.zeros((1, 192), np.uint8), np.full((1, 192), 255, np.uint8)
    for frames, want in (((black, white), [0, 1]), ((black, white, white), [0, 1]), ((black, black, white), [0, 2]), ((black, black), [0])):
        assert media.shots(np.concatenate(frames)) == want


def test_odd_media(spark):
    rows, frames = media.padded(np.frombuffer(b"a" * 400, np.uint8), np.array([0]), np.array([400]))
    coded = [media._HEAD + s + b"\xff\xd9" for s in media.scans(rows)]
    good = media.avi(coded)
    plain = good[: good.rindex(b"idx1")]  # no index: frames are found by the lists
    broken = good.replace(coded[0][-40:-2], b"\xff\x00" * 19)
    colour = good.replace(bytes([1, 1, 0x11, 0]), bytes([3, 1, 0x11, 0]))
    cases = [good, plain[:4] + struct.pack("<I", len(plain) - 8) + plain[8:], good[:100], b"", b"RIFFxxxxWAVE", None, broken, colour]
    out = media.described(spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, media binary")).orderBy("id").collect()
    assert [r["status"] for r in out] == ["ok", "ok", *["unsupported"] * 3, None, "unsupported", "unsupported"]
    assert out[1]["samples"] == out[0]["samples"] and out[5]["clips"] is None
    assert media.described(spark.createDataFrame([(1, good)], "id int, media binary")).select(media.feature(F.col("clips"))).first()[0] == "0+2,2+1"  # the last frame is nearly all spaces
    clash = spark.createDataFrame([(1, good, "x", 7)], "clip int, media binary, _size string, first_frame int")
    assert [tuple(r)[:4] for r in media.clips(clash).select("clip", "first_frame", "n_frames", "_size").collect()] == [(0, 0, 2, "x"), (1, 2, 1, "x")]
