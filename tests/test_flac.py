"""Clips made here by an encoder of every kind of subframe."""

import hashlib
import struct

import numpy as np
import pytest

from vocalith.sources import audio, flac

RATE = 16_000


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [int(value) >> i & 1 for i in reversed(range(n))]

    def unary(self, n):
        self.bits += [0] * n + [1]

    def done(self):
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def residual(w, r, order, size, parts=0, method=0, escape=False):
    w.put(method, 2)
    w.put(parts, 4)
    at = 0
    for i in range(1 << parts):
        part = r[at : at + (size >> parts) - (order if i == 0 else 0)]
        at += len(part)
        if escape:
            n = max((int(abs(v)).bit_length() + 1 for v in part), default=0)
            w.put(15 if method == 0 else 31, 4 + method)
            w.put(n, 5)
            for v in part:
                w.put(v, n)
            continue
        k = min(14 + 16 * method, int(np.abs(part).mean()).bit_length()) if len(part) else 0
        w.put(k, 4 + method)
        for v in part:
            u = int(v) << 1 if v >= 0 else (-int(v) << 1) - 1
            w.unary(u >> k)
            w.put(u, k)


def subframe(w, x, width, kind, **how):
    wasted = how.pop("wasted", 0)
    x, width = x >> wasted, width - wasted
    code = {"constant": lambda: 0, "verbatim": lambda: 1, "fixed": lambda: 8 + kind[1], "lpc": lambda: 31 + len(kind[1])}[kind[0]]()
    w.put(0, 1)
    w.put(code, 6)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.unary(wasted - 1)
    if kind[0] == "constant":
        return w.put(x[0], width)
    if kind[0] == "verbatim":
        return [w.put(v, width) for v in x]
    c, shift, precision = (flac.FIXED[kind[1]], 0, 0) if kind[0] == "fixed" else (kind[1], kind[2], 14)
    for v in x[: len(c)]:
        w.put(v, width)
    if kind[0] == "lpc":
        w.put(precision - 1, 4)
        w.put(shift, 5)
        for v in c:
            w.put(v, precision)
    r = [int(x[t]) - (sum(int(c[j]) * int(x[t - 1 - j]) for j in range(len(c))) >> shift) for t in range(len(c), len(x))]
    residual(w, np.array(r, dtype=object), len(c), len(x), **how)


def frame(number, x, width, layout, kinds, how=({}, {}), size_code=7, rate=(5, None), bits_code=0):
    head = bytearray([0xFF, 0xF8, size_code << 4 | rate[0], layout << 4 | bits_code << 1])
    head += chr(number).encode() if number < 0x800 else b""
    head += {7: struct.pack(">H", len(x) - 1), 6: bytes([(len(x) - 1) & 255])}.get(size_code, b"") + (rate[1] or b"")
    head.append(flac.crc8(head))
    if layout == flac.LEFT_SIDE:
        parts = [x[:, 0], x[:, 0] - x[:, 1]]
    elif layout == flac.RIGHT_SIDE:
        parts = [x[:, 0] - x[:, 1], x[:, 1]]
    elif layout == flac.MID_SIDE:
        parts = [(x[:, 0] + x[:, 1]) >> 1, x[:, 0] - x[:, 1]]
    else:
        parts = list(x.T)
    w, side = Writer(), {flac.LEFT_SIDE: 1, flac.RIGHT_SIDE: 0, flac.MID_SIDE: 1}.get(layout)
    for c, part in enumerate(parts):
        subframe(w, part, width + (c == side), kinds[c % len(kinds)], **how[c % len(how)])
    body = bytes(head) + w.done()
    return body + struct.pack(">H", flac.crc16(body))


def stream(frames, x, width=16, rate=RATE, total=None, digest=None):
    wide = -(-width // 8)
    md5 = hashlib.md5(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()).digest() if digest is None else digest
    packed = rate << 44 | (x.shape[1] - 1) << 41 | (width - 1) << 36 | (len(x) if total is None else total)
    info = struct.pack(">HH", 16, 65535) + bytes(6) + packed.to_bytes(8) + md5
    return b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x81, 0, 0, 3]) + b"pad" + b"".join(frames)


def tone(n, channels=1, bits=16, seed=1):
    t, rng = np.arange(n) / RATE, np.random.default_rng(seed)
    x = [0.5 * np.sin(2 * np.pi * (300 + 70 * c) * t) + 0.01 * rng.standard_normal(n) for c in range(channels)]
    return (np.stack(x, 1) * ((1 << (bits - 1)) - 1) * 0.9).astype(np.int64)


LPC = ("lpc", (5000, -2500, 900, 30, -7), 12)
KINDS = [("constant",), ("verbatim",), *[("fixed", o) for o in range(5)], LPC, ("lpc", tuple(range(40, 8, -1)), 11)]


@pytest.mark.parametrize("kind", KINDS, ids=lambda k: f"{k[0]}{len(k[1]) if k[0] == 'lpc' else ''.join(map(str, k[1:]))}")
@pytest.mark.parametrize("bits", [8, 16, 24])
def test_kinds_of_subframes(kind, bits):
    x = tone(600, bits=bits)
    if kind[0] == "constant":
        x[:] = -5
    # Blocks of two sizes, residuals in one and in two parts, short and long parameters, and raw ones.
    hows = [{}, {"parts": 1}, {"method": 1}, {"escape": True}, {"escape": True, "method": 1}] if kind[0] in ("fixed", "lpc") else [{}] * 5
    cuts = [0, 120, 240, 360, 480, 600]
    made = [frame(i, x[a:b], bits, 0, [kind], [dict(h)]) for i, (a, b, h) in enumerate(zip(cuts, cuts[1:], hows, strict=False))]
    got, rate, width = flac.samples(stream(made, x, bits))
    assert (rate, width) == (RATE, bits) and (got == x).all()


@pytest.mark.parametrize("layout", [1, flac.LEFT_SIDE, flac.RIGHT_SIDE, flac.MID_SIDE])
def test_stereo_and_wasted_bits(layout):
    x = tone(800, 2) >> 3 << 3
    made = [frame(0, x[:500], 16, layout, [LPC, ("fixed", 2)], [{"wasted": 2}, {"wasted": 1}]), frame(1, x[500:], 16, layout, [("verbatim",), ("fixed", 1)])]
    assert (flac.samples(stream(made, x))[0] == x).all()
    x = tone(300, 8)
    assert (flac.samples(stream([frame(0, x, 16, 7, [("fixed", 2)])], x))[0] == x).all()


def test_headers():
    x = tone(192 + 256 + 100 + 576)
    made = [
        frame(0, x[:192], 16, 0, [("fixed", 1)], size_code=1, bits_code=4),
        frame(1, x[192:448], 16, 0, [("fixed", 1)], size_code=8, rate=(12, bytes([16]))),
        frame(2, x[448:548], 16, 0, [("fixed", 1)], size_code=6, rate=(13, struct.pack(">H", RATE))),
        frame(0x7FF, x[548:], 16, 0, [("fixed", 1)], size_code=2, rate=(14, struct.pack(">H", RATE // 10))),
    ]
    assert (flac.samples(stream(made, x))[0] == x).all()
    assert (flac.samples(stream(made, x, total=0, digest=bytes(16)))[0] == x).all()  # length and check not known
    assert len(flac.samples(stream([], x, total=RATE * 30), 20.0)[0]) == RATE * 30  # told by the header


def test_damage_is_found():
    x = tone(9000)
    made = [frame(i, x[a : a + 1000], 16, 0, [LPC]) for i, a in enumerate(range(0, 9000, 1000))]
    good = stream(made, x)
    assert audio.decode(good)[1] is None
    start, rng = len(stream([], x)), np.random.default_rng(3)
    for at in [4, start, start + 1, start + 2, start + 3, start + 5, start + 6, *rng.integers(start, len(good), 60).tolist()]:
        bad = bytearray(good)
        bad[at] ^= 1 << int(rng.integers(8))
        assert audio.decode(bytes(bad))[1] in ("audio/decode-failed",), at
    for cut in (0, 3, 20, start - 1, start + 3, start + 200, len(good) - 1):
        assert audio.decode(good[:cut])[1] == "audio/decode-failed"
    assert audio.decode(stream(made[:-1], x))[1] == "audio/decode-failed"  # a frame is missing
    assert audio.decode(stream(made, x, digest=b"x" * 16))[1] == "audio/decode-failed"
    with pytest.raises(flac.Damaged):
        flac.samples(b"OggS" + good)


def test_flac_gives_what_wav_gives(spark):
    x = np.concatenate([np.zeros((6000, 1), np.int64), tone(12_000, seed=2), np.zeros((6000, 1), np.int64)])
    whole = stream([frame(i, x[a : a + 2000], 16, 0, [("fixed", 2)]) for i, a in enumerate(range(0, len(x), 2000))], x)
    raw = x.astype("<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, 2 * RATE, 2, 16)
    wav = b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(raw)) + raw
    clips = spark.createDataFrame([("a.wav", wav), ("a.flac", whole), ("b.flac", whole[:-5]), ("short.flac", stream([frame(0, x[:100], 16, 0, [("constant",)])], x[:100]))], "path string, content binary")
    got = {r.path: r for r in audio.analyze(clips).collect()}
    assert got["a.wav"].segments and got["a.wav"].segments == got["a.flac"].segments and got["a.flac"].error is None
    assert got["b.flac"].error == "audio/decode-failed" and got["short.flac"].error == "audio/too-short"
