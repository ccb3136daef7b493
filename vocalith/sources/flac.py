"""FLAC streams to whole-number samples.

A frame's codes are read one after the other, with the places of all its one-bits found at once; the
predictions of all subframes of a clip are undone together, a sample of each at a time.
Checks of headers, frames and the whole stream must hold, else the stream is damaged.
"""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed values of the format.
BLOCKS = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
LEFT_SIDE, RIGHT_SIDE, MID_SIDE = 8, 9, 10
MOST_ORDER = 32


class Damaged(ValueError):
    """A stream that breaks the format or one of its checks."""


class Ended(Damaged):
    """A stream that ends inside a frame."""


def _table(poly: int, width: int) -> list[int]:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c & top else 0)) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ b]
    return c


class Bits:
    """Bits of ``data`` from its first one on."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0
        ones = np.where(self.bits == 1, np.arange(len(self.bits)), len(self.bits))
        self.next_one = np.minimum.accumulate(ones[::-1])[::-1]

    def take(self, n: int) -> int:
        """The next ``n`` bits as a number without a sign."""
        if self.at + n > len(self.bits):
            raise Ended("the stream ends inside a frame")
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def signed(self, n: int) -> int:
        return (v := self.take(n)) - (v >> (n - 1) << n) if n else 0

    def unary(self) -> int:
        """How many zeros come before the next one, which is taken too."""
        if self.at >= len(self.bits) or self.next_one[self.at] >= len(self.bits):
            raise Ended("the stream ends inside a frame")
        start, self.at = self.at, int(self.next_one[self.at]) + 1
        return self.at - start - 1

    def many(self, starts: np.ndarray, n: int) -> np.ndarray:
        """The numbers of ``n`` bits at each of ``starts``."""
        out = np.zeros(len(starts), np.int64)
        for i in range(n):
            out = out << 1 | self.bits[starts + i]
        return out

    def signed_run(self, count: int, n: int) -> np.ndarray:
        """``count`` numbers with a sign, of ``n`` bits each."""
        if self.at + count * n > len(self.bits):
            raise Ended("the stream ends inside a frame")
        v = self.many(self.at + n * np.arange(count), n)
        self.at += count * n
        return v - (v >> (n - 1) << n) if n else v

    def rice(self, count: int, k: int) -> np.ndarray:
        """``count`` Rice codes with ``k`` low bits, zigzag undone."""
        follow, at, starts = (self.next_one + (1 + k)).tolist(), self.at, []
        try:
            for _ in range(count):
                starts.append(at)
                at = follow[at]
        except IndexError:
            raise Ended("the stream ends inside a frame") from None
        if at > len(self.bits):
            raise Ended("the stream ends inside a frame")
        first = np.array(starts, np.int64)
        one, self.at = self.next_one[first], at
        v = (one - first) << k | self.many(one + 1, k)
        return v >> 1 ^ -(v & 1)


def _residual(bits: Bits, size: int, order: int) -> np.ndarray:
    method, parts = bits.take(2), 1 << bits.take(4)
    if method > 1 or size % parts or size // parts < order:
        raise Damaged("no such coding of a residual")
    width, out = 4 + method, []
    for i in range(parts):
        k, n = bits.take(width), size // parts - (order if i == 0 else 0)
        out.append(bits.signed_run(n, bits.take(5)) if k == (1 << width) - 1 else bits.rice(n, k))
    return np.concatenate(out)


def _subframe(bits: Bits, size: int, width: int) -> dict:
    """The subframe's known samples, residual, coefficients and shifts; ``x`` alone if nothing was predicted."""
    if bits.take(1):
        raise Damaged("a subframe starts with a zero")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if width < 1:
        raise Damaged("no bits of a sample are left")
    if kind == 0:
        return {"x": np.full(size, bits.signed(width), np.int64), "wasted": wasted}
    if kind == 1:
        return {"x": bits.signed_run(size, width), "wasted": wasted}
    if not (8 <= kind <= 12 or kind >= 32):
        raise Damaged("no such kind of subframe")
    order = kind - 8 if kind < 32 else kind - 31
    if order > size:
        raise Damaged("more known samples than samples")
    warm = bits.signed_run(order, width)
    coefficients, shift = FIXED[order] if kind < 32 else (), 0
    if kind >= 32:
        precision, shift = bits.take(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise Damaged("no such precision")
        coefficients = bits.signed_run(order, precision)
    return {"warm": warm, "residual": _residual(bits, size, order), "coefficients": coefficients, "shift": shift, "wasted": wasted}


def _frame(data: bytes, at: int, rate: int, width: int) -> tuple[dict, int]:
    """The frame at ``at``, its subframes not yet restored, and where the next one starts."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise Damaged("no frame where one must be")
    block, speed, layout, sample = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    lead = 8 - int(~head[4] & 0xFF).bit_length()  # ones at the head of the coded number
    n = 4 + max(1, lead)
    if head[3] & 1 or layout > MID_SIDE or lead in (1, 8) or block == 0 or speed == 15 or sample == 3:
        raise Damaged("no such header")
    size = BLOCKS.get(block) or int.from_bytes(head[n : n + block - 5]) + 1
    n += block - 5 if block in (6, 7) else 0
    more = {12: 1, 13: 2, 14: 2}.get(speed, 0)
    rate = RATES.get(speed) or (int.from_bytes(head[n : n + more]) * {12: 1000, 13: 1, 14: 10}[speed] if more else rate)
    n += more
    if n >= len(head) or crc8(head[:n]) != head[n]:
        raise Damaged("the check of a header fails")
    width = BITS.get(sample) or width
    channels = layout + 1 if layout < LEFT_SIDE else 2
    # Hardly any frame is longer than one that holds its samples as they are; for others more is looked at.
    look = channels * (size * (width + 1) // 8 + 64)
    while True:
        bits = Bits(data[at + n + 1 : at + n + 1 + look])
        try:
            subs = [_subframe(bits, size, width + ((layout, c) in {(LEFT_SIDE, 1), (RIGHT_SIDE, 0), (MID_SIDE, 1)})) for c in range(channels)]
            break
        except Ended:
            if at + n + 1 + look >= len(data):
                raise
            look *= 8
    end = at + n + 1 + -(-bits.at // 8)
    if len(data) < end + 2 or crc16(data[at:end]) != int.from_bytes(data[end : end + 2]):
        raise Damaged("the check of a frame fails")
    return {"size": size, "rate": rate, "bits": width, "layout": layout, "subs": subs}, end + 2


def _restore(subs: list[dict]) -> None:
    """Undo the predictions of subframes of one size, all at once, and put their samples under ``x``."""
    size, n = len(subs[0]["warm"]) + len(subs[0]["residual"]), len(subs)
    x, added, c = np.zeros((MOST_ORDER + size, n), np.int64), np.zeros((size, n), np.int64), np.zeros((MOST_ORDER, n), np.int64)
    order, shift = np.array([len(s["warm"]) for s in subs]), np.array([s["shift"] for s in subs])
    for i, s in enumerate(subs):
        x[MOST_ORDER : MOST_ORDER + order[i], i], added[order[i] :, i] = s["warm"], s["residual"]
        c[: order[i], i] = s["coefficients"]
    deep = int(order.max())
    c = c[:deep][::-1]
    for t in range(int(order.min()), size):
        now = MOST_ORDER + t
        made = added[t] + ((c * x[now - deep : now]).sum(0) >> shift)
        x[now] = np.where(t < order, x[now], made)
    for i, s in enumerate(subs):
        s["x"] = x[MOST_ORDER:, i]


def _together(layout: int, parts: list[np.ndarray]) -> np.ndarray:
    """The channels of a frame, a column each."""
    if layout == LEFT_SIDE:
        parts = [parts[0], parts[0] - parts[1]]
    elif layout == RIGHT_SIDE:
        parts = [parts[0] + parts[1], parts[1]]
    elif layout == MID_SIDE:
        both = parts[0] << 1 | parts[1] & 1
        parts = [(both + parts[1]) >> 1, (both - parts[1]) >> 1]
    return np.stack(parts, 1)


def samples(data: bytes, most_s: float | None = None) -> tuple[np.ndarray, int, int]:
    """The samples, a column for each channel, their rate and bits; beyond ``most_s`` seconds by the header, none are read."""
    if data[:4] != b"fLaC":
        raise Damaged("not a FLAC stream")
    at, info = 4, b""
    while True:
        head = data[at : at + 4]
        if len(head) < 4:
            raise Damaged("the stream ends before its frames")
        length = int.from_bytes(head[1:])
        if head[0] & 127 == 0:
            info = data[at + 4 : at + 4 + length]
        at += 4 + length
        if head[0] & 128:
            break
    if len(info) < 34:
        raise Damaged("no information on the stream")
    packed = int.from_bytes(info[10:18])
    rate, channels, width, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    if not rate:
        raise Damaged("no rate")
    if most_s is not None and total > most_s * rate:
        return np.broadcast_to(np.zeros((1, channels), np.int64), (total, channels)), rate, width
    frames = []
    while at < len(data):
        frame, at = _frame(data, at, rate, width)
        if (frame["rate"], frame["bits"], len(frame["subs"])) != (rate, width, channels):
            raise Damaged("frames of different kinds")
        frames.append(frame)
    by_size: dict[int, list[dict]] = {}
    for frame in frames:
        for sub in frame["subs"]:
            if "x" not in sub:
                by_size.setdefault(frame["size"], []).append(sub)
    for subs in by_size.values():
        _restore(subs)
    parts = [_together(f["layout"], [s["x"] << s["wasted"] for s in f["subs"]]) for f in frames]
    x = np.concatenate(parts) if parts else np.zeros((0, channels), np.int64)
    if total and len(x) != total:
        raise Damaged("samples are missing")
    digest, wide = info[18:34], -(-width // 8)
    if any(digest) and hashlib.md5(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()).digest() != digest:  # noqa: S324
        raise Damaged("the check of the samples fails")
    return x, rate, width
