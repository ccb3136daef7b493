"""A deterministic generator of 32-bit numbers as Column expressions, and signals made from it.

Its state moves by a constant from draw to draw, so the i-th draw of a seed is worked out by itself
and signals are made sample by sample wherever their rows are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The step of the state, and the signals.
STEP = 0x6D2B79F5
RATE = 16_000
KINDS = ("tone_440", "tone_900", "chirp", "noise")
WORD, LOW = 1 << 32, 0xFFFF


def _times(a: Column, b: Column) -> Column:
    """The product of two 32-bit numbers, of which the lower 32 bits are kept; no step of it passes 2^49."""
    return F.pmod(a * b.bitwiseAND(LOW) + F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(LOW), 16), F.lit(WORD))


def draw(seed: Column, i: Column) -> Column:
    """The ``i``-th draw (from 0) of ``seed``: a number of 32 bits divided by 2^32."""
    t = F.pmod(seed.cast("long") + (i.cast("long") + 1) * STEP, F.lit(WORD))
    t = _bound(t, lambda s: _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1).cast("long"))))
    t = _bound(t, lambda s: s.bitwiseXOR(F.pmod(s + _times(s.bitwiseXOR(F.shiftright(s, 7)), s.bitwiseOR(F.lit(61).cast("long"))), F.lit(WORD))))
    return _bound(t, lambda s: s.bitwiseXOR(F.shiftright(s, 14))) / float(WORD)


def _bound(x: Column, f: object) -> Column:
    """f(x) with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normal(u: Column, v: Column) -> Column:
    """A normally distributed number of two draws."""
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * math.pi * v)


def sample(kind: Column, i: Column, n: Column, seed: Column) -> Column:
    """Sample ``i`` of ``n`` of a signal, as a float.  The phase of a chirp is the sum of its frequencies so far."""
    turn = lambda x: F.sin(2 * math.pi * x / RATE)
    phase = 300.0 * (i + 1) + 900.0 * (i * (i + 1) / 2) / (n - 1)
    value = (
        F.when(kind == "tone_440", 0.8 * turn(440.0 * i))
        .when(kind == "tone_900", 0.6 * turn(900.0 * i))
        .when(kind == "chirp", 0.7 * turn(phase))
        .when(kind == "noise", (draw(seed, i) * 2 - 1) * 0.5)
    )
    return value.cast("float")
