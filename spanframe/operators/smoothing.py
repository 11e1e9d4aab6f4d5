"""Smoothing of coordinates over the frames of a key."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame

from spanframe.operators.folds import fold_arrays

#: Cutoff at rest, its growth with speed, the cutoff of the speed; least confidence.
MIN_CUTOFF, BETA, D_CUTOFF = 1.5, 0.05, 1.0
MIN_CONFIDENCE = 0.4


def _weight(cutoff: float, dt: float) -> float:
    return 1 / (1 + 1 / (2 * pi * cutoff) / dt)


def one_euro(df: DataFrame, *keys: str, time: str = "frame", value: str = "x", confidence: str = "confidence", out: str = "smooth") -> DataFrame:
    """Add ``out``: ``value`` after a low-pass filter that gives way as the value
    moves faster; time is the frame's number. Rows without value or confidence
    (null: none) keep their value and leave the filter as it is."""

    def step(state, c):
        out = []
        for x, t, sure in zip(c[value].astype(float).tolist(), c[time].tolist(), c[confidence].astype(float).tolist(), strict=True):
            if not (x == x and sure >= MIN_CONFIDENCE):  # NaN: none
                out.append(x if x == x else None)
                continue
            if state is not None:
                before, speed, then = state
                dt = max(t - then, 1e-6)
                a = _weight(D_CUTOFF, dt)
                speed = a * (x - before) / dt + (1 - a) * speed
                a = _weight(MIN_CUTOFF + BETA * abs(speed), dt)
                x = a * x + (1 - a) * before
            else:
                speed = 0.0
            state = (x, speed, t)
            out.append(x)
        return state, [out]

    return fold_arrays(df, step, [value, time, confidence], f"`{out}` double", *keys, order=[time])
