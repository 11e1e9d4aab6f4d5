"""Scoreboard readings and clocks as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: round prefixes in the order in which they are tried, the clock,
# and the zero-padded clock whose separator is lost or misread.
ROUND_PREFIXES = (r"\bR\s*([1-5])\b", r"\bROUND\s*([1-5])\b", r"\bRD\s*([1-5])\b", r"\bRUNDA\s*([1-5])\b", r"\bR-([1-5])\b")
CLOCK = r"\b(\d{1,2})[:.;](\d{2})\b"
LOST_SEPARATOR = r"(?:^|\s)0(\d)\S?([0-5]\d)(?:\s|$)"
ROUND_DIGIT = r"^[^0-9A-Za-z]*([1-5])[^0-9A-Za-z]*$"
# Reach of a round digit from the clock's box (of its height and width),
# weights of the fused signal.
DIGIT_OFFSET, DIGIT_GAP = 0.6, 1.5
READING_WEIGHT, PRESENCE_WEIGHT, ENGAGEMENT_WEIGHT = 0.7, 0.2, 0.1


def _group(text: Column, pattern: str, k: int) -> Column:
    """Group k of the first match as an integer, null without one."""
    found = F.regexp_extract(text, pattern, k)
    return F.when(found != "", found.cast("int"))


def timer_seconds(text: Column) -> Column:
    """Seconds that a clock in ``text`` shows, else null. A clock that is out of
    range gives null, even if a clock without a separator follows."""
    minutes, seconds = _group(text, CLOCK, 1), _group(text, CLOCK, 2)
    other = _group(text, LOST_SEPARATOR, 1) * 60 + _group(text, LOST_SEPARATOR, 2)
    return F.when(minutes.isNotNull(), F.when((minutes <= 59) & (seconds <= 59), minutes * 60 + seconds)).otherwise(other)


def round_number(text: Column) -> Column:
    """Round that a prefix in ``text`` names, else null."""
    return F.coalesce(*(_group(F.upper(text), p, 1) for p in ROUND_PREFIXES))


def round_from_boxes(boxes: Column, floor: float = 0.0) -> Column:
    """Round that text boxes (array of x1, y1, x2, y2, text, conf) show: the first
    box with a prefix, else the bare digit nearest to the surest clock, on its
    height and within reach of it."""
    usable = F.filter(boxes, lambda b: b["conf"] >= floor)
    named = F.get(F.filter(F.transform(usable, lambda b: round_number(b["text"])), lambda r: r.isNotNull()), F.lit(0))
    clocks = F.filter(usable, lambda b: timer_seconds(b["text"]).isNotNull())
    # the first of the surest
    best = F.aggregate(clocks, F.get(clocks, F.lit(0)), lambda a, b: F.when(b["conf"] > a["conf"], b).otherwise(a))
    gap = lambda b: F.greatest(F.lit(0.0), best["x1"] - b["x2"], b["x1"] - best["x2"])
    near = lambda b: (
        F.trim(b["text"]).rlike(ROUND_DIGIT)
        & (F.abs((b["y1"] + b["y2"]) / 2 - (best["y1"] + best["y2"]) / 2) <= DIGIT_OFFSET * (best["y2"] - best["y1"]))
        & (gap(b) <= DIGIT_GAP * (best["x2"] - best["x1"]))
    )
    digits = F.transform(F.filter(usable, near), lambda b, i: F.struct(gap(b).alias("gap"), i.alias("i"), _group(F.trim(b["text"]), ROUND_DIGIT, 1).alias("digit")))
    sound = (best["x2"] > best["x1"]) & (best["y2"] > best["y1"])
    return F.coalesce(named, F.when(sound, F.array_min(digits)["digit"]))


def reading_signal(found: Column, error: Column, round_: Column, seconds: Column) -> Column:
    """How surely a reading shows a running round: 1, 0.9, 0.6, 0 for one of low
    confidence, -1 for none."""
    return (
        F.when(~F.coalesce(found, F.lit(False)), -1.0).when(error.eqNullSafe("low_confidence"), 0.0)
        .when(round_.isNotNull() & seconds.isNotNull(), 1.0).when(seconds.isNotNull(), 0.9).when(round_.isNotNull(), 0.6).otherwise(-1.0)
    )


def fused(signal: Column, present: Column, engaged: Column) -> Column:
    """Probability of a running round; without a reading its weight goes to the others."""
    p, e = present.cast("double"), engaged.cast("double")
    rest = PRESENCE_WEIGHT + ENGAGEMENT_WEIGHT
    return F.when(signal >= 0, READING_WEIGHT * signal + PRESENCE_WEIGHT * p + ENGAGEMENT_WEIGHT * e).otherwise(PRESENCE_WEIGHT / rest * p + ENGAGEMENT_WEIGHT / rest * e)


def frame_clock(frame: Column, fps: Column) -> Column:
    """1-based frame as m:ss."""
    seconds = F.greatest(F.lit(0.0), (frame - 1) / fps)
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(seconds % 60))


def exact_clock(frame: Column, fps: Column) -> Column:
    """Frame as m:ss.cc."""
    seconds = frame / fps
    return F.format_string("%d:%05.2f", F.floor(seconds / 60), seconds % 60)


def duration(seconds: Column) -> Column:
    """1h02m, 4m05s or 12s, of seconds rounded half to even."""
    s = F.rint(seconds).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(hours > 0, F.format_string("%dh%02dm", hours, minutes)).when(minutes > 0, F.format_string("%dm%02ds", minutes, rest)).otherwise(F.format_string("%ds", rest))
