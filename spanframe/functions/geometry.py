"""Boxes and skeletons as column functions.

A box is a struct x1, y1, x2, y2; a skeleton an array of 17 [x, y, confidence].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Joints by their place, thresholds as ratios of the body scale.
CONFIDENT = 0.4
NOSE, LEFT_EAR, RIGHT_EAR, SHOULDERS, HIPS, ANKLES = 0, 3, 4, (5, 6), (11, 12), (15, 16)
STRIKE_JOINTS = (0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)
CORE_JOINTS = (0, 5, 6, 11, 12)
EXTREMITIES = (9, 10, 15, 16)
MIN_SCALE, MIN_TORSO_RATIO = 10.0, 0.5
TILT_DEGREES, LYING_SPAN = 50, 1.2
HEAD_RATIO = 0.45
ENGAGED_RATIO = 0.625
HULL_RATIO, HULL_PAD, HULL_JOINTS = 6.0, 0.2, 4
GRAPPLING_JOINTS = 6
CLEAN_TAPE, CLEAN_PIXELS = 8, 150


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _span(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b - a)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two boxes without area."""
    both = _span(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * _span(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    area = lambda r: _span(r["x1"], r["x2"]) * _span(r["y1"], r["y2"])
    union = area(a) + area(b) - both
    return F.when(union == 0, 0.0).otherwise(both / F.when(union != 0, union))


def gap(a: Column, b: Column) -> Column:
    """Distance between two rectangles, 0 where they overlap; null without one."""
    dx = _span(F.least(a["x2"], b["x2"]), F.greatest(a["x1"], b["x1"]))
    dy = _span(F.least(a["y2"], b["y2"]), F.greatest(a["y1"], b["y1"]))
    return F.when(a.isNotNull() & b.isNotNull(), F.sqrt(dx * dx + dy * dy))


def sure(skeleton: Column, joint: int) -> Column:
    return F.coalesce(F.get(F.get(skeleton, F.lit(joint)), F.lit(2)) >= CONFIDENT, F.lit(False))


def _at(skeleton: Column, joint: int, axis: int) -> Column:
    return F.get(F.get(skeleton, F.lit(joint)), F.lit(axis))


def _sure_of(skeleton: Column, joints) -> Column:
    points = F.array(*(F.get(skeleton, F.lit(j)) for j in joints))
    return F.filter(points, lambda p: F.coalesce(F.get(p, F.lit(2)) >= CONFIDENT, F.lit(False)))


def _axis(points: Column, axis: int) -> Column:
    return F.transform(points, lambda p: F.get(p, F.lit(axis)))


def _hull(points: Column) -> Column:
    xs, ys = _axis(points, 0), _axis(points, 1)
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def torso(skeleton: Column) -> Column:
    """Rectangle of the sure shoulders and hips, null with fewer than two."""
    points = _sure_of(skeleton, SHOULDERS + HIPS)
    return F.when(F.size(points) >= 2, _hull(points))


def _middle(skeleton: Column, pair, axis: int) -> Column:
    return (_at(skeleton, pair[0], axis) + _at(skeleton, pair[1], axis)) / 2


def scale(skeleton: Column) -> Column:
    """Body size in pixels: shoulders to hips, or the shoulders' width where the
    torso is foreshortened or the hips are unsure; null without sure shoulders."""
    a, b = SHOULDERS
    width = F.hypot(_at(skeleton, a, 0) - _at(skeleton, b, 0), _at(skeleton, a, 1) - _at(skeleton, b, 1))
    length = F.hypot(*(_middle(skeleton, SHOULDERS, x) - _middle(skeleton, HIPS, x) for x in (0, 1)))
    shoulders, hips = sure(skeleton, a) & sure(skeleton, b), sure(skeleton, HIPS[0]) & sure(skeleton, HIPS[1])
    return F.when(shoulders & hips & (length >= MIN_TORSO_RATIO * width), F.greatest(length, F.lit(MIN_SCALE))).when(shoulders & (width > 0), F.greatest(width, F.lit(MIN_SCALE)))


def grounded(skeleton: Column) -> Column:
    """Whether the torso lies, or, with sure head and ankles, the body's height is
    short for its scale."""
    dx, dy = (F.abs(_middle(skeleton, HIPS, x) - _middle(skeleton, SHOULDERS, x)) for x in (0, 1))
    tilt = F.degrees(F.atan2(dx, dy + 1e-6))
    ys = [_at(skeleton, j, 1) for j in (NOSE, *ANKLES)]
    sure_ends = sure(skeleton, NOSE) & sure(skeleton, ANKLES[0]) & sure(skeleton, ANKLES[1])
    short = (F.greatest(*ys) - F.least(*ys)) / scale(skeleton) < LYING_SPAN
    return (tilt > TILT_DEGREES) | F.when(sure_ends, F.coalesce(short, F.lit(False))).otherwise(False)


def head_centre(skeleton: Column) -> Column:
    """Mean of the sure ones of nose and ears, else a point above the shoulders."""
    points = _sure_of(skeleton, (NOSE, LEFT_EAR, RIGHT_EAR))
    up = HEAD_RATIO * F.coalesce(scale(skeleton), F.lit(MIN_SCALE))
    sure_head = F.struct(_mean(_axis(points, 0)).alias("x"), _mean(_axis(points, 1)).alias("y"))
    other = F.struct(_middle(skeleton, SHOULDERS, 0).alias("x"), (_middle(skeleton, SHOULDERS, 1) - up).alias("y"))
    return F.when(F.size(points) > 0, sure_head).otherwise(other)


def present_engaged(boxes: Column, width: Column) -> Column:
    """Struct present, engaged: of the first two boxes (arrays of 4)."""
    whole = F.filter(boxes, lambda b: F.size(b) == 4)
    middle = lambda k: (F.get(F.get(whole, F.lit(k)), F.lit(0)) + F.get(F.get(whole, F.lit(k)), F.lit(2))) / 2
    near = F.abs(middle(0) - middle(1)) < ENGAGED_RATIO * width
    return F.struct((F.size(whole) >= 2).alias("present"), F.coalesce(near, F.lit(False)).alias("engaged"))


def centred(b: Column) -> Column:
    """Centre and size of a box."""
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def cornered(c: Column) -> Column:
    """The box of a centre and size."""
    return box(c["cx"] - c["w"] / 2, c["cy"] - c["h"] / 2, c["cx"] + c["w"] / 2, c["cy"] + c["h"] / 2)


def skeleton_hull(skeleton: Column) -> Column:
    """Box of the sure joints, padded at hands and feet; null where joints are too
    few, the scale is unknown or the hull is too large for a body."""
    points = F.filter(skeleton, lambda p: F.coalesce(F.get(p, F.lit(2)) >= CONFIDENT, F.lit(False)))
    size, hull = scale(skeleton), _hull(points)
    ends = _sure_of(skeleton, EXTREMITIES)
    pad = HULL_PAD * size
    low = lambda axis, edge: F.least(edge, F.array_min(F.transform(ends, lambda p: F.get(p, F.lit(axis)) - pad)))
    high = lambda axis, edge: F.greatest(edge, F.array_max(F.transform(ends, lambda p: F.get(p, F.lit(axis)) + pad)))
    padded = box(low(0, hull["x1"]), low(1, hull["y1"]), high(0, hull["x2"]), high(1, hull["y2"]))
    longer = F.greatest(hull["x2"] - hull["x1"], hull["y2"] - hull["y1"])
    return F.when((F.size(points) >= HULL_JOINTS) & (longer <= HULL_RATIO * size), padded)


def torso_centre(skeleton: Column) -> Column:
    """Struct x, y: mean of the sure shoulders and hips, null with fewer than two."""
    points = _sure_of(skeleton, SHOULDERS + HIPS)
    return F.when(F.size(points) >= 2, F.struct(_mean(_axis(points, 0)).alias("x"), _mean(_axis(points, 1)).alias("y")))


def off_centre(b: Column, centre: Column) -> Column:
    """How far a point (struct x, y) lies outside a box, in diagonals of the box; 0 without one."""
    cx, cy = centre["x"], centre["y"]
    dx, dy = F.greatest(b["x1"] - cx, cx - b["x2"], F.lit(0.0)), F.greatest(b["y1"] - cy, cy - b["y2"], F.lit(0.0))
    diagonal = F.greatest(F.lit(1.0), F.hypot(b["x2"] - b["x1"], b["y2"] - b["y1"]))
    return F.when(centre.isNotNull(), F.hypot(dx, dy) / diagonal).otherwise(0.0)


def drift(b: Column, skeleton: Column) -> Column:
    """How far the torso's centre lies outside its box, in diagonals of the box."""
    return off_centre(b, torso_centre(skeleton))


def tape_distance(net_red: Column, total: Column, sign: Column) -> Column:
    """0 for a sure match of the tape's sign, 1 for a sure mismatch, 0.5 for no tape."""
    confidence = F.least(total, F.lit(CLEAN_TAPE)) / CLEAN_TAPE
    match = F.when(net_red >= 0, 1).otherwise(-1) == sign
    return F.when(match, 0.5 - 0.5 * confidence).otherwise(0.5 + 0.5 * confidence)


def bhattacharyya(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms (arrays of doubles)."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, v: s + v)
    norm = total(a) * total(b)
    common = total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y))) * F.when(norm > 1.2e-7, 1 / F.sqrt(norm)).otherwise(1.0)
    return F.sqrt(F.greatest(1 - common, F.lit(0.0)))


def histogram_distance(hist: Column, weight: Column, template: Column) -> Column:
    """Bhattacharyya distance of two histograms, drawn towards 0.5 with few pixels."""
    distance = F.least(F.lit(1.0), bhattacharyya(hist, template))
    return F.coalesce(0.5 + (distance - 0.5) * F.least(weight, F.lit(CLEAN_PIXELS)) / CLEAN_PIXELS, F.lit(0.5))


def usable(red: Column, blue: Column, grappling: Column) -> Column:
    """Whether both skeletons are good enough for the fight's state: all strike
    joints, or the core's when striking, or enough of them when grappling."""
    whole = lambda s: F.size(_sure_of(s, STRIKE_JOINTS)) == len(STRIKE_JOINTS)
    core = lambda s: F.size(_sure_of(s, CORE_JOINTS)) == len(CORE_JOINTS)
    some = lambda s: F.size(_sure_of(s, STRIKE_JOINTS)) >= GRAPPLING_JOINTS
    both = lambda f: f(red) & f(blue) & (F.size(red) >= 17) & (F.size(blue) >= 17)
    return F.coalesce(both(whole) | F.when(grappling, both(some)).otherwise(both(core)), F.lit(False))
