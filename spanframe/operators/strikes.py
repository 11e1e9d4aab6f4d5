"""What happens around a strike or a takedown, read from poses next to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.asof import asof
from spanframe.operators.segmentation import BLOCK, number_rows

#: Seconds before a takedown whose first and last frames are compared, and the share of
#: the fighters' scale by which one's hips must fall further.
LOOKBACK_SECONDS, DROP_RATIO = 0.3, 0.17
#: Seconds after contact at which the head is looked for first (and up to four times
#: that), and the speed, in scales a second, from which a strike has landed.
RECOIL_SECONDS, RECOIL_RATIO = 0.08, 1.5
#: Least confidence of a joint next to a strike, and of a joint that counts as well seen.
SEEN, WELL_SEEN = 0.30, 0.50
#: Frames to either side of a strike among which its best pose is chosen.
POSE_REACH = 3

HEAD, SHOULDERS, HIPS, KNEES, ANKLES, WRISTS = (0, 1, 2, 3, 4), (5, 6), (11, 12), (13, 14), (15, 16), (9, 10)


def _frames(seconds: float, fps: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(fps * seconds).cast("long"))


def initiators(rows: DataFrame, key: str = "fight_id", block: int = BLOCK) -> DataFrame:
    """Add ``initiator`` to each row: "red" or "blue", who took the other down, or null.

    ``rows``: key, frame, fps, red, blue (height of the hips, growing downwards),
    red_scale and blue_scale (may be null), one row for each frame in which both are
    seen. The oldest of the rows of the last LOOKBACK_SECONDS is compared with the last:
    whose hips fell further, by DROP_RATIO of the mean of the scales known in both
    rows, was taken down. One row alone tells nothing.
    """
    t = number_rows(rows, key, order=["frame"], block=block, out="_n")
    names = ("red", "blue", "red_scale", "blue_scale")
    old = t.select(key, F.col("_n").alias("_old"), F.struct(*names).alias("_o"))
    first = F.greatest(F.lit(1), F.col("_n") - _frames(LOOKBACK_SECONDS, F.col("fps")) + 1)
    t = t.withColumn("_old", first).join(old, [key, "_old"])
    scales = F.filter(F.array("_o.red_scale", "_o.blue_scale", "red_scale", "blue_scale"), lambda s: s.isNotNull() & (s != 0))
    scale = F.when(F.size(scales) > 0, F.aggregate(scales, F.lit(0.0), lambda a, s: a + s) / F.size(scales)).otherwise(1.0)
    further = (F.col("red") - F.col("_o.red")) - (F.col("blue") - F.col("_o.blue"))
    two = F.col("_old") < F.col("_n")
    who = F.when(two & (further > DROP_RATIO * scale), "blue").when(two & (-further > DROP_RATIO * scale), "red")
    return t.withColumn("initiator", who).select(*rows.columns, "initiator")


def landed(contacts: DataFrame, heads: DataFrame, key: str = "fight_id", block: int | None = BLOCK) -> DataFrame:
    """Add ``landed`` to each contact: whether the defender's head moves fast enough in
    the first frame that is read from RECOIL_SECONDS after contact on, up to four times
    that; null if it is not read there, or at contact.

    ``contacts``: key, event_id, frame, defender (corner), fps. ``heads``: key, frame,
    head_0, head_1 (x, y, scale), one row a frame; scale is null where a head is not
    usable. The distance is divided by RECOIL_SECONDS, whatever the gap.
    """
    of = lambda c: F.when(F.col("defender") == 0, F.col(f"{c}_0")).otherwise(F.col(f"{c}_1"))
    ahead = _frames(RECOIL_SECONDS, F.col("fps"))
    t = contacts.join(heads.select(key, "frame", "head_0", "head_1"), [key, "frame"], "left").withColumn("_at", of("head"))
    t = t.select(*contacts.columns, "_at", ahead.alias("_l"), F.col("frame").alias("_contact")).withColumn("frame", F.col("frame") + ahead)
    marks = heads.select(key, "frame", F.lit(0).cast("long").alias("event_id"), F.col("head_0").alias("later_0"), F.col("head_1").alias("later_1"))
    t = asof(t, marks, ["later_0", "later_1"], key=key, forward=True, block=block)
    later = F.when(F.col("mark_frame") <= F.col("_contact") + 4 * F.col("_l"), of("later"))
    speed = F.hypot(later["x"] - F.col("_at.x"), later["y"] - F.col("_at.y")) / F.col("_l") * F.col("fps")
    verdict = F.when(F.col("_at.scale").isNotNull(), speed >= RECOIL_RATIO * F.col("_at.scale"))
    return t.withColumns({"frame": F.col("_contact"), "landed": verdict}).select(*contacts.columns, "landed")


# ---------------------------------------------------------------- limbs


def _joint(skeleton: Column, j: int) -> Column:
    return F.get(skeleton, F.lit(j))


def _seen(p: Column) -> Column:
    return F.coalesce(F.get(p, F.lit(2)) >= SEEN, F.lit(False))


def _mean(skeleton: Column, joints: tuple[int, ...]) -> Column:
    """The mean place of the joints that are seen, or null."""
    points = F.filter(F.array(*(_joint(skeleton, j) for j in joints)), _seen)
    axis = lambda a: F.aggregate(points, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(a))) / F.size(points)
    return F.when(F.size(points) > 0, F.struct(axis(0).alias("x"), axis(1).alias("y")))


def _far(p: Column, q: Column) -> Column:
    return F.hypot(F.get(p, F.lit(0)) - q["x"], F.get(p, F.lit(1)) - q["y"])


def family_of(action: Column) -> Column:
    """The family by what the name holds; else the name."""
    return F.when(action.contains("hook"), "hook").when(action.contains("uppercut"), "uppercut").when(action.endswith("kick"), "kick").when(action.endswith("knee"), "knee").otherwise(action)


def limb(action: Column, target: Column, me: Column, opponent: Column) -> Column:
    """The joints of the limb that threw a strike, from the trunk outwards.

    Kicks and knees: the leg whose end is further from the hips (left if none is seen);
    names with a side tell theirs; else the wrist nearer to what was aimed at. Skeletons
    are 17 x (x, y, confidence).
    """
    head = F.coalesce(_mean(opponent, HEAD), _mean(opponent, SHOULDERS))
    body = _mean(opponent, SHOULDERS + HIPS)
    aim = F.when(target == "head", head).when(target == "leg", F.coalesce(_mean(opponent, KNEES), body)).otherwise(body)
    aim = F.coalesce(aim, head)
    hip = F.coalesce(_mean(me, HIPS), _mean(me, SHOULDERS))

    def leg(ends, left, right):
        a, b = (_joint(me, j) for j in ends)
        nearer = F.coalesce(_far(b, hip) > _far(a, hip), F.lit(False))
        return F.when(_seen(b) & (~_seen(a) | nearer), F.array(*map(F.lit, right))).otherwise(F.array(*map(F.lit, left)))

    reach = lambda j: F.when(_seen(_joint(me, j)) & aim.isNotNull(), _far(_joint(me, j), aim)).otherwise(float("inf"))
    left, right = (F.array(*map(F.lit, c)) for c in ((5, 7, 9), (6, 8, 10)))
    family = family_of(action)
    return (
        F.when(family == "kick", leg(ANKLES, (11, 13, 15), (12, 14, 16)))
        .when(family == "knee", leg(KNEES, (11, 13), (12, 14)))
        .when(action.startswith("left_"), left)
        .when(action.startswith("right_"), right)
        .otherwise(F.when(reach(WRISTS[0]) <= reach(WRISTS[1]), left).otherwise(right))
    )


def best_pose(strikes: DataFrame, poses: DataFrame, key: str = "fight_id") -> DataFrame:
    """The frame of each key, at most POSE_REACH from a strike, in which most joints of
    all people are well seen (then: whose worst joint is seen best; then the first by
    strike and frame): key, frame, seen, worst. ``strikes``: key, event_id, frame;
    ``poses``: key, frame, skeletons (an array of skeletons)."""
    scores = F.flatten(F.transform("skeletons", lambda s: F.transform(s, lambda p: F.get(p, F.lit(2)))))
    well = F.size(F.filter(scores, lambda c: c >= WELL_SEEN))
    t = poses.select(key, "frame", well.alias("seen"), F.array_min(scores).alias("worst"))
    near = strikes.select(key, "event_id", F.col("frame").alias("_s"), F.explode(F.sequence(F.col("frame") - POSE_REACH, F.col("frame") + POSE_REACH)).alias("frame"))
    met = near.join(t, [key, "frame"]).groupBy(key, "frame", "seen", "worst").agg(F.min(F.struct("_s", "event_id")).alias("_first"))
    best = F.max_by(F.struct("frame", "seen", "worst"), F.struct("seen", "worst", -F.col("_first._s"), -F.col("_first.event_id"), -F.col("frame")))
    return met.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")
