"""Names, titles, descriptions and messages as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanframe.functions.vocabulary import lookup

# Wording of labelled and of predicted events ({} is the fighter).
HAND_STRIKES = {
    "jab": "jab", "cross": "cross", "left_hook": "left hook", "right_hook": "right hook", "left_uppercut": "left uppercut", "right_uppercut": "right uppercut",
    "left_elbow": "left elbow", "right_elbow": "right elbow", "elbow": "elbow",
}
LABEL_TEXT = {
    "calf_kick": " calf kick", "low_kick": " low kick", "middle_kick": " middle kick to the body", "high_kick": " high kick to the head", "clinch_punch": " punches in the clinch",
    "ground_punch": " lands ground and pound", "ground_knee": " knees from the ground", "takedown_attempt": " shoots for a takedown", "takedown_landed": " lands a takedown",
    "takedown_defended": " defends the takedown", "submission_attempt": " threatens a submission", "knockdown": " scores a KNOCKDOWN", "clinch_knee": " knee in the clinch",
}
STATE_TEXT = {"state_striking": "Fight state → STRIKING", "state_clinch": "Fight state → CLINCH", "state_ground": "Fight state → GROUND"}
PREDICTED_TEXT = {
    "takedown_initiated": " lands a takedown", "clinch_initiated": " initiates a clinch", "clinch_punch": " punches in the clinch", "clinch_knee": " knees in the clinch",
    "ground_punch": " lands ground and pound", "ground_knee": " knees from the ground",
}
OPEN_TEXT = {
    "knee": " throws a knee", "head_kick": " kicks to the head", "middle_kick": " kicks to the body", "low_kick": " kicks to the leg",
} | {f"{p}_{t}": f" {p} to the {t}" for p in ("jab", "cross", "hook", "uppercut") for t in ("head", "body")}
# Aimed actions, those with a target of their own, those that always landed.
AIMED = tuple(HAND_STRIKES)
FIXED_TARGET = {"calf_kick": "leg", "low_kick": "leg", "middle_kick": "body", "high_kick": "head"}
ALWAYS_LANDED = ("knockdown", "takedown_landed")
PUNCHES = ("jab", "cross", "hook", "uppercut")
KICKS = {"head": "head_kick", "body": "middle_kick", "leg": "low_kick"}


def describe_label(action: Column, target: Column, name: Column, in_clinch: Column) -> Column:
    """What a labelled event says; an unknown action is named as it is."""
    hand = F.concat(name, F.lit(" "), lookup(HAND_STRIKES, action), F.lit(" to the "), F.coalesce(target, F.lit("head")))
    knee = F.when(action == "knee", F.concat(name, F.when(in_clinch, " knee in the clinch").otherwise(" knee")))
    return F.coalesce(lookup(STATE_TEXT, action), hand, knee, F.concat(name, lookup(LABEL_TEXT, action)), action, F.lit(""))


def describe_prediction(action: Column, state: Column, success: Column, name: Column, round_: Column) -> Column:
    """What a predicted event says, with its outcome where that is open."""
    outcome = F.when(success.eqNullSafe(True), " (landed)").when(success.eqNullSafe(False), " (missed)").otherwise(" (unconfirmed)")
    who, label = F.coalesce(name, F.lit("Fighter")), F.coalesce(F.concat(F.lit("Round "), round_), F.lit("Round"))
    text = F.coalesce(F.concat(who, lookup(PREDICTED_TEXT, action)), F.concat(who, lookup(OPEN_TEXT, action), outcome), action)
    return F.when(action.isNull(), F.coalesce(F.concat(F.lit("Fight state → "), state), F.lit(""))).when(action == "round_start", F.concat(label, F.lit(" started"))).when(action == "round_end", F.concat(label, F.lit(" ended"))).otherwise(text)


def stem(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(.)\.[^.]+$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def title(path: Column, red: Column, blue: Column) -> Column:
    """Both names, else the stem of the video's file."""
    known = (F.coalesce(red, F.lit("")) != "") & (F.coalesce(blue, F.lit("")) != "")
    return F.when(known, F.concat(red, F.lit(" vs "), blue)).otherwise(stem(path))


def safe_name(path: Column) -> Column:
    """A file name of word characters, dots and hyphens; "video" if none is left."""
    kept = F.regexp_replace(F.regexp_replace(stem(path), r"[^\w\-.]", "_"), "^_+|_+$", "")
    end = extension(path)
    return F.concat(F.when(kept == "", "video").otherwise(kept), F.when(end != "", F.concat(F.lit("."), end)).otherwise(""))


def email(text: Column) -> Column:
    """Trimmed lower-case address; null if it is none."""
    t = F.lower(F.trim(text))
    return F.when(t.contains("@") & (F.length(t) <= 320), t)


def reclassified_target(action: Column, target: Column) -> Column:
    """Target after an event becomes ``action``: its fixed one, else head or body."""
    return F.coalesce(lookup(FIXED_TARGET, action), F.when(action.isin(*AIMED), F.when(target.eqNullSafe("body"), "body").otherwise("head")))


def reclassified_success(action: Column) -> Column:
    return F.when(action.isin(*ALWAYS_LANDED), True)


def strike_action(family: Column, target: Column, state: Column) -> Column:
    """Action name of a strike model's output."""
    punch = F.when(state == "CLINCH", "clinch_punch").when(state == "GROUND", "ground_punch").otherwise(F.concat(family, F.when(target.eqNullSafe("head"), "_head").otherwise("_body")))
    knee = F.when(state == "GROUND", "ground_knee").when(state == "CLINCH", "clinch_knee").otherwise("knee")
    return F.when(family.isin(*PUNCHES), punch).when(family == "kick", lookup(KICKS, target)).otherwise(knee)


def measure(text: Column) -> Column:
    """Number of a measurement: feet and inches as inches, inches, a leading number, else 0."""
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    feet, inches, plain = r"(\d+)'(\d+)", r"(\d+)\"", r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))"
    return (
        F.when(part(feet, 1) != "", part(feet, 1).try_cast("double") * 12 + part(feet, 2).try_cast("double"))
        .when(part(inches, 1) != "", part(inches, 1).try_cast("double"))
        .otherwise(F.coalesce(F.when(part(plain, 1) != "", part(plain, 1).try_cast("double")), F.lit(0.0)))
    )


def split_name(full: Column) -> Column:
    """Struct first, name: the surname in capitals and what comes before it."""
    parts = F.split(F.trim(full), r"\s+")
    last = F.element_at(parts, -1)
    before = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")
    return F.when(F.trim(full) != "", F.struct(F.when(before == "", last).otherwise(before).alias("first"), F.upper(last).alias("name")))


def invalid_reason(reported: Column, decoded: Column) -> Column:
    """Why a video is invalid."""
    percent = F.when(reported > 0, F.floor((reported - decoded) / reported * 100 + 0.5)).otherwise(0)
    text = F.format_string("Container reports %d frames, only %d decode (%d%% missing) — the file is an incomplete download.", reported, decoded, percent)
    return F.when(reported.isNull() | decoded.isNull(), "The source video failed to decode.").otherwise(text)


def uploader_subject(state: Column, name: Column, labelled: Column) -> Column:
    """Subject of the message that a state sends to the uploader; null for none."""
    return (
        F.when(state == "completed", F.concat(name, F.lit(" is ready")))
        .when((state == "labeling_in_progress") & ~labelled, F.concat(name, F.lit(" is ready to label")))
        .when(state == "failed", F.concat(F.lit("processing failed for "), name))
        .when(state == "invalid", F.concat(name, F.lit(" could not be processed")))
    )


def uploader_body(state: Column, name: Column, fight: Column, reported: Column, decoded: Column, base: str) -> Column:
    frames = F.when((reported != 0) & decoded.isNotNull(), F.format_string(" Only %d of its %d frames could be decoded.", decoded, reported)).otherwise("")
    url = F.concat(F.lit(f"{base}/fights/"), fight)
    return (
        F.when(state == "completed", F.concat(name, F.lit(" has been processed. Its AI annotations are ready to review:\n\n"), url, F.lit("\n")))
        .when(state == "labeling_in_progress", F.concat(name, F.lit(" has been processed. Fighter tracking is done, so it's ready to label:\n\n"), url, F.lit("/annotate\n")))
        .when(state == "failed", F.concat(F.lit("The pipeline failed while processing "), name, F.lit(f". You can delete it and upload it again from the fight list:\n\n{base}/\n")))
        .when(state == "invalid", F.concat(name, F.lit(" didn't pass validation, so it wasn't processed."), frames, F.lit(f" The file is probably truncated: download or export it again, then upload it again:\n\n{base}/\n")))
    )
