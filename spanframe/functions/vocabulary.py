"""Fixed vocabularies of the event model, and how to look them up in both engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of actions, families, targets and states.

STATES = ("STRIKING", "CLINCH", "GROUND")
FAMILIES = ("jab", "cross", "hook", "uppercut", "elbow", "knee", "kick", "punch")
SPECIFIC_FAMILIES = ("jab", "cross", "hook", "uppercut", "elbow", "knee", "kick")
TARGETS = ("head", "body", "leg", "unknown")

#: Predicted action -> (family, target).
PREDICTED = {
    "jab_head": ("jab", "head"),
    "jab_body": ("jab", "body"),
    "cross_head": ("cross", "head"),
    "cross_body": ("cross", "body"),
    "hook_head": ("hook", "head"),
    "hook_body": ("hook", "body"),
    "uppercut_head": ("uppercut", "head"),
    "uppercut_body": ("uppercut", "body"),
    "head_kick": ("kick", "head"),
    "middle_kick": ("kick", "body"),
    "low_kick": ("kick", "leg"),
    "knee": ("knee", "unknown"),
    "clinch_punch": ("punch", "unknown"),
    "ground_punch": ("punch", "unknown"),
    "clinch_knee": ("knee", "unknown"),
    "ground_knee": ("knee", "unknown"),
}
PREDICTED_FAMILY = {action: family for action, (family, _) in PREDICTED.items()}
PREDICTED_TARGET = {action: target for action, (_, target) in PREDICTED.items()}

#: Labelled action -> family.
LABEL_FAMILY = {
    "jab": "jab",
    "cross": "cross",
    "left_hook": "hook",
    "right_hook": "hook",
    "left_uppercut": "uppercut",
    "right_uppercut": "uppercut",
    "calf_kick": "kick",
    "low_kick": "kick",
    "middle_kick": "kick",
    "high_kick": "kick",
    "left_elbow": "elbow",
    "right_elbow": "elbow",
    "elbow": "elbow",
    "knee": "knee",
    "clinch_knee": "knee",
    "ground_knee": "knee",
    "clinch_punch": "punch",
    "ground_punch": "punch",
}

#: Labelled state mark -> state.
STATE_MARK = {"state_striking": "STRIKING", "state_clinch": "CLINCH", "state_ground": "GROUND"}

CLINCH_ACTIONS = ("clinch_punch", "clinch_knee")
GROUND_ACTIONS = ("ground_punch", "ground_knee")


def lookup(mapping: dict, key: Column | str) -> Column:
    """The value that ``mapping`` (a few dozen literals) has for ``key``, else null."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.col(key) if isinstance(key, str) else key)


def sql_lookup(mapping: dict, key: str) -> str:
    """The same as a SQL CASE."""
    arms = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in mapping.items())
    return f"CASE {key} {arms} END"


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# ---------------------------------------------------------------- rounding


def half_even(x: Column) -> Column:
    """Nearest integer as a long, halves to the even one."""
    return F.rint(x).cast("long")


def half_up(x: Column) -> Column:
    """Nearest integer as a long, halves up."""
    return F.floor(x + F.lit(0.5)).cast("long")


def share(part: Column, whole: Column, otherwise: float | None = 0.0) -> Column:
    """part / whole, or ``otherwise`` where whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(otherwise).cast("double"))
