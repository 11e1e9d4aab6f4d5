"""Fights and rounds of a live stream of frames: the segmentation machines with their
state kept by fight from trigger to trigger."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from spanframe.operators.segmentation import Machine, Rules

ROUNDS = "fight_id long, start_frame long, end_frame long, final boolean, upto long, over boolean"


class RoundsOfFight(StatefulProcessor):
    """Emits the rounds that frames end (``final``), and after every trigger one status
    row with the round that is open (without frames: none is). Frames must come in
    order from trigger to trigger; one that is not beyond the last is left out, so
    that rows which are delivered again change nothing. A fight without frames for
    ``idle_ms`` of event time is over: its open round ends, its state is dropped."""

    def __init__(self, rules: Rules, idle_ms: int):
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values(["frame", "event_id"])
        kept = json.loads(self.state.get()[0]) if self.state.exists() else None
        machine = Machine(float(got.fps.iloc[0]), self.rules) if kept is None else Machine(**{**kept["machine"], "rules": self.rules})
        last, out = (-1, -1) if kept is None else tuple(kept["last"]), []
        for frame, tie, hit in zip(got.frame.tolist(), got.event_id.tolist(), got.hit.tolist(), strict=True):
            if (frame, tie) > last:
                last = (frame, tie)
                out += [(*key, *r, True, frame, False) for r in machine.see(frame, bool(hit))]
        start, end = (machine.open_round() or [(None, None)])[0]
        out.append((*key, start, end, False, machine.last_frame, False))
        fields = {k: v for k, v in asdict(machine).items() if k != "rules"}
        self.state.update((json.dumps({"machine": fields, "last": last}),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(got["at"].max().timestamp() * 1000) + self.idle_ms)
        yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        machine = Machine(**{**json.loads(self.state.get()[0])["machine"], "rules": self.rules})
        self.state.clear()
        yield _rows([*((*key, *r, True, machine.last_frame, True) for r in machine.open_round()), (*key, None, None, False, machine.last_frame, True)])

    def close(self) -> None:
        pass


def _rows(rows: list[tuple]) -> pd.DataFrame:
    names = ["fight_id", "start_frame", "end_frame", "final", "upto", "over"]
    return pd.DataFrame({c: pd.array(v, dtype="boolean" if c in ("final", "over") else "Int64") for c, v in zip(names, zip(*rows, strict=True), strict=True)})


def live_rounds(frames: DataFrame, rules: Rules = Rules(), late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:  # noqa: B008
    """Streaming rows of ``ROUNDS`` for streaming ``frames``: fight_id, frame, event_id,
    hit, fps and the instant ``at``. Needs a session of ``streams.stateful``."""
    kept = frames.select("fight_id", "frame", "event_id", F.coalesce("hit", F.lit(False)).alias("hit"), "fps", "at").withWatermark("at", late)
    return kept.groupBy("fight_id").transformWithStateInPandas(RoundsOfFight(rules, idle_ms), ROUNDS, "Append", "EventTime")


def rounds_so_far(emitted: DataFrame) -> DataFrame:
    """The rounds as of the last trigger: those that ended, and each fight's open one up
    to its last frame."""
    latest = Window.partitionBy("fight_id").orderBy(F.col("upto").desc(), F.col("over").desc())
    status = emitted.where("not final").withColumn("_n", F.row_number().over(latest)).where("_n = 1 and start_frame is not null")
    return emitted.where("final").unionByName(status.drop("_n")).select("fight_id", "start_frame", "end_frame")
