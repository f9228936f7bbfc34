"""Health checks of training runs as a stateful stream: the twin of `operators.evaluation.health_alerts`.

A run is a key. Its state holds the ranks' rows of steps that may still grow, the
last loss, the times of the last `recent` steps, and when it was heard of last.
Steps are judged in their order when the watermark passes the slot of time they
are in, so ranks may come late and in any order. A run that says nothing for
`silence` gets one alert, by a timer that each new row moves.

State a run: the steps within the watermark's delay and `recent` numbers, so it
does not grow with the run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "run long, step long, non_finite boolean, spike boolean, explosion boolean, collapse boolean, slow boolean, stale boolean, diverged boolean, silent boolean"
FLAGS = ["non_finite", "spike", "explosion", "collapse", "slow", "stale", "diverged", "silent"]
PENDING = "step long, bad long, loss double, grad double, seconds double, saved long, low long, high long, ms long"
FIELDS = [f.split()[0] for f in PENDING.split(", ")]


@dataclass(frozen=True)
class Bounds:
    """The limits of the checks; slots and silence in milliseconds."""

    grad: float = 10.0
    loss: float = 2.0
    slow: float = 1.5
    stale: int = 1000
    recent: int = 100
    slot_ms: int = 60_000
    silence_ms: int = 600_000


def slot_end(ms: int, width: int) -> int:
    return (ms // width + 1) * width


def folded(frame, width: int):
    """One row a step of ranks' rows or of rows folded before: extremes of what is finite, and how many values are not."""
    import pandas as pd

    f = frame.groupby("step", as_index=False).agg({"bad": "sum", "loss": "max", "grad": "max", "seconds": "max", "saved": "max", "low": "min", "high": "max", "ms": "max"})
    return f[FIELDS] if len(f) else pd.DataFrame(columns=FIELDS)


def judged(steps, last_loss: float | None, times: list[float], b: Bounds):
    """Alerts of steps in their order, the loss to compare with next, and the times to compare with next."""
    from math import isnan
    from statistics import median

    out = []
    for s in steps.sort_values("step").itertuples():
        has = lambda v: v is not None and not isnan(v)
        usual = median(times) if times else None
        out.append((
            int(s.step), s.bad > 0, bool(has(s.loss) and has(last_loss) and s.loss > b.loss * last_loss), bool(has(s.grad) and s.grad > b.grad), bool(has(s.grad) and s.grad == 0),
            bool(usual is not None and has(s.seconds) and s.seconds > b.slow * usual), bool(not has(s.saved) or s.step - s.saved > b.stale), bool(has(s.low) and s.low != s.high), False,
        ))
        last_loss = s.loss if has(s.loss) else None
        if has(s.seconds):
            times = [*times, s.seconds][-b.recent :]
    return out, last_loss, times


class HealthProcessor(StatefulProcessor):
    def __init__(self, bounds: Bounds):
        self.bounds = bounds

    def init(self, handle):
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.times = handle.getListState("times", "seconds double")
        self.last = handle.getValueState("last", "loss double, step long, deadline long")

    def _pending(self):
        import pandas as pd

        rows = list(self.pending.get()) if self.pending.exists() else []
        return pd.DataFrame([tuple(r) for r in rows], columns=FIELDS)

    def _keep(self, state, frame_rows: list[tuple]) -> None:
        state.clear()
        if frame_rows:
            state.put(frame_rows)

    def _plain(self, frame) -> list[tuple]:
        none = lambda v: None if v is None or v != v else v
        whole = {"step", "bad", "saved", "low", "high", "ms"}
        return [tuple(None if none(v) is None else int(v) if k in whole else float(v) for k, v in zip(FIELDS, r, strict=True)) for r in frame.itertuples(index=False)]

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        got = [self._pending(), *rows]
        steps = folded(pd.concat([g[FIELDS] for g in got if len(g)]), self.bounds.slot_ms)
        self._keep(self.pending, self._plain(steps))
        loss, _, deadline = self.last.get() if self.last.exists() else (None, None, None)
        for end in sorted({slot_end(int(ms), self.bounds.slot_ms) for ms in steps.ms}):
            self.handle.registerTimer(end)
        heard = int(steps.ms.max()) + self.bounds.silence_ms
        if deadline is None or heard > deadline:
            if deadline is not None:
                self.handle.deleteTimer(deadline)
            self.handle.registerTimer(heard)
            deadline = heard
        self.last.update((loss, int(steps.step.max()), deadline))
        yield pd.DataFrame({c: [] for c in ["run", "step", *FLAGS]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        at = expiredTimerInfo.getExpiryTimeInMs()
        loss, step, deadline = self.last.get()
        steps = self._pending()
        due = steps.ms.map(lambda ms: slot_end(int(ms), self.bounds.slot_ms)) <= at if len(steps) else steps.ms.astype(bool)
        out = []
        if due.any():
            times = [r[0] for r in self.times.get()] if self.times.exists() else []
            out, loss, times = judged(steps[due], loss, times, self.bounds)
            self._keep(self.times, [(t,) for t in times])
            self._keep(self.pending, self._plain(steps[~due]))
            self.last.update((loss, step, deadline))
        if at == deadline:
            out.append((step, *[False] * 7, True))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["run", "step", *FLAGS])

    def close(self):
        pass


def health_checks(log: DataFrame, bounds: Bounds = Bounds(), delay: str = "1 minute") -> DataFrame:
    """Alerts of a stream of ranks' rows: run, step, ts, loss, grad_norm, seconds, last_saved, param_hash. Needs the RocksDB state store."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = log.withWatermark("ts", delay).select(
        "run", "ts", F.col("step").cast("long").alias("step"), (~finite("loss") | ~finite("grad_norm")).cast("long").alias("bad"), F.when(finite("loss"), F.col("loss")).alias("loss"), F.when(finite("grad_norm"), F.col("grad_norm")).alias("grad"),
        F.col("seconds").cast("double").alias("seconds"), F.col("last_saved").cast("long").alias("saved"), F.col("param_hash").cast("long").alias("low"), F.col("param_hash").cast("long").alias("high"), F.unix_millis("ts").alias("ms"),
    )
    return rows.groupBy("run").transformWithStateInPandas(HealthProcessor(bounds), outputStructType=OUT, outputMode="append", timeMode="eventTime")
