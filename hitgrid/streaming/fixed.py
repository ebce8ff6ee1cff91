"""Fixed windows from a run's first event: every window that time has passed comes out, empty ones too, and the last one is forced.

A window has the events of channels 1 .. channels, those of other channels as ignored, and mean and Feynman-Y of its
gates; a forced one ends behind the last event, its last gate may be cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = "run_id string, win long, start_us long, end_us long, forced boolean, n long, ignored long, mean double, y double"


def _mean_and_y(n: Column, f2: Column, gates: Column) -> tuple[Column, Column]:
    mean, m2 = n / gates, f2 / gates
    return mean, F.when(mean > 0, (m2 - mean * mean) / mean).otherwise(0.0)


def fixed_windows(events: DataFrame, window_us: int, gate_us: int, channels: int) -> DataFrame:
    """events (run_id, ts_us, channel) as WINDOWS. Events are counted by gate before anything is joined; a run's windows are a sequence of numbers."""
    runs = events.groupBy("run_id").agg(F.min("ts_us").alias("t0"), (F.max("ts_us") + 1).alias("t1"))
    last = F.expr(f"(t1 - t0 - 1) div {window_us}")
    spans = runs.select("run_id", "t0", "t1", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("win"))
    spans = spans.select("run_id", "win", (F.col("t0") + F.col("win") * window_us).alias("start_us"), F.least(F.col("t0") + (F.col("win") + 1) * window_us, F.col("t1")).alias("end_us"), (F.col("win") == F.col("last")).alias("forced"))
    at = events.join(runs.select("run_id", "t0"), "run_id").withColumn("_d", F.col("ts_us") - F.col("t0"))
    own = F.col("channel").between(1, channels)
    gates = at.groupBy("run_id", F.expr(f"_d div {window_us}").alias("win"), F.expr(f"_d % {window_us} div {gate_us}").alias("gate")).agg(F.count_if(own).alias("n"), F.count_if(F.coalesce(~own, F.lit(True))).alias("ignored"))
    sums = gates.groupBy("run_id", "win").agg(F.sum("n").alias("n"), F.sum("ignored").alias("ignored"), F.sum(F.col("n") * (F.col("n") - 1)).alias("f2"))
    whole = spans.join(sums, ["run_id", "win"], "left").na.fill(0, ["n", "ignored", "f2"])
    mean, y = _mean_and_y(F.col("n"), F.col("f2"), F.ceil((F.col("end_us") - F.col("start_us")) / gate_us))
    return whole.select("run_id", "win", "start_us", "end_us", "forced", "n", "ignored", mean.alias("mean"), y.alias("y"))


def stream_fixed_windows(events: DataFrame, window_us: int, gate_us: int, channels: int, lateness: str, idle_us: int) -> DataFrame:
    """The same over a stream with a column `ts` (timestamp) besides; rows may come late by `lateness`.

    The state of a run is its next window and the counts of its open gates. A window comes out when the watermark has passed its
    end, by an event-time timer also where no event comes; the last one is forced once the watermark is `idle_us` past
    the last event, and the run ends. So a run's gaps must be shorter than that.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t0, win, last, gates, own, ignored = state.get if state.exists else (None, 0, 0, [], [], [])
        counts = {g: [n, m] for g, n, m in zip(gates, own, ignored, strict=True)}
        rows = pd.concat(list(batches)) if not state.hasTimedOut else pd.DataFrame()
        if len(rows):
            t0 = int(rows["ts_us"].min()) if t0 is None else t0
            last = max(last, int(rows["ts_us"].max()))
            for (gate, mine), n in rows.groupby([(rows["ts_us"] - t0) // gate_us, rows["channel"].between(1, channels)]).size().items():
                counts.setdefault(int(gate), [0, 0])[0 if mine else 1] += int(n)
        passed = state.getCurrentWatermarkMs() * 1000
        out = []

        def flush(end: int, forced: bool) -> None:
            start = t0 + win * window_us
            inside = [g for g in counts if start <= t0 + g * gate_us < start + window_us]
            mine, other = [counts[g][0] for g in inside], sum(counts.pop(g)[1] for g in inside)
            n_gates = -(-(end - start) // gate_us)
            mean, m2 = sum(mine) / n_gates, sum(n * (n - 1) for n in mine) / n_gates
            out.append((key[0], win, start, end, forced, sum(mine), other, mean, (m2 - mean * mean) / mean if mean > 0 else 0.0))

        while t0 + (win + 1) * window_us <= min(passed, last):
            flush(t0 + (win + 1) * window_us, False)
            win += 1
        if passed > last + idle_us:
            while t0 + (win + 1) * window_us <= last:
                flush(t0 + (win + 1) * window_us, False)
                win += 1
            flush(last + 1, True)
            state.remove()
        else:
            state.update((t0, win, last, list(counts), [c[0] for c in counts.values()], [c[1] for c in counts.values()]))
            soon = min(t0 + (win + 1) * window_us, last + idle_us) if t0 + (win + 1) * window_us <= last else last + idle_us
            state.setTimeoutTimestamp(max(soon, passed) // 1000 + 1)
        yield pd.DataFrame(out, columns=names)

    timed = events.select("run_id", "ts_us", "channel", "ts").withWatermark("ts", lateness)
    return timed.groupBy("run_id").applyInPandasWithState(fold, WINDOWS, "t0 long, win long, last long, gates array<long>, own array<long>, ignored array<long>", "append", GroupStateTimeout.EventTimeTimeout)
