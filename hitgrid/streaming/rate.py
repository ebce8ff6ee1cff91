"""The simple rate controller: trailing rate, smoothing, change detection on log rate, five states, slewed width.

One step function serves the batch fold (`control_runs`) and the streaming operator (`control_stream`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class RateConfig:
    target: float = 0.1  # relative error, so that 1 / target ** 2 events are wanted
    w_min: float = 1.0
    w_max: float = 48.0
    start: float = 5.0
    warmup: float = 5.0
    min_events: int = 10
    tau: float = 4.0
    step: float = 1.0
    delta: float = 0.02
    threshold: float = 1.5
    debounce: float = 3.0
    expand: float = 2.0
    contract: float = 4.0


@dataclass
class RateState:
    w: float = 5.0
    smooth: float = -1.0
    k: int = 0
    mean: float = 0.0
    cum: float = 0.0
    low: float = 0.0
    state: str = "Warmup"
    alarm_since: float = -1.0
    clear_since: float = 0.0


RATE_SCHEMA = "run_id string, t double, n long, w double, rate double, smooth double, w_des double, change double, alarm boolean, state string"


def rate_step(s: RateState, c: RateConfig, t: float, n: int) -> dict:
    """One step at time t with n events in [t - w, t)."""
    used = s.w
    rate = n / used
    alpha = 1 - math.exp(-c.step / c.tau)
    s.smooth = rate if s.smooth < 0 else s.smooth + alpha * (rate - s.smooth)
    wanted = min(max(1 / c.target**2 / max(s.smooth, 1e-9), c.w_min), c.w_max)
    x = math.log(rate + 1e-6)
    s.k += 1
    s.mean += (x - s.mean) / s.k
    s.cum += x - s.mean - c.delta
    s.low = min(s.low, s.cum)
    change = s.cum - s.low
    alarm = change > c.threshold
    if alarm:
        s.alarm_since, s.clear_since = (s.alarm_since if s.alarm_since >= 0 else t), -1.0
    else:
        s.alarm_since, s.clear_since = -1.0, (s.clear_since if s.clear_since >= 0 else t)
    sustained = alarm and t - s.alarm_since >= c.debounce
    cleared = not alarm and t - s.clear_since >= c.debounce
    few = n < c.min_events or rate < c.min_events / c.w_max
    if t < c.warmup:
        s.state = "Warmup"
    elif sustained:
        s.state = "Hold" if n >= c.min_events else "Degraded"
    elif s.state in ("Hold", "Degraded"):
        s.state = "Track" if cleared else s.state
    elif s.state == "LowRate":
        s.state = "Track" if n >= c.min_events and cleared else "LowRate"
    else:
        s.state = "LowRate" if few else "Track"
    if s.state == "Track":
        s.w += min(max(wanted - s.w, -c.contract), c.expand)
    elif s.state in ("Degraded", "LowRate"):
        s.w += c.expand
    s.w = min(max(s.w, c.w_min), c.w_max)
    return {"t": t, "n": n, "w": used, "rate": rate, "smooth": s.smooth, "w_des": wanted, "change": change, "alarm": alarm, "state": s.state}


def _count(times: list[int], bins: list[int], cum: list[int], a: float, b: float) -> int:
    """Events of the bins in [a, b) by cumulative counts."""
    from bisect import bisect_left

    return cum[bisect_left(bins, math.ceil(b))] - cum[bisect_left(bins, math.ceil(a))]


def control_runs(bins: DataFrame, config: RateConfig | None = None) -> DataFrame:
    """bins (run_id, bin, n) as controller steps of each run, a step a bin. A run's bins are few; its events never come here."""
    c = config or RateConfig()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        run, first = pdf["run_id"].iloc[0], int(pdf["bin"].iloc[0])
        at = (pdf["bin"] - first).astype(int).tolist()
        cum = [0, *pdf["n"].cumsum().astype(int).tolist()]
        state, out = RateState(w=c.start), []
        for t in range(1, at[-1] + 2):
            n = _count([], at, cum, t - state.w, t)
            out.append({"run_id": run, **rate_step(state, c, float(t), n)})
        return pd.DataFrame(out)

    return bins.groupBy("run_id").applyInPandas(fold, RATE_SCHEMA)


def control_stream(bins: DataFrame, config: RateConfig | None = None) -> DataFrame:
    """The same over a stream of (run_id, bin, n) in order: each bin is a step, and only the bins of the widest window stay in the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    c = config or RateConfig()
    kept = "w double, smooth double, k int, mean double, cum double, low double, state string, alarm_since double, clear_since double, first long, at array<long>, ns array<long>"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        names = list(RateState.__annotations__)
        if held.exists:
            got = held.get
            state, first, at, ns = RateState(*got[: len(names)]), got[len(names)], list(got[-2]), list(got[-1])
        else:
            state, first, at, ns = RateState(w=c.start), None, [], []
        rows = pd.concat(list(batches)).sort_values("bin")
        out = []
        for b, n in zip(rows["bin"].tolist(), rows["n"].tolist(), strict=True):
            first = b if first is None else first
            done = int(at[-1] + 1) if at else 0
            for t in range(done + 1, int(b - first) + 2):  # empty bins are steps, too
                if t == int(b - first) + 1:
                    at.append(int(b - first))
                    ns.append(int(n))
                seen = sum(m for k, m in zip(at, ns, strict=True) if t - state.w <= k < t)
                out.append({"run_id": key[0], **rate_step(state, c, float(t), seen)})
            while at and at[0] < at[-1] - c.w_max:
                at.pop(0)
                ns.pop(0)
        held.update((*asdict(state).values(), first, at, ns))
        yield pd.DataFrame(out)

    return bins.groupBy("run_id").applyInPandasWithState(fold, RATE_SCHEMA, kept, "append", GroupStateTimeout.NoTimeout)
