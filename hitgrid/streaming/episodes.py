"""The episode policy: debounced start, probes and a final request, gates for publishing, recovery.

Predictions are joined to the windows first, so the policy is a fold over the windows of a run.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class PolicyConfig:
    debounce: int = 2
    recover: int = 2
    probe_counts: float = 60.0
    first: float = 30.0
    last: float = 60.0
    n_low: float = 80.0
    n_high: float = 120.0
    tolerance: float = 1.0
    stable_need: int = 3
    early_need: int = 2
    p_publish: float = 0.80
    p_early: float = 0.98


@dataclass
class PolicyState:
    active: bool = False
    streak: int = 0
    calm: int = 0
    counts: float = 0.0
    duration: float = 0.0
    asked_at: float = 0.0
    candidate: bool = False
    stable: int = 0
    before: tuple[str, float] | None = None
    episode: int = 0
    pending: tuple[float, float] = (0.0, 0.0)


DECISIONS = "run_id string, idx long, episode int, counts double, duration double, request string, decision string, reason string"


def needed(c: PolicyConfig, duration: float) -> float:
    return c.n_low + (c.n_high - c.n_low) * (min(max(duration, c.first), c.last) - c.first) / (c.last - c.first)


def _end(s: PolicyState) -> None:
    s.active, s.streak, s.calm, s.counts, s.duration, s.asked_at, s.candidate, s.stable, s.before = False, 0, 0, 0.0, 0.0, 0.0, False, 0, None


def policy_step(s: PolicyState, c: PolicyConfig, n: float, seconds: float, confused: bool, label: str, center: float, p: float, ood: bool) -> dict | None:
    """One window. Returns its decision record, or None where nothing is asked for or ends."""
    if not s.active:
        if not confused:
            s.streak, s.pending = 0, (0.0, 0.0)
            return None
        s.streak += 1
        s.pending = s.pending[0] + n, s.pending[1] + seconds
        if s.streak < c.debounce:
            return None
        s.active, s.episode, (s.counts, s.duration), s.pending, s.calm = True, s.episode + 1, s.pending, (0.0, 0.0), 0
        return {"request": None, "decision": "Start", "reason": "CONFUSED", **_now(s)}
    s.counts, s.duration = s.counts + n, s.duration + seconds
    s.calm = 0 if confused else s.calm + 1
    if s.calm >= c.recover and not s.candidate:
        out = {"request": None, "decision": "End", "reason": "CONFUSION_CLEARED", **_now(s)}
        _end(s)
        return out
    final = s.duration >= c.last
    if not final and not (s.duration >= c.first and s.counts - s.asked_at >= c.probe_counts):
        return None
    s.asked_at = s.counts
    return _result(s, c, "final" if final else "probe", label, center, p, ood)


def _now(s: PolicyState) -> dict:
    return {"episode": s.episode, "counts": s.counts, "duration": s.duration}


def _result(s: PolicyState, c: PolicyConfig, kind: str, label: str, center: float, p: float, ood: bool) -> dict:
    enough = s.counts >= needed(c, s.duration)
    inside = c.first <= s.duration <= c.last
    s.candidate = s.candidate or (inside and not ood and enough)
    say = lambda d, r: {"request": kind, "decision": d, "reason": r, **_now(s)}
    if kind == "final":
        out = say("Publish", "UNKNOWN_OOD" if ood else "OK" if enough else "LOW_STATISTICS")
        _end(s)
        return out
    if ood or not inside:
        s.stable, s.before = 0, None
        return say("Refuse", "OUT_OF_DISTRIBUTION") if ood else say("Defer", "OUTSIDE_TIME")
    same = s.before is not None and s.before[0] == label and abs(s.before[1] - center) < c.tolerance
    s.stable, s.before = (s.stable + 1 if same else 0), (label, center)
    if not s.candidate and not enough:
        return say("Defer", "COUNTS")
    sure = lambda q: p >= q or p <= 1 - q
    if (s.stable >= c.early_need and sure(c.p_early)) or (s.stable >= c.stable_need and sure(c.p_publish)):
        out = say("Publish", "STABLE")
        _end(s)
        return out
    return say("Defer", "PROBABILITY" if s.stable >= c.stable_need else "STABILITY")


def run_policy(windows: DataFrame, config: PolicyConfig | None = None) -> DataFrame:
    """windows (run_id, idx, n, seconds, confused, label, center, p, ood) as decision records."""
    c = config or PolicyConfig()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = PolicyState(), []
        for r in pdf.sort_values("idx").itertuples(index=False):
            if done := policy_step(s, c, r.n, r.seconds, bool(r.confused), r.label, r.center, r.p, bool(r.ood)):
                out.append({"run_id": r.run_id, "idx": r.idx, **done})
        return pd.DataFrame(out, columns=[x.split()[0] for x in DECISIONS.split(", ")])

    return windows.groupBy("run_id").applyInPandas(fold, DECISIONS)
