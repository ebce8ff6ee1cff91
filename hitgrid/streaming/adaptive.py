"""The adaptive window engine: gate ladder, Feynman-Y, change monitors, eight states and a window that follows the statistics.

Feedback makes each step depend on the one before, so a run is folded in order; what it folds are pre-counted
bins, and prefix sums give every gate sum in constant time.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class AdaptiveConfig:
    gates: tuple[int, ...] = (1, 2, 4, 8, 16, 32)  # bins
    start: float = 48.0  # all widths and times in bins
    floor: float = 12.0
    w_max: float = 240.0
    cadence: float | None = 6.0  # the fixed step of a replay; None: the live engine's, which follows beta * w
    beta_track: float = 0.5
    beta_other: float = 0.1
    z_min: float = 3.0
    z_track: float = 3.0
    z_hold: float = 6.0
    z_poisson: float = 4.0
    eta: float = 0.05
    confirm: int = 2
    eps_y: float = 0.10
    eps_m1: float = 0.02
    ph_delta: float = 5e-3
    ph_threshold: float = 50.0
    mismatch_need: int = 3
    mismatch_clear: int = 6
    tau_k: float = 3.0
    min_gates: int = 2
    first_gate: int = 2


@dataclass
class Monitor:
    """Page-Hinkley with an exponential mean from 0, clamped at 0."""

    mean: float = 0.0
    cum: float = 0.0

    def step(self, x: float, delta: float, threshold: float) -> bool:
        self.mean = 0.99 * self.mean + 0.01 * x
        self.cum = max(0.0, self.cum + x - self.mean - delta)
        return self.cum > threshold


@dataclass
class AdaptiveState:
    w: float
    left: int = 0
    gate: int = 0
    state: str = "Warmup"
    pending_gate: int = -1
    gate_votes: int = 0
    pending_state: str = ""
    state_votes: int = 0
    quiet: int = 0
    quiet_until: float = 0.0
    tau: float = math.nan
    alarm: bool = False
    mismatches: int = 0
    clean: int = 0
    beta: float = 0.1
    rate_monitor: Monitor = field(default_factory=Monitor)
    z_monitor: Monitor = field(default_factory=Monitor)


ADAPTIVE_SCHEMA = "run_id string, step int, t double, state string, w double, gate int, m1 double, y double, sigma_y double, z double, max_abs_z double, tau double, mismatch boolean, insufficient boolean, alarm boolean, beta double, wanted int, votes int, quiet_until double"


def gate_moments(prefix: np.ndarray, left: int, width: float, gate: int) -> dict[str, float]:
    """Moments and the delta-method error of Y for N whole gates from the left edge; bins after the last are empty."""
    n = max(1, int(width // gate))
    edges = np.minimum(left + gate * np.arange(n + 1), len(prefix) - 1)
    c = np.diff(prefix[edges]).astype(float)
    f2, f3 = c * (c - 1), c * (c - 1) * (c - 2)
    m1, m2, m3 = c.mean(), f2.mean(), f3.mean()
    free = max(1, n - 1)
    v11, v22 = max(0.0, ((c * c).sum() - n * m1 * m1) / free) / n, max(0.0, ((f2 * f2).sum() - n * m2 * m2) / free) / n
    v33 = max(0.0, ((f3 * f3).sum() - n * m3 * m3) / free) / n
    v12 = ((c * f2).sum() - n * m1 * m2) / free / n
    most = max(v11, v22, v33)
    ok, ridge = most > 0, 1e-3 * max(1.0, most)
    y = (m2 - m1 * m1) / m1 if m1 > 0 else 0.0
    var = 0.0
    if m1 > 0:
        a, b = -m2 / m1**2 - 1, 1 / m1
        var = max(0.0, a * a * (v11 + ridge) + b * b * (v22 + ridge) + 2 * a * b * v12)
    sigma = math.sqrt(var) if n > 1 and ok and var > 0 else math.inf
    return {"n": n, "m1": m1, "v11": v11, "y": y, "sigma": sigma, "ok": ok}


def fit_tau(times: np.ndarray, ys: np.ndarray, sigmas: np.ndarray) -> tuple[float, float]:
    """(tau, rms residual) of Y (1 - exp(-t / tau)) on a grid of 80 values; tau is NaN for flat or too short series."""
    fine = (times > 0) & np.isfinite(ys) & (ys > 0)
    if fine.sum() < 2:
        return math.nan, math.inf
    t, y, s = times[fine], ys[fine], sigmas[fine]
    mid = np.median(y)
    mad = np.median(np.abs(y - mid))
    near = np.abs(y - mid) <= (6 * mad if mad > 0 else 0.25 * max(1e-6, mid))
    if near.sum() < 2:
        return math.nan, math.inf
    t, y, s = t[near], y[near], s[near]
    if (y.max() - y.min()) / (abs(y.mean()) + 1e-12) < 0.02:
        return math.nan, 0.5
    known = np.isfinite(s) & (s > 0)
    weigh = known.sum() >= max(2, len(s) // 2) and s[known].max() / max(s[known].min(), 1e-12) < 1e6
    w = np.where(known, 1 / np.where(known, s, 1.0) ** 2, 1.0) if weigh else np.ones(len(y))
    grid = np.geomspace(0.05 * t.min(), 20 * t.max(), 80)
    f = 1 - np.exp(-t[None, :] / grid[:, None])
    top = (w * y * f).sum(axis=1) / (w * f * f).sum(axis=1)
    err = (w * (y - top[:, None] * f) ** 2).sum(axis=1) / w.sum()
    k = int(np.argmin(err))
    return float(grid[k]), float(np.sqrt(np.mean((y - top[k] * f[k]) ** 2)))


def tau_floor(s: AdaptiveState, c: AdaptiveConfig) -> float:
    return max(c.floor, c.tau_k * s.tau) if math.isfinite(s.tau) and s.tau > 0 else c.floor


def beta_of(s: AdaptiveState, c: AdaptiveConfig) -> float:
    return c.beta_track if s.state == "Track" else c.beta_other


def stride(s: AdaptiveState, c: AdaptiveConfig) -> float:
    """Bins until the next analysis: fixed in a replay, else the share beta of the window, one bin at least."""
    return c.cadence if c.cadence is not None else min(max(1.0, s.beta * s.w), c.w_max)


def adapt(s: AdaptiveState, c: AdaptiveConfig, rel_y: float, rel_m1: float, honor_tau_floor: bool, down: float, up: float) -> None:
    floor = tau_floor(s, c)
    if rel_y < 0.5 * c.eps_y and rel_m1 < 0.5 * c.eps_m1:
        s.w = max(0.9 * s.w, floor)
    elif rel_y > 2 * c.eps_y or rel_m1 > 2 * c.eps_m1:
        s.w = min(1.2 * s.w, c.w_max)
    if rel_y > c.eps_y or rel_m1 > c.eps_m1:
        s.w = min(1.3 * s.w, c.w_max)
    elif rel_y < c.eps_y and rel_m1 < c.eps_m1:
        s.w = max(0.95 * s.w, floor)
    scale = max((rel_y / c.eps_y) ** 2, (rel_m1 / c.eps_m1) ** 2)
    if math.isfinite(scale) and scale > 0:
        # Only a contraction minds the correlation time here; else the window's own floor is the bound.
        s.w = min(max(min(max(s.w * scale, s.w * down), s.w * up), floor if honor_tau_floor else c.floor), c.w_max)


def choose_gate(s: AdaptiveState, c: AdaptiveConfig, wanted: int, insufficient: bool) -> None:
    """A new gate needs two votes in a row; none changes in Hold, and no larger one on too few statistics."""
    if wanted == s.gate:
        s.pending_gate, s.gate_votes = -1, 0
        return
    if wanted != s.pending_gate:
        s.pending_gate, s.gate_votes = wanted, 1
        return
    s.gate_votes += 1
    if s.state == "Hold":
        s.pending_gate, s.gate_votes = -1, 0
    elif s.gate_votes >= c.confirm:
        if not (wanted > s.gate and insufficient):
            s.gate = wanted
        s.pending_gate, s.gate_votes = -1, 0


def request(s: AdaptiveState, c: AdaptiveConfig, to: str, now: float) -> None:
    """A new state needs two requests in a row, also where one confirmation is asked for."""
    if to == s.state:
        s.pending_state, s.state_votes = s.state, 0
        return
    if to != s.pending_state:
        s.pending_state, s.state_votes = to, 1
        return
    s.state_votes += 1
    if s.state_votes < c.confirm:
        return
    s.pending_state, s.state_votes, s.state = to, 0, to
    s.beta = beta_of(s, c)
    if to == "Hold":
        s.alarm, s.pending_gate = False, -1
        s.w = max(s.w, tau_floor(s, c))
        s.quiet_until = now + max(5 * s.beta * s.w, 4 * tau_floor(s, c))
    elif to in ("LowRate", "Degraded"):
        s.gate, s.w = 0, max(s.w, c.floor)
    else:
        s.quiet_until = 0.0
    if to != "Warmup":
        s.quiet = 0


def step(s: AdaptiveState, c: AdaptiveConfig, prefix: np.ndarray, now: float, base: int = 0) -> dict:
    """One analysis at time `now` (bins from the start); prefix begins at bin `base`, which the window has not left."""
    s.left = max(s.left, int(max(0.0, now - s.w)))
    gates = [gate_moments(prefix, s.left - base, s.w, g) for g in c.gates]
    valid = [math.isfinite(g["sigma"]) and g["sigma"] > 0 for g in gates]
    zs = [g["y"] / g["sigma"] if v else 0.0 for g, v in zip(gates, valid, strict=True)]
    max_z = max((abs(z) for k, (z, v) in enumerate(zip(zs, valid, strict=True)) if v and k >= c.first_gate and gates[k]["n"] >= c.min_gates), default=0.0)
    sig, plateau = -1, -1
    for k, (g, v) in enumerate(zip(gates, valid, strict=True)):
        if v and g["y"] > 0 and zs[k] >= c.z_min:
            if sig < 0:
                sig = k
            elif abs((g["y"] - gates[k - 1]["y"]) / math.log(c.gates[k] / c.gates[k - 1])) < c.eta * abs(g["y"]):
                plateau = k
    at = gates[s.gate]
    insufficient = at["n"] < 2 or at["m1"] < 1e-6
    s.tau, rms = fit_tau(np.array(c.gates, float), np.array([g["y"] for g in gates]), np.array([g["sigma"] for g in gates]))
    mismatch = math.isfinite(rms) and math.isfinite(s.tau) and rms > 2 * c.eps_y
    # Flat and short series have no fit: they count neither way.
    s.mismatches, s.clean = (s.mismatches + 1, 0) if mismatch else (0, s.clean + 1) if math.isfinite(rms) and math.isfinite(s.tau) else (0, 0)
    moments, z_sel = at, zs[s.gate]
    wanted = 0 if sig < 0 else plateau if plateau >= sig else sig
    choose_gate(s, c, wanted, insufficient)
    fired = [s.rate_monitor.step(moments["m1"], c.ph_delta, c.ph_threshold), s.z_monitor.step(z_sel, c.ph_delta, c.ph_threshold)]
    s.alarm = s.alarm or any(fired)
    insufficient = insufficient or sig < 0 or not math.isfinite(moments["sigma"]) or moments["sigma"] <= 0
    degraded = not all(g["ok"] for g in gates) or (any(valid) and all(g["y"] <= 0 for g, v in zip(gates, valid, strict=True) if v))
    rel_y = moments["sigma"] / moments["y"] if moments["y"] > 0 else math.inf
    rel_m1 = math.sqrt(moments["v11"]) / moments["m1"] if moments["m1"] > 0 else math.inf
    _transition(s, c, now, max_z, z_sel, insufficient, degraded, any(fired), sig, rel_y, rel_m1, moments)
    return {"t": now, "state": s.state, "w": s.w, "gate": c.gates[s.gate], "m1": moments["m1"], "y": moments["y"], "sigma_y": moments["sigma"] if math.isfinite(moments["sigma"]) else None, "z": z_sel, "max_abs_z": max_z, "tau": s.tau if math.isfinite(s.tau) else None, "mismatch": mismatch, "insufficient": insufficient, "alarm": s.alarm, "beta": s.beta, "wanted": c.gates[wanted], "votes": s.gate_votes, "quiet_until": s.quiet_until if s.state == "Hold" else None}


def _transition(s, c, now, max_z, z_sel, insufficient, degraded, fired, sig, rel_y, rel_m1, moments) -> None:
    if s.mismatches >= c.mismatch_need and s.state != "Degraded":
        request(s, c, "Degraded", now)
    floor, worst = tau_floor(s, c), max(rel_y, rel_m1)
    strong = "Hold" if max_z >= c.z_hold else "Track" if max_z >= c.z_track else ""
    s.beta = beta_of(s, c)

    def quiet(is_quiet: bool) -> None:
        s.quiet = s.quiet + 1 if is_quiet and abs(z_sel) < c.z_poisson else 0
        if s.quiet >= 1:
            request(s, c, "Poisson", now)

    state = s.state
    if state == "Warmup":
        if to := "Hold" if s.alarm else "LowRate" if insufficient else strong:
            s.quiet = 0 if to == strong else s.quiet
            request(s, c, to, now)
        else:
            quiet(now - s.left >= s.w and moments["n"] >= 2 and moments["m1"] > 0 and max_z < c.z_poisson)
    elif state == "Poisson":
        if to := "Hold" if s.alarm else "LowRate" if insufficient else "Degraded" if degraded else strong:
            request(s, c, to, now)
        else:
            s.w = max(s.w, floor)
    elif state == "Track":
        if to := "Hold" if s.alarm else "Degraded" if degraded else "LowRate" if insufficient else "Hold" if fired else "":
            request(s, c, to, now)
            return
        if worst > 1 and s.w < c.w_max:
            request(s, c, "Expand", now)
        elif worst < 0.5 and s.w > floor:
            request(s, c, "Contract", now)
        else:
            adapt(s, c, rel_y, rel_m1, False, 0.5, 2.0)
        quiet(max_z < c.z_poisson)
    elif state == "Expand":
        adapt(s, c, rel_y, rel_m1, False, 0.8, 2.0)
        if worst <= 1 or s.w >= c.w_max:
            request(s, c, "Track", now)
    elif state == "Contract":
        adapt(s, c, rel_y, rel_m1, True, 0.5, 1.2)
        if worst >= 0.8 or s.w <= floor:
            request(s, c, "Track", now)
    elif state == "Hold":
        s.w = max(s.w, floor)
        if not fired and now >= s.quiet_until:
            request(s, c, "Track", now)
    else:
        s.alarm = False if state == "Degraded" else s.alarm
        s.gate, s.w = 0, min(1.2 * s.w, c.w_max)
        if (state == "LowRate" and sig >= 0) or (state == "Degraded" and s.clean >= c.mismatch_clear):
            request(s, c, "Track", now)


def run_engine(bins: DataFrame, config: AdaptiveConfig | None = None) -> DataFrame:
    """bins (run_id, bin, n) as engine steps; a run is one key, its bins were counted before."""
    c = config or AdaptiveConfig()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        first, last = int(pdf["bin"].min()), int(pdf["bin"].max())
        counts = np.zeros(last - first + 1)
        np.add.at(counts, (pdf["bin"] - first).to_numpy(), pdf["n"].to_numpy())
        prefix = np.concatenate([[0.0], np.cumsum(counts)])
        s, out, now, k = AdaptiveState(w=c.start), [], c.start, 0
        while now <= len(counts):
            out.append({"run_id": pdf["run_id"].iloc[0], "step": k, **step(s, c, prefix[: int(now) + 1], now)})
            now, k = now + stride(s, c), k + 1
        return pd.DataFrame(out, columns=[x.split()[0] for x in ADAPTIVE_SCHEMA.split(", ")])

    return bins.groupBy("run_id").applyInPandas(fold, ADAPTIVE_SCHEMA)


def stream_engine(bins: DataFrame, config: AdaptiveConfig | None = None) -> DataFrame:
    """The same over a stream of (run_id, bin, n) in order. A step runs once its last bin has come; of the counts only those from the left edge on are kept.

    The state is the controller's fields and those counts, as bytes that only this function reads.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    c = config or AdaptiveConfig()
    names = [x.split()[0] for x in ADAPTIVE_SCHEMA.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if held.exists:
            s, first, base, counts, k, now = pickle.loads(held.get[0])
        else:
            s, first, base, counts, k, now = AdaptiveState(w=c.start), int(rows["bin"].min()), 0, np.zeros(0), 0, c.start
        last = int(rows["bin"].max()) - first + 1 - base
        counts = np.concatenate([counts, np.zeros(max(0, last - len(counts)))])
        np.add.at(counts, (rows["bin"] - first - base).to_numpy(), rows["n"].to_numpy())
        prefix, out = np.concatenate([[0.0], np.cumsum(counts)]), []
        # The engine never looks past `now`: gates beyond it are empty, so later bins must not be seen.
        while now <= base + len(counts):
            out.append({"run_id": key[0], "step": k, **step(s, c, prefix[: int(now) - base + 1], now, base)})
            now, k = now + stride(s, c), k + 1
        cut = min(s.left, base + len(counts)) - base
        held.update((pickle.dumps((s, first, base + cut, counts[cut:], k, now)),))
        yield pd.DataFrame(out, columns=names)

    return bins.groupBy("run_id").applyInPandasWithState(fold, ADAPTIVE_SCHEMA, "held binary", "append", GroupStateTimeout.NoTimeout)
