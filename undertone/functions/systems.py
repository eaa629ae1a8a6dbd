"""Recurrences that can be stopped and taken up again: linear systems as matrices, and nonlinear dynamics with a state.

A linear system is s' = A s + B x, y = C s + D x. What a run of samples does to the state is an affine map, so runs can be
composed without their samples; outputs come in blocks, by matrix products. Nonlinear dynamics run from a given state over
positions a..b of their inputs, whose further samples they may look at, and return the outputs and the state after."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

BLOCK = 64


@dataclass(frozen=True)
class Linear:
    """held: start in the state in which the first sample, had it been there for ever, would have put the system."""

    A: np.ndarray
    B: np.ndarray
    C: np.ndarray
    D: float
    held: bool = False

    def start(self, first: float) -> np.ndarray:
        return np.linalg.solve(np.eye(len(self.B)) - self.A, self.B * first) if self.held else np.zeros(len(self.B))

    def then(self, other: Linear) -> Linear:
        """This system and another one behind it."""
        a = np.block([[self.A, np.zeros((len(self.B), len(other.B)))], [np.outer(other.B, self.C), other.A]])
        return Linear(a, np.concatenate([self.B, other.B * self.D]), np.concatenate([other.D * self.C, other.C]), other.D * self.D, self.held)

    def after(self, state: np.ndarray, n: int) -> np.ndarray:
        """The state after n samples of zero."""
        return np.linalg.matrix_power(self.A, n) @ state

    def run(self, x, state) -> tuple[np.ndarray, np.ndarray]:
        """Outputs, and the state after."""
        x, s = np.asarray(x, float), np.asarray(state, float)
        kernel, seen, entered, power = _blocks(self)
        whole = len(x) // BLOCK
        blocks = x[: whole * BLOCK].reshape(whole, BLOCK)
        states, inputs = np.empty((whole, len(s))), blocks @ entered.T
        for i in range(whole):
            states[i] = s
            s = power @ s + inputs[i]
        out = [(blocks @ kernel.T + states @ seen.T).ravel()]
        for v in x[whole * BLOCK :]:
            out.append([self.C @ s + self.D * v])
            s = self.A @ s + self.B * v
        return np.concatenate(out), s


_KEPT: dict[int, tuple] = {}


def _blocks(system: Linear) -> tuple[np.ndarray, ...]:
    """Of a block of samples: outputs by inputs, outputs by state, state after by inputs, state after by state."""
    if id(system) not in _KEPT or _KEPT[id(system)][0] is not system:
        powers = [np.eye(len(system.B))]
        for _ in range(BLOCK):
            powers.append(system.A @ powers[-1])
        response = np.array([system.D, *(system.C @ p @ system.B for p in powers[: BLOCK - 1])])
        lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
        kernel = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
        entered = np.stack([p @ system.B for p in powers[BLOCK - 1 :: -1]], axis=1)
        _KEPT.clear()
        _KEPT[id(system)] = (system, (kernel, np.stack([system.C @ p for p in powers[:BLOCK]]), entered, powers[BLOCK]))
    return _KEPT[id(system)][1]


def average(keep: float) -> Linear:
    """y = keep * previous y + (1 - keep) * x, from the first sample on."""
    return Linear(np.array([[keep]]), np.array([1 - keep]), np.array([keep]), 1 - keep, held=True)


def biquad(coefficients) -> Linear:
    """A second-order filter (b0, b1, b2, a1, a2), from rest."""
    b0, b1, b2, a1, a2 = coefficients
    return Linear(np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0]), b0)


def cascade(filters) -> Linear:
    """Second-order filters one behind the other; none pass everything."""
    systems = [biquad(f) for f in filters] or [biquad((1.0, 0.0, 0.0, 0.0, 0.0))]
    out = systems[0]
    for s in systems[1:]:
        out = out.then(s)
    return out


class Dynamics:
    """ahead: how many samples after one its output depends on."""

    ahead = 0

    def initial(self) -> tuple[float, ...]:
        raise NotImplementedError

    def run(self, state, a: int, b: int, *inputs) -> tuple[np.ndarray, tuple[float, ...]]:
        raise NotImplementedError

    def whole(self, *inputs) -> np.ndarray:
        return self.run(self.initial(), 0, len(inputs[0]), *inputs)[0]


@dataclass(frozen=True)
class TwoSpeed(Dynamics):
    """An average that keeps `rise` of itself while the input is above it, `fall` while below."""

    rise: float
    fall: float

    def initial(self):
        return (math.nan,)

    def run(self, state, a, b, x):
        out, y = np.empty(b - a), state[0]
        for i in range(a, b):
            v = x[i]
            keep = 0.0 if y != y else self.rise if v > y else self.fall
            y = v if keep == 0.0 else keep * y + (1 - keep) * v
            out[i - a] = y
        return out, (y,)


@dataclass(frozen=True)
class LiveFloor(Dynamics):
    """A noise floor that follows slowly and never rises far over the input."""

    start: float = 1e-6

    def initial(self):
        return (self.start,)

    def run(self, state, a, b, x):
        out, y = np.empty(b - a), state[0]
        for i in range(a, b):
            v = x[i]
            y = max(1e-6, min(0.95 * y + 0.05 * v, 1.05 * v))
            out[i - a] = y
        return out, (y,)


@dataclass(frozen=True)
class Gate(Dynamics):
    """Gain opens when a sample ahead is over the threshold, stays for `hold` samples, then closes to the floor."""

    threshold: float
    floor: float
    look: int
    hold: int
    attack: float
    release: float

    @property
    def ahead(self):
        return self.look

    def initial(self):
        return 0.0, 0.0

    def run(self, state, a, b, x):
        out, (env, left), last = np.empty(b - a), state, len(x) - 1
        for i in range(a, b):
            if abs(x[min(i + self.look, last)]) > self.threshold:
                target, left = 1.0, self.hold
            elif left > 0:
                target, left = 1.0, left - 1
            else:
                target = self.floor
            env += ((1 - self.attack) if target > env else (1 - self.release)) * (target - env)
            out[i - a] = x[i] * env
        return out, (env, float(left))


@dataclass(frozen=True)
class Compressor(Dynamics):
    """Level in dB followed at two speeds, reduced above the threshold with a quadratic knee."""

    threshold: float
    ratio: float
    knee: float
    attack: float
    release: float
    makeup: float = 0.0

    def initial(self):
        return (-96.0,)

    def run(self, state, a, b, x):
        out, level = np.empty(b - a), state[0]
        for i in range(a, b):
            v = x[i]
            now = 20 * math.log10(abs(v)) if v else -96.0
            keep = self.attack if now > level else self.release
            level = keep * level + (1 - keep) * now
            over = level - self.threshold
            if over > self.knee / 2:
                cut = over / self.ratio - over
            elif over > -self.knee / 2:
                cut = (1 / self.ratio - 1) * (over + self.knee / 2) ** 2 / (2 * self.knee)
            else:
                cut = 0.0
            out[i - a] = v * 10 ** ((cut + self.makeup) / 20)
        return out, (level,)


@dataclass(frozen=True)
class SideDeesser(Dynamics):
    """Gain that follows the excess of a side signal over a threshold; the side is a filter of the signal."""

    filter: tuple[float, ...]
    threshold: float
    ratio: float
    wet: float
    attack: float
    release: float

    def initial(self):
        return 0.0, 0.0, 1.0

    def run(self, state, a, b, x):
        out, (s1, s2, env) = np.empty(b - a), state
        b0, b1, b2, a1, a2 = self.filter
        for i in range(a, b):
            v = x[i]
            side = b0 * v + s1
            s1, s2 = b1 * v - a1 * side + s2, b2 * v - a2 * side
            size = abs(side)
            target = (self.threshold + (size - self.threshold) / self.ratio) / size if size > self.threshold else 1.0
            keep = self.attack if target < env else self.release
            env = keep * env + (1 - keep) * target
            out[i - a] = v * (1 - self.wet + self.wet * env)
        return out, (s1, s2, env)


@dataclass(frozen=True)
class Follower(Dynamics):
    """The level of a signal, from 0: it moves by a share of the way, one share up and another down."""

    attack: float = 0.05
    release: float = 0.0005

    def initial(self):
        return (0.0,)

    def run(self, state, a, b, x):
        out, env = np.empty(b - a), state[0]
        for i in range(a, b):
            size = abs(x[i])
            env += (self.attack if size > env else self.release) * (size - env)
            out[i - a] = env
        return out, (env,)


@dataclass(frozen=True)
class LiveDeesser(Dynamics):
    """Takes a share of a filtered side band out of the signal. It starts when the band's level over the sample's size passes
    `over` by `slack`, stops `slack` below, and the share grows with the excess over `reach`, `amount` (0 to 1) and `most`."""

    filter: tuple[float, ...]
    amount: float
    over: float = 0.35
    reach: float = 0.65
    slack: float = 0.02
    most: float = 0.85
    level: Follower = field(default_factory=Follower)

    def initial(self):
        return 0.0, 0.0, 0.0, 0.0

    def run(self, state, a, b, x):
        out, (s1, s2, env, on) = np.empty(b - a), state
        b0, b1, b2, a1, a2 = self.filter
        for i in range(a, b):
            v = x[i]
            side = b0 * v + s1
            s1, s2 = b1 * v - a1 * side + s2, b2 * v - a2 * side
            size = abs(side)
            env += (self.level.attack if size > env else self.level.release) * (size - env)
            share = min(1.0, env / (abs(v) + 1e-9))
            on = share >= self.over - self.slack if on else share > self.over + self.slack
            out[i - a] = v - side * min(max((share - self.over) / self.reach * self.amount * self.most, 0.0), self.most) if on else v
        return out, (s1, s2, env, float(on))


@lru_cache(maxsize=64)
def power(system_bytes: bytes, size: int, n: int) -> np.ndarray:
    """The n-th power of a matrix given as bytes; runs of one length are common."""
    return np.linalg.matrix_power(np.frombuffer(system_bytes).reshape(size, size), n)
