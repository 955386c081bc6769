"""Where to try next: a tree of Parzen estimators, one density ratio a weight.

The judged trials are split into the best few and the rest. Each weight's good and bad values make two densities: truncated
normal kernels at the values, as wide as the gaps to their neighbours, and a flat prior over the bounds. Candidates are drawn
from the good density, and the one with the largest ratio of good to bad is tried. Within a batch, what was just chosen counts as
a trial with a lie for its result, the worst seen so far, so that the next choice goes elsewhere.
"""

from __future__ import annotations

import math
import random

Bounds = tuple[float, ...]

#: Candidates drawn for a weight, and the largest number of good trials.
CANDIDATES = 32
MOST_GOOD = 25


def n_good(n: int) -> int:
    """A fifth of few trials, a tenth of many."""
    return max(1, min(MOST_GOOD, math.ceil(0.2 * n if n < 50 else 0.1 * n)))


class Density:
    """Kernels at the values of one weight, truncated to its bounds, and the prior as one more."""

    def __init__(self, values: list[float], lo: float, hi: float) -> None:
        self.lo, self.hi = lo, hi
        wide = hi - lo
        at = sorted(values)
        least = wide / min(100, 1 + len(at))
        self.kernels = []
        for i, x in enumerate(at):
            left = x - (at[i - 1] if i else lo)
            right = (at[i + 1] if i + 1 < len(at) else hi) - x
            self.kernels.append((x, min(wide, max(least, left, right))))
        self.kernels.append(((lo + hi) / 2, wide))

    def __call__(self, x: float) -> float:
        return sum(math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi) * self._inside(m, s)) for m, s in self.kernels) / len(self.kernels)

    def _inside(self, m: float, s: float) -> float:
        """The share of a kernel within the bounds."""
        part = lambda v: 0.5 * (1 + math.erf((v - m) / s / math.sqrt(2)))
        return max(part(self.hi) - part(self.lo), 1e-12)

    def draw(self, rng: random.Random) -> float:
        m, s = rng.choice(self.kernels)
        for _ in range(64):
            if self.lo <= (x := rng.gauss(m, s)) <= self.hi:
                return x
        return rng.uniform(self.lo, self.hi)


def stepped(x: float, bounds: Bounds) -> float:
    lo, hi, *step = bounds
    return min(hi, lo + step[0] * round((x - lo) / step[0])) if step else x


def suggest(rng: random.Random, space: dict[str, Bounds], trials: list[tuple[dict[str, float], float]]) -> dict[str, float]:
    """The next trial after ``trials``, weights with their results (more is better); of equal results the earlier one is better."""
    order = sorted(range(len(trials)), key=lambda i: (-trials[i][1], i))
    k = n_good(len(trials))
    out = {}
    for key, bounds in space.items():
        values = [trials[i][0][key] for i in order]
        good, bad = Density(values[:k], *bounds[:2]), Density(values[k:], *bounds[:2])
        out[key] = stepped(max((good.draw(rng) for _ in range(CANDIDATES)), key=lambda x: good(x) / bad(x)), bounds)
    return out


def batch(rng: random.Random, space: dict[str, Bounds], trials: list[tuple[dict[str, float], float]], size: int, startup: int) -> list[dict[str, float]]:
    """``size`` trials to be judged together. While fewer than ``startup`` are judged, they are drawn evenly over the bounds."""
    if len(trials) < startup:
        return [{k: stepped(rng.uniform(*b[:2]), b) for k, b in space.items()} for _ in range(size)]
    told = list(trials)
    lie = min(x for _, x in trials)
    out = []
    for _ in range(size):
        out.append(suggest(rng, space, told))
        told.append((out[-1], lie))
    return out
