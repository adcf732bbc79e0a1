"""Rolling features of sorted series, computed on Arrow batches.

The families of :class:`~pitscore.operators.rolling.RollingFeatures` over windows put together from the same
units and tiles, but a window is a shifted sum of whole columns here, so a row costs no window frame and no
wide intermediate row. All features look back only: a batch needs the last rows of the one before it.

Values are exact where the sums are: nothing is taken from running totals, so no digit is lost over a long
series, and a NaN stays within its windows. Missing values are skipped, NaN is the largest value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNIT = 5
TILE = 30


class Steps:
    """Looks back from rows whose number within their sorted series (from 1) is given."""

    def __init__(self, number: np.ndarray):
        self.number = number
        self._has: dict[int, np.ndarray] = {}

    def back(self, x: np.ndarray, rows: int, neutral: float) -> np.ndarray:
        """The value so many rows back in the same series, or ``neutral``."""
        out = np.full_like(x, neutral)
        if rows < x.shape[-1]:
            if rows not in self._has:
                self._has[rows] = self.number[rows:] > rows
            np.copyto(out[..., rows:], x[..., : x.shape[-1] - rows], where=self._has[rows])
        return out


class Windows:
    """Values of the last ``n`` rows joined, for any ``n``; ``join`` gets the newer part first. Parts are kept.

    Nothing here refers back to its owner: arrays of a batch go when it is done, not when garbage is collected.
    """

    def __init__(self, steps: Steps, x: np.ndarray, join: Callable, neutral: float):
        self.steps, self.x, self.join, self.neutral = steps, x, join, neutral
        self._parts: dict[int, np.ndarray] = {1: x}

    def last(self, n: int) -> np.ndarray:
        """A window is its tiles and a rest, both in units; one more of them joins the window without it."""
        if n not in self._parts:
            whole = TILE if n > TILE else UNIT if n > UNIT else 1
            older = n % whole or whole
            older_part = self.last(older)
            self._parts[n] = self.join(self.last(n - older), self.steps.back(older_part, n - older, self.neutral))
        return self._parts[n]


class Block:
    """Rows of sorted series: their number within the series, and per column values and presence."""

    def __init__(self, number: np.ndarray, columns: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.number, self.columns, self.steps = number, columns, Steps(number)
        self._windows: dict[tuple, Windows] = {}

    def back(self, x: np.ndarray, rows: int, neutral: float) -> np.ndarray:
        return self.steps.back(x, rows, neutral)

    def windows(self, x: np.ndarray, join: Callable, neutral: float) -> Windows:
        return Windows(self.steps, x, join, neutral)

    def counts(self, value: str) -> Windows:
        if value not in self._windows:
            self._windows[value] = self.windows(self.columns[value][1].astype(float), np.add, 0.0)
        return self._windows[value]

    def extremes(self, value: str, high: bool) -> Windows:
        if (value, high) not in self._windows:
            x, there = self.columns[value]
            edge, join = (-np.inf, np.maximum) if high else (np.nan, np.fmin)
            self._windows[value, high] = self.windows(np.where(there, x, edge), join, edge)
        return self._windows[value, high]


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, sum and squared deviations of two parts together, by the pooled-variance identity."""
    n = a[0] + b[0]
    apart = b[1] / np.maximum(b[0], 1) - a[1] / np.maximum(a[0], 1)
    return np.stack([n, a[1] + b[1], a[2] + b[2] + apart * apart * (a[0] * b[0] / np.maximum(n, 1))])


def _divided(a: np.ndarray, b: np.ndarray, there: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
    there = there & (b != 0)
    return np.divide(a, b, out=np.zeros_like(a), where=there), there


def _stats(block: Block, value: str, windows: Sequence[int], label: str) -> dict:
    x, there = block.columns[value]
    last = block.windows(np.stack([there.astype(float), x, x - x]), _merge, 0.0).last
    high, low = block.extremes(value, True).last, block.extremes(value, False).last
    out = {}
    for n in windows:
        size, total, squares = last(n)
        some = size > 0
        variance, spread = _divided(squares, np.maximum(size - 1, 0))
        out[f"amt_avg_{label}_{n}"] = _divided(total, size)
        out[f"amt_std_{label}_{n}"] = np.sqrt(variance), spread
        out[f"amt_min_{label}_{n}"] = low(n), some
        out[f"amt_max_{label}_{n}"] = high(n), some
    return out


def _changes(block: Block, value: str, windows: Sequence[int], label: str) -> dict:
    x, there = block.columns[value]
    out = {}
    for n in windows:
        base = block.back(x, n, 0.0)  # a missing value is kept as 0, and neither is divided by
        out[f"pct_tx_{label}_{n}d"] = _divided(x - base, np.abs(base), there)
    return out


def _slopes(block: Block, value: str, windows: Sequence[int], label: str) -> dict:
    x, there = block.columns[value]
    t = np.where(there, block.number, 0).astype(float)
    last = block.windows(np.stack([there.astype(float), t, x, t * t, t * x]), np.add, 0.0).last
    out = {}
    for n in windows:
        size, st, sx, stt, stx = last(n)
        out[f"amt_beta_{label}_{n}"] = _divided(size * stx - st * sx, size * stt - st * st)
    return out


def _breakouts(block: Block, value: str, windows: Sequence[int], label: str, high: bool) -> dict:
    x, there = block.columns[value]
    side, edges, counts = "high" if high else "low", block.extremes(value, high).last, block.counts(value).last
    nan, out = np.isnan(x), {}
    for n in windows:
        edge = block.back(edges(n), 1, 0.0)
        beyond = (x > edge) | (nan & ~np.isnan(edge)) if high else (x < edge) | (np.isnan(edge) & ~nan)
        known = there & (block.back(counts(n), 1, 0.0) > 0)
        out[f"cat_{label}_broke_{side}_{n}"] = beyond.astype(np.int32), known
    return out


def _strength(block: Block, value: str, windows: Sequence[int], label: str) -> dict:
    x, there = block.columns[value]
    known = there & block.back(there, 1, False)
    move = np.where(known, x - block.back(x, 1, 0.0), 0.0)
    gain, loss = np.where(move <= 0, 0.0, move), np.where(move < 0, -move, 0.0)
    last = block.windows(np.stack([known.astype(float), gain, loss]), np.add, 0.0).last
    out = {}
    for n in windows:
        moves, gains, losses = last(n)
        ratio, some = _divided(gains, losses)
        out[f"amt_IFR_{label}_{n}"] = np.where(some, 100 - 100 / (1 + ratio), 100.0), moves > 0
    return out


FAMILIES = {"stats": _stats, "changes": _changes, "slopes": _slopes, "breakouts": _breakouts, "strength": _strength}


def features_of(block: Block, families: Sequence[tuple]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Values and presence by feature. ``families``: (family, column, windows, label, further arguments...)."""
    out = {}
    with np.errstate(all="ignore"):  # what overflows or is no number stays so, as in SQL
        for family, value, windows, label, *more in families:
            out |= FAMILIES[family](block, value, windows, label, *more)
    return out


def _column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return (
        pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False),
        pc.is_valid(values).to_numpy(zero_copy_only=False),
    )


def window_step(names: Sequence[str], families: Sequence[tuple], features: Sequence[str]) -> Callable:
    """Function over the batches of (row number in its series, columns ``names``...) of sorted series that
    gives a struct of ``features`` for each row. Up to the longest window is carried from batch to batch."""
    reach = max((n for f in families for n in f[2]), default=0)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        number, columns = np.zeros(0, np.int64), {}
        for first, *rest in batches:
            carried = len(number)
            number = np.concatenate([number, first.to_numpy(zero_copy_only=False)])
            for name, values in zip(names, rest, strict=True):
                new = _column(values)
                columns[name] = tuple(map(np.concatenate, zip(columns[name], new, strict=True))) if carried else new
            found = features_of(Block(number, columns), families)
            arrays = [pa.array(x[carried:], mask=~there[carried:]) for x, there in map(found.__getitem__, features)]
            yield pa.StructArray.from_arrays(arrays, list(features))
            keep = len(number) - (min(reach, int(number[-1]), len(number)) if len(number) else 0)
            number, columns = number[keep:], {c: (x[keep:], there[keep:]) for c, (x, there) in columns.items()}

    return run
