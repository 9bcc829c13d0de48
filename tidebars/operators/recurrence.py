"""Exponential moving averages, exact over gaps of any length.

``y[t] = f y[t-1] + (1 - f) x[t]`` refers to its own output, which a window
function cannot do.  Every row is an affine map of the average so far, the
identity where there is no value, and the maps of many values in a row forget
what came before: ``memory(span)`` values back an input weighs less than 1e-20,
under the rounding of a double.  So a block of rows needs the last ``memory``
*values* before it, not rows, and `tidebars.series.in_blocks` gives it these,
however far back they lie.

A `Chain` is a function over the columns of a block as arrays.  Any number of
chains run in one pass, a block at a time, in Arrow batches: the recursion
itself is that of pandas' ``ewm``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.series import BLOCK, BLOCK_ROWS, CORE, SERIES, in_blocks

FORGOTTEN = 46.1  # -ln(1e-20)

Arrays = dict[str, np.ndarray]


def decay(span: float) -> float:
    if span < 2:
        raise ValueError("span must be at least 2")
    return 1 - 2 / (span + 1)


def memory(span: float) -> int:
    """Values after which an input no longer shows in a double."""
    return math.ceil(FORGOTTEN / -math.log(decay(span)))


def ema(x: np.ndarray, span: float) -> np.ndarray:
    """Average of values that may be missing (NaN) anywhere.

    A value ``g`` rows after the last one weighs the old average by ``q^g``:
    ``y = (q^g y + a x) / (q^g + a)``; a row without value repeats the average,
    leading ones have none.  Equal values give exactly themselves.
    """
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


class Whole:
    """Running figures over arrays that begin early enough for what is asked of them."""

    def ema(self, x: np.ndarray, span: float) -> np.ndarray:
        return ema(x, span)

    def mean(self, x: np.ndarray, rows: int) -> np.ndarray:
        """Mean of what the last ``rows`` rows hold."""
        return pd.Series(x).rolling(rows, min_periods=1).mean().to_numpy()

    def deviation(self, x: np.ndarray, rows: int) -> np.ndarray:
        """Sample deviation of what the last ``rows`` rows hold, two values at least."""
        return pd.Series(x).rolling(rows, min_periods=2).std().to_numpy()

    def back(self, x: np.ndarray, rows: int) -> np.ndarray:
        """The value ``rows`` rows ago."""
        return np.r_[np.full(min(rows, len(x)), np.nan), x[:-rows]]

    def total(self, x: np.ndarray) -> np.ndarray:
        """Running sum; a row without value has none and adds nothing."""
        return np.where(np.isnan(x), np.nan, np.nancumsum(x))

    def greatest(self, x: np.ndarray) -> np.ndarray:
        """The greatest value so far."""
        return np.fmax.accumulate(x) if len(x) else x


class Carried(Whole):
    """The same figures over arrays that go on where others ended.

    ``slots`` holds what each call, in the order of calls, left behind: an
    average and the rows since its last value, the last rows of a window, a sum.
    It is read at the start and replaced call by call; a first run starts from none.
    """

    def __init__(self, slots: list[list[float]] | None = None) -> None:
        self.slots, self.at = [list(s) for s in slots or []], 0

    def _slot(self) -> list[float]:
        if self.at == len(self.slots):
            self.slots.append([])
        self.at += 1
        return self.slots[self.at - 1]

    def ema(self, x: np.ndarray, span: float) -> np.ndarray:
        slot = self._slot()
        before = np.r_[slot[0], np.full(min(int(slot[1]), memory(span)), np.nan)] if slot else np.zeros(0)
        y = ema(np.r_[before, x], span)[len(before) :]
        if len(y) and not np.isnan(y[-1]):
            seen = np.flatnonzero(~np.isnan(x))
            slot[:] = [float(y[-1]), float(len(x) - 1 - seen[-1] if len(seen) else slot[1] + len(x))]
        return y

    def _behind(self, x: np.ndarray, rows: int) -> tuple[np.ndarray, int]:
        """The rows before and these; how many are from before."""
        slot = self._slot()
        n, joined = len(slot), np.r_[slot, x]
        slot[:] = joined[max(len(joined) - rows, 0) :].tolist()
        return joined, n

    def mean(self, x: np.ndarray, rows: int) -> np.ndarray:
        joined, n = self._behind(x, rows - 1)
        return super().mean(joined, rows)[n:]

    def deviation(self, x: np.ndarray, rows: int) -> np.ndarray:
        joined, n = self._behind(x, rows - 1)
        return super().deviation(joined, rows)[n:]

    def back(self, x: np.ndarray, rows: int) -> np.ndarray:
        joined, n = self._behind(x, rows)
        return super().back(joined, rows)[n:]

    def total(self, x: np.ndarray) -> np.ndarray:
        slot = self._slot()
        before = slot[0] if slot else 0.0
        slot[:] = [before + float(np.nansum(x))]
        return before + super().total(x)

    def greatest(self, x: np.ndarray) -> np.ndarray:
        slot = self._slot()
        joined = super().greatest(np.r_[slot, x])
        n = len(slot)
        slot[:] = joined[-1:].tolist()
        return joined[n:]


@dataclass(frozen=True)
class Chain:
    """Averages of averages: ``run`` maps input columns to outputs, by running figures it is given.

    ``memory`` is the sum of the memories along the chain, in rows and in
    ``values``, the conditions that a row has an input.  ``prepare`` are
    columns over the row before, which have to be there before values are
    counted.  Outputs are doubles unless named in ``integers``.
    """

    outputs: tuple[str, ...]
    inputs: tuple[str, ...]
    run: Callable[[Arrays, Whole], Arrays]
    memory: int
    values: dict[str, Column]
    prepare: dict[str, Column] = field(default_factory=dict)
    integers: tuple[str, ...] = ()


def needed_values(chains: Sequence[Chain]) -> dict[str, tuple[Column, int]]:
    """Conditions and numbers of values that a block has to see for all chains."""
    needed: dict[str, tuple[Column, int]] = {}
    for chain in chains:
        for name, present in chain.values.items():
            needed[name] = (present, max(chain.memory, needed.get(name, (present, 0))[1]))
    return needed


def run_chains(laid: DataFrame, chains: Sequence[Chain], kept: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """The ``kept`` columns of the rows that a block owns, and the outputs of the chains.

    ``laid`` comes from `in_blocks`.  A block is at most its rows and what it
    looks back on; a stretch of rows that were left out of it, being empty,
    counts as at most as many rows as any chain remembers.
    """
    inputs = list(dict.fromkeys(name for c in chains for name in c.inputs))
    integers = {name for c in chains for name in c.integers}
    outputs = list(dict.fromkeys(name for c in chains for name in c.outputs))
    longest = max(c.memory for c in chains)
    runs = [c.run for c in chains]
    carried = list(dict.fromkeys([*kept, *inputs, *keys, "pos", BLOCK, CORE]))
    kept = list(kept)

    def block(table: pa.Table) -> pa.Table:
        pos = table["pos"].to_numpy()
        order = np.argsort(pos, kind="stable")
        place = np.r_[0, np.cumsum(np.minimum(np.diff(pos[order]), longest))]
        columns = {}
        for name in inputs:
            columns[name] = np.full(int(place[-1]) + 1, np.nan)
            columns[name][place] = table[name].cast(pa.float64()).to_numpy(zero_copy_only=False)[order]
        found: Arrays = {}
        for run in runs:
            found |= run(columns, Whole())
        core = table[CORE].to_numpy(zero_copy_only=False)[order]
        own = table.select(kept).take(pa.array(order[core]))
        for name in outputs:
            values = pa.array(found[name][place][core], from_pandas=True)
            own = own.append_column(name, values.cast(pa.int32()) if name in integers else values)
        return own

    fields = [laid.schema[c] for c in kept]
    fields += [T.StructField(name, T.IntegerType() if name in integers else T.DoubleType()) for name in outputs]
    return laid.select(*carried).groupBy(*keys, BLOCK).applyInArrow(block, T.StructType(fields))


def average(column: str, span: float, name: str) -> Chain:
    def run(c: Arrays, t: Whole) -> Arrays:
        return {name: t.ema(c[column], span)}

    return Chain((name,), (column,), run, memory(span), {column: F.col(column).isNotNull()})


def ema_with_gaps(
    df: DataFrame, column: str, span: float, name: str, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS
) -> DataFrame:
    """EMA of a column that may be null anywhere, as ``name``."""
    chain = average(column, span, name)
    laid = in_blocks(df, chain.memory, keys, rows, needed_values([chain]))
    return run_chains(laid, [chain], [c for c in df.columns if c != name], keys)
