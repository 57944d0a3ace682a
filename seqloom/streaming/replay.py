"""Keyed replay of ordered rows: state per sequence, output only where a prediction is due.

Rows of a sequence may arrive out of order. The state keeps the next expected step; earlier steps are
reported as late, later ones wait in the state store until the gap is filled. A second row for a waiting step is reported as
a repeat and changes nothing. Once more than `most_waiting` rows wait, once rows have waited for `patience_ms`, or once a row with the step `END` closes
the sequence, the missing steps are reported as gaps and the waiting rows follow in order.

The rows that follow each other go through the model as one block. What has to wait is stored as bundles, one for each batch that brought such rows: the
steps of a bundle apart from its content, which is read only when its turn has come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from seqloom.layout import KEY, NEED, STEP

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Step of a row that says: no more rows of this sequence will come.
END = -1
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class StepModel:
    """Model fed row by row. `start()` gives the zero state, `step` returns the new state and outputs.

    The state is a flat float array, so that it can live in the state store.
    """

    outputs: tuple[str, ...] = ("y",)

    def start(self) -> np.ndarray:
        raise NotImplementedError

    def step(self, state: np.ndarray, step: int, row: np.ndarray) -> tuple[np.ndarray, Sequence[float]]:
        raise NotImplementedError

    def block(self, state: np.ndarray, first: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Several rows that follow each other; outputs have a row each. Models override it where a block is cheaper than its rows."""
        out = np.empty((len(rows), len(self.outputs)))
        for i, row in enumerate(rows):
            state, out[i] = self.step(state, first + i, row)
        return state, out


@dataclass(frozen=True)
class Reading:
    """Rows as the readout sees them: standardized inputs, base predictions and the three memories after each row, a row of the arrays each."""

    x: np.ndarray
    base: np.ndarray
    fast: np.ndarray
    slow: np.ndarray
    square: np.ndarray

    def spread(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - self.slow**2, 0.1))


#: Feature blocks by name, and the blocks of each mode in the order of their coefficients. The bounds are fixed values.
BLOCKS: dict[str, Callable[[Reading], np.ndarray]] = {
    "one": lambda r: np.ones((len(r.x), 1)),
    "base": lambda r: np.clip(r.base[:, None], -2.0, 2.0),
    "x": lambda r: r.x,
    "fast": lambda r: r.fast,
    "slow": lambda r: r.slow,
    "x_fast": lambda r: r.x * r.fast,
    "x_slow": lambda r: r.x * r.slow,
    "surprise": lambda r: np.clip((r.x - r.slow) / r.spread(), -8.0, 8.0),
}
PLAIN = ("one", "base", "x", "fast", "slow")
MODES = {"linear": PLAIN, "bilinear": (*PLAIN, "x_fast", "x_slow"), "normalize": (*PLAIN, "surprise")}


class MemoryCorrection(StepModel):
    """Base prediction plus a linear readout of the inputs and their fast and slow memories.

    Inputs are the features followed by the base prediction. The state is a matrix with one memory per row; every row
    moves towards what it sees at a rate of its own. `mode` names the feature blocks of the readout (`MODES`).
    """

    outputs = ("corrected",)

    def __init__(self, mean, scale, coef, strength: float = 1.0, mode: str = "linear", from_step: int = 0, fast: float = 0.01, slow: float = 0.001):
        if mode not in MODES:
            raise ValueError(f"unknown mode: {mode}")
        self.blocks = [BLOCKS[name] for name in MODES[mode]]
        self.offset, self.factor = np.asarray(mean, dtype=float), 1.0 / np.asarray(scale, dtype=float)
        self.coef, self.strength, self.from_step = np.asarray(coef, dtype=float), strength, from_step
        self.rates = np.array([[fast], [slow], [slow]])

    def start(self) -> np.ndarray:
        return np.zeros(self.rates.size * self.offset.size)

    def block(self, state, first, rows):
        rows = np.asarray(rows, dtype=float)
        x = ((rows[:, :-1] - self.offset) * self.factor).clip(-8.0, 8.0)
        seen = np.stack([x, x, x * x], axis=1)
        memories, at = np.empty_like(seen), np.array(state, dtype=float).reshape(3, -1)
        for i, value in enumerate(seen):
            # The memories move row by row; everything around them is done for all rows together.
            at = at + self.rates * (value - at)
            memories[i] = at
        reading = Reading(x, np.nan_to_num(rows[:, -1], posinf=0.0, neginf=0.0), memories[:, 0], memories[:, 1], memories[:, 2])
        change = self.strength * (np.concatenate([b(reading) for b in self.blocks], axis=1) @ self.coef)
        change[:max(0, self.from_step - first)] = 0.0
        return at.ravel(), (reading.base + change)[:, None]

    def step(self, state, step, row):
        state, out = self.block(state, step, np.asarray(row, dtype=float)[None, :])
        return state, out[0]


class _Replay(StatefulProcessor):
    def __init__(self, make_model: Callable[[], StepModel], visible: Sequence[str], most_waiting: int | None = None, patience_ms: int | None = None):
        self.make_model, self.visible, self.most_waiting, self.patience_ms = make_model, list(visible), most_waiting, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model, self.handle = self.make_model(), handle
        self.memory = handle.getValueState("memory", "expected bigint, state array<double>")
        self.places = handle.getMapState("places", "bundle bigint", "steps array<bigint>")
        self.content = handle.getMapState("content", "bundle bigint", "need array<boolean>, rows array<double>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Start from a stored step and state, one row per sequence."""
        row = initialState.iloc[0]
        self.memory.update((int(row["expected"]), [float(v) for v in row["state"]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        closed = False
        for pdf in rows:
            pdf = pdf.sort_values(STEP, kind="stable")
            closed |= bool((pdf[STEP] == END).any())
            frame = self._take(key[0], pdf[pdf[STEP] != END])
            if frame is not None:
                yield frame
        if closed:
            yield from self._give_up(key[0], 0)
        self._save(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Rows have waited long enough: their gaps are given up."""
        self._load()
        yield from self._give_up(key[0], 0)
        self._save(timerValues)

    def _load(self) -> None:
        self.expected, self.state = 0, self.model.start()
        if self.memory.exists():
            saved = self.memory.get()
            self.expected, self.state = saved[0], np.asarray(saved[1], dtype=float)
        self.held = {k[0]: np.asarray(v[0], dtype=np.int64) for k, v in self.places.iterator()}

    def _save(self, timerValues) -> None:
        self.memory.update((self.expected, self.state.tolist()))
        if self.patience_ms is not None:
            set_ = list(self.handle.listTimers())
            if self.held and not set_:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
            elif not self.held:
                for at in set_:
                    self.handle.deleteTimer(at)

    def _take(self, key, pdf: pd.DataFrame) -> pd.DataFrame | None:
        """Rows in order of their steps: the model takes those whose turn has come, the others wait."""
        steps = pdf[STEP].to_numpy(np.int64)
        waiting = np.concatenate([*self.held.values(), np.zeros(0, np.int64)])
        new = np.concatenate(([True], steps[1:] != steps[:-1])) & (steps >= self.expected) & ~np.isin(steps, waiting) if len(steps) else np.zeros(0, bool)
        odd = steps[~new]
        out: list[pd.DataFrame] = []
        if new.any():
            bundle = max(self.held, default=-1) + 1
            fresh = pdf[new]
            self.held[bundle] = steps[new]
            self.fresh = {bundle: (fresh[NEED].to_numpy(bool), fresh[self.visible].to_numpy(float))}
            out += self._follow(key)
            while self.most_waiting is not None and sum(map(len, self.held.values())) > self.most_waiting:
                out += self._skip(key)
            self._store(bundle)
        if len(odd):
            # A second row is late if the first one has been used by the end of the batch, else it repeats a waiting one.
            out.append(self._frame(key, odd, np.where(odd < self.expected, "late", "repeat"), None))
        return pd.concat(out) if out else None

    def _store(self, bundle: int) -> None:
        """Keep what is left of a new bundle."""
        need, rows = self.fresh.pop(bundle, (None, None))
        if bundle in self.held and need is not None:
            self.places.updateValue((bundle,), (self.held[bundle].tolist(),))
            self.content.updateValue((bundle,), (need.tolist(), rows.ravel().tolist()))

    def _content(self, bundle: int) -> tuple[np.ndarray, np.ndarray]:
        if bundle in self.fresh:
            return self.fresh[bundle]
        need, rows = self.content.getValue((bundle,))
        return np.asarray(need, dtype=bool), np.asarray(rows, dtype=float).reshape(len(need), -1)

    def _follow(self, key) -> list[pd.DataFrame]:
        """Use the waiting rows that follow the last one without a gap, as one block."""
        steps = np.sort(np.concatenate([*self.held.values(), np.zeros(0, np.int64)]))
        run = int(np.argmin(np.append(steps == self.expected + np.arange(len(steps)), False)))
        if not run:
            return []
        stop = self.expected + run
        at, need, rows = [], [], []
        for bundle in [b for b, own in self.held.items() if own[0] < stop]:
            own, (n, r) = self.held[bundle], self._content(bundle)
            cut = int(np.searchsorted(own, stop))
            at, need, rows = [*at, own[:cut]], [*need, n[:cut]], [*rows, r[:cut]]
            fresh = bundle in self.fresh
            if cut == len(own):
                del self.held[bundle]
                if fresh:
                    del self.fresh[bundle]
                else:
                    self.places.removeKey((bundle,))
                    self.content.removeKey((bundle,))
            else:
                self.held[bundle] = own[cut:]
                if fresh:
                    self.fresh[bundle] = (n[cut:], r[cut:])
                else:
                    self.places.updateValue((bundle,), (own[cut:].tolist(),))
                    self.content.updateValue((bundle,), (n[cut:].tolist(), r[cut:].ravel().tolist()))
        order = np.argsort(np.concatenate(at), kind="stable")
        need, rows = np.concatenate(need)[order], np.concatenate(rows)[order]
        self.state, values = self.model.block(self.state, self.expected, rows)
        values = np.asarray(values, dtype=float)
        if values.shape != (run, len(self.model.outputs)) or not np.isfinite(values[need]).all():
            raise ValueError(f"invalid prediction in steps {self.expected} to {stop - 1}")
        due = np.arange(self.expected, stop)[need]
        self.state, self.expected = np.asarray(self.state, dtype=float), stop
        return [self._frame(key, due, np.full(len(due), "ok"), values[need])] if len(due) else []

    def _skip(self, key) -> list[pd.DataFrame]:
        """Give up the steps missing before the first waiting row: one report per run of missing steps."""
        gap = self._frame(key, np.array([self.expected]), np.array(["gap"]), None)
        self.expected = int(min(own[0] for own in self.held.values()))
        return [gap, *self._follow(key)]

    def _give_up(self, key, most: int) -> Iterator[pd.DataFrame]:
        self.fresh = {}
        while sum(map(len, self.held.values())) > most:
            yield from self._skip(key)

    def _frame(self, key, steps, status, values) -> pd.DataFrame:
        frame = pd.DataFrame({KEY: key, STEP: steps, "status": status})
        for i, name in enumerate(self.model.outputs):
            frame[name] = None if values is None else values[:, i]
        return frame.astype(dict.fromkeys(self.model.outputs, float))

    def close(self) -> None:
        pass


def use_state_store(spark) -> None:
    """Keyed replay keeps its state in RocksDB: it may exceed memory and survives executors."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def stream_replay(stream: DataFrame, visible: Sequence[str], make_model: Callable[[], StepModel], most_waiting: int | None = None,
                  patience_ms: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """Streaming `(seq, step, status, outputs...)`: `ok` rows carry predictions, `late` and `repeat` rows broke the order, a
    `gap` row names the first of a run of steps given up.

    The model sees only `visible` columns; warm-up rows update its state and give no output. `start` is a table `(seq, expected, state)`, one row per
    sequence, from which sequences of a new stream continue: the next step and the model's state before it, as a batch run has left them.
    """
    use_state_store(stream.sparkSession)
    fields = ", ".join(f"`{o}` double" for o in make_model().outputs)
    rows = stream.select(KEY, STEP, NEED, *[F.col(c).cast("double").alias(c) for c in visible])
    return rows.groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=_Replay(make_model, visible, most_waiting, patience_ms), outputStructType=f"{KEY} bigint, {STEP} bigint, status string, {fields}",
        outputMode="Append", timeMode="None" if patience_ms is None else "ProcessingTime", initialState=None if start is None else start.groupBy(KEY))


def run_available(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into parquet files, exactly once per batch."""
    query = result.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_once(result: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there in one batch. A stream with `patience_ms` always has another batch to come, so it runs in such batches or on a clock."""
    query = result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(once=True).start()
    query.awaitTermination()


def parity(streamed: DataFrame, batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows on each side and the largest absolute difference per column."""
    a = streamed.select(KEY, STEP, *[F.col(c).alias(f"_s_{c}") for c in columns], F.lit(1).alias("_ins"))
    b = batch.select(KEY, STEP, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_inb"))
    both = a.join(b, [KEY, STEP], "full_outer")

    def gap(c: str) -> Column:
        return F.max(F.abs(F.col(f"_s_{c}") - F.col(f"_b_{c}"))).alias(f"gap_{c}")

    return both.agg(F.count("_ins").alias("stream_rows"), F.count("_inb").alias("batch_rows"),
                    F.sum((F.col("_ins").isNull() | F.col("_inb").isNull()).cast("bigint")).alias("unmatched"), *[gap(c) for c in columns])
