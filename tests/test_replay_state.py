"""The replay processor against a row-by-row reading of its rules, over states kept in plain dictionaries."""

import numpy as np
import pandas as pd
import pytest
from seqloom.layout import KEY, NEED, STEP
from seqloom.streaming import replay


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class _Map(dict):
    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(list(self.items()))


class _Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return _Value()

    def getMapState(self, *_):
        return _Map()

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1_000


class Sum(replay.StepModel):
    """The outputs name the rows used so far, in order."""

    def start(self):
        return np.zeros(1)

    def step(self, state, step, row):
        state = state * 0.5 + row[0]
        return state, (float(state[0]),)


def _plain(batches, most):
    """Every row for itself."""
    expected, state, held, out = 0, 0.0, {}, []

    def one(step, need, x):
        nonlocal state, expected
        state = state * 0.5 + x
        if need:
            out.append((step, "ok", state))
        expected = step + 1

    def follow():
        while expected in held:
            one(expected, *held.pop(expected))

    def skip():
        nonlocal expected
        out.append((expected, "gap", None))
        expected = min(held)
        follow()

    for rows in batches:
        closed = False
        for step, need, x in sorted(rows, key=lambda r: r[0]):
            if step == replay.END:
                closed = True
            elif step < expected:
                out.append((step, "late", None))
            elif step in held:
                out.append((step, "repeat", None))
            elif step > expected:
                held[step] = (need, x)
                if most is not None and len(held) > most:
                    skip()
            else:
                one(step, need, x)
                follow()
        while closed and held:
            skip()
    return out


def _run(batches, most, make=Sum):
    p = replay._Replay(make, ["x"], most)
    p.init(_Handle())
    out = []
    for rows in batches:
        pdf = pd.DataFrame(rows, columns=[STEP, NEED, "x"])
        for frame in p.handleInputRows((7,), iter([pdf[:len(pdf) // 2], pdf[len(pdf) // 2:]] if most is None else [pdf]), _Clock()):
            assert (frame[KEY] == 7).all()
            out += [(int(s), k, None if y is None or np.isnan(y) else float(y)) for s, k, y in zip(frame[STEP], frame["status"], frame["y"])]
    assert sorted(len(v[0]) for v in p.places.values()) == sorted(len(v[0]) for v in p.content.values())
    return out


@pytest.mark.parametrize("most", [None, 0, 1, 5])
def test_any_order_of_rows(most):
    rng = np.random.default_rng(6)
    for _ in range(150):
        steps = [int(s) for s in range(int(rng.integers(1, 40))) if rng.random() < 0.9]
        steps += [int(s) for s in rng.choice(40, rng.integers(0, 6))]
        rng.shuffle(steps)
        rows = [(s, bool(rng.random() < 0.8), float(rng.integers(0, 9))) for s in steps]
        # Two rows of one step carry the same content, so that it does not matter which comes first.
        known = {}
        rows = [known.setdefault(r[0], r) for r in rows]
        cuts = sorted(rng.integers(0, len(rows) + 1, 3).tolist()) if rows else []
        batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        if rng.random() < 0.5:
            batches[-1] = [*batches[-1], (replay.END, False, 0.0)]
        if most is None:  # a batch arrives in two parts there, the row that closes the sequence in the last one
            closed = bool(batches) and any(r[0] == replay.END for r in batches[-1])
            parts = [h for b in batches for h in (b[:len(b) // 2], b[len(b) // 2:])]
            want = _plain(parts, None)
            assert not closed or parts[-1][-1][0] == replay.END
        else:
            want = _plain(batches, most)
        got = _run(batches, most)
        if most is not None:
            # Whether the first row of a step was given up on within the batch before or after the second one came is not told apart.
            got, want = ([(s, "again" if k in ("late", "repeat") else k, y) for s, k, y in rows] for rows in (got, want))
        assert sorted(got, key=str) == sorted(want, key=str)


def test_a_timer_gives_up_the_gap():
    p = replay._Replay(Sum, ["x"], None, patience_ms=50)
    handle = _Handle()
    p.init(handle)
    list(p.handleInputRows((1,), iter([pd.DataFrame([(0, True, 1.0), (3, True, 1.0), (4, True, 1.0)], columns=[STEP, NEED, "x"])]), _Clock()))
    assert handle.timers == [1_050]
    out = pd.concat(p.handleExpiredTimer((1,), _Clock(), None))
    assert list(zip(out[STEP], out["status"])) == [(1, "gap"), (3, "ok"), (4, "ok")] and handle.timers == [] and not p.places


def test_continue_from_a_stored_state():
    p = replay._Replay(Sum, ["x"])
    p.init(_Handle())
    p.handleInitialState((1,), pd.DataFrame({KEY: [1], "expected": [10], "state": [np.array([8.0])]}), _Clock())
    out = pd.concat(p.handleInputRows((1,), iter([pd.DataFrame([(9, True, 1.0), (10, True, 1.0)], columns=[STEP, NEED, "x"])]), _Clock()))
    assert sorted(zip(out[STEP], out["status"])) == [(9, "late"), (10, "ok")] and out["y"].dropna().tolist() == [5.0]
