"""Two-ended location on a live stream of samples.

Samples of a line arrive in any order within the watermark. For each line the state carries the few samples that derivatives still
need (the halo), samples that arrived ahead of a gap, and the sums of the panes of unfinished windows; it grows with what is out of
order, not with the record. A window is emitted as soon as its last pane is complete. When the watermark has passed a line's
last sample by ``gap``, its end is taken as the record's end: derivatives there are fitted on the last samples, the
remaining windows are emitted, and the state is dropped. The windows are those of :func:`two_ended.td_estimate` on the whole record.

Samples behind the line's frontier, repeated ones, ones that lack a value and ones behind a gap that was never filled count as late and
change nothing (samples that only one end has are none of these); the count so far is on every row, and a line that ends with late samples but no further window gives one row without window. Rows that Spark itself drops
behind the watermark are in the query's progress (``numRowsDroppedByWatermark``). Lines without parameters, or whose ends have
fewer than a derivative's samples in common, give no estimate.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultspark.config import SignalConfig
from faultspark.operators.signal import CHANNELS


def slope_weights(half: int) -> np.ndarray:
    """Row k: weights of 2 * half + 1 samples for the slope of their least-squares quadratic, k - half samples off the middle."""
    m = np.arange(-half, half + 1, dtype=float)
    second, size = (m * m).sum(), 2 * half + 1
    bow = m * m - second / size
    return m / second + 2 * m[:, None] * bow / (bow * bow).sum()


def no_rows(*shape: int) -> np.ndarray:
    return np.zeros((0, *shape))


@dataclass
class LineState:
    """What a line carries from one micro-batch to the next."""

    first: int = 0  # number of the first sample kept
    kept: np.ndarray = field(default_factory=lambda: no_rows(2, len(CHANNELS)))  # samples without a gap from there on: 2 ends x 6 channels
    ahead: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # number * 2 + end of samples behind a gap, ascending
    waiting: np.ndarray = field(default_factory=lambda: no_rows(len(CHANNELS)))  # their channels
    summed: int = 0  # samples that are in the pane sums
    pane: int = 0  # number of the first pane kept
    panes: np.ndarray = field(default_factory=lambda: no_rows(2))  # sums of u w and w w by pane
    emitted: int = 0  # last window end
    late: int = 0
    said: int = 0  # late samples that a row has told of
    params: tuple[float, float] | None = None
    last_ts: float = 0.0

    def add(self, end: int, n: int, values: np.ndarray) -> None:
        self.add_all(np.array([end]), np.array([n]), np.array([values], float))

    def add_all(self, end: np.ndarray, n: np.ndarray, values: np.ndarray) -> None:
        """Samples in the order in which they came; of repeated ones the first counts."""
        top = self.first + len(self.kept)
        good = ((end == 0) | (end == 1)) & (n >= top) & np.isfinite(values).all(axis=1)
        code, at = np.unique(n[good].astype(np.int64) * 2 + end[good].astype(np.int64), return_index=True)
        fresh = ~np.isin(code, self.ahead)
        self.late += len(n) - int(fresh.sum())
        code = np.concatenate([self.ahead, code[fresh]])
        order = np.argsort(code)
        code, rows = code[order], np.concatenate([self.waiting, values[good][at[fresh]]])[order]
        gap = np.flatnonzero(code != 2 * top + np.arange(len(code)))
        k = (int(gap[0]) if len(gap) else len(code)) // 2 * 2
        self.kept = np.concatenate([self.kept, rows[:k].reshape(-1, 2, len(CHANNELS))])
        self.ahead, self.waiting = code[k:], rows[k:]

    def advance(self, cfg: SignalConfig, closing: bool) -> list[tuple[int, float]]:
        """Sum what can be summed; (window end, estimate) of windows that are complete now."""
        half, hop, top = cfg.fir_half, cfg.hop, self.first + len(self.kept)
        until = top if closing else top - half
        if self.params is None or top < 2 * half + 1 or until <= self.summed:
            return []
        x = self.kept  # samples x ends x channels
        n = np.arange(self.summed, until)
        centre = np.clip(n, half, top - 1 - half)
        weights = slope_weights(half)[n - centre + half]
        around = x[(centre - self.first)[:, None] + np.arange(-half, half + 1)]
        slope = cfg.fs * np.einsum("nm,nmec->nec", weights, around[:, :, :, :3])
        now = x[n - self.first]

        def modes(v: np.ndarray) -> np.ndarray:
            a, b, c = v[..., 0], v[..., 1], v[..., 2]
            return np.stack([(2 * a - b - c) / 3.0, (b - c) / np.sqrt(3.0)], axis=-1)

        i, v, d = modes(now[:, :, :3]), modes(now[:, :, 3:]), modes(slope)
        r, inductance = self.params[0], self.params[1] / cfg.omega
        u = v[:, 0] - v[:, 1] + r * i[:, 1] + inductance * d[:, 1]
        w = r * (i[:, 0] + i[:, 1]) + inductance * (d[:, 0] + d[:, 1])
        sums = np.stack([(u * w).sum(1), (w * w).sum(1)], axis=1)
        number = n // hop - self.pane
        panes = np.zeros((number[-1] + 1, 2))
        panes[:len(self.panes)] = self.panes
        begins = np.flatnonzero(np.diff(number, prepend=-1))
        panes[number[begins]] += np.add.reduceat(sums, begins)
        self.panes, self.summed = panes, until
        ends = np.arange(max(self.emitted + hop, cfg.win), until // hop * hop + 1, hop)
        out = []
        if len(ends):
            rolled = np.lib.stride_tricks.sliding_window_view(panes, cfg.win_panes, axis=0).sum(axis=-1)
            uw, ww = rolled[(ends - cfg.win) // hop - self.pane].T
            out = list(zip(ends.tolist(), (uw / (ww + 1e-12)).tolist()))
            self.emitted = out[-1][0]
        done = max(0, self.emitted // hop - cfg.win_panes + 1 - self.pane)
        self.panes, self.pane = self.panes[done:], self.pane + done
        drop = max(0, min(self.summed - half, top - 2 * half - 1) - self.first)  # the end may be fitted on the last samples
        self.kept, self.first = self.kept[drop:], self.first + drop
        return out


def td_estimate(samples: DataFrame, key: str, ts: str, cfg: SignalConfig, watermark: str = "10 seconds", gap_s: float = 5.0) -> DataFrame:
    """(key, win_end, td_est, late) of a stream of samples (key, term, n, ts, six channels, z1r, z1x)."""
    kind = dict(samples.dtypes)[key]

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line = pickle.loads(state.get[0]) if state.exists else LineState()
        if state.hasTimedOut:
            found = line.advance(cfg, True)
            line.late += 2 * int((np.unique(line.ahead // 2, return_counts=True)[1] == 2).sum())  # beyond a gap that was never filled
            if not found and line.late > line.said:
                found = [(None, None)]
            state.remove()
        else:
            for pdf in frames:
                if line.params is None:
                    known = pdf[["z1r", "z1x"]].dropna()
                    line.params = tuple(map(float, known.iloc[0])) if len(known) else None
                values = pdf[CHANNELS].to_numpy(dtype=float)
                end, n = pdf["term"], pdf["n"]
                if end.hasnans or n.hasnans:
                    whole = (n.notna() & end.notna()).to_numpy()
                    line.late += int((~whole).sum())
                    end, n, values = end[whole], n[whole], values[whole]
                line.add_all(end.to_numpy(dtype=np.int64), n.to_numpy(dtype=np.int64), values)
                line.last_ts = max(line.last_ts, pdf[ts].max().timestamp())
            found = line.advance(cfg, False)
            line.said = line.late if found else line.said
            state.update((pickle.dumps(line),))
            state.setTimeoutTimestamp(max(int((line.last_ts + gap_s) * 1000), state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame({key: [name[0]] * len(found), "win_end": pd.array([e for e, _ in found], "Int32"),
                                "td_est": pd.array([x for _, x in found], "Float64"), "late": [line.late] * len(found)})

    stream = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return stream.groupBy(key).applyInPandasWithState(
        run, f"`{key}` {kind}, win_end int, td_est double, late long", "state binary", "append", GroupStateTimeout.EventTimeTimeout)
