"""Signal geometry: every sampling constant is a parameter of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SignalConfig:
    """Sampling rate, cycle, window and hop of a record set.

    ``block_hops`` is the number of hops per halo block, the unit of work of
    every sample-level operator: a record is cut into blocks of
    ``block_hops * hop`` samples, so a long record is spread over many tasks.
    """

    fs: float = 9600.0
    f0: float = 50.0
    t0: float = 1.0
    win: int = 480
    hop: int = 48
    active_len: int = 289
    memory_gap: int = 10
    fir_half: int = 5
    block_hops: int = 200

    def __post_init__(self) -> None:
        if self.win % self.hop or self.cycle % self.hop:
            raise ValueError("window and cycle must be whole numbers of hops")
        if self.win < 2 * self.cycle:
            raise ValueError("the window must hold a first and a last cycle")

    @property
    def cycle(self) -> int:
        return int(round(self.fs / self.f0))

    @property
    def omega(self) -> float:
        return 2.0 * 3.141592653589793 * self.f0

    @property
    def block(self) -> int:
        return self.block_hops * self.hop

    @property
    def lead(self) -> int:
        """Samples a block needs before its first own sample."""
        return self.win - self.hop + 2 * self.fir_half

    @property
    def trail(self) -> int:
        return self.fir_half

    @property
    def win_panes(self) -> int:
        return self.win // self.hop

    @property
    def cycle_panes(self) -> int:
        return self.cycle // self.hop


#: 50 Hz at 800 samples per second: 16-sample cycle, 50 ms window, 5 ms hop.
COMPACT = SignalConfig(
    fs=800.0, f0=50.0, t0=1.0, win=40, hop=4,
    active_len=24, memory_gap=2, fir_half=5, block_hops=64,
)
