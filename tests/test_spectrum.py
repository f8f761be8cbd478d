"""The two-step transform against that of whole records."""

import numpy as np

from faultspark.operators import spectrum


def test_delay_of_records(spark):
    rng = np.random.default_rng(2)
    records = {1: rng.normal(size=360), 2: rng.normal(size=97), 3: rng.normal(size=64), 4: rng.normal(size=1), None: rng.normal(size=35)}
    rows = [(r, n, float(x), 0) for r, v in records.items() for n, x in enumerate(v)]
    rows += [(8, n, 1.0, 0) for n in range(20) if n != 7] + [(9, n, 1.0 if n else None, 0) for n in range(12)] + [(1, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "rec long, n int, x double, q int").repartition(5)
    out = spectrum.fractional_delay(df, ["rec"], "x", 3.3e-4, 800.0)
    assert out.dtypes == [("rec", "bigint"), ("n", "int"), ("x", "double")]
    got = {(r.rec, r.n): r.x for r in out.collect()}
    assert len(got) == len(rows) - 1
    for r, v in records.items():
        f = np.fft.rfftfreq(len(v), 1 / 800.0)
        want = np.fft.irfft(np.fft.rfft(v) * np.exp(-2j * np.pi * f * 3.3e-4), n=len(v))
        assert max(abs(got[r, n] - x) for n, x in enumerate(want)) < 1e-9
    assert all(x is None for (r, _), x in got.items() if r in (8, 9))
    assert spectrum.fractional_delay(df.limit(0), ["rec"], "x", 1e-4, 800.0).count() == 0
