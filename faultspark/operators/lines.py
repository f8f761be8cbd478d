"""Line parameters: per-kilometre table to totals, and its joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.functions.cplx import Cx


def totals(params: DataFrame) -> DataFrame:
    """Series impedances of the whole line: length times per-km values."""
    c = F.col
    drop = ["r1_km", "x1_km", "r0_km", "x0_km"]
    return params.withColumns({
        "z1r": c("r1_km") * c("length_km"), "z1x": c("x1_km") * c("length_km"),
        "z0r": c("r0_km") * c("length_km"), "z0x": c("x0_km") * c("length_km")}).drop(*drop)


def z1() -> Cx:
    return Cx("z1r", "z1x")


def z0() -> Cx:
    return Cx("z0r", "z0x")


def attach(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Join a parameter dimension.

    No broadcast hint: Spark broadcasts the side only if its measured size is
    under the session threshold, and splits a hot line's partition beyond it.
    """
    return df.join(params, keys)
