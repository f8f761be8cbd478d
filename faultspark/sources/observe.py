"""Checks that run while a table is written: Spark's observed metrics instead of a second pass over the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from faultspark.functions.scalar import defined
from faultspark.operators.signal import CHANNELS


def sample_checks(cols: list[str] | None = None) -> dict[str, Column]:
    """Rows, records (samples of number 0), samples before them, and rows with an undefined value."""
    bad = F.lit(False)
    for c in cols or CHANNELS:
        bad = bad | defined(F.col(c)).isNull()
    return {"rows": F.count(F.lit(1)), "records": F.count_if(F.col("n") == 0), "before_start": F.count_if(F.col("n") < 0),
            "undefined": F.count_if(bad)}


def rule_counts(rules: list[str], column: str = "rule") -> dict[str, Column]:
    """Rows of a table of violations by rule."""
    return {r: F.count_if(F.col(column) == r) for r in rules}


def observed(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with checks that are counted where it stands in the plan, in the first action on it.

    Place it behind the last shuffle: tasks of a writing stage count once, even if they are tried again, while those of a stage
    before a shuffle count again when their lost output is made anew.
    """
    name = Observation(f"checks-{uuid.uuid4().hex}")
    return df.observe(name, *[v.alias(k) for k, v in checks.items()]), name


def write_checked(df: DataFrame, path: str, checks: dict[str, Column], limits: dict[str, int] | None = None) -> dict[str, int]:
    """Write a table and count its checks in the same pass.

    ``limits`` gives the largest count allowed for some checks. Beyond one of them the table stays for inspection and a ValueError
    names the check, so nothing that follows runs on it.
    """
    rows, name = observed(df, checks)
    rows.write.parquet(path)
    found = dict(name.get)
    over = {k: found[k] for k, most in (limits or {}).items() if found[k] > most}
    if over:
        raise ValueError(f"{path}: " + ", ".join(f"{k} {v}" for k, v in sorted(over.items())))
    return found
