"""Episode labels: which rows are line faults, and which end is local."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Target names of line faults (fixed pattern of the data format).
LINE_PATTERN = r"^MainLn(\d+)-(\d+)[AB]?$"


def filter_line_faults(episodes: DataFrame) -> DataFrame:
    c = F.col
    return episodes.where(c("etype").startswith("flt_") & c("target").rlike(LINE_PATTERN) & c("location").isNotNull())


def parse_line(episodes: DataFrame) -> DataFrame:
    """Bus numbers of both ends; NULL when the target is not a line."""
    bus = lambda k: F.nullif(F.regexp_extract("target", LINE_PATTERN, k), F.lit("")).cast("int")
    return episodes.withColumns({"bus_s": bus(1), "bus_r": bus(2)})


def orient_local(episodes: DataFrame, measured: DataFrame, on: list[str]) -> DataFrame:
    """Choose the local end from the measured terminals.

    ``measured`` has (on, bus, target). If the first bus is not measured, the
    other end is local, the location is mirrored and two-ended values are
    undefined.
    """
    m = measured.select(*on, "bus", "target").distinct()
    has = {}
    df = episodes
    for end in ("s", "r"):
        flag = f"_has_{end}"
        df = df.join(m.withColumnRenamed("bus", f"bus_{end}").withColumn(flag, F.lit(True)),
                     [*on, f"bus_{end}", "target"], "left")
        has[end] = F.coalesce(F.col(flag), F.lit(False))
    flip = ~has["s"]
    y = F.col("location") / 100.0
    return df.withColumns({
        "flip": flip.cast("int"), "two": (~flip & has["r"]).cast("int"), "y_label": y,
        "local_bus": F.when(flip, F.col("bus_r")).otherwise(F.col("bus_s")),
        "y": F.when(flip, 1.0 - y).otherwise(y)}).drop("_has_s", "_has_r")


def missing_lines(episodes: DataFrame, params: DataFrame, line: str = "target") -> DataFrame:
    """Targets without a parameter row; must be empty before a feature pass."""
    return episodes.select(line).distinct().join(params.select(line), line, "left_anti")
