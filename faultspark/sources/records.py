"""Waveform record files.

A record file has a line of column names, a line of units and one line per
sample. Files are read as text in parallel; the two head lines are recognised
by their content, so no file is opened by the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspark.config import SignalConfig
from faultspark.functions.scalar import defined
from faultspark.operators.signal import CHANNELS

# --- fixed formats of the record files -------------------------------------------
TERMINAL_PATTERN = r"pex_(MainBus(\d+))_(MainLn[^,.]+)$"
UNITS = ["Isec:A", "Isec:B", "Isec:C", "Usec:A", "Usec:B", "Usec:C"]
FILE_ID = r"result(\d+)\.csv$"
NUMBER = r"^\s*[-+]?[0-9.]"
# -----------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sim_idx, value) text lines of all record files under ``path``."""
    name = F.col("_metadata.file_path")
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "result*.csv").text(path)
            .select(F.regexp_extract(name, FILE_ID, 1).cast("bigint").alias("sim_idx"), "value"))


def probe_header(lines: DataFrame) -> DataFrame:
    """Column map: one row per terminal with its first column position.

    Only the two head lines of a file take part. A terminal's six columns
    repeat one name, so its first position is where the name first occurs.
    """
    heads = lines.where(~F.col("value").rlike(NUMBER))
    is_units = F.col("value").contains(UNITS[0])
    per_file = heads.groupBy("sim_idx").agg(
        F.max(F.when(~is_units, F.col("value"))).alias("names"), F.max(F.when(is_units, F.col("value"))).alias("units"))
    cells = per_file.select("sim_idx", F.split("units", ",").alias("units"), F.posexplode(F.split("names", ",")))
    base = F.regexp_replace(F.trim("col"), r"\.\d+$", "")
    cells = cells.withColumns({"_name": base, "_unit": F.trim(F.get("units", F.col("pos")))})
    cells = cells.where(F.col("_name").rlike(TERMINAL_PATTERN))
    part = lambda k: F.regexp_extract("_name", TERMINAL_PATTERN, k)
    return (cells.groupBy("sim_idx", part(2).cast("int").alias("bus"), part(3).alias("target"))
            .agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_cols"), F.max("pos").alias("last_pos"),
                 F.transform(F.array_sort(F.collect_list(F.struct("pos", "_unit"))), lambda s: s["_unit"]).alias("units")))


def header_violations(column_map: DataFrame) -> DataFrame:
    """Terminals whose columns are not six, contiguous and in unit order."""
    gap = F.col("last_pos") - F.col("first_pos") != 5
    wrong_unit = F.lit(False)
    for i, u in enumerate(UNITS):
        wrong_unit = wrong_unit | ~F.coalesce(F.get("units", F.lit(i)).contains(u), F.lit(False))
    rules = {"columns": F.col("n_cols") != 6, "contiguous": gap, "units": wrong_unit}
    found = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    return column_map.select("sim_idx", "bus", "target", F.explode(found).alias("rule"))


def parse_samples(lines: DataFrame, column_map: DataFrame, cfg: SignalConfig) -> DataFrame:
    """(sim_idx, bus, target, n, six channels) from sample lines.

    The sample index comes from the time column, so lines may arrive in any
    order. The column map has a few rows per file; the join is on the file
    key, where Spark broadcasts a small map and AQE splits a skewed one.
    """
    rows = lines.where(F.col("value").rlike(NUMBER)).select("sim_idx", F.split("value", ",").alias("_f"))
    t = F.get("_f", F.lit(0)).cast("double")
    rows = rows.withColumn("n", F.round((t - cfg.t0) * cfg.fs, 0).cast("int"))
    df = rows.join(column_map.select("sim_idx", "bus", "target", "first_pos"), "sim_idx")
    cells = [defined(F.get("_f", F.col("first_pos") + i).try_cast("double")).alias(c) for i, c in enumerate(CHANNELS)]
    return df.select("sim_idx", "bus", "target", "n", *cells)


def read_records(spark: SparkSession, path: str, cfg: SignalConfig) -> DataFrame:
    lines = read_lines(spark, path)
    return parse_samples(lines, probe_header(lines), cfg)


def for_lines(samples: DataFrame, episodes: DataFrame) -> DataFrame:
    """Both measured ends of each episode's own line, as terminals 0 and 1.

    ``episodes`` holds (sim_idx, target, bus_s, bus_r). If the first bus is not
    measured the other end becomes terminal 0.
    """
    ends = samples.join(episodes.select("sim_idx", "target", "bus_s", "bus_r"), ["sim_idx", "target"])
    return ends.withColumn("end", F.when(F.col("bus") == F.col("bus_s"), 0).when(F.col("bus") == F.col("bus_r"), 1)).where(
        F.col("end").isNotNull()).drop("bus_s", "bus_r")


def validate_samples(samples: DataFrame, keys: list[str], n_expected: int, cols: list[str] | None = None) -> DataFrame:
    """Violations per record: sample count, start, span, repeats, undefined values."""
    cols = cols or CHANNELS
    undefined = F.lit(0)
    for c in cols:
        undefined = undefined + F.when(F.col(c).isNull() | F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")), 1).otherwise(0)
    agg = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"), F.min("n").alias("_lo"), F.max("n").alias("_hi"),
                                     F.sum(undefined).alias("_bad"))
    rules = {"count": F.col("_cnt") != n_expected, "start": F.col("_lo") != 0, "span": F.col("_hi") != n_expected - 1,
             "gaps": F.col("_hi") - F.col("_lo") + 1 != F.col("_cnt"), "undefined": F.col("_bad") > 0}
    found = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    return agg.select(*keys, F.explode(found).alias("rule"))
