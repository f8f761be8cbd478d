"""Record files as a Spark data source: ``spark.read.format("records").load(folder)``.

A partition is a byte range of one file. Its task reads the two head lines at the start of the file (a few kilobytes), finds the
columns of each terminal in them, and then parses only the wanted columns of the lines that begin in its range. So the text is
read once, in parallel within a file, and nothing is joined. Equality and membership filters on ``sim_idx`` are pushed down to the
list of files, and what is wanted is set by options:

* ``channels``: comma-separated subset of the six channels (all by default); the schema has those only,
* ``buses``: comma-separated bus numbers (all by default),
* ``split_bytes``: size of a range, ``fs`` and ``t0``: sampling rate and time of the first sample.

Files are found by Arrow's file systems, so the path is one that every executor can open. Files whose name has no record number
are passed over. A file of only head lines, or of none, gives no rows; values that are no numbers are NULL; lines without a time are left out.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from faultspark.operators.signal import CHANNELS
from faultspark.sources.records import FILE_ID, NUMBER, TERMINAL_PATTERN
from faultspark.sources.stage import no_shuffle_files

HEAD_BYTES = 1 << 20
SPLIT_BYTES = 32 << 20
#: Small files are read together, up to this many bytes a task.
PACK_BYTES = 4 << 20
#: Bytes parsed at once.
CHUNK_BYTES = 8 << 20


@dataclass
class FileRange(InputPartition):
    path: str
    sim_idx: int
    start: int
    end: int


@dataclass
class FileRanges(InputPartition):
    ranges: list[FileRange]


def open_path(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def terminals(head: list[str]) -> list[tuple[int, str, int]]:
    """(bus, target, first column) of each terminal named in the head lines."""
    names = next((h for h in head if re.search(TERMINAL_PATTERN.rstrip("$"), h)), "")
    first: dict[tuple[int, str], int] = {}
    for pos, cell in enumerate(names.split(",")):
        found = re.search(TERMINAL_PATTERN, re.sub(r"\.\d+$", "", cell.strip()))
        if found:
            first.setdefault((int(found.group(2)), found.group(3)), pos)
    return [(bus, target, pos) for (bus, target), pos in first.items()]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str], channels: list[str]):
        self.path = options["path"]
        self.channels = channels
        self.buses = {int(b) for b in options["buses"].split(",")} if options.get("buses") else None
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.fs, self.t0 = float(options.get("fs", 9600.0)), float(options.get("t0", 1.0))
        self.ids: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the record number choose files; Spark evaluates the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sim_idx",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = ids if self.ids is None else self.ids & ids
            else:
                yield f

    def partitions(self) -> list[FileRanges]:
        from pyarrow import fs

        system, root = open_path(self.path)
        out, held = [], PACK_BYTES
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            found = re.search(FILE_ID, info.path)
            if info.type != fs.FileType.File or not found or self.ids is not None and int(found.group(1)) not in self.ids:
                continue
            for start in range(0, info.size, self.split):
                part = FileRange(info.path, int(found.group(1)), start, min(info.size, start + self.split))
                if held + part.end - part.start > min(PACK_BYTES, self.split):
                    out.append(FileRanges([]))
                    held = 0
                out[-1].ranges.append(part)
                held += part.end - part.start
        return out

    def read(self, partition: FileRanges | None) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges if partition else ():
            yield from self._range(part)

    def _range(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        system, _ = open_path(self.path)
        with system.open_input_file(part.path) as f:
            head = self._head(f)
            ends = [e for e in terminals(head) if self.buses is None or e[0] in self.buses]
            if ends:
                for chunk in self._chunks(f, part):
                    yield from self._parsed(chunk, part.sim_idx, ends)

    @staticmethod
    def _head(f) -> list[str]:
        """Lines before the first sample."""
        out = []
        for line in io.BytesIO(f.read_at(min(HEAD_BYTES, f.size()), 0)):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if re.search(NUMBER, text):
                break
            out.append(text)
        return out

    @staticmethod
    def _chunks(f, part: FileRange) -> Iterator[bytes]:
        """Whole lines that begin in the range."""
        at, size = part.start, f.size()
        if at:  # the line that is under way belongs to the range before
            at -= 1
            while True:
                block = f.read_at(min(1 << 16, size - at), at)
                cut = block.find(b"\n")
                if cut >= 0 or at + len(block) >= size:
                    at = at + cut + 1 if cut >= 0 else size
                    break
                at += len(block)
        while at < part.end:
            want = min(CHUNK_BYTES, part.end - at)
            block = f.read_at(want, at)
            at += want
            while not block.endswith(b"\n") and at < size:  # finish the last line
                more = f.read_at(min(1 << 16, size - at), at)
                cut = more.find(b"\n")
                take = len(more) if cut < 0 else cut + 1
                block, at = block + more[:take], at + take
            yield block

    def _parsed(self, chunk: bytes, sim_idx: int, ends: list[tuple[int, str, int]]) -> Iterator[pa.RecordBatch]:
        rows = [line.split(b",") for line in chunk.splitlines() if re.match(NUMBER.encode(), line)]
        t, kept = _numbers([r[0] for r in rows]), rows
        if np.isnan(t).any():
            kept, t = [r for r, x in zip(rows, t) if not np.isnan(x)], t[~np.isnan(t)]
        if not kept:
            return
        n = np.rint((t - self.t0) * self.fs).astype(np.int32)
        for bus, target, first in ends:
            values = []
            for c in self.channels:
                pos = first + CHANNELS.index(c)
                v = _numbers([r[pos] if pos < len(r) else b"" for r in kept])
                values.append(pa.array(v, mask=~np.isfinite(v)))
            k = len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, sim_idx)), pa.array(np.full(k, bus, np.int32)), pa.array([target] * k), pa.array(n), *values],
                                             names=["sim_idx", "bus", "target", "n", *self.channels])


def _numbers(cells: list[bytes]) -> np.ndarray:
    """Doubles; NaN for what is none."""
    try:
        return np.array(cells, "S").astype(np.float64) if cells else np.zeros(0)
    except ValueError:
        out = np.full(len(cells), np.nan)
        for i, c in enumerate(cells):
            try:
                out[i] = float(c)
            except ValueError:
                pass
        return out


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def _channels(self) -> list[str]:
        wanted = self.options.get("channels")
        return [c for c in CHANNELS if not wanted or c in wanted.split(",")]

    def schema(self) -> str:
        return "sim_idx bigint, bus int, target string, n int, " + ", ".join(f"{c} double" for c in self._channels())

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options), self._channels())


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)


def write_records(lines: DataFrame, path: str, name: str = "result{}.csv") -> int:
    """Write lines (sim_idx, n, value) as one file per record, in the order of n; returns the number of files.

    A file is written under a name of its task's attempt and moved to its own name when it is complete, so a lost or repeated
    task leaves whole files only. Lines stream through; none is held but the current one.
    """
    return write_dealt(lines.where("sim_idx is not null").repartition("sim_idx").sortWithinPartitions("sim_idx", "n"), path, name)


def write_dealt(lines: DataFrame, path: str, name: str = "result{}.csv") -> int:
    """``write_records`` of lines of which each record's are in one partition and in order already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = open_path(path)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        held, out, done = None, None, 0

        def close() -> None:
            out.close()
            system.move(f"{root}/.{attempt}-{held}", f"{root}/{name.format(held)}")

        for b in batches:
            for key, value in zip(b.column("sim_idx").to_pylist(), b.column("value").to_pylist()):
                if key != held:
                    if held is not None:
                        close()
                    held, out, done = key, system.open_output_stream(f"{root}/.{attempt}-{key}"), done + 1
                out.write((value or "").encode() + b"\n")
        if held is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["files"])

    with no_shuffle_files(lines.sparkSession):
        return lines.select("sim_idx", "value").mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0
