"""Whitening of vectors, from exact cross-products of bit planes.

An entry c becomes the integer x = floor(1024 c) + 100000. In a block of rows every dimension is shifted by its least x, so
what is left is not negative and takes few bits. Each bit of each dimension is one plane: that bit of all rows of the block, packed
into 64-bit words. A sum of products over the block is the sum over pairs of planes of 2^(a + b) times the popcount of
their AND, and the shifts are put back by the sums, which are weighted popcounts as well. All of it is integers, so blocks and
tasks add up to the exact cross-products in whatever order they come. Covariance numerators n * sum(xy) - sum(x) sum(y) are
integers too, divided once, then eigenvectors follow.

A task passes on d(d + 1) / 2 products and d sums; the driver gets their totals, which depend on the number of dimensions only.

Rows whose vector is null, or holds a null, NaN or infinite entry, are dropped, and so are rows whose vector has another length than
most have (of equally frequent lengths the smallest counts). Zero vectors, repeated rows and rows without vec_id
remain. Entries whose x would leave the range of +-2^62 are held at its ends. A component without variance (all vectors equal, a single row) has
no scale: its ``whitened`` is null and it does not enter ``identity_error`` (null if there is none with); ``explained`` is null without any variance.
``deviation`` is null where it exceeds a long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Rows of a block; a multiple of 64.
BLOCK = 4_096
_LIMIT = float(1 << 62)
_LONG = (1 << 63) - 1
#: Share of the largest eigenvalue below which a component counts as without variance, times dimensions.
_FLAT = 1e-14


def integers(vectors: np.ndarray) -> np.ndarray:
    """x of each entry."""
    return np.clip(np.floor(vectors * SCALE), -_LIMIT, _LIMIT - 2 * OFFSET).astype(np.int64) + OFFSET


def planes(shifted: np.ndarray) -> np.ndarray:
    """Bits of a block of non-negative integers (rows x dimensions), packed over rows: dimensions x bits x words."""
    rows, d = shifted.shape
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    padded = np.zeros((d, -(-rows // 64) * 64), np.uint64)
    padded[:, :rows] = shifted.T
    each = [np.packbits((padded >> np.uint64(a) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for a in range(bits)]
    return np.stack(each, axis=1)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (d) and cross-products (d x d, upper half) of a block, as Python integers."""
    rows, d = x.shape
    least = x.min(axis=0)
    packed = planes((x - least).astype(np.uint64))
    bits = packed.shape[1]
    kind = np.int64 if 2 * bits + rows.bit_length() < 63 else object
    weight = np.array([1 << b for b in range(bits)], dtype=kind)
    sums = (np.bitwise_count(packed).sum(axis=2, dtype=np.int64).astype(kind) * weight).sum(axis=1).astype(object)
    cross = np.zeros((d, d), object)
    for i in range(d):
        total = np.zeros(d - i, kind)
        for a in range(bits):
            both = np.bitwise_count(packed[i:] & packed[i, a]).sum(axis=2, dtype=np.int64).astype(kind)
            total = total + (both * weight).sum(axis=1) * weight[a]
        cross[i, i:] = total
    shift = least.astype(object)
    whole = cross + np.triu(np.outer(shift, sums) + np.outer(sums, shift) + rows * np.outer(shift, shift))
    return sums + rows * shift, whole


@dataclass
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions x components, unit length
    values: np.ndarray  # eigenvalues, falling
    scaled: np.ndarray  # which components have variance
    trace: float


def solve(n: int, sums: list[int], cross: dict[tuple[int, int], int], components: int = COMPONENTS) -> Whitening:
    """Eigenvectors of the covariance; its numerators are centred as integers."""
    d = len(sums)
    cov = np.zeros((d, d))
    for (i, j), c in cross.items():
        cov[i, j] = cov[j, i] = (n * c - sums[i] * sums[j]) / (n * n)  # a quotient of integers, rounded once
    values, vectors = np.linalg.eigh(cov)
    order = np.arange(d)[::-1][:components]
    values, vectors = values[order], vectors[:, order]
    scaled = values > _FLAT * d * max(float(values[0]) if d else 0.0, 0.0)
    return Whitening(n, sums, vectors, values, scaled, float(np.trace(cov)))


def centred(model: Whitening, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """x - S / n as doubles, and the exact sum of squares of n x - S for each row."""
    sums = np.array(model.sums, object)
    reach = max((max(abs(model.n * int(x[:, i].max()) - s), abs(model.n * int(x[:, i].min()) - s)) for i, s in enumerate(model.sums)), default=0)
    kind = np.int64 if reach and len(model.sums) * reach * reach <= _LONG and model.n * (int(np.abs(x).max()) + 1) <= _LONG else object
    scaled = model.n * x.astype(kind) - sums.astype(kind)
    squares = (scaled * scaled).sum(axis=1).tolist()
    return (scaled / model.n).astype(np.float64), [q if q <= _LONG else None for q in squares]


def project(model: Whitening, offsets: np.ndarray) -> np.ndarray:
    root = np.sqrt(np.where(model.scaled, model.values, 1.0))
    return offsets @ model.vectors / root


def remaining(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v as doubles) of the rows that take part, and their number of dimensions."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    d = sizes[0].n if sizes else 0
    return v.where(F.size("v") == d), d


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for b in batches:
        if b.num_rows:
            held.append(integers(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)))
        while sum(map(len, held)) >= BLOCK:
            whole = np.concatenate(held)
            yield whole[:BLOCK]
            held = [whole[BLOCK:]]
    if sum(map(len, held)):
        yield np.concatenate(held)


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows; None if there are none."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        for x in _blocks(batches, d):
            s, c = scatter(x)
            n, sums, cross = n + len(x), sums + s, cross + c
        if n:
            out = [(-1, -1, n)] + [(i, -1, int(s)) for i, s in enumerate(sums)] + [(i, j, int(cross[i, j])) for i in range(d) for j in range(i, d)]
            i, j, total = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(t) for t in total])], names=["i", "j", "total"])

    # Totals travel as text: an integer of any size. Above 38 digits the decimal sum fails, it does not round.
    totals = (rows.select("v").mapInArrow(per_task, "i int, j int, total string")
              .groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))).collect()
    found = {(r.i, r.j): int(r.total) for r in totals}
    if not found:
        return None
    return solve(found[-1, -1], [found[i, -1] for i in range(d)], {k: t for k, t in found.items() if k[1] >= 0}, components)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component."""
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = remaining(vectors)
    model = fit(rows, d, components) if d else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    m = len(model.values)
    explained = (model.values / model.trace).tolist() if model.trace > 0 else [None] * m
    used = np.flatnonzero(model.scaled)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of squares and products of whitened values, which are centred: x - S / n is."""
        total = np.zeros((len(used), len(used)))
        for x in _blocks(batches, d):
            z = project(model, centred(model, x)[0])[:, used]
            total += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    error = None
    if len(used):
        entry = F.abs(F.col("s") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
        error = (rows.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
                 .agg(F.max(entry).alias("e")).first().e)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d))
            offsets, squares = centred(model, x)
            z = project(model, offsets)
            at = np.repeat(np.arange(b.num_rows), m)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), b.num_rows)),
                 pa.array(np.full(len(at), model.n)), pa.array([q for q in squares for _ in range(m)], pa.int64()),
                 pa.array(z.ravel(), mask=np.tile(~model.scaled, b.num_rows)), pa.array(explained * b.num_rows, pa.float64()),
                 pa.array([error] * len(at), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(values, schema)
