"""Approximate nearest neighbours by adaptive dimension scans within probed lists.

Unit vectors are rotated by a random orthogonal matrix and cut into column blocks. Lists come from spherical k-means on a
bounded sample; every vector of the table is put into its list. A query scans the lists nearest to it. Within a list,
distances are first summed over the first block; a test then abandons candidates whose partial distance, scaled up to all
dimensions, lies beyond the query's fifth best by more than chance allows; survivors go on to the next block. What
survives all blocks is scored exactly on the original vectors in double precision.

How many lists a query scans is measured at fitting time: on the sample, so that the share ``RECALL`` of true neighbours lies in them. A
query goes on to further lists while those it has hold fewer than k others. Its first bound is the k-th best of the sample's rows in
its own lists; these rows are scanned like any other, so whatever a bound passes over is worse than k rows that are met. Should the
tests leave a query fewer hits than there are rows, it is scanned once more without them.

Work is dealt in tiles: a list, or a share of a long list's rows, against the queries that scan it, or a share of them. Row and
query counts per list set the shares, and rows are dealt to shares one after the other, so a list with a third of all rows, or one
vector repeated as often, is many tiles. Neither rows nor queries pass through the driver; it has the sample and two numbers per list.

Vectors that are null, zero, hold a null or non-finite component, or have another length than most take no part, nor do
rows without vec_id. Ties go to the smaller vec_id; a repeated vec_id is a candidate as often as it occurs, and a query once
for each of its distinct vectors' first row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultspark.llm.common import stored

#: Rows the lists are fitted on: a tenth of the table, within these limits; and rows of it whose neighbours are measured.
LEAST_SAMPLE, SAMPLE, MEASURED = 64, 8_192, 512
LISTS, RECALL = 128, 0.985
#: Rows and queries of a tile, about.
TILE_ROWS, TILE_QUERIES = 16_384, 1_024
COLUMNS = 16
#: Deviations of a partial distance that chance may explain.
EPSILON = 2.1


@dataclass
class Lists:
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    sample: np.ndarray  # rotated unit vectors
    sample_ids: np.ndarray
    sample_lists: np.ndarray

    def nearest(self, rotated: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        return np.argmax(rotated @ self.centres.T, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def fit(ids: np.ndarray, vectors: np.ndarray, k: int, seed: int = 3) -> Lists:
    """Rotation, centres and the number of lists to scan."""
    rng = np.random.default_rng(seed)
    n, d = vectors.shape
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    u = unit(vectors) @ rotation
    m = max(1, min(LISTS, n // 32))
    centres = u[rng.choice(n, m, replace=False)]
    for _ in range(12):
        near = np.argmax(u @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, u)
        norm = np.sqrt((sums * sums).sum(1))
        centres = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centres)
    near = np.argmax(u @ centres.T, 1)
    q = u[:MEASURED]
    dots = q @ u.T
    dots[np.arange(len(q)), np.arange(len(q))] = -2
    top = np.argsort(-dots, 1)[:, :k]
    rank = np.argsort(np.argsort(-(q @ centres.T), 1), 1)
    found = np.take_along_axis(rank, near[top], 1).ravel()
    probes = m if n <= 4 * k * m else int(np.quantile(found, RECALL, method="higher")) + 1
    return Lists(rotation, centres, min(m, probes), u, ids, near)


def route(lists: Lists, sizes: np.ndarray, ids: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists each query scans (queries x lists), and its first bound: a squared distance, infinite if the sample has too few rows there.

    ``own``: rows with the query's id, which are no candidates of it. ``sizes``: rows of each list.
    """
    order = np.argsort(-(q @ lists.centres.T), 1, kind="stable")
    before = np.cumsum(sizes[order], 1) - sizes[order]
    wanted = (np.arange(order.shape[1])[None, :] < lists.probes) | (before < k + own[:, None])
    probed = np.zeros(wanted.shape, bool)
    np.put_along_axis(probed, order, wanted, 1)
    bound = np.full(len(q), np.inf)
    for a in range(0, len(q), 512):
        d = 2 - 2 * (q[a:a + 512] @ lists.sample.T)
        d[(ids[a:a + 512, None] == lists.sample_ids[None, :]) | ~probed[a:a + 512][:, lists.sample_lists]] = np.inf
        if d.shape[1] >= k:
            bound[a:a + 512] = np.partition(d, k - 1, 1)[:, k - 1]
    return probed, bound


@dataclass
class Queries:
    """Queries of a tile, and per query the scores and ids of the k best so far, best first."""

    ids: np.ndarray
    original: np.ndarray
    rotated: np.ndarray
    bound: np.ndarray
    score: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, original: np.ndarray, bound: np.ndarray, rotation: np.ndarray, k: int) -> "Queries":
        return cls(ids, original, unit(original) @ rotation, bound, np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max))


def scan(queries: Queries, ids: np.ndarray, original: np.ndarray, rotation: np.ndarray, tested: bool = True) -> None:
    """Scan rows of a list for all queries. Without ``tested`` no candidate is abandoned by chance."""
    score, owner = queries.score, queries.owner
    k = score.shape[1]
    norm = np.sqrt((original * original).sum(1))
    u = (original / norm[:, None]) @ rotation
    d = u.shape[1]
    qnorm = np.sqrt((queries.original * queries.original).sum(1))

    def slack(h: int) -> float:
        return (1 + EPSILON / np.sqrt(h)) ** 2 if tested else np.inf

    for part in range(0, len(ids), 2_048):
        own = np.arange(part, min(part + 2_048, len(ids)))
        for at in range(0, len(queries.ids), 512):
            q = np.arange(at, min(at + 512, len(queries.ids)))
            limit = np.minimum(queries.bound[q], 2 - 2 * score[q, k - 1])  # an empty place scores -inf
            first = min(COLUMNS, d)
            x, y = queries.rotated[q, :first], u[own, :first]
            part_d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
            if first < d:
                with np.errstate(invalid="ignore"):
                    i, j = np.nonzero(part_d * (d / first) <= (limit * slack(first) + 1e-9)[:, None]) if tested else np.nonzero(part_d < np.inf)
            else:
                i, j = np.nonzero(part_d <= (limit + 1e-9)[:, None])
            left = part_d[i, j]
            for lo in range(first, d, COLUMNS):
                hi = min(d, lo + COLUMNS)
                diff = queries.rotated[q[i], lo:hi] - u[own[j], lo:hi]
                left = left + (diff * diff).sum(1)
                if hi == d:
                    ok = left <= limit[i] + 1e-9
                elif tested:
                    ok = left * (d / hi) <= limit[i] * slack(hi) + 1e-9
                else:
                    continue
                i, j, left = i[ok], j[ok], left[ok]
            other = queries.ids[q[i]] != ids[own[j]]
            i, j = i[other], j[other]
            if not len(i):
                continue
            exact = (queries.original[q[i]] * original[own[j]]).sum(1) / (qnorm[q[i]] * norm[own[j]])
            exact = np.clip(exact, -1.0, 1.0)
            touched = np.unique(i)
            who_all = np.concatenate([np.repeat(touched, k), i])
            s_all = np.concatenate([score[q[touched]].ravel(), exact])
            o_all = np.concatenate([owner[q[touched]].ravel(), ids[own[j]]])
            order = np.lexsort((o_all, -s_all, who_all))
            who_all, s_all, o_all = who_all[order], s_all[order], o_all[order]
            start = np.searchsorted(who_all, touched)
            take = start[:, None] + np.arange(k)[None, :]
            score[q[touched]], owner[q[touched]] = s_all[take], o_all[take]


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, as doubles."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    v = v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("v") == (sizes[0].n if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def tiles(rows: DataFrame, routed: DataFrame, lists: Lists, row_counts: list[int], query_counts: list[int], k: int, tested: bool) -> DataFrame:
    """(query_id, vec_id, score): of each tile and query the k best.

    ``rows``: (list, turn, vec_id, v), turn being a number that goes round; ``routed``: (list, query_id, v, bound).
    """
    cells = [max(1, -(-n // TILE_ROWS)) for n in row_counts]
    blocks = [-(-n // TILE_QUERIES) for n in query_counts]

    def per_list(numbers: list[int]) -> Column:
        return F.element_at(F.expr("array(" + ", ".join(map(str, numbers)) + ")"), F.col("list") + 1)

    left = rows.where(per_list(blocks) > 0).select(
        "list", F.pmod("turn", per_list(cells)).alias("cell"), F.explode(F.sequence(F.lit(0), per_list(blocks) - 1)).alias("block"),
        F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("double").alias("bound"))
    right = routed.select(
        "list", F.explode(F.sequence(F.lit(0), per_list(cells) - 1)).alias("cell"), F.pmod(F.xxhash64("query_id"), per_list(blocks)).cast("int").alias("block"),
        F.lit(0).alias("kind"), F.col("query_id").alias("id"), "v", "bound")
    keys = ["list", "cell", "block"]
    rotation = lists.rotation

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, queries, waiting = None, None, []

        def hits() -> pa.RecordBatch:
            who, place = np.nonzero(np.isfinite(queries.score)) if queries else (np.zeros(0, int), np.zeros(0, int))
            cols = (queries.ids[who], queries.owner[who, place], queries.score[who, place]) if queries else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in [*keys, "kind"]])
            cuts = [0, *(np.flatnonzero((np.diff(at, axis=1) != 0).any(0)) + 1).tolist(), b.num_rows]
            ids, v, bound = b.column("id").to_numpy(zero_copy_only=False), _matrix(b.column("v")), b.column("bound").to_numpy(zero_copy_only=False)
            for lo, hi in zip(cuts, cuts[1:]):
                key, kind = tuple(at[:3, lo]), at[3, lo]
                if key != held:
                    yield hits()
                    held, queries, waiting = key, None, []
                if kind == 0:
                    waiting.append((ids[lo:hi], v[lo:hi], bound[lo:hi]))
                    continue
                if waiting:
                    queries = Queries.of(*(np.concatenate(x) for x in zip(*waiting)), rotation, k)
                    waiting = []
                if queries:
                    scan(queries, ids[lo:hi], v[lo:hi], rotation, tested)
        yield hits()

    dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "kind")
    return dealt.mapInArrow(per_task, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, every: int = 50, k: int = 5, sample_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    rows = valid(vectors).withColumn("vec_id", F.col("vec_id").cast("long"))
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample_rows or SAMPLE, max(LEAST_SAMPLE, n // 10))).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = fit(np.array([r.vec_id for r in sample], np.int64), np.array([r.v for r in sample], np.float64), k)
    m = len(lists.centres)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                near = lists.nearest(unit(_matrix(b.column("v"))) @ lists.rotation)
                turns = np.arange(turn, turn + b.num_rows)
                turn += b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(turns), b.column("vec_id"), b.column("v")], names=["list", "turn", "vec_id", "v"])

    assigned = rows.mapInArrow(listed, "list int, turn long, vec_id long, v array<double>")

    def per_list(df: DataFrame) -> list[int]:
        counts = {r.list: r.n for r in df.groupBy("list").agg(F.count("*").alias("n")).collect()}
        return [counts.get(i, 0) for i in range(m)]

    row_counts = per_list(assigned)
    sizes = np.array(row_counts)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("own"))

    def routed_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column("vec_id").to_numpy(zero_copy_only=False)
                probed, bound = route(lists, sizes, ids, b.column("own").to_numpy(zero_copy_only=False), unit(_matrix(b.column("v"))) @ lists.rotation, k)
                who, where = np.nonzero(probed)
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(ids[who]), b.column("v").take(pa.array(who)), pa.array(bound[who])],
                                                 names=["list", "query_id", "v", "bound"])

    asked = stored(asked)
    routed = asked.mapInArrow(routed_to, "list int, query_id long, v array<double>, bound double")
    found = stored(tiles(assigned, routed, lists, row_counts, per_list(routed), k, True))
    # Queries that the tests left with fewer hits than there are rows: once more, all lists, no bound, no tests.
    short = (asked.join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("hits")), "vec_id", "left")
             .where(F.coalesce("hits", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.col("own"))))
    if not short.isEmpty():
        again = short.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("list"), F.col("vec_id").alias("query_id"), "v", F.lit(float("inf")).alias("bound"))
        more = tiles(assigned, again, lists, row_counts, per_list(again), k, False)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
