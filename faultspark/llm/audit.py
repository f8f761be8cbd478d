"""Interaction of filters, by sorted lists of failing ids.

Every document that fails a filter enters the list of that filter in its part (a source). Lists are kept by ranges of row
numbers, so that a part with a third of all rows is many short lists and none is longer than ``RANGE``. In a range, unions of
lists and what one list has beyond others are found by k-way merges that gallop: a cursor leaps ahead by doubled steps to the
next head of the other lists, and whole runs are taken or skipped at once. Sizes are summed over ranges; the order of
filters enters only afterwards, as what a filter removes depends on which filters came before, not on their order.

Filters, of words (maximal runs without white space, ``[^\\x20\\x09-\\x0D]+``, case-sensitive): A under 50 words; B distinct words
under 65 % of them; C capitals A-Z over 5 % of code points; D any of ``#$%&*|``; E a text that is that of a smaller doc_id too.

Nulls: a null text is empty, a null source is the part named by the empty string. A row without doc_id has no label and fails
no E, nor does it make others fail it. Rows are counted one by one, repeated ones and those of one doc_id included (which do
not fail E for each other). Of several labels of one id, any counts. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.llm.common import byte_texts, stored

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"
#: Row numbers of one range are the same above so many bits; a list holds at most 2^RANGE of them.
RANGE = 16
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))


def failing(data: bytes) -> int:
    """Bits of the filters A to D that the UTF-8 text fails; those need no other document."""
    words = data.split()  # of bytes: at exactly the six white spaces of the rule
    points = len(data.translate(None, _CONTINUED))
    return ((len(words) < MIN_WORDS) + 2 * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
            + 4 * (100 * (len(data) - len(data.translate(None, _CAPITALS))) > CAPITALS_PERCENT * points)
            + 8 * (len(data.translate(None, MARKS)) < len(data)))


def gallop(ids: list[int], wanted: int, at: int) -> int:
    """First place from ``at`` on whose id is not below ``wanted``, by doubled leaps and a search in the last one."""
    low, leap = at, 1
    while low + leap < len(ids) and ids[low + leap] < wanted:
        low += leap
        leap *= 2
    return bisect_left(ids, wanted, low, min(low + leap, len(ids)))


def _heads(lists: list[list[int]]) -> list[tuple[int, int, int]]:
    heap = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapify(heap)
    return heap


def union_size(lists: list[list[int]]) -> int:
    """Ids in any of the sorted lists."""
    heap, size = _heads(lists), 0
    while len(heap) > 1:
        head, k, at = heap[0]
        ids = lists[k]
        bound = min(h[0] for h in heap[1:3])
        end = at + 1 if head == bound else gallop(ids, bound, at)  # an equal head is counted by the last list that has it
        size += 0 if head == bound else end - at
        if end < len(ids):
            heapreplace(heap, (ids[end], k, end))
        else:
            heappop(heap)
    return size + (len(lists[heap[0][1]]) - heap[0][2] if heap else 0)


def beyond(ids: list[int], others: list[list[int]]) -> list[int]:
    """Ids of a sorted list that are in none of the others."""
    heap, at, out = _heads(others), 0, []
    while at < len(ids):
        while heap and heap[0][0] < ids[at]:
            _, k, there = heap[0]
            there = gallop(others[k], ids[at], there)
            if there < len(others[k]):
                heapreplace(heap, (others[k][there], k, there))
            else:
                heappop(heap)
        if not heap:
            return out + ids[at:]
        if heap[0][0] == ids[at]:
            at += 1
        else:
            end = gallop(ids, heap[0][0], at)
            out += ids[at:end]
            at = end
    return out


def sizes(lists: list[list[int]], good: list[int], toxic: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(filters before as bits, filter, removed, good lost, toxic lost, failing any of these and those before)."""
    n = len(lists)
    either = [union_size([lists[k] for k in range(n) if s >> k & 1]) for s in range(1 << n)]
    for f in range(n):
        for before in range(1 << n):
            if before >> f & 1:
                continue
            gone = beyond(lists[f], [lists[k] for k in range(n) if before >> k & 1])
            yield before, f, len(gone), len(gone) - len(beyond(gone, [good])), len(gone) - len(beyond(gone, [toxic])), either[before | 1 << f]


def failing_lists(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, part, doc_id, digest, fails A to D as bits), stored, and lists by (part, range): f0 to f4, good, toxic."""
    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                         F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_texts(b, "data")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 pa.array([failing(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "fails"])

    rows = stored(source.mapInArrow(per_task, f"doc_id {kind}, part string, digest binary, fails int")
                  .withColumn("id", F.monotonically_increasing_id()))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    known = (labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                                          F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good or toxic"))

    def entries(df: DataFrame, conditions: dict[int, Column]) -> DataFrame:
        lists = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]))
        return df.select("part", "id", F.explode(lists).alias("list"))

    found = entries(rows, {k: F.col("fails").bitwiseAND(1 << k) > 0 for k in range(4)})
    found = found.unionAll(entries(rows.join(first, "digest"), {4: F.col("doc_id") > F.col("first")}))
    found = found.unionAll(entries(rows.join(known, "doc_id"), {5: F.col("good"), 6: F.col("toxic")}))
    names = [f"f{k}" for k in range(5)] + ["good", "toxic"]
    lists = found.groupBy("part", F.shiftright("id", RANGE).alias("range")).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("list") == k, F.col("id")))).alias(name) for k, name in enumerate(names)])
    return rows, lists


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley."""
    rows, lists = failing_lists(docs, labels)
    measures = ["removed", "good_lost", "toxic_lost", "either"]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in [f"f{k}" for k in range(5)] + ["good", "toxic"]]
            parts, out = [], []
            for part, *seven in zip(b.column("part").to_pylist(), *columns):
                some = list(sizes(seven[:5], seven[5], seven[6]))
                parts += [part] * len(some)
                out += some
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())] + [pa.array(c, pa.int64()) for c in cols], names=["part", "before", "filter"] + measures)

    found = (lists.mapInArrow(merged, "part string, before long, filter long, " + ", ".join(f"{m} long" for m in measures))
             .groupBy("part", "before", "filter").agg(*[F.sum(m).alias(m) for m in measures]))
    # At most 80 sizes a part, so they are kept in its row.
    found = found.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("before") * len(FILTERS) + F.col("filter"), F.struct(*measures)))).alias("sizes"))
    steps = docs.sparkSession.createDataFrame(
        [(i * 5 + s, "".join(order), s + 1, FILTERS.index(order[s]), sum(1 << FILTERS.index(f) for f in order[:s]))
         for i, order in enumerate(permutations(FILTERS)) for s in range(5)],
        "slot int, filter_order string, step int, filter int, before int")
    own = F.element_at(F.array(*[F.lit(1 << f) for f in range(len(FILTERS))]), F.col("filter") + 1)
    everyone = rows.groupBy("part").agg(F.count("*").alias("n")).join(found, "part", "left")
    table = (everyone.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) * factorial(len(FILTERS)) - 1))))
             .join(F.broadcast(steps), "slot"))  # 600 rows, whatever the input

    def size(before: Column, measure: str) -> Column:
        at = (before * len(FILTERS) + F.col("filter")).cast("long")
        return F.coalesce(F.try_element_at("sizes", at)[measure], F.lit(0))

    others = F.lit((1 << len(FILTERS)) - 1) - own
    weighted = [F.when(F.lit(s).bitwiseAND(own) == 0, size(F.lit(s), "removed") * (factorial(bin(s).count("1")) * factorial(len(FILTERS) - 1 - bin(s).count("1"))))
                .otherwise(0) for s in range((1 << len(FILTERS)) - 1)]
    shapley = weighted[0]
    for w in weighted[1:]:
        shapley = shapley + w
    return table.select(
        "part", "filter_order", "step", (F.col("n") - size(F.col("before"), "either")).alias("kept"),
        size(F.col("before"), "removed").alias("removed"),
        (size(F.lit(0), "removed") - size(F.col("before"), "removed")).alias("redundant"),
        size(others, "removed").alias("unique_fails"), size(F.col("before"), "good_lost").alias("good_lost"),
        size(F.col("before"), "toxic_lost").alias("toxic_lost"), shapley.cast("long").alias("shapley"))


#: DuckDB SQL with the rows of :func:`audit` on the given tables.
SQL = r"""
WITH docs AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS words
  FROM documents),
known AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(docs.doc_id > min(docs.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM docs LEFT JOIN known ON docs.doc_id = known.doc_id),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flags GROUP BY part, fails),
letter AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, i AS step, o[i] AS f, o[1:i - 1] AS before, o[1:i] AS until FROM orders, letter),
counted AS (
  SELECT part, o, step, f,
         coalesce(sum(n) FILTER (WHERE NOT list_bool_or(list_transform(until, lambda k : fails[k]))), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE fails[f] AND NOT coalesce(list_bool_or(list_transform(before, lambda k : fails[k])), false)), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE fails[f] AND coalesce(list_bool_or(list_transform(before, lambda k : fails[k])), false)), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE fails[f] AND len(list_filter(fails, lambda x : x)) = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails[f] AND NOT coalesce(list_bool_or(list_transform(before, lambda k : fails[k])), false)), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE fails[f] AND NOT coalesce(list_bool_or(list_transform(before, lambda k : fails[k])), false)), 0) AS toxic_lost
  FROM kinds, steps GROUP BY part, o, step, f)
SELECT part, array_to_string(list_transform(o, lambda k : substr('ABCDE', k, 1)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept,
       removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
