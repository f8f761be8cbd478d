"""Removal of repeated byte strings, by sorted suffixes at shared positions.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else in the corpus. Not every suffix is sorted: of each
such string one position is chosen by content alone, the leftmost least hash among its runs of ``RUN`` bytes. Equal strings
choose the same place, so every repetition shows between chosen positions that share a run, one in about 150 bytes.

1. Runs chosen in more than one place are found by a combined count.
2. For those places the text before and after is cut out, as far as a string can reach, and dealt by run.
3. In a run's group both sides are sorted by deep-shallow (``suffixes``), and common prefixes of neighbours give each place
   the widest stretch that it shares with others in one piece.
4. Stretches are united per text and removed.

Runs in more than ``BIG`` places are not gathered. The strings that chose such a place start in one range before it, which is cut
into windows at fixed distances from the place (:func:`windows`). All strings of a window share a block, and equal strings lie in
windows at the same distance, so blocks are looked up first, by combined counts of their hashes (:func:`starts_shared`): those of
windows of ``STEP`` starts, within the ones that occur twice those of ``FINE`` starts, and there the strings of ``LENGTH`` bytes
themselves. A text adds a few blocks and strings at each border of what it shares, not one for each byte. A task passes each
different string on once and settles at once those that it has seen twice; no group is ever in one place. These hashes have 128 bits
and are not verified.

Equal texts are one content with a count, so copies are never compared or expanded: from two on all their bytes go if there are
``LENGTH`` of them. Equal surroundings are one entry with a count as well: within a task before they are dealt (so a phrase
repeated thousands of times, or a large group of near copies, moves little), and again within the group.

Nulls count as empty texts. Repeated rows, also of one doc_id, repeat each other. Rows without doc_id take part. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.llm.common import byte_texts, stored
from faultspark.llm.suffixes import deep_shallow, extents

LENGTH, RUN = 400, 100
#: Bytes hashed in one go; longer texts are taken in stretches that overlap by a string.
STRETCH = 1 << 20
#: Places of one run from which on it is looked up by counts, starts whose blocks are looked up first, and strings that a task combines.
BIG, STEP, COMBINED = 2_000, 50, 1_000_000
#: Starts whose blocks are looked up next.
FINE = 10
#: Starts of strings that are united in one go.
UNITED = 4_096
#: Surroundings that a task remembers while it looks for equal ones; then it starts afresh.
SEEN = 8_000
_POSITION = np.uint64((1 << 24) - 1)
_BASE, _OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(n: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    with np.errstate(over="ignore"):
        for b in (base, inverse):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Chooser:
    """Chosen positions of byte texts. ``length`` is that of a string, ``run`` that of a hashed run."""

    def __init__(self, length: int = LENGTH, run: int = RUN, stretch: int = STRETCH):
        self.length, self.run, self.stretch = length, run, max(stretch, 2 * length)
        self.values = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up, self.down = _powers(1)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of the run that starts at each byte."""
        n = len(data)
        if len(self.up) < n:
            self.up, self.down = _powers(n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.up[:n], dtype=np.uint64)])
            h = (sums[self.run:] - sums[:n - self.run + 1]) * self.down[:n - self.run + 1]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)

    def choose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Positions in ``data`` chosen by strings that lie within one text (start, end), their hashes, and the first and last
        start of the strings that chose each. Later strings of a text choose later positions, so these starts are one range."""
        w = self.length - self.run + 1
        n = len(data)
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2
        h = self.hashes(data)
        packed = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(packed) // w)
        full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        full[:len(packed)] = packed
        grid = full.reshape(rows, w)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - self.length + 1
        least = np.minimum(after[:count], before[w - 1:w - 1 + count])
        inside = np.zeros(n + 1, np.int32)
        long = ends - starts >= self.length
        inside[starts[long]] += 1
        np.subtract.at(inside, ends[long] - self.length + 1, 1)
        of = np.flatnonzero(np.cumsum(inside[:count]) > 0)
        at = (least[of] & _POSITION).astype(np.int64)
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        last = of[np.append(begin[1:], len(at))[:len(begin)] - 1]
        at = at[begin]
        return at, h[at], of[begin], last

    def batch(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text number, position, hash) of the chosen positions; a position may come twice from overlapping stretches."""
        for found in self.owned(texts):
            yield found[:3]

    def owned(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text number, position, hash, first and last start of the strings that chose it); a position may come twice, with other starts."""
        group: list[tuple[int, int, bytes]] = []
        held = 0
        for i, t in enumerate(texts):
            if len(t) < self.length:
                continue
            step = self.stretch - self.length + 1
            for lo in range(0, max(1, len(t) - self.length + 1), step):
                piece = t[lo:lo + self.stretch]
                if held + len(piece) > self.stretch and group:
                    yield self._group(group)
                    group, held = [], 0
                group.append((i, lo, piece))
                held += len(piece)
        if group:
            yield self._group(group)

    def _group(self, group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        ends = np.cumsum([len(g[2]) for g in group])
        starts = np.concatenate([[0], ends[:-1]])
        at, h, first, last = self.choose(data, starts, ends)
        k = np.searchsorted(ends, at, "right")
        shift = np.array([g[1] for g in group])[k] - starts[k]
        return np.array([g[0] for g in group])[k], at + shift, h, first + shift, last + shift


def windows(p: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts a to b (included) at or before p, cut into windows of ``step`` starts counted back from p: (last start of the whole
    window, first and last one wanted). All strings of a window hold the block from its last start to the end of its first string."""
    near, far = (p - b) // step, (p - a) // step
    count = far - near + 1
    of = np.repeat(np.arange(len(p)), count)
    v = p[of] - step * (near[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    return v, np.maximum(a[of], v - step + 1), np.minimum(b[of], v)


def as_ranges(at: np.ndarray) -> list[dict[str, int]]:
    """Numbers, in any order and repeated, as ranges (a, b), b included."""
    at = np.unique(at)
    cut = np.flatnonzero(np.diff(at) > 1)
    return [{"a": int(x), "b": int(y)} for x, y in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)])] if len(at) else []


def numbers(ranges: list[dict[str, int]]) -> np.ndarray:
    """The numbers in ranges (a, b), b included."""
    return np.concatenate([np.zeros(0, np.int64), *[np.arange(r["a"], r["b"] + 1) for r in ranges]])


class StringHashes:
    """Two hashes of 64 bits of the strings of ``length`` bytes that start at given places of a text."""

    def __init__(self, length: int):
        self.length = length
        self.values = np.random.default_rng(2).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
        self.powers = [(np.ones(1, np.uint64),) * 2] * 2

    def of(self, piece: bytes) -> np.ndarray:
        """2 x starts; ``piece`` is at least ``length`` bytes long."""
        data = np.frombuffer(piece, np.uint8)
        n = len(data)
        if len(self.powers[0][0]) < n:
            self.powers = [_powers(n, base) for base in (_BASE, _OTHER_BASE)]
        out = []
        with np.errstate(over="ignore"):
            for values, (up, down) in zip(self.values, self.powers):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[:n], dtype=np.uint64)])
                h = (sums[self.length:] - sums[:n - self.length + 1]) * down[:n - self.length + 1]
                out.append((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))
        return np.stack(out)


def starts_shared(texts: DataFrame, length: int) -> DataFrame:
    """(content, ranges): starts whose strings of ``length`` bytes start in more than one place, as ranges (a, b), b included.

    A content may come in several rows.

    ``texts``: (content, data, ranges), ranges of starts as (a, b), b included; contents are unique.
    """
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = StringHashes(length)
        held: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        count = 0

        def combined() -> pa.RecordBatch:
            """Each different string once, with the least and largest of its places, and a row for each text with what is known to repeat."""
            h = np.concatenate([x for _, _, x in held], axis=1)
            sizes = np.array([x.shape[1] for _, _, x in held])
            of = np.repeat(np.arange(len(held)), sizes)
            start = np.concatenate([at for _, at, _ in held])
            names = np.array([int.from_bytes(c[:8], "little") for c, _, _ in held], np.uint64)
            with np.errstate(over="ignore"):
                place = (names[of] ^ (start.astype(np.uint64) * _BASE)).view(np.int64)
            order = np.lexsort((h[1], h[0]))
            first = np.concatenate([[True], (np.diff(h[0][order]) != 0) | (np.diff(h[1][order]) != 0)])
            begin = np.flatnonzero(first)
            low, high = np.minimum.reduceat(place[order], begin), np.maximum.reduceat(place[order], begin)
            twice = low != high
            many = np.zeros(len(order), bool)
            many[order] = np.repeat(twice, np.diff(np.append(begin, len(order))))
            one = order[begin]
            rows = [(int(h[0][i].view(np.int64)), int(h[1][i].view(np.int64)), int(lo), int(hi), None if t else held[of[i]][0], int(start[i]), None)
                    for i, lo, hi, t in zip(one, low, high, twice)]
            known: dict[bytes, list[tuple[int, int]]] = {}
            ends = np.cumsum(sizes)
            for (content, at, _), lo, hi in zip(held, ends - sizes, ends):
                if many[lo:hi].any():
                    known.setdefault(content, []).extend(as_ranges(at[many[lo:hi]]))
            rows += [(None, None, None, None, content, None, some) for content, some in known.items()]
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["s", "t", "low", "high", "content", "at", "known"])

        for batch in batches:
            for content, data, ranges in zip(batch.column("content").to_pylist(), byte_texts(batch, "data"), batch.column("ranges").to_pylist()):
                at = np.unique(numbers(ranges))
                for near in np.split(at, np.flatnonzero(np.diff(at) > length) + 1) if len(at) else ():
                    # Starts close to each other are hashed in one go.
                    for lo in range(int(near[0]), int(near[-1]) + 1, STRETCH):
                        some = near[np.searchsorted(near, lo):np.searchsorted(near, lo + STRETCH)]
                        if not len(some):
                            continue
                        held.append((content, some, hashes.of(data[lo:int(some[-1]) + length])[:, some - lo]))
                        count += len(some)
                        if count > COMBINED:
                            yield combined()
                            held, count = [], 0
        if held:
            yield combined()

    # Heavy texts are few: by ranges of their digests each task gets the same number, which hash partitions do not give.
    rows = stored(texts.repartitionByRange("content").mapInArrow(per_task, "s long, t long, low long, high long, content binary, at long, known array<struct<a:long,b:long>>"))
    strings = rows.where("s is not null")
    twice = strings.groupBy("s", "t").agg(F.min("low").alias("l"), F.max("high").alias("r")).where("l <> r").select("s", "t")
    met = (strings.where("content is not null").join(twice, ["s", "t"]).groupBy("content", F.floor(F.col("at") / UNITED))
           .agg(F.collect_set(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("ranges")))
    return met.select("content", "ranges").unionAll(rows.where("s is null").select("content", "known"))


def united_spans(ranges: DataFrame, length: int) -> DataFrame:
    """(content, a, b): the bytes that strings starting in the ranges cover, in a few pieces per text; b excluded."""
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(name, x, y) for name, some in zip(b.column("content").to_pylist(), b.column("ranges").to_pylist())
                   for x, y in united([(r["a"], r["b"] + length) for r in some])]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                             names=["content", "a", "b"])

    return ranges.mapInArrow(per_task, "content binary, a long, b long")


def group_stretches(places: list[tuple[bytes, int, bytes, int]], length: int = LENGTH, run: int = RUN) -> list[tuple[bytes, int, int]]:
    """Repeated stretches (content, start, end) at places that share a run: (content, position, surroundings, bytes before)."""
    entries: dict[tuple[bytes, int], dict[tuple[bytes, int], None]] = {}
    for content, at, around, before in places:
        entries.setdefault((around, before), {})[(content, at)] = None
    if len(entries) == 1 and len(next(iter(entries.values()))) == 1:
        return []
    keys = list(entries)
    left = [around[:before][::-1] for around, before in keys]
    right = [around[before:] for around, before in keys]
    back = ahead = [-1] * len(keys)
    if len(keys) > 1:
        lo, lo_lcp = deep_shallow(left)
        ro, ro_lcp = deep_shallow(right, run)
        back = extents(lo, lo_lcp, ro, ro_lcp, length)
        ahead = extents(ro, ro_lcp, lo, lo_lcp, length)
    out = []
    for key, l, r, b, a in zip(keys, left, right, back, ahead):
        if len(entries[key]) > 1 and len(l) + len(r) >= length:
            b, a = len(l), len(r)
        if b >= 0:
            out += [(content, at - b, at + a) for content, at in entries[key]]
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, length: int = LENGTH, run: int = RUN, big: int = BIG) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row. ``big``: places of one run from which on it is looked up by counts."""
    bytes_of = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", bytes_of.alias("data"))
    content = F.unhex(F.substring(F.sha2("data", 256), 1, 32))
    plain = rows.select("doc_id", content.alias("content"), F.length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("whole"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = Chooser(length, run)
        for b in batches:
            for i, at, h in chooser.batch(byte_texts(b, "data")):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("content").take(pa.array(i)), pa.array(at.astype(np.int64))],
                                                 names=["h", "content", "at"])

    places = stored(rows.select("data", content.alias("content")).mapInArrow(chosen, "h long, content binary, at long"))
    where = F.xxhash64("content", "at")
    # Stored, so that the join below stands on plain exchanges and Spark can split a run that very many texts share.
    shared = stored(places.groupBy("h").agg(F.min(where).alias("a"), F.max(where).alias("b"), F.count("*").alias("n")).where("a <> b")
                    .select("h", (F.col("n") > big).alias("big")))
    wanted = (places.join(shared, "h").groupBy("content").agg(F.collect_set(F.struct("h", "at", "big")).alias("places")))
    first = rows.groupBy(content.alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    contents = first.join(wanted, "content", "left")
    texts = (rows.withColumnRenamed("doc_id", "id").join(contents.where("places is not null").select("content", "doc_id", "places"),
                                                         F.col("id").eqNullSafe(F.col("doc_id")))
             .where(content == F.col("content")).select("content", "places", "data"))
    texts = stored(texts)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places with their surroundings, dealt by run. Equal surroundings within a task go on once: they repeat
        each other whole, so their stretches are known (column ``stop``) and dealt by content."""
        reach = length - run
        seen: dict[tuple[int, int, bytes], list] = {}
        for b in batches:
            rows: list[tuple] = []
            for key, some, data in zip(b.column("content").to_pylist(), b.column("places").to_pylist(), byte_texts(b, "data")):
                known: list[tuple[bytes, int, int]] = []
                for p in some:
                    if p["big"]:
                        continue
                    at, lo = p["at"], max(0, p["at"] - reach)
                    text = data[lo:at + length]
                    first = seen.setdefault((p["h"], at - lo, text), [])
                    if not first:
                        first += [key, lo, False]
                        rows.append((p["h"], key, at, text, at - lo, None))
                    else:
                        if not first[2]:
                            known.append((first[0], first[1], first[1] + len(text)))
                            first[2] = True
                        known.append((key, lo, lo + len(text)))
                for name in {k[0] for k in known}:
                    for x, y in united([k[1:] for k in known if k[0] == name]):
                        rows.append((zlib.crc32(name) << 20 ^ x, name, x, None, 0, y))
                if len(seen) > SEEN:
                    seen.clear()
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h", "content", "at", "around", "before", "stop"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = None, []
        out: list[tuple[bytes, int, int]] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 3
            made = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                              names=["content", "a", "b"])
            out.clear()
            return made

        for b in batches:
            for h, *place, stop in zip(*(b.column(c).to_pylist() for c in ("h", "content", "at", "around", "before", "stop"))):
                if stop is not None:
                    out.append((place[0], place[1], stop))
                    continue
                if h != held:
                    out += group_stretches(group, length, run) if len(group) > 1 else []
                    held, group = h, []
                group.append(tuple(place))
            if len(out) > 20_000:
                yield emit()
        out += group_stretches(group, length, run) if len(group) > 1 else []
        yield emit()

    # Of big runs: blocks of windows of starts, blocks of finer windows where those occur twice, then the strings where these do.
    steps = [min(STEP, length - run), min(FINE, length - run), 1]
    ranges = "content binary, data binary, ranges array<struct<a:long,b:long>>"

    def candidates(level: int, by_seen: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chooser = Chooser(length, run)
            for b in batches:
                data = byte_texts(b, "data")
                some: list[list[tuple[np.ndarray, ...]]] = [[] for _ in data]
                for i, at, _, first, last in chooser.owned(data):
                    cut = np.flatnonzero(np.diff(i, prepend=-1))
                    for lo, hi in zip(cut, np.append(cut[1:], len(i))):
                        some[i[lo]].append((at[lo:hi], first[lo:hi], last[lo:hi]))
                out = []
                for parts, places, seen in zip(some, b.column("places").to_pylist(), b.column("seen").to_pylist() if by_seen else data):
                    starts = tuple(np.concatenate(x) for x in zip(*parts))
                    keep = np.isin(starts[0], [p["at"] for p in places if p["big"]])
                    for k, step in enumerate(steps[:level + 1]):
                        starts = windows(*(x[keep] for x in starts), step)
                        keep = np.isin(starts[0], numbers(seen)) if k == level - 1 else np.ones(len(starts[0]), bool)
                    out.append(as_ranges(starts[0]))
                yield pa.RecordBatch.from_arrays([b.column("content"), b.column("data"), pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                                                 names=["content", "data", "ranges"])
        return per_task

    hot = texts.where("exists(places, p -> p.big)")
    covered = None
    for level, step in enumerate(steps):
        if covered is None:
            wide = hot
        else:
            seen = covered.groupBy("content").agg(F.flatten(F.collect_list("ranges")).alias("seen"))
            wide = hot.join(seen, "content")
        covered = starts_shared(wide.mapInArrow(candidates(level, covered is not None), ranges), length - step + 1)
    covered = united_spans(covered, length)

    dealt = texts.mapInArrow(around, "h long, content binary, at long, around binary, before int, stop long").repartition("h").sortWithinPartitions("h")
    found = (dealt.mapInArrow(stretches, "content binary, a long, b long").unionAll(covered).groupBy("content")
             .agg(F.collect_set(F.struct("a", "b")).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, spans, kept = [], [], []
            for data, some in zip(byte_texts(b, "data"), b.column("spans").to_pylist()):
                merged = united([(s["a"], s["b"]) for s in some])
                left, at = hashlib.sha256(), 0
                for x, y in merged:
                    left.update(data[at:x])
                    at = y
                left.update(data[at:])
                removed.append(sum(y - x for x, y in merged))
                spans.append(len(merged))
                kept.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
                                             names=["content", "removed", "spans", "kept"])

    results = (texts.select("content", "data").join(found, "content").mapInArrow(cut, "content binary, removed long, spans long, kept string")
               .dropDuplicates(["content"]))
    known = first.select("content", "copies").join(results, "content", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return plain.join(known, "content").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"))
