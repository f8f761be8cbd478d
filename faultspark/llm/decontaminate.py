"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs without ASCII white space, lower-cased (A-Z) and stripped of ASCII marks at both ends; a word of marks only is left
out. A shingle is five words (a shorter item: all of them), its weight is how often it occurs. A document matches an item
if one of its windows of as many words as the item has a weighted Jaccard similarity (sum of smaller counts over sum of
larger counts) of 0.8 or more to it. A document shorter than the item is itself its one window; with less than 0.8 of the
item's shingles it cannot reach 0.8, and with fewer words than a shingle of the item it has none in common with it.

1. Only windows that share a shingle with an item of their size can be similar at all, so positions are first tested
   against the item shingles (a bit table, then the sorted hashes); all other text is passed over.
2. Each such window gets a 64-bit SimHash from running sums over its shingles.
3. A multi-index finds items within ``RADIUS`` bits: the 64 bits are cut into four blocks, one of which differs in at most
   RADIUS // 4 bits, and every item is entered under all values that close to its blocks, so none within the radius is missed.
4. Candidates are verified by the exact similarity.

The radius is chosen so that pairs at 0.8 lie within it: a fingerprint whose weighted shingle vectors have cosine c differs in
about 64 acos(c) / pi bits, ten on average at a similarity of 0.8, with a deviation of three. ``RADIUS`` is three deviations
beyond, so about one in a thousand pairs just at the limit stays out; equal passages differ in no bit.

Documents are never shuffled: blocks of the benchmark, bounded by ``BLOCK_ITEMS``, go to the tasks one after the other,
so a benchmark of any size is searched whole. Nulls and empty texts on either side match nothing; equal items are all
reported; repeated rows are reported once each; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultspark.llm.common import byte_texts

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprint bits in which a candidate may differ.
RADIUS = 19
#: Items a task holds at once. The multi-index takes 60 KB an item.
BLOCK_ITEMS = 1_000
_BLOCK_BITS, _BLOCKS = 16, 4
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return [w for w in [w.strip(_MARKS) for w in text.lower().split()] if w]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """Hash by word with and without its marks; a word of marks only has hash zero."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        bare = word.strip(_MARKS)
        h = self[word] = (xxhash.xxh64_intdigest(bare, 1) | 1) if bare else 0
        return h


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes; of the whole sequence if it is shorter."""
    n = len(words)
    size = min(size, n)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = words[:n - size + 1].copy()
    for i in range(1, size):
        h = h * _MULT + words[i:n - size + 1 + i]
    return _mix(h)


def simhash(totals: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of plus and minus ones, one row each."""
    return np.packbits(totals > 0, axis=-1).view(">u8").astype(np.uint64).reshape(totals.shape[:-1])


def votes(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def near_values(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` set."""
    every = np.arange(1 << bits, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius]


class ItemIndex:
    """The items of one benchmark block: shingles, fingerprints and the multi-index, by item size in words."""

    def __init__(self, items: list[tuple[int, list[bytes]]], radius: int = RADIUS):
        hashes = WordHashes()
        self.radius = radius
        self.ids = [i for i, _ in items]
        self.words = np.array([len(w) for _, w in items], np.int64)
        each = [shingle_hashes(np.array([hashes[x] for x in w], np.uint64)) for _, w in items]
        self.shingles = [dict(zip(*map(np.ndarray.tolist, np.unique(h, return_counts=True)))) for h in each]
        self.fingerprints = np.array([int(simhash(votes(h).sum(0)[None])[0]) for h in each], np.uint64)
        flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(h) for h in each])
        pairs = np.unique(np.stack([flat, owner.astype(np.uint64)], 1), axis=0) if len(flat) else np.zeros((0, 2), np.uint64)
        self.known, first = np.unique(pairs[:, 0], return_index=True)
        self.owner, self.owner_cut = pairs[:, 1].astype(np.int64), np.r_[first, len(pairs)]
        self.shift = np.uint64(64 - max(16, min(26, int(len(self.known)).bit_length() + 6)))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.known >> self.shift).astype(np.int64)] = True
        self.sizes = np.array(sorted({min(SHINGLE, int(w)) for w in self.words}), np.int64)
        self.masks = near_values(_BLOCK_BITS, radius // _BLOCKS)
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def multi_index(self, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per block: sorted block values near to an item of this size, and the items beside them."""
        if size not in self.tables:
            own = np.flatnonzero(self.words == size)
            made = []
            for b in range(_BLOCKS):
                value = ((self.fingerprints[own] >> np.uint64(_BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.uint32)
                keys = (value[:, None] ^ self.masks[None, :]).ravel().astype(np.uint16)
                items = np.repeat(own.astype(np.int32), len(self.masks))
                order = np.argsort(keys, kind="stable")
                made.append((keys[order], items[order]))
            self.tables[size] = made
        return self.tables[size]

    def within(self, size: int, fingerprints: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) for items of this size within the radius of each fingerprint."""
        out: set[tuple[int, int]] = set()
        for b, (keys, items) in enumerate(self.multi_index(size)):
            value = ((fingerprints >> np.uint64(_BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            lo, hi = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
            row = np.repeat(np.arange(len(value)), hi - lo)
            at = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            item = items[at]
            ok = np.bitwise_count(fingerprints[row] ^ self.fingerprints[item]) <= self.radius
            out.update(zip(row[ok].tolist(), item[ok].tolist()))
        return sorted(out)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions whose shingle belongs to an item."""
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        return at[self.known[k] == h[at]]

    def owners(self, h: int) -> np.ndarray:
        k = int(np.searchsorted(self.known, h))
        return self.owner[self.owner_cut[k]:self.owner_cut[k + 1]]


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard of two shingle bags."""
    small = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return small / max(1, sum(a.values()) + sum(b.values()) - small)


def search(index: ItemIndex, words: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(item_id, first word, windows, similarity) of each item that a window of this document matches.

    ``words`` are the hashes of the document's words. The best window counts; of equal ones the first.
    """
    best: dict[int, tuple[float, int, int]] = {}
    n = len(words)
    for k in index.sizes.tolist():
        if k > n:
            continue
        h = shingle_hashes(words, k)
        at = index.hits(h)
        if not len(at):
            continue
        starts: dict[int, set[int]] = {}
        for p in at.tolist():
            for item in index.owners(int(h[p])).tolist():
                size = int(index.words[item])
                if min(SHINGLE, size) != k:
                    continue
                if size <= n:
                    starts.setdefault(size, set()).update(range(max(0, p - (size - k)), min(p, n - size) + 1))
                elif len(h) >= SIMILARITY * (size - k + 1) - 1e-9:
                    starts[size] = {0}
        for size, some in starts.items():
            begin = np.array(sorted(some), np.int64)
            span = min(size, n) - k + 1  # shingles of a window
            lo, hi = int(begin[0]), int(begin[-1]) + span
            fp = np.empty(len(begin), np.uint64)
            step = 1 << 16
            for a in range(lo, int(begin[-1]) + 1, step):  # running sums, a stretch at a time
                sel = (begin >= a) & (begin < a + step)
                if sel.any():
                    stop = min(hi, a + step + span - 1)
                    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes(h[a:stop]), axis=0, dtype=np.int32)])
                    fp[sel] = simhash(sums[begin[sel] - a + span] - sums[begin[sel] - a])
            found = index.within(size, fp)
            for row, item in found:
                w = h[begin[row]:begin[row] + span]
                s = similarity(dict(zip(*map(np.ndarray.tolist, np.unique(w, return_counts=True)))), index.shingles[item])
                if s >= SIMILARITY:
                    old = best.get(item)
                    p = int(begin[row])
                    if old is None or s > old[0]:
                        best[item] = (s, p, (old[2] if old else 0) + 1)
                    else:
                        best[item] = (old[0], old[1], old[2] + 1)
    return [(index.ids[i], p, c, s) for i, (s, p, c) in sorted(best.items())]


def document_words(texts: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    """Word hashes of each text; words of marks only are left out."""
    out = []
    for t in texts:
        w = t.lower().split()
        h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
        out.append(h[h != 0])
    return out


def item_blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The benchmark in blocks of at most ``block_items`` rows, one at a time on the driver; ids may be null and of any type."""
    rows = (benchmark.where(F.col("text").isNotNull())
            .select("item_id", F.col("text").cast("binary").alias("text")).distinct())
    n = rows.count()
    parts = max(1, -(-n // max(1, block_items // 2)))
    for part in range(parts):
        items = [(r.item_id, words_of(bytes(r.text))) for r in
                 rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toLocalIterator()]
        items = [x for x in items if x[1]]
        if items or part == 0:
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, windows, similarity): each document and item with a matching window.

    Rows without doc_id are searched as well and carry a null, and so do matches of items without item_id.
    """
    out = None
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    spark = docs.sparkSession
    for items in item_blocks(benchmark, block_items):
        items.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]) if not isinstance(x[0], str) else (True, x[0], x[1]))
        names = [i for i, _ in items]
        shared = spark.sparkContext.broadcast([(place, words) for place, (_, words) in enumerate(items)])

        def per_task(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            index, hashes = None, WordHashes()
            for b in batches:
                index = index or ItemIndex(shared.value, radius)
                docs_of, found = b.column("doc_id"), []
                for row, words in enumerate(document_words(byte_texts(b, "bytes"), hashes)):
                    found += [(row, *x) for x in search(index, words)]
                cols = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [docs_of.take(pa.array(cols[0], pa.int64())), pa.array([names[i] for i in cols[1]], item_type), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())],
                    names=["doc_id", "item_id", "start_word", "windows", "similarity"])

        rows = docs.select("doc_id", F.col("text").cast("binary").alias("bytes")).mapInArrow(
            per_task, f"doc_id {kind}, item_id {item_kind}, start_word long, windows long, similarity double")
        out = rows if out is None else out.unionAll(rows)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: documents without a matching window, with their columns.

    Texts are named by their digests, so rows without doc_id are decided like any other, and rows that repeat a doc_id each by its own text.
    """
    name = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    found = contaminated(docs.select(name.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__text")).distinct()
    return docs.withColumn("__text", name).join(found, "__text", "left_anti").select(*docs.columns)
