"""SimHash near-duplicates with a byte-position inverted index and count filtering.

A fingerprint of eight bytes is a set of eight (position, byte) tokens. Fingerprints within three bits differ in at most
three bytes, so they share at least five tokens. Split the positions into two halves of four: five shared tokens put
three into one half, so each such pair meets in one of the eight postings keyed by three positional bytes of a half. To keep
postings short, the other forty bits are cut into four chunks; three differing bits leave one of them unharmed, so each
posting is divided by chunk without losing a pair. Inside a posting the shared positional bytes of a pair are tallied, pairs
with fewer than five are dropped, the rest are verified by the bits that differ.

Nulls and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node of the link graph, so
copies are never expanded into pairs. Rows without doc_id take part; a component's id is the smallest doc_id that is not
null. Repeated rows get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.llm.common import byte_texts, stored
from faultspark.llm.components import components

SEED = 42
SHINGLE = 3
#: Fingerprints link at so many differing bits or fewer; so many bytes are then equal at least.
RADIUS, SHARED = 3, 5
#: Fingerprints of a posting that are compared in one go: bounds the memory of a task to its square.
BLOCK = 2048
_TRIPLES = [[h + i for i in range(4) if i != skip] for h in (0, 4) for skip in range(4)]


def fingerprint(text: bytes) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included."""
    words = text.lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    flat = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    lo, hi = starts[:n].tolist(), (ends[SHINGLE - 1:] - 1).tolist()
    for at in range(0, n, 50_000):
        h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(lo[at:at + 50_000], hi[at:at + 50_000])), np.uint64, min(50_000, n - at))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in byte_texts(b, "bytes")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("bytes"))
    return rows.mapInArrow(per_batch, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def postings(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all postings of each fingerprint, and the fingerprints repeated beside them."""
    b = fp.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.uint64)
    keys = []
    for t, triple in enumerate(_TRIPLES):
        head = (b[:, triple[0]] << np.uint64(16)) | (b[:, triple[1]] << np.uint64(8)) | b[:, triple[2]]
        rest = np.zeros(len(fp), np.uint64)
        for i in (i for i in range(8) if i not in triple):
            rest = (rest << np.uint64(8)) | b[:, i]
        for c in range(4):
            chunk = (rest >> np.uint64(10 * c)) & np.uint64(1023)
            keys.append((np.uint64(t * 4 + c) << np.uint64(34)) | (head << np.uint64(10)) | chunk)
    return np.concatenate(keys).view(np.int64), np.tile(fp, len(keys)).view(np.int64)


def _near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius, after the tally of shared positional bytes."""
    diff = x[:, None] ^ y[None, :]
    i, j = np.nonzero(np.bitwise_count(diff) <= 8 * (8 - SHARED))  # more bits than three bytes hold: cannot share five
    d = diff[i, j]
    tally = (d.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    d, i, j = d[tally >= SHARED], i[tally >= SHARED], j[tally >= SHARED]
    ok = np.bitwise_count(d) <= RADIUS
    return i[ok], j[ok]


def posting_links(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what one posting links: at most one fewer than its fingerprints, whatever the number of pairs."""
    fp = np.unique(fp)
    parent = np.arange(len(fp))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for a in range(0, len(fp), BLOCK):
        for b in range(a, len(fp), BLOCK):
            for i, j in zip(*_near(fp[a:a + BLOCK], fp[b:b + BLOCK])):
                p, q = find(a + i), find(b + j)
                if p != q:
                    parent[q] = p
                    out.append((int(fp[a + i]), int(fp[b + j])))
    return out


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, thinned to a forest inside each posting. ``distinct`` has column fp."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp = postings(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], names=["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key = None

        def emit(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            e = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            cut = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(key)]
            rows: list[tuple[int, int]] = []
            for s, e in zip(starts[(ends - starts > 1) | (ends == len(key)) | (starts == 0)], ends[(ends - starts > 1) | (ends == len(key)) | (starts == 0)]):
                if held and held_key != key[s]:
                    rows += posting_links(np.concatenate(held))
                    held = []
                if e == len(key) or (held and held_key == key[s]):  # may go on in the next batch
                    held_key = key[s]
                    held.append(fp[s:e].copy())
                else:
                    rows += posting_links(fp[s:e])
            yield emit(rows)
        if held:
            yield emit(posting_links(np.concatenate(held)))

    rows = distinct.select("fp").mapInArrow(index, "key long, fp long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``; root is the component's smallest fingerprint."""
    marked = stored(fingerprints(docs))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct))
    known = (distinct.join(roots, distinct.fp == roots.node, "left")
             .select("fp", F.coalesce("root", "fp").alias("root"), "first_id"))
    ids = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(known.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as hexadecimal digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component one row, that with the smallest doc_id (those without come last).

    Rows are named by doc_id and a digest of the text, so of rows with one doc_id and different texts each is decided for
    itself, and of rows that are equal in both one stays.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", digest.alias("digest"))

    def name(r: Column) -> Column:
        """A plain string, so that the join and the removal of repeated rows share one exchange of texts."""
        return F.concat_ws(":", r["nameless"].cast("string"), r["digest"], r["doc_id"].cast("string"))

    first = near_duplicates(docs.select(row.alias("doc_id"), "text")).where("doc_id = component_id").select(name(F.col("doc_id")).alias("__row")).distinct()
    return docs.withColumn("__row", name(row)).join(first, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)
