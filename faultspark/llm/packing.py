"""Sum-of-squares online packing of token sequences.

Each task packs its own rows in the order it reads them. A document's full windows are cut off first. The rest, of
size s, goes into the fill level h for which the sum over all levels of the squared number of windows at that level
becomes smallest: moving a window from h to h + s changes it by 2 (N[h + s] - N[h] + 1), opening one by 2 N[s] + 1, filling
one up by 1 - 2 N[h]. The counts N are an array over levels; ties go to the fullest window. What is still partially filled when
the rows end is drained: windows are joined level by level and cut at the window size, and the last remainder is cut into
powers of two, which need no padding. So a sequence id is the task's number and a counter, and no row is shuffled.

Nulls and empty texts are documents of one token, the end token. Rows are packed one by one, so repeated rows and equal
doc_ids are packed as often as they occur. An empty table gives an empty result. The result depends on how the input is
divided into tasks, not on retries: a lost task reads the same rows again and packs them the same way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Distinct words whose ids a Python worker remembers; beyond it starts afresh.
CACHE_WORDS = 600_000
_TASK_SHIFT = 40
#: Controls that word splitting and the tokenizer may take differently: such texts are encoded whole.
_CONTROLS = re.compile("[\x00-\x08\x0e-\x1f]")
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "-.,;:!?*$%&#"
#: Letters that keep their form when composed and lowered, or marks: the tokenizer makes one piece of either.
_PLAIN = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+")


class WordIds:
    """Ids of texts by way of a dictionary of words.

    The tokenizer drops white space and never joins characters across it, nor letters with marks. So a space between a letter
    and a mark changes nothing, and the ids of a text are those of its words. A plain word ends in the one id that closes
    it: unknown words are encoded many at a time and told apart by those ids.
    """

    _shared: dict[str, "WordIds"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    @classmethod
    def shared(cls, path: str) -> "WordIds":
        """One per Python worker, kept from task to task."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        rest = [w for w in words if not _PLAIN.fullmatch(w)]
        found, sizes = [self.ids], []
        for at in range(0, len(plain), 5_000):
            some = plain[at:at + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                found.append(ids)
                sizes.append(np.diff(np.r_[0, ends]))
            else:  # a vocabulary without closing ids
                each = [self.encode(w) for w in some]
                found += each
                sizes.append(np.array([len(e) for e in each], np.int64))
        each = [self.encode(w) for w in rest]
        sizes.append(np.array([len(e) for e in each], np.int64))
        self.index.update(zip(plain + rest, range(len(self.index), len(self.index) + len(words))))
        self.ids = np.concatenate(found + each)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])

    def batch(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; nulls have none."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        spaced = pc.replace_substring_regex(column, f"([{_LETTERS}])([{_MARKS}])", r"\1 \2")
        lists = pc.utf8_split_whitespace(spaced)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        unknown = [w for w in words if w not in self.index]
        self.learn(unknown)
        code = np.fromiter((self.index[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()]
        sizes = self.starts[code + 1] - self.starts[code]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        flat = self.ids[np.repeat(self.starts[code] - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy()].tolist()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(pc.match_substring_regex(column, _CONTROLS.pattern).to_numpy(zero_copy_only=False)):
            out[i] = self.encode(column[int(i)].as_py())
        return out


@dataclass
class Window:
    fill: int = 0
    pieces: list[tuple] = field(default_factory=list)


class SumOfSquares:
    """Windows open at each fill level, and the rule that picks a level."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[Window]] = {}

    def choose(self, s: int) -> int:
        """The level to place a piece of size ``s`` < window size into; 0 opens a window."""
        n = self.counts
        last = self.size - s
        change = np.where(n[:last + 1] > 0, 2 * (n[s:] - n[:last + 1] + 1), np.iinfo(np.int64).max)
        change[0] = 2 * n[s] + 1
        if n[last] > 0:
            change[last] = 1 - 2 * n[last]
        return last - int(np.argmin(change[::-1]))

    def place(self, s: int, piece: tuple) -> Window | None:
        """Place a piece; returns the window if it is full now."""
        level = self.choose(s)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window = Window()
        window.pieces.append(piece)
        window.fill += s
        if window.fill == self.size:
            return window
        self.open.setdefault(window.fill, []).append(window)
        self.counts[window.fill] += 1
        return None

    def drain(self) -> list[Window]:
        """The partially filled windows, fullest first."""
        return [w for level in sorted(self.open, reverse=True) for w in self.open[level]]


def pack(rows: Iterator[tuple[object, bytes]], first_sequence: int, size: int = WINDOW) -> Iterator[tuple]:
    """(doc_id, ids) in, pieces out: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    state, sequence = SumOfSquares(size), first_sequence

    def emit(pieces: list[tuple]) -> Iterator[tuple]:
        nonlocal sequence
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, sequence, offset
            offset += n
        sequence += 1

    for doc, ids in rows:
        total = len(ids) // 4
        whole = total // size * size
        for start in range(0, whole, size):
            yield from emit([(doc, start, ids[4 * start:4 * (start + size)], total)])
        if total > whole:
            full = state.place(total - whole, (doc, whole, ids[4 * whole:], total))
            if full:
                yield from emit(full.pieces)
    queue, held = [], 0
    rest = [p for w in state.drain() for p in w.pieces]
    left = sum(len(p[2]) // 4 for p in rest)
    want = size if left >= size else 1 << max(0, left.bit_length() - 1)
    for doc, start, ids, total in rest:
        while ids:
            take = min(len(ids) // 4, want - held)
            queue.append((doc, start, ids[:4 * take], total))
            start, ids, held, left = start + take, ids[4 * take:], held + take, left - take
            if held == want:
                yield from emit(queue)
                queue, held = [], 0
                want = size if left >= size else 1 << max(0, left.bit_length() - 1)


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, size: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer_path`` is a file of the tokenizers library, which every executor can open; by default the
    installed vocabulary. ``size`` is a power of two.
    """
    kind = dict(docs.dtypes)["doc_id"]
    columns = ["doc_id"] + [c.split()[0] for c in SCHEMA.split(", ")]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        words, end = WordIds.shared(path), np.array([END_ID], "<u4").tobytes()
        ids = None

        def rows() -> Iterator[tuple[object, bytes]]:
            nonlocal ids
            for b in batches:
                ids = b.column("doc_id").type
                for doc, found in zip(b.column("doc_id").to_pylist(), words.batch(b.column("text"))):
                    yield doc, found.astype("<u4").tobytes() + end

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], ids)] + [pa.array(c, pa.int64()) for c in cols[1:]], names=columns)

        out: list[tuple] = []
        for piece in pack(rows(), TaskContext.get().partitionId() << _TASK_SHIFT, size):
            out.append(piece)
            if len(out) == 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return docs.select("doc_id", F.col("text")).mapInArrow(per_task, f"doc_id {kind}, {SCHEMA}")
