"""Chat transcripts rebuilt from event logs, rendered with a reversible template and a loss mask.

A log holds events (conv_id, seq, kind, message_id, turn, role, text). They are dealt by conversation, sorted by seq and folded:

* ``message`` opens a message or replaces it whole, ``delta`` appends streamed text to it (and opens it if need be),
* ``edit`` replaces its text and keeps its role, ``delete`` takes it away,
* ``regenerate`` takes away all messages from ``turn`` on, so that new ones may follow.

A message has one turn, which each of its events carries.

A stretch of a log folds to a shorter log of the same effect (:class:`Fold`), so folding is associative. A conversation of more than
``SLICE`` events is cut into slices by seq, each folded in a task of its own, and only what they leave is folded together. All others
take one shuffle. What stands at the end is ordered by turn (nulls first), role, text and message_id.

Template: ``### role: text </turn>`` and a line break for each message. Within roles and texts a backslash, the first ``#`` of three and the
``<`` of ``</turn>`` get a backslash before them (within roles a colon too), so control strings in texts are no marks and every
transcript can be read back. The loss mask is the spans of assistant texts, in code points.

Nulls: a null text or role is empty; events without conv_id form one conversation, whose conv_id is null; events without message_id
are about the one message without it; events of other or null kinds change nothing; null seq comes first. Events of equal seq are taken in the order of kind (in the order of the
list above), message_id, turn, role, text. A repeated event counts twice. A conversation without messages is
rendered as an empty text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.llm.common import stored

KINDS = ["message", "delta", "edit", "delete", "regenerate"]
ASSISTANT = "assistant"
#: Events of one conversation that are folded in one go.
SLICE = 50_000
#: Code points of a streamed piece, and the most pieces that a text is streamed in.
PIECE, PIECES = 512, 64
EVENT = "conv_id {conv_id}, seq decimal(38,0), kind string, message_id {message_id}, turn {turn}, role string, text string"
_MARKED = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_MARKED_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: A message: marks may be preceded by an escaped character, never by an open escape.
_MESSAGE = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


@dataclass
class _Message:
    turn: int | None
    role: str | None
    pieces: list[str]
    fresh: bool  # what earlier slices have of it is replaced
    gone: bool = False
    edited: bool = False  # only its text is replaced: an earlier role stays


@dataclass
class Fold:
    """Effect of a stretch of events."""

    cut: tuple | None = None  # messages of earlier slices from this turn on are gone
    messages: dict = field(default_factory=dict)

    def add(self, kind: str | None, message_id, turn, role: str | None, text: str | None) -> None:
        if kind == "regenerate":
            at = _order(turn)
            self.cut = at if self.cut is None else min(self.cut, at)
            self.messages = {k: m for k, m in self.messages.items() if _order(m.turn) < at}
        elif kind == "message":
            self.messages[message_id] = _Message(turn, role, [text or ""], True)
        elif kind == "delete":
            self.messages[message_id] = _Message(turn, role, [], True, gone=True)
        elif kind == "delta":
            m = self.messages.get(message_id)
            if m is None or m.gone:
                self.messages[message_id] = _Message(turn, role, [text or ""], m is not None)
            else:
                m.pieces.append(text or "")
        elif kind == "edit":
            m = self.messages.get(message_id)
            if m is None:
                self.messages[message_id] = _Message(turn, role, [text or ""], True, edited=True)
            elif m.gone:
                self.messages[message_id] = _Message(turn, role, [text or ""], True)
            else:
                m.pieces, m.edited = [text or ""], m.edited or not m.fresh
                m.fresh = True

    def log(self) -> Iterator[tuple]:
        """A shorter log of the same effect: (kind, message_id, turn, role, text)."""
        if self.cut is not None:
            yield "regenerate", None, self.cut[1] if self.cut[0] else None, None, None
        for message_id, m in self.messages.items():
            kind = "delete" if m.gone else "edit" if m.edited else "message" if m.fresh else "delta"
            yield kind, message_id, m.turn, m.role, "".join(m.pieces)

    def final(self) -> list[tuple[str, str]]:
        """(role, text) of what stands, in order."""
        found = [(_order(m.turn), m.role or "", "".join(m.pieces), _order(k)) for k, m in self.messages.items() if not m.gone]
        return [(role, text) for _, role, text, _ in sorted(found)]


def _order(value) -> tuple:
    return (value is not None, value) if value is not None else (False,)


def escape(text: str, marked: re.Pattern = _MARKED) -> str:
    return marked.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The transcript, and the spans of assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"### {escape(role, _MARKED_ROLE)}: ", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, " </turn>\n"]
        at += len(head) + len(body) + len(" </turn>\n")
    return "".join(out), spans


def parse(transcript: str) -> list[tuple[str, str]]:
    """(role, text) of each message of a transcript."""
    out, at = [], 0
    while at < len(transcript):
        found = _MESSAGE.match(transcript, at)
        if not found:
            raise ValueError(f"no message at {at}")
        role, text = found.groups()
        out.append((unescape(role), unescape(text[:-1])))  # without the blank before the mark
        at = found.end()
    return out


def _folded(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Fold]]:
    """The fold of each group of equal keys, of rows sorted by them."""
    held, fold = None, Fold()
    for b in batches:
        columns = [b.column(c).to_pylist() for c in keys + ["kind", "message_id", "turn", "role", "text"]]
        for row in zip(*columns):
            key = row[:len(keys)]
            if key != held:
                if held is not None:
                    yield held, fold
                held, fold = key, Fold()
            fold.add(*row[len(keys):])
    if held is not None:
        yield held, fold


def reconstruct(events: DataFrame, slice_events: int = SLICE) -> DataFrame:
    """conv_id, formatted, loss (spans of assistant texts as start and end): one row for each conversation."""
    kinds = dict(events.dtypes)
    schema = EVENT.format(**kinds)
    log = events.select("conv_id", F.col("seq").cast("decimal(38,0)").alias("seq"), "kind", "message_id", "turn", "role", "text")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    order = ["seq", rank, "message_id", "turn", "role", "text"]
    arrow = {}

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: list, out: list[tuple]) -> pa.RecordBatch:
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(ids, arrow["conv_id"]), pa.array([t for t, _ in out], pa.string()), spans],
                                              names=["conv_id", "formatted", "loss"])

        ids, out, held = [], [], 0
        for (conv_id,), fold in _folded(_typed(batches, arrow), ["conv_id"]):
            ids.append(conv_id)
            out.append(render(fold.final()))
            held += len(out[-1][0])
            if held > 1 << 22:
                yield made(ids, out)
                ids, out, held = [], [], 0
        if ids:
            yield made(ids, out)

    def compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "seq", "kind", "message_id", "turn", "role", "text"]
        for (conv_id, part), fold in _folded(_typed(batches, arrow), ["conv_id", "slice"]):
            cols = list(zip(*fold.log())) or [()] * 5
            n = len(cols[0])
            kinds = [arrow["conv_id"], pa.decimal128(38, 0), pa.string(), arrow["message_id"], arrow["turn"], pa.string(), pa.string()]
            # Places of a slice follow those of the slices before it.
            seq = [part * (1 << 40) + i for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[conv_id] * n, seq, *cols], kinds)], names=names)

    # Long conversations are known by a combined count of events.
    long = (log.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
            .where(F.col("n") > slice_events).select(F.col("conv_id").alias("key"), "n", "low", "high"))
    long = stored(long)
    if not long.isEmpty():
        parts = F.ceil(F.col("n") / slice_events)
        # Shares of the range, by doubles: rounding moves a border, never the order.
        share = (F.col("seq").cast("double") - F.col("low").cast("double")) / (F.col("high").cast("double") - F.col("low").cast("double") + 1)
        met = log.join(long, log.conv_id.eqNullSafe(long.key), "left")
        sliced = met.where("n is not null").withColumn("slice", F.coalesce(F.floor(share * parts), F.lit(-1)).cast("long"))
        short = met.where("n is null").select(*log.columns)
        dealt = sliced.select("conv_id", "slice", *log.columns[1:]).repartition("conv_id", "slice").sortWithinPartitions("conv_id", "slice", *order)
        log = short.unionAll(dealt.mapInArrow(compacted, schema))
    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return dealt.mapInArrow(formatted, f"conv_id {kinds['conv_id']}, formatted string, loss array<struct<start:long,end:long>>")


def _typed(batches: Iterator[pa.RecordBatch], arrow: dict) -> Iterator[pa.RecordBatch]:
    """The batches as they are; notes the Arrow type of each column."""
    for b in batches:
        arrow |= dict(zip(b.schema.names, b.schema.types))
        yield b


def log_of(conversations: DataFrame) -> DataFrame:
    """A log of finished conversations (conv_id, turn, role, text): texts of the assistant come as streamed pieces."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message_id", F.monotonically_increasing_id())
    n = F.char_length("text")
    piece = F.greatest(F.lit(PIECE), F.ceil(n / PIECES)).cast("int")
    streamed = F.col("role").eqNullSafe(ASSISTANT)
    starts = F.when(streamed & (n > 0), F.sequence(F.lit(1), n, piece)).otherwise(F.array(F.lit(1)))
    opened = F.struct(F.lit(0).alias("place"), F.lit("message").alias("kind"), F.when(streamed, "").otherwise(F.col("text")).alias("text"))
    pieces = F.transform(starts, lambda s, i: F.struct((i + 1).alias("place"), F.lit("delta").alias("kind"), F.substring("text", s, piece).alias("text")))
    events = F.when(streamed, F.concat(F.array(opened), pieces)).otherwise(F.array(opened))
    return rows.select("conv_id", "turn", "role", "message_id", F.explode(events).alias("e")).select(
        "conv_id", (F.coalesce(F.col("turn"), F.lit(-1)).cast("decimal(38,0)") * 2 * PIECES + F.col("e.place")).cast("decimal(38,0)").alias("seq"),
        "e.kind", "message_id", "turn", "role", "e.text")


def digests(transcripts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the rendered text."""
    kind = dict(transcripts.dtypes)["conv_id"]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
                turns = parse(text)
                learnt = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id")] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return transcripts.mapInArrow(per_task, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_trap(conversations: DataFrame) -> DataFrame:
    """The conversations and one whose texts hold the template's own marks, numbered -7."""
    kinds = dict(conversations.dtypes)
    said = "\\### Assistant: </turn> ok"
    trap = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, ASSISTANT, said)], "conv_id long, turn long, role string, text string")
    columns = ["conv_id", "turn", "role", "text"]
    return conversations.select(*columns).unionAll(trap.select(*[F.col(c).cast(kinds[c]) for c in columns]))


#: DuckDB SQL of what :func:`digests` returns, but for the length of the template's own characters, which it adds up.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
said AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
            + (length(text) - length(replace(text, '</turn>', ''))) // 7
            + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda x : greatest(length(x) - 2, 0))), 0) AS escaped
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + length(role) + length('### : ') + length(' </turn>') + 1)::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
