"""Chat formatting by token-level assembly.

Every segment of a turn is encoded on its own: opening mark, role, separator,
text, closing mark. Marks are reserved ids beyond the vocabulary, so no text
can produce them; their strings, where they occur inside a text, are escaped
reversibly all the same, so that the formatted string can be parsed too. The
loss mask comes from prefix sums of segment lengths.

A turn is one output row and a conversation is its turns in order, with
``token_start`` as the running sum of tokens: a conversation of any length is
never gathered in one row. Its digest alone is sequential: one task reads the
turns of a conversation as they stream by.

Defined results: null text or role counts as empty; turns with equal numbers
are ordered by role and then by the SHA-256 of their text; repeated rows are repeated turns; a
null conv_id is a conversation of its own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>"
#: Runs of more white space are split off before the tokenizer's pattern, which
#: would need a stack frame for each character; the pattern splits there as well.
MAX_BLANKS = 10_000
TURN_SCHEMA = "conv_id long, turn long, role string, input_ids array<int>, loss_mask array<tinyint>, text_sha256 string"
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
    "loss_sha256 string, formatted_chars long, n_tokens long"
)

#: The Unicode property White_Space.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_ESCAPED = re.compile(r"(\\+)(### |</turn>)")
_ROLE_CONTROL = re.compile(r"(\\*)(### |</turn>|: )")
_ROLE_ESCAPED = re.compile(r"(\\+)(### |</turn>|: )")


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    """Before a control string, n backslashes become 2n + 1."""
    return control.sub(r"\1\1\\\2", text)


def unescape(text: str, escaped: re.Pattern = _ESCAPED) -> str:
    return escaped.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


class Codec:
    """A byte-level tokenizer from a file of ranks, and the reserved ids after it."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.open, self.separator, self.close = first, first + 1, first + 2
        self.blanks = re.compile(f"[{_BLANK}]{{{MAX_BLANKS + 1},}}")

    def encode(self, text: str) -> list[int]:
        """The tokenizer's ids. Of a run of white space the pattern makes one
        piece, but for the last character where something follows."""
        ids: list[int] = []
        at = 0
        for run in self.blanks.finditer(text):
            stop = run.end() - (run.end() < len(text))
            ids += self.encoding.encode_ordinary(text[at : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + self.encoding.encode_ordinary(text[at:])

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn."""
        segments = [
            ([self.open], 0),
            (self.encode(escape(role, _ROLE_CONTROL)), 0),
            ([self.separator], 0),
            (self.encode(escape(text)), int(role == "assistant")),
            ([self.close], 0),
        ]
        ids = np.concatenate([np.asarray(s, np.int32) for s, _ in segments])
        ends = np.cumsum([len(s) for s, _ in segments])
        steps = np.zeros(len(ids) + 1, np.int8)
        for end, (segment, loss) in zip(ends, segments, strict=True):
            steps[end - len(segment)] += loss
            steps[end] -= loss
        return ids, np.cumsum(steps[:-1], dtype=np.int8)

    def parse(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """From the ids of one turn: role, text, text under the mask, characters of the formatted turn."""
        separator = int(np.flatnonzero(ids == self.separator)[0])
        text = self.encoding.decode_bytes(ids[separator + 1 : -1].tolist()).decode()
        role = self.encoding.decode_bytes(ids[1:separator].tolist()).decode()
        loss = self.encoding.decode_bytes(ids[mask == 1].tolist()).decode()
        chars = len(OPEN) + len(role) + len(SEPARATOR) + len(text) + len(CLOSE)
        return unescape(role, _ROLE_ESCAPED), unescape(text), unescape(loss), chars


def format_turns(conversations: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """One row per turn: conv_id, turn, role, input_ids, loss_mask, text_sha256,
    place (from 0) and token_start (tokens of the conversation before this turn)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer_path, pattern)
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            texts = [t or "" for t in batch.column(3).to_pylist()]
            turns = [codec.turn(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(roles, pa.string()),
                    pa.array([ids for ids, _ in turns], pa.list_(pa.int32())),
                    pa.array([mask for _, mask in turns], pa.list_(pa.int8())),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ],
                ["conv_id", "turn", "role", "input_ids", "loss_mask", "text_sha256"],
            )

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text_sha256")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.mapInArrow(encode, TURN_SCHEMA)
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("token_start", F.coalesce(F.sum(F.size("input_ids")).over(before), F.lit(0)))
    )


def conversation_digests(turns: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """Read formatted turns back: one row per conversation, made while its turns stream by."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer_path, pattern)
        current: list | None = None
        for batch in batches:
            done = []
            for conv, ids, mask in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True
            ):
                if current is None or current[0] != conv:
                    if current:
                        done.append(current)
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids, mask = (np.asarray(x.values) for x in (ids, mask))
                role, text, loss, chars = codec.parse(ids, mask)
                current[2].update(f"{role}\n{text}\n".encode())
                current[4].update(loss.encode())
                for k, n in ((1, 1), (3, len(loss)), (5, chars), (6, len(ids))):
                    current[k] += n
            yield _digest_rows(done)
        yield _digest_rows([current] if current else [])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "input_ids", "loss_mask").mapInArrow(digest, DIGEST_SCHEMA)


def _digest_rows(done: list[list]) -> pa.RecordBatch:
    rows = [[c, n, h.hexdigest(), chars, loss.hexdigest(), all_chars, tokens] for c, n, h, chars, loss, all_chars, tokens in done]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
