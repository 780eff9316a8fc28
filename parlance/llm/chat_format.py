"""Chat formatting as assembly of token ids.

Every turn's text is escaped, encoded on its own and spliced between reserved ids
beyond the vocabulary, so no text can forge a turn border. A conversation is a
stream of such ids, stored in chunks of bounded length; the loss mask is the
prefix sum of +1 where an assistant text begins and -1 where it ends.

As a string the same stream reads ``### User: text\\n</turn>\\n``. Inside texts a
run of backslashes before a control string gets one more, and reading back takes
one away, which restores any text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bpe_encoder, slices, vocabulary_path

#: Fixed values of the template: role headers, the header of any other role, the
#: end of a turn. Reserved ids follow the vocabulary in this order.
ROLES = ("system", "user", "assistant")
HEADERS = {r: f"### {r.capitalize()}: " for r in ROLES}
OTHER, OTHER_END, END = "### Role ", ": ", "\n</turn>\n"
_CONTROL = r"(?:### (?:System: |User: |Assistant: |Role )|</turn>|<\|endoftext\|>)"
_PLAIN, _ESCAPED = re.compile(rf"\\*{_CONTROL}"), re.compile(rf"\\(\\*{_CONTROL})")
CHUNK_IDS = 8_192
_CHUNKS = "conv_id long, chunk long, start long, input_ids binary, loss_mask binary"


def escape(text: str) -> str:
    """One more backslash before every control string (and its backslashes)."""
    return _PLAIN.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Template:
    """The reserved ids of one vocabulary and what they read as."""

    def __init__(self, vocabulary: str):
        self.encoder = bpe_encoder(vocabulary, plain_specials=True)
        base = self.encoder.size
        self.role_ids = {r: base + i for i, r in enumerate(ROLES)}
        self.other, self.other_end, self.end = base + 3, base + 4, base + 5
        self.roles = {i: r for r, i in self.role_ids.items()}

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a turn, and the changes of the loss mask at each id."""
        ids = np.frombuffer(self.encoder.encode_bytes(escape(text)), "<u4")
        if role in self.role_ids:
            head = np.array([self.role_ids[role]], "<u4")
        else:
            name = np.frombuffer(self.encoder.encode_bytes(role), "<u4")
            head = np.concatenate([[self.other], name, [self.other_end]]).astype("<u4")
        out = np.concatenate([head, ids, np.array([self.end], "<u4")])
        delta = np.zeros(len(out), np.int8)
        if role == "assistant" and len(ids):
            delta[len(head)] = 1
            delta[-1] = -1
        return out, delta

    def text_of(self, ids: np.ndarray) -> str:
        return self.encoder.tokenizer.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""

    def read_turn(self, ids: np.ndarray) -> tuple[str, str, str]:
        """(role, escaped text, the turn as a string) of a turn's ids."""
        if int(ids[0]) in self.roles:
            role = self.roles[int(ids[0])]
            head, body = HEADERS[role], ids[1:-1]
        else:
            cut = int(np.flatnonzero(ids == self.other_end)[0])
            role, body = self.text_of(ids[1:cut]), ids[cut + 1:-1]
            head = OTHER + role + OTHER_END
        text = self.text_of(body)
        return role, text, head + text + END


def format_conversations(turns: DataFrame, vocabulary: str | None = None, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Chunks of every conversation's id stream: ``conv_id, chunk, start, input_ids
    (little-endian unsigned 32-bit), loss_mask (one byte an id)``.

    Turns are ordered by ``turn`` (null first), then role and text; turns of one
    number and repeated rows all stay. Null text or role is empty, rows of a null
    ``conv_id`` are one conversation; other columns are not read; an empty table
    gives no rows. A conversation passes through one task as a stream, so one of
    any length needs memory for a chunk and a turn only.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def assemble(batches):
        import pyarrow as pa

        template = Template(vocabulary)
        names = ["conv_id", "chunk", "start", "input_ids", "loss_mask"]
        current, chunk, start, level, ids, delta, held = None, 0, 0, 0, [], [], 0

        def emit(final: bool):
            nonlocal chunk, start, level, ids, delta, held
            stream, change = np.concatenate(ids), np.concatenate(delta)
            while len(stream) >= chunk_ids or (final and len(stream)):
                mask = level + np.cumsum(change[:chunk_ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([current[0]], pa.int64()), pa.array([chunk], pa.int64()), pa.array([start], pa.int64()),
                    pa.array([stream[:chunk_ids].astype("<u4").tobytes()], pa.binary()), pa.array([mask.astype(np.uint8).tobytes()], pa.binary())], names=names)
                chunk, start, level = chunk + 1, start + len(mask), int(mask[-1])
                stream, change = stream[chunk_ids:], change[chunk_ids:]
            ids, delta, held = [stream], [change], len(stream)

        for batch in slices(batches):
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if current is None or current[0] != conv:
                    if ids:
                        yield from emit(True)
                    current, chunk, start, level, ids, delta, held = (conv,), 0, 0, 0, [], [], 0
                one, change = template.turn(role or "", text or "")
                ids.append(one)
                delta.append(change)
                held += len(one)
                if held >= chunk_ids:
                    yield from emit(False)
        if ids:
            yield from emit(True)

    return (turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(assemble, _CHUNKS))


def read_conversations(chunks: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What the chunks of each conversation hold: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``. The digests are over role, line
    feed, text, line feed of each turn, and over all text under the loss mask;
    texts are unescaped. Chunks pass as a stream; one turn is held at a time."""
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def read(batches):
        import pyarrow as pa

        template = Template(vocabulary)
        rows: list[tuple] = []
        current, open_ids, open_mask = None, [], []

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

        def close():
            rows.append((current[0], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        state = fresh()
        for batch in slices(batches, 64):
            for conv, data, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if current is None or current[0] != conv:
                    if current is not None:
                        close()
                    current, state, open_ids, open_mask = (conv,), fresh(), [], []
                ids, mask = np.frombuffer(data, "<u4"), np.frombuffer(loss, np.uint8)
                at = 0
                for end in np.flatnonzero(ids == template.end).tolist():
                    turn = np.concatenate([*open_ids, ids[at:end + 1]])
                    under = np.concatenate([*open_mask, mask[at:end + 1]]).astype(bool)
                    at, open_ids, open_mask = end + 1, [], []
                    role, text, written = template.read_turn(turn)
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{unescape(text)}\n".encode())
                    state["chars"] += len(written)
                    if under.any():
                        learnt = unescape(template.text_of(turn[under]))
                        state["loss"].update(learnt.encode())
                        state["loss_chars"] += len(learnt)
                open_ids.append(ids[at:])
                open_mask.append(mask[at:])
        if current is not None:
            close()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return (chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "input_ids", "loss_mask")
            .mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
