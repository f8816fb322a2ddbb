"""Chat formatting: conversations as token ids with reserved marks, loss masks and escaped control strings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablecraft.llm.common import BATCH_ROWS, map_arrow
from tablecraft.llm.tokens import FOLDER, VOCABULARY, tokenizer

#: Ids that the vocabulary leaves free, and what they stand for in the formatted text.
TURN, ROLE_END, TURN_END = 50_257, 50_258, 50_259
SHOWN = {TURN: "### ", ROLE_END: ": ", TURN_END: " </turn>\n"}


def escape(text: str, role: bool = False) -> str:
    """Reversibly break up what could be taken for a control string: after it no ``##`` and no ``</turn`` is left."""
    text = re.sub(r"#(?=#)", r"#\\", text.replace("\\", "\\\\")).replace("</turn", "<\\/turn")
    return text.replace(":", "\\:") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """One row per turn, (conv_id, turn, role, ids, loss): put in turn order they are the conversation's tokens.

    Role and text are escaped and encoded each on its own, then spliced: TURN, role, ROLE_END, text, TURN_END. The loss
    mask comes from prefix sums over +1 where an assistant's text begins and -1 behind it, so it covers these texts
    and no mark. ids and loss are binary (uint16 and one byte for each id). Null roles and texts count as empty.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, ids_out, loss_out = tokenizer(folder, name).encode, [], []
        for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist()):
            head, body = (np.frombuffer(encode(x), np.uint16) for x in (escape(role or "", True), escape(text or "")))
            ids = np.concatenate([[TURN], head, [ROLE_END], body, [TURN_END]]).astype(np.uint16)
            steps = np.zeros(len(ids) + 1, np.int8)
            if role == "assistant":
                steps[len(head) + 2] += 1
                steps[len(ids) - 1] -= 1
            ids_out.append(ids.tobytes())
            loss_out.append(np.cumsum(steps[:-1], dtype=np.int8).tobytes())
        return pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], batch["role"], pa.array(ids_out, pa.binary()), pa.array(loss_out, pa.binary())], ["conv_id", "turn", "role", "ids", "loss"])

    plain = conversations.select(*[F.col(f"`{c}`").cast(t).alias(n) for c, t, n in ((conv_column, "bigint", "conv_id"), (turn_column, "bigint", "turn"), (role_column, "string", "role"), (text_column, "string", "text"))])
    return map_arrow(plain, work, "conv_id bigint, turn bigint, role string, ids binary, loss binary")


class Digest:
    """What is read back from one conversation's tokens, turn after turn; holds sums only, whatever the length."""

    def __init__(self, conv: int | None, folder: str, name: str) -> None:
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss, self.coder = hashlib.sha256(), hashlib.sha256(), tokenizer(folder, name)

    def add(self, ids: bytes, loss: bytes) -> None:
        values, mask = np.frombuffer(ids, np.uint16), np.frombuffer(loss, np.int8) > 0
        for start, middle, end in zip(*(np.flatnonzero(values == mark).tolist() for mark in (TURN, ROLE_END, TURN_END))):
            head, body = self.coder.decode(values[start + 1 : middle]), self.coder.decode(values[middle + 1 : end])
            self.chars += len(head) + len(body) + sum(map(len, SHOWN.values()))
            self.all.update(f"{unescape(head)}\n{unescape(body)}\n".encode())
            self.turns += 1
        if mask.any():
            said = unescape(self.coder.decode(values[mask]))
            self.loss.update(said.encode())
            self.loss_chars += len(said)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_conversations(turns: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """One row per conversation, read back from ``format_turns``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are streamed in order through running digests (a digest over a conversation cannot be split), so a task
    holds one batch of turns and never a conversation. Equal turn numbers go by role, then tokens; null ones come
    first. Rows with a null conv_id are one conversation.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split(" ")[0] for f in schema.split(", ")])

        for batch in batches:
            for conv, ids, loss in zip(batch["conv_id"].to_pylist(), batch["ids"].to_pylist(), batch["loss"].to_pylist()):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = Digest(conv, folder, name)
                now.add(ids, loss)
            if done:
                yield batch_of(done)
                done = []
        if now:
            yield batch_of([now.row()])

    turns.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return ordered.select("conv_id", "ids", "loss").mapInArrow(work, schema)
