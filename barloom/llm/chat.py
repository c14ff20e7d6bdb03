"""Chat formatting by assembling tokens.

A turn is rendered as ``### role: text</turn>`` and a line end. The three control
strings are reserved ids beyond the tokenizer's vocabulary. Role and text are
encoded apart and the reserved ids are spliced in between, so no content can turn
into a control token; control strings inside content are escaped by a backslash
besides, so the rendered text can be read back as well. Places of turns and the
loss mask (assistant texts) are prefix sums of segment lengths. A conversation is
kept as one row per turn with its place, so no row grows with the conversation.
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

from barloom.llm.shared import settings, worker_memo

OPEN, SAID, CLOSE = "### ", ": ", "</turn>\n"
#: Ids of the control strings; the tokenizer's own end below 50,257.
OPEN_ID, SAID_ID, CLOSE_ID = 50_257, 50_258, 50_259
#: Characters of a segment encoded at once.
CHUNK = 100_000
SPECIAL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
SPECIAL_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")


def escape(text: str, special: re.Pattern = SPECIAL) -> str:
    return special.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Coder:
    def __init__(self, path: str, pattern: str):
        memo = worker_memo(f"chat {path}")
        if not memo:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            memo["coder"] = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.coder = memo["coder"]

    def encode(self, text: str) -> list[int]:
        return [i for at in range(0, len(text), CHUNK) for i in self.coder.encode_ordinary(text[at:at + CHUNK])]

    def decode(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode("utf-8")


def _assemble(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, pattern)
        for batch in batches:
            ids, head, body = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                front = [OPEN_ID, *coder.encode(escape(role, SPECIAL_ROLE)), SAID_ID]
                said = coder.encode(escape(text))
                ids.append(np.array([*front, *said, CLOSE_ID], np.int32))
                head.append(len(front))
                body.append(len(said))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([hashlib.sha256(t.encode()).digest() for t in batch.column("text").to_pylist()]),
                 pa.array(ids, pa.list_(pa.int32())), pa.array(head, pa.int64()), pa.array(body, pa.int64())],
                [*kept, "tie", "ids", "head", "body"])
    return run


def format_chats(turns: DataFrame, ranks_path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One row per turn: ``conv_id, position, ids, start, loss_start, loss_end``, counted in tokens of the conversation.

    ``position`` numbers the turns from 0 by turn, null turns first, then role and
    text digest, so ties and repeated rows have a fixed order and all stay. The
    loss mask covers the text of ``learn_role`` turns; elsewhere the span is empty.
    Null role and text count as empty; rows without conversation id form one
    conversation. An empty table gives an empty result. Other columns are ignored.
    """
    source = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                          F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                          F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kinds = dict(source.dtypes)
    schema = (f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, tie binary, ids array<int>, head long, body long")
    coded = source.mapInArrow(_assemble(ranks_path, pattern), schema)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "tie")
    length = F.col("head") + F.col("body") + 1
    start = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = coded.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("position"), "ids", start.alias("start"),
                          "role", "head", "body")
    loss = F.col("start") + F.col("head")
    return placed.select("conv_id", "position", "ids", "start", loss.alias("loss_start"),
                         (loss + F.when(F.col("role") == learn_role, F.col("body")).otherwise(0)).alias("loss_end"))


def _read_back(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, state = Coder(path, pattern), None, None

        def done():
            n, turns, chars, loss, formatted = state
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], kind), pa.array([n]), pa.array([turns.hexdigest()]), pa.array([chars]),
                 pa.array([loss.hexdigest()]), pa.array([formatted])],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:  # sorted by conversation and place; a conversation may span batches
            kind = batch.schema.field("conv_id").type
            column = batch.column("ids")
            flat, cut = column.values.to_numpy(), column.offsets.to_numpy()
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "start", "loss_start", "loss_end")))
            for i, (conv, start, lo, hi) in enumerate(rows):
                if now != (conv,):
                    if now is not None:
                        yield done()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = flat[cut[i]:cut[i + 1]]
                opened, said, closed = (np.flatnonzero(ids == x) for x in (OPEN_ID, SAID_ID, CLOSE_ID))
                for a, b, c in zip(opened, said, closed, strict=True):
                    role, text = coder.decode(ids[a + 1:b]), coder.decode(ids[b + 1:c])
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    state[4] += len(OPEN) + len(role) + len(SAID) + len(text) + len(CLOSE)
                learnt = unescape(coder.decode(ids[lo - start:hi - start]))
                state[2] += len(learnt)
                state[3].update(learnt.encode())
        if now is not None:
            yield done()
    return run


def read_back(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests per conversation, from the tokens and the mask alone: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``. A digest runs over its conversation in order, so one task reads it as a stream of
    turns and holds one at a time."""
    kind = dict(formatted.dtypes)["conv_id"]
    schema = (f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "start")
            .mapInArrow(_read_back(ranks_path, pattern), schema))


def render(ids: list[int], coder: Coder) -> str:
    """The text of a formatted turn."""
    control, out, run = {OPEN_ID: OPEN, SAID_ID: SAID, CLOSE_ID: CLOSE}, [], []
    for i in [*ids, None]:
        if i is None or i in control:
            out += [coder.decode(np.array(run, np.int64)), control.get(i, "")]
            run = []
        else:
            run.append(i)
    return "".join(out)


def small_batches(spark):
    """Texts may be long; few rows at a time keep a worker's memory bounded by them."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="500")
