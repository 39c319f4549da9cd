"""Token-level chat assembly (operator 4).

Each text is encoded by itself with a byte-level tokenizer, and the reserved ids
of the template are spliced in between, so no merge ever crosses a turn's border
and no text can produce a reserved id. For readers of the decoded string, control
strings inside texts are escaped: one backslash goes behind their first
character (and one more is added where backslashes already stand there), which
is undone exactly.

Turns are encoded row by row wherever they lie. Conversations are then put in
order by a sort, and token offsets, turn numbers and the loss mask come from
running sums over the sorted turns, so no conversation is ever held as a whole,
however many turns it has.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenreel.llm.common import arrow_types, map_rows
from evenreel.llm.token_counts import PIECES, byte_alphabet

#: Marks around the texts of a role; other roles are spelled out between ROLE marks.
OPEN = {"user": "[INST]", "assistant": "[ANS]", "system": "<<SYS>>"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "<</SYS>>"}
ROLE, ROLE_END, TURN_END, BEGIN = "[ROLE]", "[/ROLE]", "[/TURN]", "<s>"
CONTROLS = (BEGIN, *OPEN.values(), *CLOSE.values(), ROLE, ROLE_END, TURN_END)

_HEADS = "|".join(re.escape(c[0]) + r"(?=\\*" + re.escape(c[1:]) + ")" for c in CONTROLS)
_ESCAPE = re.compile(f"(?:{_HEADS})")
_UNESCAPE = re.compile(_ESCAPE.pattern + r"\\")


def escape(text: str) -> str:
    """Put a backslash behind the first character of every control string, escaped ones included."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text)


class Vocabulary:
    """A byte-level vocabulary with the template's reserved ids behind its own."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, w)): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        first = max([*ranks.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.reserved = {c: first + i for i, c in enumerate(CONTROLS)}
        self.marks = {i: c for c, i in self.reserved.items()}

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def turn_ids(words: Vocabulary, role: str, text: str) -> tuple[list[int], int, int]:
    """Ids of one turn, and the part of them that is trained on."""
    mark = words.reserved
    if role in OPEN:
        head, close = [mark[OPEN[role]]], mark[CLOSE[role]]
    else:
        head, close = [mark[ROLE], *words.encode(escape(role)), mark[ROLE_END]], mark[TURN_END]
    body = words.encode(escape(text))
    trained = len(head) + len(body) if role == "assistant" else len(head)
    return [*head, *body, close], len(head), trained


def assemble(
    conversations: DataFrame, path: str, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per turn: conv_id, place, ids, start, loss_from, loss_to.

    ``place`` numbers the turns of a conversation from 0. ``start`` is the offset
    of the turn's ids in the conversation's ids (the begin mark is at offset 0, in
    the first turn's ids); the loss mask covers the offsets from ``loss_from`` up
    to ``loss_to``: the assistant's texts, without marks. Turns stand by turn
    (null first), equal ones by role, then text, so repeated rows are turns of
    their own. Null texts and null roles are empty; rows without a conv_id make
    up one conversation; an empty table gives an empty one; other columns are
    not read.
    """
    kind = conversations.schema[conv_id].dataType.simpleString()
    order_kind = conversations.schema[turn].dataType.simpleString()

    def start():
        words = vocabulary(path)

        def work(rows):
            out = []
            for row in rows:
                ids, begin, end = turn_ids(words, row["role"] or "", row["text"] or "")
                out.append({
                    "conv_id": row["conv_id"], "_turn": row["turn"], "_role": row["role"] or "", "ids": ids,
                    "_from": begin, "_to": end, "_text": hashlib.sha256((row["text"] or "").encode()).digest(),
                })
            return out

        return work

    rows = conversations.select(*[F.col(c).alias(n) for c, n in ((conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))])
    turns = map_rows(
        rows, start, f"conv_id {kind}, _turn {order_kind}, _role string, ids array<int>, _from int, _to int, _text binary"
    )
    order = W.partitionBy("conv_id").orderBy("_turn", "_role", "_text")
    place = F.row_number().over(order) - 1
    length = F.size("ids").cast("long")
    # the running sum of lengths; the begin mark takes offset 0
    offset = F.sum(length).over(order.rowsBetween(W.unboundedPreceding, 0)) - length + 1
    first = F.lit(_reserved_begin(path))
    return turns.select(
        "conv_id",
        place.cast("long").alias("place"),
        F.when(place == 0, F.concat(F.array(first), F.col("ids"))).otherwise(F.col("ids")).alias("ids"),
        F.when(place == 0, F.lit(0)).otherwise(offset).cast("long").alias("start"),
        (offset + F.col("_from")).alias("loss_from"),
        (offset + F.col("_to")).alias("loss_to"),
    )


def _reserved_begin(path: str) -> int:
    return vocabulary(path).reserved[BEGIN]


class Reader:
    """Reads one conversation back from its ids and mask, turn after turn."""

    def __init__(self, words: Vocabulary) -> None:
        self.words = words
        self.roles = {words.reserved[m]: r for r, m in OPEN.items()}
        self.ends = {words.reserved[m] for m in (*CLOSE.values(), TURN_END)}
        self.turns = hashlib.sha256()
        self.loss = hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = 0

    def add(self, ids: list[int], start: int, loss_from: int, loss_to: int) -> None:
        words, mark = self.words, self.words.reserved
        role, piece = None, 0
        shown = 0
        for i, token in enumerate(ids):
            if token not in words.marks:
                continue
            body = words.decode(ids[piece:i])
            shown += len(body) + len(words.marks[token])
            if token == mark[ROLE_END]:
                role = unescape(body)
            elif token in self.roles:
                role = self.roles[token]
            elif token in self.ends:
                self.turns.update(f"{role}\n{unescape(body)}\n".encode())
                self.n_turns += 1
            piece = i + 1
        self.formatted += shown
        if loss_to > loss_from:
            text = unescape(words.decode(ids[loss_from - start : loss_to - start]))
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def row(self, conv_id) -> dict:
        return {
            "conv_id": conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted,
        }


def digests(segments: DataFrame, path: str) -> DataFrame:
    """Read the assembled turns back; one row per conversation.

    The turns come sorted, so a task holds one turn and a few running sums.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = arrow_types(schema)
    sorted_ = segments.repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, reader, conv = vocabulary(path), None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if reader is None or row["conv_id"] != conv:
                    if reader is not None:
                        out.append(reader.row(conv))
                    reader, conv = Reader(words), row["conv_id"]
                reader.add(row["ids"], row["start"], row["loss_from"], row["loss_to"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=types)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([reader.row(conv)], schema=types)

    return sorted_.mapInArrow(read, schema)
