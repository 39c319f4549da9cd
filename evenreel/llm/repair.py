"""Repair of damaged conversations by scalar integer weights (operator 11).

A conversation's rows become its repaired rows by edits: keep, give another role
(rerole), delete, insert. The cheapest edits are the shortest path through a
graph: a node is a place between two rows and the kind of the row put out last,
an edge is an edit. The weight of a path is one integer: its high digits are the
cost, its low digits the letters of the edits, one digit each from the left, with
zeros behind the end. The least integer so is the cheapest path and, among the
cheapest, the one whose letters are least in ASCII order; nothing else decides.
From the end backwards, an edit in front of a path adds its cost and moves the
letters one digit on.

Rows are cut into stretches of ``STRETCH``. Each stretch gives, for every state
it may begin and end in, its least integer; a conversation's stretches are then
put together from the end. So the search of a conversation of any length is
spread over tasks, and integers stay short. This asks that an insertion costs
more than deleting two rows: then no cheapest path holds an insertion (deleting
its neighbour instead, and a system row left alone, is cheaper), all cheapest
paths have as many letters as rows, and joined stretches compare like their
parts. Other costs are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenreel.llm.common import arrow_types
from evenreel.operators.ordering import value_counts
from evenreel.session import written

#: Rows of a conversation that are searched together.
STRETCH = 256
#: Costs: rerole, delete, insert; a truncated row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
BLANKS = " \t\n\x0b\f\r"
#: Letters of the edits in ASCII order; the digit 0 stands behind the end.
LETTERS = " DIKR"
DIGIT = 3
#: States: nothing yet, after a system, user, assistant row; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: State after a row whose role begins so.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: State after a row put out as the state wants it, and that row's role.
WANTED = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}


class Weights:
    """Integers of paths with up to ``width`` letters."""

    def __init__(self, width: int):
        self.low = DIGIT * width
        self.mask = (1 << self.low) - 1
        self.heads = {c: d << (self.low - DIGIT) for d, c in enumerate(LETTERS)}

    def before(self, letter: str, cost: int, path: int) -> int:
        """The path with an edit in front."""
        return (((path >> self.low) + cost) << self.low) + self.heads[letter] + ((path & self.mask) >> DIGIT)

    def cost(self, path: int) -> int:
        return path >> self.low

    def letters(self, path: int) -> str:
        out = []
        for at in range(self.low - DIGIT, -1, -DIGIT):
            digit = path >> at & 7
            if not digit:
                break
            out.append(LETTERS[digit])
        return "".join(out)


def _with_inserts(path: list[int | None], w: Weights) -> list[int | None]:
    """Insertions before a place: at most two in a row, a third would only go round."""
    for _ in range(2):
        new = list(path)
        for state, (after, _role) in WANTED.items():
            if path[after] is not None:
                x = w.before("I", INSERT, path[after])
                if new[state] is None or x < new[state]:
                    new[state] = x
        path = new
    return path


def cheapest(rows: list[tuple[str, str]], end: dict[int, int], w: Weights) -> list[int | None]:
    """Least integer from each state before ``rows`` (initial, fault) to the states of ``end``."""
    path = _with_inserts([end.get(s) for s in range(4)], w)
    for initial, fault in reversed(rows):
        new: list[int | None] = []
        stays = CUT_OFF if fault == "truncated" else 0
        for state in range(4):
            ways = [w.before("D", DELETE, path[state])] if path[state] is not None else []
            if fault in ("", "truncated"):
                kept = AFTER.get(initial, {}).get(state)
                if kept is not None and path[kept] is not None:
                    ways.append(w.before("K", stays, path[kept]))
                after = WANTED[state][0]
                if path[after] is not None:
                    ways.append(w.before("R", REROLE + stays, path[after]))
            new.append(min(ways) if ways else None)
        path = _with_inserts(new, w)
    return path


def stretch_table(rows: list[tuple[str, str]], first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state behind, cost, letters) of a stretch; a conversation's end has no state behind."""
    w = Weights(3 * len(rows) + 2)
    before = (START,) if first else range(4)
    ends = [({s: 0 for s in ENDS}, -1)] if last else [({s: 0}, s) for s in range(4)]
    out = []
    for end, name in ends:
        path = cheapest(rows, end, w)
        out += [(s, name, w.cost(path[s]), w.letters(path[s])) for s in before if path[s] is not None]
    return out


def put_together(tables: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, str]]:
    """(state before, letters) of each stretch of a conversation on its cheapest path."""
    best: dict[int, tuple[int, str]] = {-1: (0, "")}
    steps: list[dict[int, tuple[int, str]]] = []
    for table in reversed(tables):
        now: dict[int, tuple[int, str]] = {}
        step: dict[int, tuple[int, str]] = {}
        for state, behind, cost, letters in table:
            if behind in best:
                x = (cost + best[behind][0], letters + best[behind][1])
                if state not in now or x < now[state]:
                    now[state], step[state] = x, (behind, letters)
        best = now
        steps.append(step)
    out, state = [], START
    for step in reversed(steps):
        behind, letters = step[state]
        out.append((state, letters))
        state = behind
    return out


# -- rows ------------------------------------------------------------------------
def _shown(column: str, missing: str = " ") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(missing))


def _key(column: Column) -> Column:
    """A key that null has too."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def damaged(said: DataFrame) -> DataFrame:
    """The rows as the damage leaves them: dropped, emptied, without full stops, repeated, given to the user."""
    hit = F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")) % 20
    role, text = _shown("role"), _shown("text")
    rows = said.select("conv_id", "turn", role.alias("role"), text.alias("text"), hit.alias("_hit")).where("_hit <> 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    twice = F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(twice).alias("copy"))


def placed(rows: DataFrame) -> DataFrame:
    """``_conv, _at``, the row and its ``fault``: rows of a conversation by turn, null first, then role and text.

    Places come from counts per (conversation, turn range), so no task numbers
    the rows of a long conversation.
    """
    known = F.col("turn").isNotNull()
    turn = F.struct(known.alias("known"), F.coalesce("turn", F.lit(0)).cast("decimal(38,0)").alias("n"))
    rows = rows.withColumns({"_conv": _key(F.col("conv_id")), "_turn": turn})
    spread = F.when(F.col("_turn.known"), F.floor(F.col("_turn.n") / STRETCH)).otherwise(F.lit(-(1 << 62)).cast("decimal(38,0)"))
    before = value_counts(rows, ["_conv"], "_turn", spread).select("_conv", "_turn", "_before")
    inside = F.row_number().over(W.partitionBy("_conv", "_turn").orderBy("role", "text", "copy"))
    rows = rows.withColumn("_inside", inside).join(before, ["_conv", "_turn"])
    rows = rows.withColumns({"_at": F.col("_before") + F.col("_inside") - 1, "_said": F.md5(F.col("text").cast("binary"))})
    rows = written(rows.select("_conv", "_at", "turn", "role", "text", "_said"), "placed")
    same = ["_conv", "role", "_said"]
    first = rows.groupBy(*same).agg(F.min("_at").alias("_first"))
    spoken = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(spoken == "", "blank").when(F.col("_at") > F.col("_first"), "duplicate")
        .when(~F.substring(spoken, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    )
    return rows.join(first, same).select(
        "_conv", F.floor(F.col("_at") / STRETCH).alias("_stretch"), "_at", "turn", "role", "text", fault.alias("fault")
    )


# -- tasks -----------------------------------------------------------------------
def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal keys."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


_TABLE = "_conv string, _stretch long, _states array<struct<before:int,behind:int,cost:long,letters:string>>"


def _search(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (conv, stretch), rows in _grouped(batches, ("_conv", "_stretch")):
        last = rows[0]["_last"] == stretch
        table = stretch_table([(r["role"][:1], r["fault"]) for r in rows], stretch == 0, last)
        states = [dict(zip(("before", "behind", "cost", "letters"), x, strict=True)) for x in table]
        yield pa.RecordBatch.from_pylist([{"_conv": conv, "_stretch": stretch, "_states": states}], schema=types)


_PIECE = "_conv string, _stretch long, _before int, _letters string"


def _put(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (conv,), rows in _grouped(batches, ("_conv",)):
        tables = [[(s["before"], s["behind"], s["cost"], s["letters"]) for s in r["_states"]] for r in rows]
        pieces = put_together(tables)
        out = [{"_conv": conv, "_stretch": r["_stretch"], "_before": s, "_letters": x} for r, (s, x) in zip(rows, pieces, strict=True)]
        yield pa.RecordBatch.from_pylist(out, schema=types)


class Repair:
    """What is known of one conversation while its rows go by."""

    def __init__(self):
        self.turns: list = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.distinct, self.last_turn, self.initial = 0, None, None
        self.audit: list[str] = []
        self.digest, self.said = hashlib.sha256(), 0
        self.stretch, self.letters, self.state = -1, iter(()), START

    def _say(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.said else "") + f"{role}:{text}").encode())
        self.said += 1

    def _insert_until_row(self) -> str | None:
        for letter in self.letters:
            self.audit.append(letter)
            if letter != "I":
                return letter
            self.state, role = WANTED[self.state]
            self.counts["cost"] += INSERT
            self._say(role, "")
        return None

    def row(self, r: dict) -> None:
        if r["_stretch"] != self.stretch:
            self._insert_until_row()
            self.stretch, self.letters, self.state = r["_stretch"], iter(r["_letters"]), r["_before"]
        if (turn := r["turn"]) is not None:
            self.turns = [min([*self.turns[:1], turn]), max([*self.turns[1:], turn])]
            self.distinct += turn != self.last_turn
            self.last_turn = turn
        initial = r["role"][:1]
        if self.initial is not None:
            self.counts["illegal"] += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if r["fault"]:
            self.counts[r["fault"]] += 1
        letter = self._insert_until_row()
        if letter == "D":
            self.counts["cost"] += DELETE
            return
        role = r["role"]
        if letter == "R":
            self.state, role = WANTED[self.state]
            self.counts["cost"] += REROLE
        else:
            self.state = AFTER[initial][self.state]
        self.counts["cost"] += CUT_OFF * (r["fault"] == "truncated")
        self._say(role, r["text"])

    def result(self) -> dict:
        self._insert_until_row()
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return {"gaps": gaps, **self.counts, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


_RESULT = (
    "_conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def _mend(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come in order; a conversation is never held whole."""
    conv, state = None, None
    for batch in batches:
        out = []
        for at in range(0, batch.num_rows, 512):
            for row in batch.slice(at, 512).to_pylist():
                if row["_conv"] != conv:
                    if state:
                        out.append({"_conv": conv} | state.result())
                    conv, state = row["_conv"], Repair()
                state.row(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)
    if state:
        yield pa.RecordBatch.from_pylist([{"_conv": conv} | state.result()], schema=types)


def _mapped(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    types = arrow_types(schema)
    return rows.mapInArrow(lambda batches: work(batches, types), schema)


def repair(rows: DataFrame) -> DataFrame:
    """``_conv`` and the figures of each conversation that has rows; ``rows`` as from ``placed``."""
    if INSERT <= 2 * DELETE:
        raise ValueError("an insertion must cost more than two deletions")
    rows = written(rows, "faults")
    ends = rows.groupBy("_conv").agg(F.max("_stretch").alias("_last"))
    slim = rows.select("_conv", "_stretch", "_at", "role", "fault").join(ends, "_conv")
    slim = slim.repartition("_conv", "_stretch").sortWithinPartitions("_conv", "_stretch", "_at")
    tables = _mapped(slim.select("_conv", "_stretch", "_last", "role", "fault"), _search, _TABLE)
    tables = tables.repartition("_conv").sortWithinPartitions("_conv", "_stretch")
    pieces = written(_mapped(tables, _put, _PIECE), "pieces")
    edited = rows.join(pieces, ["_conv", "_stretch"]).select(
        "_conv", "_stretch", "_at", "turn", "role", "text", "fault", "_before", "_letters"
    )
    return _mapped(edited.repartition("_conv").sortWithinPartitions("_conv", "_at"), _mend, _RESULT)


def repair_damaged(said: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    A null role or text is one blank, and so is a null id or turn where the
    damage is drawn; a null id is a conversation of its own. Rows of one turn
    stand in the order of role and text, so repeated rows follow each other. A
    conversation without rows after the damage has zeros, no audit and the hash
    of nothing; an empty table gives an empty one; other columns are not read.
    """
    said = said.select("conv_id", "turn", "role", "text")
    all_ = said.select("conv_id").distinct().withColumn("_conv", _key(F.col("conv_id")))
    found = repair(placed(damaged(said)))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return all_.join(found, "_conv", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
