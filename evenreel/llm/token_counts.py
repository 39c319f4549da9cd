"""Token counts by a compiled counting transducer (operator 10).

The byte-level tokenizer never joins a character that is not white space with
white space after it, nor does it look across such a place. There the machine
is in its start state, whatever came before. The text between two such places
is one input symbol of a deterministic transducer over a single state, and its
transition is annotated with the number of tokens it emits. Transitions are
compiled from the tokenizer the first time a task meets their symbol.

A long text is read in chunks that end anywhere. A chunk's state map is (open
head, tokens of whole symbols, open tail); maps compose associatively, so they
can be combined as a prefix scan in any grouping, with results that do not
depend on where the chunks were cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import DataFrame

from evenreel.llm.common import map_rows

#: Characters of a chunk.
CHUNK = 1 << 16
#: Compiled transitions a task keeps; beyond that it starts afresh.
TRANSITIONS = 600_000
#: Symbols longer than this are counted but not kept.
LONG = 64

# Fixed value: the pieces of the byte-level tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# white space in any reading of the term: a superset, so every cut is safe
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​-‏﻿])(?=[ \n])")
_ODD = re.compile(r"[\s\x1c-\x1f\x85᠎​-‏﻿][ \n]|^[ \n]")


@dataclass(frozen=True)
class StateMap:
    """What a chunk does: text open to the left, tokens inside, text open to the right.

    ``tail`` is None for a chunk without any cut; all its text is then in ``head``.
    """

    head: str
    tokens: int = 0
    tail: str | None = None


class Emissions(dict):
    """Transition table: symbol -> tokens emitted; compiles what it lacks."""

    def __init__(self, encode: Callable[[str], int]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, symbol: str) -> int:
        n = self.encode(symbol)
        if len(symbol) <= LONG:
            if len(self) >= TRANSITIONS:
                self.clear()
            self[symbol] = n
        return n


class Transducer:
    """Counts tokens; ``encode`` gives the tokens of one symbol."""

    def __init__(self, encode: Callable[[str], int]) -> None:
        self.emits = Emissions(encode)

    def count(self, symbols: list[str]) -> int:
        """Sum of the emissions along a path of symbols."""
        return sum(map(self.emits.__getitem__, symbols))

    def state_map(self, chunk: str) -> StateMap:
        symbols = split(chunk)
        if len(symbols) == 1:
            return StateMap(chunk)
        return StateMap(symbols[0], self.count(symbols[1:-1]), symbols[-1])

    def compose(self, left: StateMap, right: StateMap) -> StateMap:
        """Left, then right. The symbol open between them closes if both have cuts."""
        if left.tail is None and right.tail is None:
            # a cut may fall exactly between the two chunks
            return self.state_map(left.head + right.head)
        if left.tail is None:
            inner = self.state_map(left.head + right.head)
            if inner.tail is None:
                return StateMap(inner.head, right.tokens, right.tail)
            return StateMap(inner.head, inner.tokens + self.count([inner.tail]) + right.tokens, right.tail)
        inner = self.state_map(left.tail + right.head)
        if right.tail is None:
            if inner.tail is None:
                return StateMap(left.head, left.tokens, inner.head)
            return StateMap(left.head, left.tokens + self.count([inner.head]) + inner.tokens, inner.tail)
        closed = [inner.head] if inner.tail is None else [inner.head, inner.tail]
        return StateMap(left.head, left.tokens + self.count(closed) + inner.tokens + right.tokens, right.tail)

    def finish(self, whole: StateMap) -> int:
        return whole.tokens + self.count([s for s in (whole.head, whole.tail) if s])

    def tokens(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.count(split(text))
        maps = [self.state_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        return self.finish(reduce(self.compose, maps))


def split(text: str) -> list[str]:
    """Cut before every blank or line feed that follows other than white space."""
    if _ODD.search(text):
        return _CUT.split(text)
    # the same cuts: each blank or line feed stands alone after a visible character
    if "\n" not in text:
        first, *rest = text.split(" ")
        return [first, *(" " + s for s in rest)]
    out = []
    for i, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        out.append("\n" + first if i else first)
        out.extend([" " + s for s in rest])
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabulary files.

    Visible Latin-1 characters stand for themselves; the other bytes, in order,
    for the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_level_counts(path: str) -> Callable[[str], int]:
    """Token counts by a byte-level vocabulary file; one per process.

    The merges run in tiktoken, which is several times faster than the library
    that the file is for and gives the same counts (the tests compare them).
    Strings of special tokens count as one token each, as that library has it.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(letters.__getitem__, w)): i for w, i in spec["model"]["vocab"].items() if w not in special}
    encoding = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
    find = re.compile("|".join(map(re.escape, special))).search if special else lambda _: None

    plain, every = encoding.encode_ordinary, set(special)

    def encode(symbol: str) -> int:
        return len(encoding.encode(symbol, allowed_special=every) if find(symbol) else plain(symbol))

    return encode


def token_counts(
    docs: DataFrame, vocabulary: str, *, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``).

    One map over the rows, nothing is shuffled. ``vocabulary`` names a public
    byte-level tokenizer file that every worker can open. A null text counts as
    empty (0 tokens); null or repeated ids and equal rows are kept as they are;
    other columns are not read; an empty table gives an empty one.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        machine = Transducer(byte_level_counts(vocabulary))

        def work(rows):
            out = []
            for row in rows:
                body = row["text"] or ""
                n = machine.tokens(body)
                out.append({
                    "doc_id": row["doc_id"], "n_bytes": len(body.encode()), "n_tokens": n, "over_limit": n > limit,
                })
            return out

        return work

    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    return map_rows(rows, start, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
